"""Tokens of texts, a batch at a time in Python: one pass by byte tables and sets, where built-in expressions take a pattern for each step and an interpreted lambda for each word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import TYPE_CHECKING

from .stopwords import LANGUAGES, stopwords

if TYPE_CHECKING:
    import pyarrow as pa

#: text.SPACE as characters.
SPACES = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Letters of Latin-1 that are not among those of words; any of them stands for all letters beyond Latin-1, whose words are dropped alike.
OTHER = "\xaa\xb5\xba"
#: Words that are gathered before they are packed into an array.
PACKED = 1 << 20

_LATIN_1 = [chr(i) for i in range(256)]
_BLANKED = bytes(32 if c in SPACES else ord(c) for c in _LATIN_1)
_DELETED = bytes(ord(c) for c in _LATIN_1 if not c.isalpha() and c not in SPACES)
_BEYOND = re.compile("[^\x00-\xff]")


class _Near(dict):
    """What stands for a character beyond Latin-1."""

    def __missing__(self, c: str) -> str:
        self[c] = found = " " if c in SPACES else OTHER[0] if c.isalpha() else ""
        return found


_NEAR = _Near()


@cache
def _languages() -> tuple[frozenset[str], list[tuple[str, frozenset[str]]], re.Pattern, dict[str, frozenset[str]]]:
    from .text import TRIGGERS

    own = [(lang, frozenset(listed.split())) for lang, listed in TRIGGERS.items()]
    every = frozenset().union(*(w for _, w in own))
    pattern = re.compile(f"(?<![A-Za-z0-9_])(?:{'|'.join(sorted(every, key=len, reverse=True))})(?![A-Za-z0-9_])")
    return every, own, pattern, {lang: frozenset(stopwords(lang)) for lang in LANGUAGES}


def kept(words: list[str], ascii: bool) -> list[str]:
    """words (lower-case Latin ones) of 3 to 49 letters without the stop words of their language; ascii: none has other letters."""
    every, own, pattern, stop = _languages()
    found = {w for w in every.intersection(words) if len(w) >= 3}
    if not ascii:
        odd = " ".join([w for w in words if not w.isascii() and 2 < len(w) < 50])
        found.update(pattern.findall(odd))
    drop = stop[next((lang for lang, listed in own if not found.isdisjoint(listed)), "en") if found else "en"]
    return [w for w in words if 2 < len(w) < 50 and w not in drop]


def tokens(text: str) -> list[str]:
    lower = text.lower()
    if not (ascii := lower.isascii()):
        lower = _BEYOND.sub(lambda m: _NEAR[m[0]], lower)
    plain = lower.encode("latin-1").translate(_BLANKED, _DELETED).decode("latin-1")
    words = plain.split(" ")
    if not ascii and any(c in plain for c in OTHER):
        words = [w for w in words if not any(c in w for c in OTHER)]
    return kept(words, ascii or plain.isascii())


def lists(each: Iterator[list[str]]) -> pa.ListArray:
    """An array of lists of strings, packed by and by, so that few words are Python objects at a time."""
    import pyarrow as pa

    done, flat, first = [], [], [0]

    def pack() -> None:
        done.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.string())))
        flat.clear()
        first[:] = [0]

    for words in each:
        flat += words
        first.append(len(flat))
        if len(flat) >= PACKED:
            pack()
    if len(first) > 1 or not done:
        pack()
    return pa.concat_arrays(done)


# the next two have no annotations: Spark would take them for those of another kind of function


def tokens_of(texts):
    import pyarrow as pa

    return lists(tokens((t.as_py() or b"").decode("utf-8", "replace")) for t in texts.cast(pa.binary()))


def kept_of(arrays):
    """kept of arrays of tokens; a null is empty."""
    import numpy as np

    ends = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    flat = arrays.flatten().to_numpy(zero_copy_only=False).tolist()

    def one(own: list[str]) -> list[str]:
        return kept(own, all(map(str.isascii, own)))

    return lists(one(flat[a:z]) for a, z in zip([0, *ends[:-1]], ends))
