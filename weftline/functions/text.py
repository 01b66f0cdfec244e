"""Text as columns: tokens, language, stop words, anchors. Built-in expressions, but for tokens, which each query needs of every text (words.py)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as by_batch
from .stopwords import LANGUAGES, stopwords

#: What counts as white space (no U+0085), spelled out as regular-expression dialects differ on \s.
SPACE = r"\t\n\f\r\x0B \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LETTER = "[a-zA-ZÀ-ÿ]"
LATIN = f"^{LETTER}+$"
#: Words that give a language away, in the order in which languages are tried.
TRIGGERS = {
    "fr": "avec dans est la le les pour sont",
    "de": "das der die für ist mit und von",
    "es": "con el la las los para por que",
    "it": "che con gli il la le lo per",
    "pt": "com mais para pela pelo que seu uma",
}
KANA = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
ALIASES = {
    "en": "eng english", "fr": "fra french", "de": "deu ger german", "es": "spa spanish", "it": "ita italian", "pt": "por portuguese", "ja": "jpn japanese",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(text: Column) -> Column:
    """Lower case, letters and single spaces only; other characters are deleted, not replaced."""
    letters = F.regexp_replace(F.lower(text), rf"[^\p{{L}}{SPACE}]", "")
    return F.trim(F.regexp_replace(letters, f"[{SPACE}]+", " "))


_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_ALL_TRIGGERS = sorted({w for words in TRIGGERS.values() for w in words.split()})


def _trie(words: tuple[str, ...]) -> str:
    """A pattern for any of words that shares their beginnings, so that a word is read once, not once for each alternative."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + (_trie(tuple(rest)) if rest != [""] else "") for c, rest in sorted(heads.items()) if c]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{body})?" if "" in heads else body


def detect_language(text: Column) -> Column:
    """The first language with a trigger word in text, else ja by script, else en. Word bounds are ASCII ones.

    One pass finds the trigger words of all languages; then languages are tried in order.
    """

    def first(lower: Column) -> Column:
        def of(triggers: Column) -> Column:
            found = F.when(F.size(triggers) == 0, F.when(lower.rlike(KANA), "ja").otherwise("en"))
            for lang, words in TRIGGERS.items():
                found = found.when(F.arrays_overlap(triggers, F.array(*[F.lit(w) for w in words.split()])), lang)
            return found

        return let(F.regexp_extract_all(lower, F.lit(f"{_BEFORE}{_trie(tuple(_ALL_TRIGGERS))}{_AFTER}"), F.lit(0)), of)

    return let(F.lower(text), first)


def language_code(name: Column) -> Column:
    """The code of a language named by a code or an alias; en for anything else, null included."""
    pairs = [(a, code) for code, names in ALIASES.items() for a in (code, *names.split())]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(table[F.lower(F.trim(name))], F.lit("en"))


def drop_stopwords(tokens: Column, least: int = 3, lang: Column | None = None) -> Column:
    """tokens without the stop words of lang (by default: detected from these tokens alone), repeats kept.

    Also drops what is shorter than least or not all Latin letters.
    """
    keep = lambda t: (F.length(F.trim(t)) >= least) & t.rlike(LATIN)

    def without(own: Column, words: tuple[str, ...]) -> Column:
        return F.filter(own, lambda t: keep(t) & ~F.lower(t).isin(*words)) if words else F.filter(own, keep)

    def by_language(own: Column, code: Column) -> Column:
        out = without(own, stopwords("en"))
        for other in LANGUAGES[1:]:
            out = F.when(code == other, without(own, stopwords(other))).otherwise(out)
        return out

    return let(tokens, lambda own: let(detect_language(F.array_join(own, " ")) if lang is None else lang, lambda code: by_language(own, code)))


def _language_of(words: Column) -> Column:
    """detect_language of words joined by spaces. A word of ASCII letters is a trigger or holds none; only the others need a pattern."""

    def first(odd: Column) -> Column:
        found = F.when(F.lit(False), "en")
        for lang, listed in TRIGGERS.items():
            own = listed.split()
            found = found.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in own])) | ((odd != "") & odd.rlike(f"{_BEFORE}({'|'.join(own)}){_AFTER}")), lang)
        return found.when((odd != "") & odd.rlike(KANA), "ja").otherwise("en")

    return let(F.array_join(F.filter(words, lambda w: F.octet_length(w) != F.length(w)), " "), first)


def _drop(words: Column, latin: bool = True) -> Column:
    """words (lower-case letters, 3 at least) without the stop words of their language; latin: all are Latin letters already."""

    def own(code: str, w: Column) -> Column:
        listed = stopwords(code)
        keep = lambda t: F.lit(True) if latin else t.rlike(LATIN)
        return F.filter(w, lambda t: keep(t) & ~t.isin(*listed)) if listed else F.filter(w, keep)

    def by_language(w: Column, lang: Column) -> Column:
        out = own("en", w)
        for other in LANGUAGES[1:]:
            out = F.when(lang == other, own(other, w)).otherwise(out)
        return out

    return let(words, lambda w: let(_language_of(w), lambda lang: by_language(w, lang)))


def words(text: Column) -> Column:
    """Words of 3 to 49 Latin letters in order."""
    return F.regexp_extract_all(normalise(text), F.lit(f"(?<![^ ]){LETTER}{{3,49}}(?![^ ])"), F.lit(0))


def tokens(text: Column) -> Column:
    """words without stop words; a null text has none. The same as drop_stopwords(words(text)), word for word."""
    return F.arrow_udf(by_batch.tokens_of, "array<string>")(text)


def drop_again(tokens: Column) -> Column:
    """drop_stopwords for arrays that tokens gave."""
    return F.arrow_udf(by_batch.kept_of, "array<string>")(tokens)


def document_text(title: Column, body: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def suggested_anchor(text: Column) -> Column:
    """The first three meaningful words of the target's text, the one or two there are, else its first 30 characters."""
    found = _drop(F.regexp_extract_all(normalise(text), F.lit("(?<![^ ])[^ ]{3,}(?![^ ])"), F.lit(0)), latin=False)
    return let(found, lambda f: F.when(F.size(f) == 0, F.substring(text, 1, 30)).otherwise(F.array_join(F.slice(f, 1, 3), " ")))


def document_issues(tokens: Column, least: int = 3) -> Column:
    """Issues of a token array, empty if it is valid."""
    blank = F.size(F.filter(tokens, lambda t: t.isNull() | (F.trim(t) == "")))
    few = F.when(tokens.isNull(), "not an array").when(F.size(tokens) == 0, "empty").when(F.size(tokens) < least, f"under {least} words")
    return F.filter(F.array(few, F.when(blank > 0, F.concat(blank.cast("string"), F.lit(" blank terms")))), lambda x: x.isNotNull())
