"""Stop-word lists by language code.

There is none for Japanese, and none is needed: only words of Latin letters become tokens. Unknown codes get English.
"""

from __future__ import annotations

from functools import cache

from .stopword_lists import LISTS

LANGUAGES = (*LISTS, "ja")


@cache
def stopwords(lang: str) -> tuple[str, ...]:
    """Lower-case words of a language, sorted."""
    return () if lang == "ja" else tuple(sorted(LISTS.get(lang, LISTS["en"]).split()))
