"""Token expressions."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column | str, unicode_words: bool = False) -> Column:
    """Lower-case words split at non-word characters.

    The default word class is ASCII, so an accented letter ends a word; with
    `unicode_words` accented letters belong to words.
    """
    c = F.col(text) if isinstance(text, str) else text
    pattern = r"(?U)\W+" if unicode_words else r"\W+"
    return F.array_remove(F.split(F.lower(c), pattern), "")


def stop_words(language: str = "english") -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language)


def is_content_word(token: Column | str, words: list[str]) -> Column:
    c = F.col(token) if isinstance(token, str) else token
    return ~c.isin(words)
