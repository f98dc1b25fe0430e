"""Stop words: lists of 18 languages, and sets made from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stopword_lists import LISTS

ALIASES = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "russian": "ru", "swedish": "sv",
    "norwegian": "no", "danish": "da", "finnish": "fi", "hungarian": "hu", "turkish": "tr", "polish": "pl", "arabic": "ar", "chinese": "zh", "japanese": "ja",
}


def language_code(language: str | None) -> str:
    """The list's key; English for a language that is unknown."""
    name = (language or "").lower()
    code = ALIASES.get(name, name)
    return code if code in LISTS else "en"


def get_stopwords(language: str = "en") -> list[str]:
    return sorted(LISTS[language_code(language)].split())


class StopWords:
    """A set of stop words; membership is by lower case unless case_sensitive."""

    def __init__(self, language: str = "en", words: Iterable[str] | None = None, case_sensitive: bool = False):
        self.case_sensitive = case_sensitive
        self.words = {self._key(w) for w in (get_stopwords(language) if words is None else words)}

    def _key(self, word: str) -> str:
        return word if self.case_sensitive else word.lower()

    @classmethod
    def from_list(cls, words: Iterable[str], case_sensitive: bool = False) -> StopWords:
        return cls(words=words, case_sensitive=case_sensitive)

    @classmethod
    def empty(cls) -> StopWords:
        return cls(words=())

    @classmethod
    def with_additional(cls, language: str, words: Iterable[str]) -> StopWords:
        return cls(language).add(words)

    def add(self, words: Iterable[str]) -> StopWords:
        self.words |= {self._key(w) for w in words}
        return self

    def remove(self, words: Iterable[str]) -> StopWords:
        self.words -= {self._key(w) for w in words}
        return self

    def __contains__(self, word: str) -> bool:
        return self._key(word) in self.words

    def __len__(self) -> int:
        return len(self.words)


def stopword_table(spark: SparkSession, extra: Iterable[str] = ()) -> DataFrame:
    """(stop_lang, stop_word): every list, and the extra words for each language. Its size is fixed: a few thousand rows."""
    rows = [(lang, w) for lang, words in LISTS.items() for w in {*words.split(), *(x.lower() for x in extra)}]
    return spark.createDataFrame(rows, "stop_lang string, stop_word string")


def language_of(lang: Column) -> Column:
    """language_code() of a column."""
    name = F.lower(lang)
    names = F.create_map(*(F.lit(x) for k, v in ALIASES.items() for x in (k, v)))
    code = F.coalesce(F.element_at(names, name), name)
    return F.when(code.isin(*LISTS), code).otherwise(F.lit("en"))
