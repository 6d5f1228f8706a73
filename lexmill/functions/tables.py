"""Table functions for SQL: texts cut into windows of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What a window adds to its row.
WINDOW = StructType([StructField("ordinal", LongType()), StructField("n_words", LongType()), StructField("content", StringType())])


def windows(text: str | None, size: int) -> Iterator[tuple[int, int, str]]:
    """ordinal, number of words and words of every window of ``size`` words; none for null or blank."""
    words = _WORD.findall(text or "")
    for ordinal, at in enumerate(range(0, len(words), size)):
        own = words[at : at + size]
        yield ordinal, len(own), " ".join(own)


class TextWindows:
    """text_windows(text, size) -> ordinal, n_words, content, for lateral joins, which take no function of Arrow batches."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, int, str]]:
        yield from windows(text, size)


@dataclass
class _Named(AnalyzeResult):
    text: str = "text"
    kept: tuple[str, ...] = ()


class WordWindows:
    """word_windows(TABLE(...), size, text => 'text') -> the table's other columns and a row for each window of its text column.

    The result's columns hang on the table that it is called with; a table without the text column, or a window of no words, is an error before anything runs.
    """

    def __init__(self, result: AnalyzeResult):
        self._text, self._kept = result.text, result.kept

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, text: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = text.value if text else "text"
        if name not in rows.dataType.names:
            raise ValueError(f"the table has no column {name}")
        if not size.isConstantExpression or not size.value or size.value < 1:
            raise ValueError("size must be a positive number")
        kept = [f for f in rows.dataType.fields if f.name != name]
        return _Named(schema=StructType(kept + WINDOW.fields), text=name, kept=tuple(f.name for f in kept))

    def eval(self, row, size: int, text: str | None = None) -> Iterator[tuple]:  # noqa: ANN001
        own = tuple(row[c] for c in self._kept)
        for window in windows(row[self._text], size):
            yield (*own, *window)


def register(spark: SparkSession) -> None:
    """Makes ``word_windows`` and ``text_windows`` known to the session's SQL."""
    spark.udtf.register("word_windows", udtf(WordWindows, useArrow=True))
    spark.udtf.register("text_windows", udtf(TextWindows, returnType=WINDOW, useArrow=False))
