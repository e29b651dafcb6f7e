"""Words, seeded order and small Arrow helpers shared by the text operators.

A word is a maximal run of characters other than the space and the five ASCII controls from tab to carriage return;
`bytes.split()` cuts UTF-8 text at exactly these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words, JVM side; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def word_stretches(text: Column) -> Column:
    """The words, each with the blanks behind it and the first with those before it, JVM side: joined they are the text. Empty
    for null and for a text without a word."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[ \\t-\\r]*[^ \\t-\\r]+[ \\t-\\r]*"), F.lit(0))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to about `limit` bytes of `column`, a single longer value staying whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Places(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def least_kept(counted: DataFrame, n: str, most: int) -> int:
    """The least count such that at most `most` rows reach it. Counts from 100,000 on are told apart no further, which bounds
    what comes to the driver; a class of equal counts is kept or left as a whole."""
    held, least = 0, 1 << 62
    for row in counted.groupBy(F.least(n, F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).collect():
        held += row["rows"]
        if held > most:
            break
        least = row["n"]
    return least
