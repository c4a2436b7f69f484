"""Filters of texts: which rows can't find a partner in a join, known before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two: the fewest and the most bits of a filter, which is handed to all tasks: 1 MB at most.
FEWEST, MOST = 16, 23
#: Bits by which a text is marked: by so many parts of its hash.
MARKS = 2


def _places(text: Column, bits: int) -> list[Column]:
    hashed = F.xxhash64(text)
    return [F.shiftright(hashed, 32 * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(MARKS)]


def _bit(place: Column) -> Column:
    return place.bitwiseAND(F.lit(63)).cast("int")


def filter_of(texts: DataFrame, source: DataFrame) -> tuple[Column, int]:
    """A filter of the one column of ``texts``: bits by hash for each, in whole numbers of 64 bits, as a scalar.

    Its size follows that of ``source``, from which the texts are unfolded, as the optimizer estimates it; texts beyond what
    it has room for let more rows pass, but never fewer."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(max(size.bit_length() + 3, FEWEST), MOST)
    places = texts.select(F.explode(F.array(*_places(F.col(texts.columns[0]), bits))).alias("place"))
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("place")))
    cells = places.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(own).alias("own"))
    every = cells.unionByName(texts.sparkSession.range(1 << bits - 6).select(F.col("id").alias("cell"), F.lit(0).cast("bigint").alias("own")))
    whole = every.groupBy("cell").agg(F.bit_or("own").alias("own"))
    return whole.agg(F.sort_array(F.collect_list(F.struct("cell", "own")))["own"].alias("filter")).scalar(), bits


def passes(sieve: tuple[Column, int], text: Column) -> Column:
    """Whether the filter may have the text; true for each that it was made of."""
    own, bits = sieve
    found = F.lit(True)
    for place in _places(text, bits):
        cell = F.get(own, F.shiftright(place, 6).cast("int"))
        found = found & (F.call_function("shiftrightunsigned", cell, _bit(place)).bitwiseAND(F.lit(1)) == 1)
    return found
