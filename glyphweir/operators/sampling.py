"""Deterministic choices of rows: evenly spread, every n-th, first of a kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(rows: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """Adds the 0-based place of each row in the order given, without one task that sorts them all.

    Rows are range-partitioned and sorted; each part's first place is the number of rows in the parts before it (one count
    per part, on the driver). The cut keeps the parts as they are between the two passes.
    """
    from glyphweir.session import cut, shuffle_width

    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(before, before + batch.num_rows), pa.int64())], names=[*batch.schema.names, "__own"])
            before += batch.num_rows

    parts = cut(ordered.mapInArrow(count, T.StructType([*ordered.schema.fields, T.StructField("__own", T.LongType())])))
    counts = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    offset = rows.sparkSession.createDataFrame(starts, "__part int, __before bigint")  # one row a part
    return parts.join(F.broadcast(offset), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def spread(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """At most ``limit`` rows at even distances in the order given: the places (i n + n / 2) / selected, rounded down."""
    placed = numbered(rows, *order)
    n = rows.count()
    selected = min(limit, n)
    wanted = [(i * n + n // 2) // selected for i in range(selected)]
    chosen = rows.sparkSession.createDataFrame([(w, k) for k, w in enumerate(wanted)], "i bigint, sample bigint")
    return placed.join(F.broadcast(chosen), "i")


def every(rows: DataFrame, n: int, which: int, *order: str) -> DataFrame:
    """Adds ``held_out``: true for each n-th row."""
    return numbered(rows, *order).withColumn("held_out", F.col("i") % n == which)


def greedy_first_unseen(candidates: DataFrame, group: str, place: str, text: str) -> DataFrame:
    """For each group, in order, its first candidate (by ``place``) whose text no group before has taken.

    That order of choosing is the one stable assignment in which every text prefers the earlier group, so it is found in
    rounds: each group asks for its first candidate left, each text keeps the earliest group that asks, the others lose
    that candidate. A round is two aggregations, reduced in every task before they are shuffled, and each takes at least one
    candidate away, so rounds end when none loses. Each round's tables are cut once, the losers' before the check.
    """
    from glyphweir.session import cut

    left = cut(candidates.select(group, place, text).where(F.col(text).isNotNull() & F.col(group).isNotNull()).distinct())
    while True:
        asked = cut(left.groupBy(group).agg(F.min(F.struct(place, text)).alias("v")).select(group, f"v.{place}", f"v.{text}"))
        kept = asked.groupBy(text).agg(F.min(group).alias(group))
        lost = cut(asked.join(kept, [group, text], "left_anti"))
        if lost.isEmpty():
            return asked
        left = cut(left.join(lost.select(group, place), [group, place], "left_anti"))


def order_statistics(counted: DataFrame, key: str, value: str, times: str) -> DataFrame:
    """(key, n, least, median, p95, most) of values with how often they occur: the values at the 0-based places n / 2,
    rounded down, and ceil(0.95 n) - 1 of all in order. Only distinct values are put in order, never all rows."""
    w = Window.partitionBy(key)
    upto = F.sum(times).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.select(key, value, times, upto.alias("__upto"), F.sum(times).over(w).alias("__n"))
    middle, high = F.floor(F.col("__n") / 2) + 1, F.ceil(F.col("__n") * 95 / 100)
    return placed.groupBy(key).agg(F.max("__n").alias("n"), F.min(value).alias("least"), F.min(F.when(F.col("__upto") >= middle, F.col(value))).alias("median"), F.min(F.when(F.col("__upto") >= high, F.col(value))).alias("p95"), F.max(value).alias("most"))
