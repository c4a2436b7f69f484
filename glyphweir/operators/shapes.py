"""Characters found by prefixes of their stroke codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphweir.functions.keys import fingerprint
from glyphweir.operators.lexicon import ranked

PREFIXES = 3


def character_pool(words: DataFrame) -> DataFrame:
    """(code, ch, frequency, rank): the characters of each two-key code, from words that have a syllable per character."""
    own = words.where((F.length("text") == F.size("codes")) & F.col("text").rlike(r"\A[㐀-䶿一-鿿]+\z"))
    parts = F.arrays_zip(F.filter(F.split("text", ""), lambda c: c != "").alias("ch"), F.col("codes").alias("code"))
    rows = own.select("frequency", F.inline(parts)).groupBy("code", "ch").agg(F.sum("frequency").alias("frequency"))
    return ranked(rows, ["code"], F.desc("frequency"), F.asc("ch"))


def filtered(pool: DataFrame, shapes: DataFrame, prefixes: int = PREFIXES) -> DataFrame:
    """(code, ch, rank, length, new_rank): places of characters among those whose strokes begin as theirs do.

    A stroke code shorter than the prefix is used whole. The prefix table is an equi-join; no pair of characters of a
    code is compared beyond those that agree."""
    strokes = pool.join(shapes, "ch").select("code", "ch", "rank", F.explode("strokes").alias("stroke"))
    lengths = F.sequence(F.lit(1), F.lit(prefixes))
    cuts = strokes.select("code", "ch", "rank", "stroke", F.explode(lengths).alias("length")).withColumn("prefix", F.left("stroke", F.col("length")))
    own = cuts.select("code", "length", "prefix", "ch", "rank").distinct()
    w = Window.partitionBy("code", "length", "prefix").orderBy("rank")
    return own.withColumn("new_rank", F.row_number().over(w)).groupBy("code", "ch", "rank", "length").agg(F.min("new_rank").alias("best_rank"), F.max("new_rank").alias("worst_rank"))


def tasks(targets: DataFrame, key: str, bucket: str) -> DataFrame:
    """Targets in an order that looks random and is always the same: by fingerprint in each bucket, buckets in turn."""
    marked = targets.withColumn("mark", fingerprint(F.col(key)))
    placed = ranked(marked, [bucket], F.asc("mark"), F.asc(key), name="turn")
    return placed.drop("mark")
