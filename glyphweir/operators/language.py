"""Word and character transitions of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweir.functions.scoring import conditional
from glyphweir.operators.lattice import Model

#: A model of more pairs isn't handed to tasks whole; a join of its table with the edges that meet takes its place.
PAIR_BOUND = 500_000
BEGIN, END = "^", "$"


def transitions(sequences: DataFrame, items: str = "items", *keys: str) -> DataFrame:
    """(prev, cur) of adjacent items of each array, with its ``keys``; no shuffle."""
    own, n = F.col(items), F.size(items)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(own, i - 1).alias("prev"), F.get(own, i).alias("cur")))
    return sequences.where(n > 1).select(*keys, F.inline(pairs))


def bigrams(sequences: DataFrame, items: str = "items") -> DataFrame:
    """(prev, cur, n, total): how often each pair stands together, and its first item before any other."""
    pairs = transitions(sequences, items).groupBy("prev", "cur").agg(F.count("*").alias("n"))
    return pairs.join(pairs.groupBy("prev").agg(F.sum("n").alias("total")), "prev")


def characters(text: Column) -> Column:
    """The characters of a text between a begin and an end mark."""
    return F.concat(F.array(F.lit(BEGIN)), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit(END)))


def model(sequences: DataFrame, size: int) -> Model | None:
    """A transition model for tasks; None beyond PAIR_BOUND pairs: then lattice.sentences joins the table itself."""
    found = sequences.where("prev is not null and cur is not null").select("prev", "cur", "n").limit(PAIR_BOUND + 1).toArrow()
    if found.num_rows > PAIR_BOUND:
        return None
    pairs: dict[tuple[str, str], int] = {}
    totals: dict[str, int] = {}
    names: dict[str, str] = {}  # each word once in the driver and in the tasks
    for batch in found.to_batches(max_chunksize=10_000):
        for prev, cur, n in zip(*(column.to_pylist() for column in batch.columns)):
            prev, cur = names.setdefault(prev, prev), names.setdefault(cur, cur)
            pairs[prev, cur] = n
            totals[prev] = totals.get(prev, 0) + n
    return Model(pairs, totals, size)


def score_sequences(sequences: DataFrame, key: str, items: str, pairs: DataFrame, vocabulary: Column | int) -> DataFrame:
    """(key, n_transitions, n_observed, score): the summed log-probability of each sequence's transitions.

    ``pairs`` is (prev, cur, n, total) as of bigrams. Joined by hash on the pair and on the first item: nothing is broadcast
    but by adaptive execution, which knows the sizes."""
    own, n = F.col(items), F.size(items)
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(own, i - 1).alias("prev"), F.get(own, i).alias("cur")))
    rows = sequences.where(n > 1).select(key, F.inline(steps)).groupBy(key, "prev", "cur").agg(F.count("*").alias("times"))
    totals = pairs.select("prev", "total").distinct()
    scored = rows.join(pairs.select("prev", "cur", "n"), ["prev", "cur"], "left").join(totals, "prev", "left")
    value = conditional(F.col("n"), F.col("total"), vocabulary)
    return scored.groupBy(key).agg(F.sum("times").alias("n_transitions"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("n_observed"), F.round(F.sum(value * F.col("times")), 6).alias("score"))
