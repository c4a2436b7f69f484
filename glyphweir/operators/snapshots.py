"""Memory kept as immutable batches and a checkpoint: load, refresh and replay of what a checkpoint doesn't cover.

A batch is a content-addressed set of selections: its name is the digest of what it holds, so writing one twice changes
nothing. Batches are folded in the order (created, process, sequence, name). A checkpoint holds the state after the batches it
covers, their names, and the place of the last. States, names and batches are tables; only one row of bounds comes to the
driver, to choose the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ("created", "process", "sequence", "name")
#: A checkpoint is due once so many batches aren't covered.
CHECKPOINT_EVERY = 64


@dataclass(frozen=True)
class Memory:
    """A state (code, text, n, last), the names of the batches in it, the place of the last of them, and how it was made."""

    state: DataFrame
    names: DataFrame
    last: tuple | None
    way: str


def place() -> Column:
    return F.struct(*PLACE)


def name_batches(selections: DataFrame, *batch: str) -> DataFrame:
    """Adds ``name``: the digest of a batch's selections (created, process, sequence, number, code, text) in their order."""
    row = F.concat_ws("\t", "created", "process", "sequence", "number", F.hex("code"), F.hex("text"))
    names = selections.groupBy(*batch).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("name"))
    return selections.join(names, list(batch))


def save(batches: DataFrame, path: str) -> None:
    """Appends batches to a folder by name; those it has already are not written again."""
    spark = batches.sparkSession
    try:
        known = spark.read.parquet(path).select("name").distinct()
    except Exception:  # noqa: BLE001 (no batch has been written yet)
        known = None
    new = batches if known is None else batches.join(known, "name", "left_anti")
    new.write.mode("append").partitionBy("name").parquet(path)


def fold(selections: DataFrame) -> DataFrame:
    """(code, text, n, last) of selections: how often and when last each was chosen."""
    return selections.groupBy("code", "text").agg(F.count("*").alias("n"), F.max(F.struct(*PLACE, "number")).alias("last"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One state from two."""
    return a.unionByName(b).groupBy("code", "text").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _names(selections: DataFrame) -> DataFrame:
    return selections.select(*PLACE).distinct()


def _bound(names: DataFrame, which) -> tuple | None:
    row = names.agg(which(place()).alias("p")).first()
    return None if row is None or row["p"] is None else tuple(row["p"])


def full(selections: DataFrame, way: str = "full") -> Memory:
    names = _names(selections)
    return Memory(fold(selections), names.select("name"), _bound(names, F.max), way)


def checkpoint(memory: Memory, path: str) -> None:
    """Writes a memory's state and names."""
    memory.state.write.mode("overwrite").parquet(f"{path}/state")
    memory.names.write.mode("overwrite").parquet(f"{path}/names")


def due(selections: DataFrame, covered: DataFrame) -> bool:
    """Whether so many batches aren't covered that a checkpoint should be written."""
    return _names(selections).join(covered, "name", "left_anti").limit(CHECKPOINT_EVERY).count() >= CHECKPOINT_EVERY


def is_subset(names: DataFrame, of: DataFrame) -> bool:
    return names.join(of, "name", "left_anti").isEmpty()


def load(selections: DataFrame, checkpoints: list[Memory]) -> Memory:
    """The memory of all batches from the checkpoint that covers most of those there are, and the tail of the others; from
    all batches, if no checkpoint covers only what is there or the tail begins before the checkpoint's end."""
    names = _names(selections)
    sized = sorted(((memory.names.count(), i) for i, memory in enumerate(checkpoints)), reverse=True)
    for _, i in sized:
        own = checkpoints[i]
        if not is_subset(own.names, names):
            continue
        tail = selections.join(own.names, "name", "left_anti")
        first = _bound(_names(tail), F.min)
        if first is not None and own.last is not None and first <= own.last:
            break
        return Memory(merged(own.state, fold(tail)), names.select("name"), _bound(names, F.max), "checkpoint")
    return full(selections)


def refresh(selections: DataFrame, before: Memory, checkpoints: list[Memory]) -> Memory:
    """The memory brought up to the batches there are now: unchanged, the tail added, or loaded anew."""
    names = _names(selections)
    lost, new = not is_subset(before.names, names), names.join(before.names, "name", "left_anti")
    first = _bound(new, F.min)
    if not lost and first is None:
        return Memory(before.state, before.names, before.last, "same")
    if lost or (before.last is not None and first <= before.last):
        return load(selections, checkpoints)
    tail = selections.join(before.names, "name", "left_anti")
    return Memory(merged(before.state, fold(tail)), names.select("name"), _bound(names, F.max), "tail")


def recent(state: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries chosen last; the others are evicted."""
    return state.orderBy(F.desc("last"), F.asc("code"), F.asc("text")).limit(most)


def preferred(state: DataFrame) -> DataFrame:
    """The text of each code: chosen most often (four times are enough), then last."""
    w = Window.partitionBy("code").orderBy(F.desc(F.least("n", F.lit(4))), F.desc("last"), F.desc("n"), F.asc("text"))
    return state.withColumn("k", F.row_number().over(w)).where("k = 1").select("code", "text", "n")
