"""Field-by-field differences between two copies of one dataset, by presence bitmaps over shared key ordinals.

Keys are hashed to blocks. In a block the keys of both copies share one dictionary, and a key's place in it is its ordinal.
Each copy, on its own, marks the ordinals that it holds in a compressed bitmap. AND-NOT of the bitmaps gives the rows missing
on either side, AND the ordinals at which both copies' rows are fetched and compared column by column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweir.session import block_count

#: Bytes of input (as stored) that a block gets on average: its rows are held by one task.
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Bitmap:
    """A set of ordinals as the sorted places at which membership changes, from out to in and back; so long runs cost two
    numbers. AND and AND-NOT work on the changes, never on single bits."""

    changes: np.ndarray

    @staticmethod
    def of(ordinals: np.ndarray) -> Bitmap:
        own = np.unique(ordinals.astype(np.int64))
        first = np.r_[True, own[1:] != own[:-1] + 1] if len(own) else np.zeros(0, bool)
        starts = own[first]
        ends = own[np.r_[first[1:], True]] + 1 if len(own) else own
        return Bitmap(np.stack([starts, ends], axis=1).ravel())

    def _combined(self, other: Bitmap, both: bool) -> Bitmap:
        """The places where this holds and the other does (``both``) or doesn't."""
        at = np.r_[self.changes, other.changes]
        order = np.argsort(at, kind="stable")
        step = np.r_[np.where(np.arange(len(self.changes)) % 2, -1, 1), np.where(np.arange(len(other.changes)) % 2, -1, 1)][order]
        mine = np.r_[np.ones(len(self.changes), bool), np.zeros(len(other.changes), bool)][order]
        inside = (np.cumsum(np.where(mine, step, 0)) > 0) & ((np.cumsum(np.where(mine, 0, step)) > 0) == both)
        at = at[order]
        last = np.r_[at[1:] != at[:-1], True] if len(at) else np.zeros(0, bool)  # what holds after all changes of a place
        at, inside = at[last], inside[last]
        return Bitmap(at[np.r_[inside[:1], inside[1:] != inside[:-1]]] if len(at) else at)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._combined(other, True)

    def __sub__(self, other: Bitmap) -> Bitmap:
        return self._combined(other, False)

    def __len__(self) -> int:
        return int((self.changes[1::2] - self.changes[::2]).sum())

    def ordinals(self) -> np.ndarray:
        sizes = self.changes[1::2] - self.changes[::2]
        return np.repeat(self.changes[::2] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def _changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each value of a sorted column is the last of its kind."""
    n = len(column)
    unlike = pc.fill_null(pc.not_equal(column.slice(0, max(n - 1, 0)), column.slice(1)), False)
    return np.r_[np.asarray(unlike.to_numpy(zero_copy_only=False) if isinstance(unlike, pa.Array) else unlike.to_numpy(), bool), np.ones(min(n, 1), bool)]


def _newest(rows: pa.Table, names: list[str]) -> pa.Table:
    """The current row of each key, in key order: the one that is greatest in ``names``, nulls least."""
    at = pc.sort_indices(rows, sort_keys=[("key", "ascending"), *((n, "ascending") for n in names)], null_placement="at_start")
    placed = rows.take(at)
    return placed.filter(pa.array(_changes(placed.column("key").combine_chunks())))


@dataclass(frozen=True)
class Block:
    """One block of keys: its dictionary, and of each copy its bitmap and its rows by ordinal."""

    keys: pa.Array
    bitmaps: tuple[Bitmap, Bitmap]
    rows: tuple[pa.Table, pa.Table]
    places: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(table: pa.Table, names: list[str]) -> Block:
        sides = [_newest(table.filter(pc.equal(table.column("side"), side)), names) for side in (0, 1)]
        shared = pa.concat_arrays([s.column("key").combine_chunks() if s.num_rows else pa.array([], table.schema.field("key").type) for s in sides]).dictionary_encode()
        codes = shared.indices.to_numpy(zero_copy_only=False)
        ordinals = codes[: sides[0].num_rows], codes[sides[0].num_rows :]
        places = []
        for own in ordinals:
            place = np.full(len(shared.dictionary), -1, np.int64)
            place[own] = np.arange(len(own))
            places.append(place)
        return Block(shared.dictionary, tuple(Bitmap.of(o) for o in ordinals), tuple(sides), tuple(places))  # type: ignore[arg-type]

    def fetch(self, side: int, ordinals: np.ndarray, column: str) -> pa.Array | pa.ChunkedArray:
        return self.rows[side].column(column).take(pa.array(self.places[side][ordinals], pa.int64()))


def _blocks(primary: DataFrame, mirror: DataFrame, key: str, fields: list[str], order: list[str]) -> tuple[DataFrame, list[str]]:
    """(block, side, key, o0.., f0..) of both copies, and the names by which the current row is chosen.

    Each Arrow batch keeps one row of a key before the shuffle, so a key with a third of all rows is a few rows in it. The
    number of blocks follows the size of the input."""
    names = [f"o{i}" for i in range(len(order))] + [f"f{i}" for i in range(len(fields))]

    def side(df: DataFrame, number: int) -> DataFrame:
        own = df.where(F.col(f"`{key}`").isNotNull()).select(F.lit(number).alias("side"), F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").alias(n) for c, n in zip([*order, *fields], names)))

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _newest(pa.Table.from_batches([batch]), names).to_batches()

        return own.mapInArrow(reduce, own.schema)

    n = block_count(primary, BLOCK_BYTES) + block_count(mirror, BLOCK_BYTES)
    both = side(primary, 0).unionByName(side(mirror, 1))
    return both.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n))), names


def compare_copies(primary: DataFrame, mirror: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Rows (``key``, ``difference``): missing_in_mirror, missing_in_primary or the name of a field whose values differ.

    The current row of a key is the one with the highest ``order``, among equal ones the one with the highest fields, so
    repeats and ties don't matter; null is lowest. Rows without a key are left out: they can't be told apart. Values are
    compared as stored: null equals null only, NaN equals NaN. Keys and fields are of types that can be sorted. Empty tables
    and tables with other columns are fine. One shuffle, by block of keys.
    """
    blocks, names = _blocks(primary, mirror, key, fields, order)
    kind = blocks.schema["key"].dataType

    def compare(table: pa.Table) -> pa.Table:
        own = Block.of(table, names)
        ours, theirs = own.bitmaps
        found = [((ours - theirs).ordinals(), "missing_in_mirror"), ((theirs - ours).ordinals(), "missing_in_primary")]
        both = (ours & theirs).ordinals()
        for i, name in enumerate(fields):
            a, b = (own.fetch(side, both, f"f{i}") for side in (0, 1))
            unlike = pc.fill_null(pc.not_equal(a, b), False)
            if pa.types.is_floating(a.type):
                unlike = pc.and_not(unlike, pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False)))
            unlike = pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b)))
            found.append((both[np.asarray(unlike, bool)], name))
        at = pa.array(np.concatenate([o for o, _ in found]), type=pa.int64())
        return pa.Table.from_arrays([own.keys.take(at), pa.array([n for o, n in found for _ in range(len(o))], type=pa.string())], ["key", "difference"])

    return blocks.groupBy("block").applyInArrow(compare, f"key {kind.simpleString()}, difference string").withColumnRenamed("key", key)


def presence_blocks(primary: DataFrame, mirror: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The presence bitmaps: one row per block with its keys in the order of their ordinals, each copy's bitmap as the places
    where membership changes, and how many keys each copy holds."""
    blocks, names = _blocks(primary, mirror, key, [], order)
    kind = blocks.schema["key"].dataType.simpleString()
    counts = ["in_primary", "in_mirror", "in_both", "only_primary", "only_mirror"]

    def present(table: pa.Table) -> pa.Table:
        own = Block.of(table, names)
        p, m = own.bitmaps
        values = [pa.array([table.column("block")[0].as_py()], pa.int64()), pa.array([own.keys.to_pylist()], pa.list_(own.keys.type)), *(pa.array([b.changes.tolist()], pa.list_(pa.int64())) for b in (p, m)), *(pa.array([len(b)], pa.int64()) for b in (p, m, p & m, p - m, m - p))]
        return pa.Table.from_arrays(values, ["block", "keys", "primary_bits", "mirror_bits", *counts])

    return blocks.groupBy("block").applyInArrow(present, f"block bigint, keys array<{kind}>, primary_bits array<bigint>, mirror_bits array<bigint>, " + ", ".join(f"{c} bigint" for c in counts))
