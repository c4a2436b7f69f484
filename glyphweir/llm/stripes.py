"""Items that occur together, by stripes: for each item an associative array of its neighbours.

Each task keeps, for its share of the records, the neighbours of every item with how often and in how many records they
stand together. Stripes are shuffled by item and their arrays merged by neighbour; counts, lift and the log-likelihood
ratio of every pair follow from the merged arrays and the items' own counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweir.session import cut

#: Pairs that a task gathers before it sends its stripes on.
LOCAL_PAIRS = 2_000_000
#: Blocks of stripes that are merged at once: so many for each shuffle partition, and one for so many items at least.
BLOCKS_PER_PARTITION, ITEMS_PER_BLOCK = 8, 2_000
#: An item in more than one of HEAVY_PART records has its stripe cut into SHARDS pieces by the neighbours' hash. There are
#: fewer such items than HEAVY_PART times the mean number of items of a record; beyond LISTED of them all stripes are cut.
HEAVY_PART, SHARDS, LISTED = 256, 64, 100_000
#: The likelihood ratio that chance reaches once in a hundred.
SIGNIFICANT = 6.63

STRIPE = "item string, shard int, neighbours array<string>, together array<bigint>, records array<bigint>"


class Gathered:
    """The pairs of a task's records by the ids of a task-wide dictionary, sent on as stripes whenever they get many."""

    def __init__(self, heavy: frozenset[str] | None):
        self.heavy, self.ids, self.terms, self.parts, self.n = heavy, {}, [], [], 0

    def encode(self, terms: list[str]) -> np.ndarray:
        ids = np.fromiter((self.ids.setdefault(t, len(self.ids)) for t in terms), np.int64, len(terms))
        self.terms += terms if not self.terms else [t for t, i in zip(terms, ids.tolist()) if i >= len(self.terms)]
        return ids

    def add(self, low: np.ndarray, high: np.ndarray, weight: np.ndarray | None = None) -> None:
        self.parts.append((low, high, np.ones(len(low), np.int64) if weight is None else weight))
        self.n += len(low)

    def full(self) -> bool:
        return self.n > LOCAL_PAIRS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from self._stripes(*(np.concatenate(c) for c in zip(*self.parts)))
        self.parts, self.n = [], 0

    def _stripes(self, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(self.terms)
        keys, inverse, records = np.unique(low * n + high, return_inverse=True, return_counts=True)
        together = np.zeros(len(keys), np.int64)
        np.add.at(together, inverse, weight)
        own, other = np.divmod(keys, n)
        shards = np.zeros(len(keys), np.int64)
        cutting = np.ones(len(keys), bool) if self.heavy is None else np.fromiter((t in self.heavy for t in self.terms), bool, n)[own]
        if cutting.any():
            at = np.flatnonzero(cutting)
            some, back = np.unique(other[at], return_inverse=True)
            shards[at] = np.fromiter((xxhash.xxh64_intdigest(self.terms[i]) % SHARDS for i in some.tolist()), np.int64, len(some))[back]
        order = np.lexsort((shards, own))
        own, other, shards = own[order], other[order], shards[order]
        items = np.asarray(self.terms, dtype=object)
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (shards[1:] != shards[:-1])])
        offsets = pa.array(np.r_[starts, len(keys)], pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, v) for v in (pa.array(items[other], pa.string()), pa.array(together[order]), pa.array(records[order])))
        batch = pa.RecordBatch.from_arrays([pa.array(items[own[starts]], pa.string()), pa.array(shards[starts], pa.int32()), *lists], names=["item", "shard", "neighbours", "together", "records"])
        for at in range(0, batch.num_rows, 10_000):
            yield batch.slice(at, 10_000)


def basket_stripes(batches: Iterator[pa.RecordBatch], heavy: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Stripes of records that are lists of different items; each pair counts once in a record, under its smaller item."""
    gathered = Gathered(heavy)
    for batch in batches:
        lists = batch.column("items")
        codes, items = pd.factorize(lists.flatten().to_pandas(), sort=True)  # Python strings sort by code point
        ids = gathered.encode(list(items))
        sizes, starts = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        for size in np.unique(sizes).tolist():  # records of one size at a time, as a matrix
            rows = starts[sizes == size]
            if size > 2_000:  # very long records, item by item
                for start in rows.tolist():
                    own = np.sort(codes[start : start + size])
                    for first in range(size - 1):
                        gathered.add(ids[np.full(size - first - 1, own[first])], ids[own[first + 1 :]])
                        if gathered.full():
                            yield from gathered.flush()
            elif size > 1:
                a, b = np.triu_indices(size, 1)
                for at in range(0, len(rows), step := max(1, LOCAL_PAIRS // len(a))):
                    own = ids[np.sort(codes[rows[at : at + step, None] + np.arange(size)], axis=1)]
                    gathered.add(own[:, a].ravel(), own[:, b].ravel())
                    if gathered.full():
                        yield from gathered.flush()
    yield from gathered.flush()


def pair_stripes(batches: Iterator[pa.RecordBatch], heavy: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Stripes of rows (low, high, n), each a pair of one record with its weight."""
    gathered = Gathered(heavy)
    for batch in batches:
        codes, items = pd.factorize(pd.concat([batch.column(c).to_pandas() for c in ("low", "high")], ignore_index=True))
        own = gathered.encode(list(items))[codes]
        gathered.add(own[: batch.num_rows], own[batch.num_rows :], batch.column("n").to_numpy())
        if gathered.full():
            yield from gathered.flush()
    yield from gathered.flush()


def merge_block(table: pa.Table) -> pa.Table:
    """Merges the arrays of a block's stripes by item and neighbour."""
    lists = [table.column(c).combine_chunks() for c in ("neighbours", "together", "records")]
    sizes = np.diff(lists[0].offsets.to_numpy())
    codes, items = pd.factorize(table.column("item").to_pandas())
    others, neighbours = pd.factorize(lists[0].flatten().to_pandas())
    keys, inverse = np.unique(np.repeat(codes, sizes) * max(len(neighbours), 1) + others, return_inverse=True)
    sums = []
    for column in lists[1:]:
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, column.flatten().to_numpy())
        sums.append(pa.array(total))
    own, other = np.divmod(keys, max(len(neighbours), 1))
    return pa.Table.from_arrays([pa.array(np.asarray(items, object)[own], pa.string()), pa.array(np.asarray(neighbours, object)[other], pa.string()), *sums], names=["low_item", "high_item", "together", "records"])


def merged(stripes: DataFrame, n_items: int) -> DataFrame:
    """(low_item, high_item, together, records) of all stripes, merged by block of items and shards."""
    blocks = max(BLOCKS_PER_PARTITION * int(stripes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_items // ITEMS_PER_BLOCK)
    own = stripes.withColumn("block", F.pmod(F.xxhash64("item", "shard"), F.lit(blocks))).select("block", "item", "neighbours", "together", "records")
    return own.groupBy("block").applyInArrow(merge_block, "low_item string, high_item string, together bigint, records bigint")


def _entropy_term(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def likelihood_ratio(k: Column, a: Column, b: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of the fourfold table in which k of n hold both, a the first and b the second item."""
    k, a, b, n = (x.cast("double") for x in (k, a, b, n))
    h = _entropy_term
    cells = h(k) + h(a - k) + h(b - k) + h(n - a - b + k)
    return F.greatest(F.lit(0.0), 2 * (cells - h(a) - h(n - a) - h(b) - h(n - b) + h(n)))


def associate(pairs: DataFrame, items: DataFrame, total: int, count: str) -> DataFrame:
    """Adds to pairs the items' own counts a and b, the total n, lift = k n / (a b), and the likelihood ratio.

    ``items`` is (item, n)."""
    named = items.select("item", F.col("n").alias("own"))
    k, n = F.col(count).cast("double"), F.lit(total).cast("bigint")
    return (
        pairs.join(named.withColumnsRenamed({"item": "low_item", "own": "a"}), "low_item")
        .join(named.withColumnsRenamed({"item": "high_item", "own": "b"}), "high_item")
        .withColumn("total", n)
        .withColumn("lift", k * F.col("total") / (F.col("a").cast("double") * F.col("b")))
        .withColumn("likelihood_ratio", likelihood_ratio(F.col(count), F.col("a"), F.col("b"), F.col("total")))
    )


def at_least(count: str, min_lift: float) -> Column:
    """Whether k n >= min_lift a b, exactly for whole numbers and without overflow of any of them.

    Doubles decide unless both sides agree to nine digits; then the products are made as decimals of 38 digits."""
    ratio = F.col("lift") / min_lift
    if min_lift != int(min_lift):
        return ratio >= 1
    k, n, a, b = (F.col(c).cast("decimal(19,0)") for c in (count, "total", "a", "b"))
    exact = F.try_subtract(F.try_multiply(k, n), F.try_multiply(F.try_multiply(a, b), F.lit(int(min_lift)).cast("decimal(9,0)"))) >= 0
    return F.when(ratio > 1 + 1e-9, True).when(ratio < 1 - 1e-9, False).otherwise(F.coalesce(exact, ratio >= 1))


def _listed(items: DataFrame, more_than: Column) -> frozenset[str] | None:
    """The items whose count is so great; None if they are too many for a list."""
    rows = items.where(more_than).select("item").limit(LISTED + 1).collect()
    return None if len(rows) > LISTED else frozenset(r.item for r in rows)


def _measured(pairs: DataFrame, items: DataFrame, total: int, count: str, min_lift: float | None, least_ratio: float) -> DataFrame:
    out = associate(pairs, items, total, count)
    if min_lift is not None:
        out = out.where(at_least(count, min_lift))
    return out.where(F.col("likelihood_ratio") >= least_ratio) if least_ratio > 0 else out


def basket_pairs(baskets: DataFrame, min_together: int = 1, min_lift: float | None = None, least_ratio: float = 0.0) -> DataFrame:
    """Pairs of different items of ``items`` (an array per row and record) with their counts and measures.

    Null and empty items and null or empty lists are no item and no pair; repeats inside a record count once; each row is
    a record. With ``min_lift`` an item in more than 1 / min_lift of all records can't be in any pair (k <= b gives
    lift <= n / a), so it leaves the lists before pairs are made; nothing else is left out. Stripes of items in more than
    one of HEAVY_PART records are cut, whatever the parameters. ``least_ratio`` is the least likelihood ratio.

    The lists and the items' counts are cut, as four passes read them."""
    own = cut(baskets.select(F.array_distinct(F.filter("items", lambda x: x.isNotNull() & (x != ""))).alias("items")))
    items = cut(own.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")))
    total, n_items = own.count(), items.count()
    heavy = _listed(items, F.col("n").cast("double") * HEAVY_PART > total)
    lists = own
    if min_lift is not None and (hot := _listed(items, F.col("n").cast("double") * min_lift > total * (1 + 1e-9))):
        lists = own.select(F.filter("items", lambda x: ~x.isin(*hot)).alias("items"))
    stripes = lists.where(F.size("items") > 1).mapInArrow(lambda batches: basket_stripes(batches, heavy), STRIPE)
    pairs = merged(stripes, n_items).where(F.col("records") >= min_together)
    return _measured(pairs, items, total, "records", min_lift, least_ratio)


def weighted_pairs(rows: DataFrame, min_records: int = 1, min_lift: float | None = None, least_ratio: float = 0.0) -> DataFrame:
    """Pairs of different items of rows (record, first, second, n), in either order, with their summed weights.

    An item's own count is the summed n of the rows that have it on either side, a row with it on both sides once; the
    total is the sum of all n. Rows with a null item count in the total only. A pair's records are distinct. Stripes of
    items with more than one of HEAVY_PART rows are cut, whatever the parameters."""
    valid = cut(rows.where(F.col("n").isNotNull()).select("record", "first", "second", "n"))
    sides = valid.select(F.explode(F.array_distinct(F.array("first", "second"))).alias("item"), "n").where("item is not null")
    counted = cut(sides.groupBy("item").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    totals = valid.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    heavy = _listed(counted, F.col("rows") * HEAVY_PART > totals["rows"])
    once = (
        valid.where("first <> second")
        .groupBy("record", F.least("first", "second").alias("low"), F.greatest("first", "second").alias("high"))
        .agg(F.sum("n").alias("n"))
    )
    stripes = once.select("low", "high", "n").mapInArrow(lambda batches: pair_stripes(batches, heavy), STRIPE)
    pairs = merged(stripes, counted.count()).where(F.col("records") >= min_records)
    return _measured(pairs, counted, int(totals["n"]), "together", min_lift, least_ratio)
