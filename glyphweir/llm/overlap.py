"""Records of one split that also stand, exactly or almost, in another, by content-defined chunks.

Both sides' strings are cut where a rolling hash has a local minimum, for windows of several sizes, so that the cuts follow
the content whatever stands before it. Chunks' digests are joined across splits, and the lengths of the chunks that two
records share, as a fraction of a record, are its overlap; the pairs' strings are compared at last.

Edits spread evenly may touch every such chunk of a short record. An exact way finds what is left, in the same join: a stored
record that may differ by k edits at most is cut into k + 1 more chunks, near the even cuts where the rolling hash says, and
query records are read through the same rolling hash at every place. k edits can't touch all k + 1 chunks, so every pair
within the bound shares one, at places that k edits can explain.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweir.session import cut, shuffle_width

#: Greatest distance of two strings as a share of the longer one.
SHARE = Fraction(15, 100)
#: Sizes of the rolling hash's windows, each also the least distance of two cuts on either side, and the least size of a
#: content-defined chunk of a longer record.
WINDOWS, LEAST_CHUNK = (2, 3, 5), 4
#: A cut of the exact way may leave its even place by so many characters.
SLACK = 1
_BASE = 0x9E3779B97F4A7C15 | 1  # an odd base has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = 0xBF58476D1CE4E5B9

# Characters without width, besides all format characters.
_NO_WIDTH = r"[\p{Cf}\x{200B}-\x{200F}\x{FE00}-\x{FE0F}]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def sentence_string(tokens: Column) -> Column:
    """All forms joined in order without punctuation; wide ASCII made plain, no-width characters dropped, lower case."""
    spoken = F.filter(tokens, lambda t: t["upos"].isNull() | (t["upos"] != "PUNCT"))
    joined = F.array_join(F.transform(spoken, lambda t: F.coalesce(t["form"], F.lit(""))), "")
    return F.lower(F.regexp_replace(F.translate(joined, _WIDE, _PLAIN), _NO_WIDTH, ""))


def most_edits(length: int, share: Fraction = SHARE) -> int:
    """Greatest distance between a string of this length and any other that is near it: d <= share * (length + d)."""
    return int(share / (1 - share) * length)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Digests of all substrings of a batch of strings, from one cumulated polynomial."""

    def __init__(self, strings: list[str]):
        text = "".join(strings)
        self.codes = codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.starts = np.r_[0, np.cumsum([len(s) for s in strings])].astype(np.int64)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(0x51ED27)) * _powers(len(codes), _BASE), dtype=np.uint64)]
            self.shift = _powers(len(codes) + 1, _INVERSE)

    def parities(self) -> np.ndarray:
        """64 bits for each string: the parity of how often characters of each of 64 classes stand in it."""
        marks = np.r_[np.uint64(1) << ((self.codes * np.uint64(_MIX)) >> np.uint64(58)), np.zeros(1, np.uint64)]
        return np.bitwise_xor.reduceat(marks, self.starts[:-1]).view(np.int64) if len(self.starts) > 1 else np.zeros(0, np.int64)

    def digests(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.sums[at + lengths] - self.sums[at]) * self.shift[at]
            value = (value ^ (value >> np.uint64(31)) ^ lengths.astype(np.uint64)) * np.uint64(_MIX)
            return (value ^ (value >> np.uint64(29))).view(np.int64)


def even_cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def chunk_lengths(length: int, share: Fraction = SHARE) -> range:
    """The lengths that chunks of the exact way of a stored string of this length can have."""
    parts = min(most_edits(length, share) + 1, length)
    slack = SLACK if length // parts > 2 * SLACK + 1 else 0
    return range(max(1, length // parts - 2 * slack), -(-length // parts) + 2 * slack + 1)


def content_chunks(rolling: Rolling, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, size) of the chunks of all strings: a cut is before each place where the hash of the next ``window``
    characters is less than at ``window`` places on either side."""
    starts, n = rolling.starts, int(rolling.starts[-1])
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(n) - starts[owner]
    whole = inside + window <= lengths[owner]
    hashes = np.full(n, np.iinfo(np.int64).max)
    at = np.flatnonzero(whole)
    hashes[at] = rolling.digests(at, np.full(len(at), window))
    cut = whole & (inside > 0)
    for step in range(1, window + 1):
        before, after = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        before[step:], after[:-step] = hashes[:-step], hashes[step:]
        cut &= (np.where(inside >= step, before, np.iinfo(np.int64).max) > hashes) & (np.where(inside + step < lengths[owner], after, np.iinfo(np.int64).max) > hashes)
    begins = np.flatnonzero(cut | (inside == 0))
    rows = owner[begins]
    sizes = np.diff(np.r_[begins, n])
    kept = (sizes >= LEAST_CHUNK) | (sizes == lengths[rows])
    return rows[kept], inside[begins[kept]], sizes[kept]


def _salted(digests: np.ndarray, scale: int) -> np.ndarray:
    """Digests of one scale, which meet none of another."""
    with np.errstate(over="ignore"):
        return (digests.view(np.uint64) * np.uint64(2 * scale + 1) + np.uint64(scale)).view(np.int64)


def _by_content(batch: pa.RecordBatch, rolling: Rolling, side: str) -> Iterator[pa.RecordBatch]:
    """The content-defined chunks of a batch, with their window as scale."""
    keys, parities, lengths = batch.column("key").to_numpy(), rolling.parities(), np.diff(rolling.starts)
    for scale in WINDOWS:
        rows, at, size = content_chunks(rolling, scale)
        digests = _salted(rolling.digests(rolling.starts[rows] + at, size), scale)
        yield from _sliced([pa.array(c) for c in (digests, keys[rows], at.astype(np.int32), size.astype(np.int32), lengths[rows].astype(np.int32), parities[rows], np.full(len(rows), scale, np.int32))], CHUNK[side])


CHUNK = {side: ["digest", side, *(p + c for c in ("place", "size", "length", "parity", "scale"))] for side, p in (("stored", ""), ("query", "query_"))}
CHUNK_TYPES = ("bigint", "bigint", "int", "int", "int", "bigint", "int")


def stored_chunks(batches: Iterator[pa.RecordBatch], share: Fraction = SHARE) -> Iterator[pa.RecordBatch]:
    """(digest, stored, place, size, length, parity, scale) of the chunks of non-empty strings (key, string); scale 0: those
    of the exact way."""
    for batch in batches:
        strings = batch.column("string").to_pylist()
        rolling = Rolling(strings)
        yield from _by_content(batch, rolling, "stored")
        n = rolling.starts[-1]
        # The rolling hash at a place: of the two characters around it.
        window = np.zeros(n + 1, np.int64)
        if n > 1:
            window[1:n] = rolling.digests(np.arange(n - 1), np.full(n - 1, 2))
        places, sizes, owner = [], [], []
        for row, (begin, string) in enumerate(zip(rolling.starts.tolist(), strings)):
            length = len(string)
            parts = min(most_edits(length, share) + 1, length)
            cuts = even_cuts(length, parts)
            if SLACK and length // parts > 2 * SLACK + 1:
                for i in range(1, parts):
                    low = cuts[i] - SLACK
                    cuts[i] = low + int(np.argmin(window[begin + low : begin + cuts[i] + SLACK + 1]))
            places += cuts[:-1]
            sizes += [b - a for a, b in zip(cuts, cuts[1:])]
            owner += [row] * parts
        at, size, rows = np.asarray(places, np.int64), np.asarray(sizes, np.int64), np.asarray(owner, np.int64)
        length = np.diff(rolling.starts)[rows]
        columns = [rolling.digests(rolling.starts[rows] + at, size), batch.column("key").to_numpy()[rows], at.astype(np.int32), size.astype(np.int32), length.astype(np.int32), rolling.parities()[rows], np.zeros(len(rows), np.int32)]
        yield from _sliced([pa.array(c) for c in columns], CHUNK["stored"])


def query_chunks(batches: Iterator[pa.RecordBatch], share: Fraction = SHARE) -> Iterator[pa.RecordBatch]:
    """The same of the query's strings; of the exact way all substrings that may be a stored chunk."""
    for batch in batches:
        strings = batch.column("string").to_pylist()
        rolling = Rolling(strings)
        yield from _by_content(batch, rolling, "query")
        lengths = np.diff(rolling.starts)
        keys, parities = batch.column("key").to_numpy(), rolling.parities()
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            low, high = int(-(-length * (1 - share) // 1)), int(length / (1 - share))
            for size in sorted({s for stored in range(max(low, 1), high + 1) for s in chunk_lengths(stored, share) if s <= length}):
                places = np.arange(length - size + 1)
                step = max(1, 1_000_000 // len(places))
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    at = (rolling.starts[some][:, None] + places[None, :]).ravel()
                    columns = [rolling.digests(at, np.full(len(at), size)), np.repeat(keys[some], len(places)), np.tile(places, len(some)).astype(np.int32), np.full(len(at), size, np.int32), np.full(len(at), length, np.int32), np.repeat(parities[some], len(places)), np.zeros(len(at), np.int32)]
                    yield from _sliced([pa.array(c) for c in columns], CHUNK["query"])


def _sliced(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, 50_000):
        yield whole.slice(at, 50_000)


def distinct_strings(records: DataFrame) -> DataFrame:
    """One row (key, string) for each distinct string: copies are compared once."""
    return records.select("string").where(F.col("string") != "").distinct().withColumn("key", F.xxhash64("string"))


def shared_chunks(stored: DataFrame, query: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """(stored, query, fraction, by_content): the greatest share of the stored string, over the windows, that stands in chunks
    which both strings have, and whether content-defined chunks are among them or only the exact way finds the pair.

    Chunks count at places which few edits explain. An edit changes at most two of the 64 parities of a string, so pairs with
    more unlike parities than twice the most edits are left out as they are joined; that and the places lose no near pair. A
    digest that many strings have is split by adaptive execution's handling of skewed joins; the filters apply as it streams."""
    width = shuffle_width(stored.sparkSession)
    schema = lambda side: ", ".join(f"{n} {t}" for n, t in zip(CHUNK[side], CHUNK_TYPES))
    s = stored.repartition(width).mapInArrow(lambda batches: stored_chunks(batches, share), schema("stored"))
    q = query.repartition(width).mapInArrow(lambda batches: query_chunks(batches, share), schema("query")).drop("query_size", "query_scale")
    shift, change = F.col("query_place") - F.col("place"), F.col("query_length") - F.col("length")
    edits = F.abs(shift) + F.abs(change - shift)
    most = F.floor(F.greatest("length", "query_length") * share.numerator / share.denominator)
    near = (edits <= most) & (F.bit_count(F.col("parity").bitwiseXOR(F.col("query_parity"))) <= 2 * most)
    # Of one scale each place of the stored string counts once, however often the query string has its chunk.
    met = s.join(q, "digest").where(near).groupBy("stored", "query", "scale", "place").agg(F.max("size").alias("size"), F.max("length").alias("length"))
    shared = met.groupBy("stored", "query", "scale").agg(F.sum("size").alias("shared"), F.max("length").alias("length"))
    return shared.groupBy("stored", "query").agg(F.max(F.col("shared") / F.col("length")).alias("fraction"), (F.max("scale") > 0).alias("by_content"))


def near_strings(stored: DataFrame, query: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """(string_a, string_b, distance, fraction, by_content) of all pairs of distinct strings at most ``share`` apart.

    ``fraction`` is the share of string_a, the stored one, that stands in chunks which string_b has too."""
    a, b = distinct_strings(stored), distinct_strings(query)
    pairs = shared_chunks(a, b, share)
    named = pairs.join(a.withColumnsRenamed({"key": "stored", "string": "string_a"}), "stored").join(b.withColumnsRenamed({"key": "query", "string": "string_b"}), "query")
    most = F.floor(F.greatest(F.length("string_a"), F.length("string_b")) * share.numerator / share.denominator).cast("int")
    # With its bound the distance is worked out in a band around the diagonal only; beyond it, it is -1.
    return named.withColumn("most", most).withColumn("distance", F.expr("levenshtein(string_a, string_b, most)")).where("distance >= 0").select("string_a", "string_b", "distance", "fraction", "by_content")


def cross_split(records: DataFrame, against: str = "train") -> DataFrame:
    """Pairs of a record of split ``against`` and one of another split whose strings are at most SHARE apart.

    ``records`` has id, split, source and string; repeated rows count once; records without a string, id or split have no
    pairs. Columns: train_id, train_source, other_id, other_split, other_source, distance, fraction, by_content. Copies of a string
    are compared once and only the pairs in the result are spelt out. The strings are cut, as four passes read them.
    """
    own = cut(records.select("id", "split", "source", "string").where("id is not null and split is not null and string <> ''").distinct())
    stored, query = own.where(F.col("split") == against), own.where(F.col("split") != against)
    near = near_strings(stored, query)
    train = stored.select(F.col("id").alias("train_id"), F.col("source").alias("train_source"), F.col("string").alias("string_a"))
    other = query.select(F.col("id").alias("other_id"), F.col("split").alias("other_split"), F.col("source").alias("other_source"), F.col("string").alias("string_b"))
    return near.join(train, "string_a").join(other, "string_b").drop("string_a", "string_b")
