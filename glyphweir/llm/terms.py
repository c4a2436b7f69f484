"""Occurrences and records of every distinct term, by a global integer dictionary and count arrays.

Each task first reduces its records to one row for each of its own terms. The distinct terms of all tasks make the global
dictionary: whole numbers from 0 on in the order of the terms. The tasks' terms are encoded by it, and from there on only
identifiers move: they are shuffled by range, and each range adds them up in a pair of arrays, of occurrences and of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweir.operators.sampling import numbered
from glyphweir.session import cut, shuffle_width

#: A local dictionary with this many terms is sent on and begun anew: the memory of a task is bounded.
LOCAL_TERMS = 400_000
#: Identifiers of one pair of arrays.
RANGE = 1 << 16


def count_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, term, occurrences, records) of a task's own counts; a row of its input is one record of a field, with
    its terms and how often each occurs (``times``; null: once for each time it stands in the list)."""
    local: dict[tuple[str, str], int] = {}
    occurrences, records = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def flush() -> pa.RecordBatch:
        n = len(local)
        columns = [pa.array([f for f, _ in local], pa.string()), pa.array([t for _, t in local], pa.string()), pa.array(occurrences[:n]), pa.array(records[:n])]
        return pa.RecordBatch.from_arrays(columns, names=["field", "term", "occurrences", "records"])

    for batch in batches:
        lists, times = batch.column("terms"), batch.column("times")
        sizes = np.diff(lists.offsets.to_numpy())
        fields, names = pd.factorize(batch.column("field").to_pandas())
        codes, terms = pd.factorize(lists.flatten().to_pandas())
        record = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.ones(len(codes), np.int64)
        weighed = np.asarray(times.is_valid().to_numpy(zero_copy_only=False), bool)[record]
        weight[weighed] = times.drop_null().flatten().to_numpy(zero_copy_only=False)
        valid = codes >= 0
        valid[valid] = np.asarray([t != "" for t in terms], bool)[codes[valid]]
        codes, record, weight = codes[valid], record[valid], weight[valid]
        keys, inverse = np.unique(fields[record].astype(np.int64) * max(len(terms), 1) + codes, return_inverse=True)
        if not len(keys):
            continue
        own_n, own_r = np.zeros(len(keys), np.int64), np.bincount(np.unique(record * len(keys) + inverse) % len(keys), minlength=len(keys))
        np.add.at(own_n, inverse, weight)
        pairs = ((names[k // len(terms)], terms[k % len(terms)]) for k in keys.tolist())
        ids = np.fromiter((local.setdefault(p, len(local)) for p in pairs), np.int64, len(keys))
        if len(local) > len(occurrences):
            more = 2 * len(local)
            occurrences, records = (np.concatenate([x, np.zeros(more - len(x), np.int64)]) for x in (occurrences, records))
        occurrences[ids] += own_n
        records[ids] += own_r
        if len(local) >= LOCAL_TERMS:
            yield flush()
            local.clear()
            occurrences[:], records[:] = 0, 0
    if local:
        yield flush()


def sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term_id, occurrences, records) of encoded rows in the order of their ranges: one pair of arrays at a time."""
    at, arrays, seen = None, None, None

    def flush() -> pa.RecordBatch:
        own = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(own + at * RANGE), *(pa.array(x[own]) for x in arrays)], names=["term_id", "occurrences", "records"])

    for batch in batches:
        blocks, places = np.divmod(batch.column("term_id").to_numpy(), RANGE)
        for block in np.unique(blocks).tolist():
            if block != at:
                if at is not None:
                    yield flush()
                at, arrays, seen = block, tuple(np.zeros(RANGE, np.int64) for _ in range(2)), np.zeros(RANGE, bool)
            own = blocks == block
            seen[places[own]] = True
            for array, name in zip(arrays, ("occurrences", "records")):
                np.add.at(array, places[own], batch.column(name).to_numpy()[own])
    if at is not None:
        yield flush()


def record_counts(records: DataFrame) -> DataFrame:
    """(term_id, field, term, occurrences, records) of records (field, terms, times), each a list of terms, with how often
    each occurs or null. A record may be spread over rows that share no term.

    Null and empty terms are left out; an empty input has no rows. A term in a third of all records is one row of each task
    before anything is shuffled, and one place of an array after: no hot key. Arrays have RANGE places whatever the number of
    terms, and are summed as their rows stream in."""
    width = shuffle_width(records.sparkSession)
    local = cut(records.select("field", "terms", "times").mapInArrow(count_locally, "field string, term string, occurrences bigint, records bigint"))
    dictionary = numbered(local.select("field", "term").distinct(), "field", "term", name="term_id")
    encoded = local.join(dictionary, ["field", "term"]).select("term_id", "occurrences", "records")
    ranges = encoded.repartition(width, F.floor(F.col("term_id") / RANGE)).sortWithinPartitions(F.floor(F.col("term_id") / RANGE))
    sums = ranges.mapInArrow(sum_ranges, "term_id bigint, occurrences bigint, records bigint")
    return sums.join(dictionary, "term_id").select("term_id", "field", "term", "occurrences", "records")


def term_counts(rows: DataFrame) -> DataFrame:
    """The same of rows (field, term, n), each the n occurrences of a term in one record."""
    return record_counts(rows.select("field", F.array("term").alias("terms"), F.array(F.col("n").cast("bigint")).alias("times")))


def mark_terms(counts: DataFrame, totals: DataFrame, rare_below: int = 3, common_from: int = 10, common_share: int = 10) -> DataFrame:
    """Adds ``mark``: too_rare below ``rare_below`` occurrences, too_common in at least ``common_from`` records that are
    more than one in ``common_share`` of the field's ``total`` records, else null. ``totals`` has one row per field, as
    many as the query names."""
    mark = F.when(F.col("occurrences") < rare_below, F.lit("too_rare")).when(
        (F.col("records") >= common_from) & (F.col("records") * common_share > F.col("total")), F.lit("too_common")
    )
    return counts.join(F.broadcast(totals), "field", "left").withColumn("mark", mark)
