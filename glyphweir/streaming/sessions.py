"""Session events as streams: corrections, counts and hourly segments, whatever files the events come in.

The stream's files arrive in any order and a trigger may hold any of them, so a segment's events are held as keyed state, in
their own order, until the segment has been idle for so long as the caller says. What each trigger writes are changes: rows that now hold, with
sign 1, and rows that no longer do, with sign -1, since an event may come to stand between two others. ``settled`` adds
them up. Events that the segment has already, and those that come once its state is given up, leave with their reason.
"""

from __future__ import annotations

from collections import Counter, namedtuple
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphweir.functions.keys import typed_letters
from glyphweir.operators.events import GAP_BOUNDS
from glyphweir.session import remove, temporary_folder

#: That a segment was there is kept so many times as long as its events, to turn away what comes later.
CLOSED_TIMES = 24
_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


HELD = {"pos": _INT, "event_id": _LONG, "kind": _TEXT, "start": _INT, "deleted": _TEXT, "inserted": _TEXT, "reliable": T.BooleanType(), "elapsed_ms": _LONG}
STATE = _struct(**{name: T.ArrayType(kind) for name, kind in HELD.items()}, closed=T.BooleanType())
CORRECTION = _struct(event_id=_LONG, correction=_TEXT, removed=_TEXT, replacement=_TEXT, gap_ms=_LONG, reject=_TEXT, sign=_INT)
KIND = _struct(kind=_TEXT, bucket=_INT, n=_LONG)
Event = namedtuple("Event", list(HELD))


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """The capsule events of a folder as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/capsule_events*.parquet")


def flat(events: DataFrame) -> DataFrame:
    c = F.col("change")
    return events.where("event_id is not null").select(
        "event_id", "session_id", "segment_seq", "pos", "elapsed_ms", "kind", F.col("recorded_at").cast("timestamp").alias("recorded_at"), c["start"].alias("start"), F.coalesce(c["deleted"], F.lit("")).alias("deleted"), F.coalesce(c["inserted"], F.lit("")).alias("inserted"),
        F.coalesce(c["evidence"] != "Ambiguous", F.lit(False)).alias("reliable"), typed_letters(F.coalesce("keys", F.array().cast("array<string>"))).alias("code"),
    )


def _events(frame: pd.DataFrame) -> list[Event]:
    """The rows as plain values; a number that pandas made a float is a whole one or null."""
    columns = []
    for name, kind in HELD.items():
        values = frame[name].tolist()
        if kind in (_INT, _LONG):
            values = [None if v is None or v != v else int(v) for v in values]
        columns.append(values)
    return [Event(*values) for values in zip(*columns)]


def by_segment(events: DataFrame, change: Callable[[list[Event], list[Event], list[Event], list[tuple[Event, str]]], list[tuple]], schema: T.StructType, idle_ms: int | None = None) -> DataFrame:
    """What ``change(before, after, new, rejected)`` returns for each segment and trigger: its events in order before and
    after, those that are new, and those turned away with their reason, repeated or closed.

    A segment without new events for ``idle_ms`` of processing time gives its events up; for streams that go on. Without,
    as in a run over what is there, state stays until the run ends (timeouts of that kind would keep such a run going).
    Segments are bounded in events, so state and work of a key are; a session with a third of all events is many keys."""
    names = list(HELD)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = tuple([] for _ in names)
        if state.hasTimedOut:
            if state.get[-1]:
                state.remove()
            else:
                state.update((*empty, True))
                state.setTimeoutDuration(idle_ms * CLOSED_TIMES)
            return
        *columns, closed = state.get if state.exists else (*empty, False)
        came = [event for frame in batches for event in _events(frame)]
        before = [Event(*values) for values in zip(*columns)]
        if closed:
            found = change([], [], [], [(event, "closed") for event in came])
        else:
            known, new, rejected = {event.event_id for event in before}, [], []
            for event in came:
                if event.event_id in known:
                    rejected.append((event, "repeated"))
                else:
                    known.add(event.event_id)
                    new.append(event)
            after = sorted(before + new, key=lambda e: (e.pos is not None, e.pos or 0, e.event_id))
            found = change(before, after, new, rejected)
            state.update((*(list(values) for values in zip(*after)), False))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=schema.names)

    own = events.select("session_id", "segment_seq", *names)
    return own.groupBy("session_id", "segment_seq").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def corrections_of(events: list[Event], max_gap: int) -> Counter:
    """The corrections of a segment's events in order, as operators.events.corrections has them, and the events that are
    earlier than the one before them, with the reason clock."""
    found: Counter = Counter()
    for last, row in pairwise(events):
        if row.elapsed_ms is None or last.elapsed_ms is None:
            continue
        gap = row.elapsed_ms - last.elapsed_ms
        if gap < 0:
            found[row.event_id, None, None, None, None, "clock"] += 1
        if not 0 <= gap <= max_gap or None in (row.start, last.start) or not (row.reliable and last.reliable):
            continue
        inside = row.start >= last.start and row.start + len(row.deleted) <= last.start + len(last.inserted)
        if row.kind == "Revision" and row.deleted and row.inserted and last.kind == "Commit" and inside:
            found[row.event_id, "replaced", row.deleted, row.inserted, gap, None] += 1
        elif row.kind == "Commit" and last.kind == "Revision" and last.deleted and not last.inserted and row.start == last.start:
            found[row.event_id, "deleted_then_inserted", last.deleted, row.inserted, gap, None] += 1
    return found


def corrections(events: DataFrame, max_gap: int, idle_ms: int | None = None) -> DataFrame:
    """Changes of the corrections found, and rejected events with ``reject`` set."""

    def change(before: list[Event], after: list[Event], new: list[Event], rejected: list[tuple[Event, str]]) -> list[tuple]:
        was, now = corrections_of(before, max_gap), corrections_of(after, max_gap)
        rows = [(*row, 1) for row in (now - was).elements()] + [(*row, -1) for row in (was - now).elements()]
        return rows + [(event.event_id, None, None, None, None, reason, 1) for event, reason in rejected]

    return by_segment(events, change, CORRECTION, idle_ms)


def settled(changes: DataFrame) -> DataFrame:
    """The rows that hold after all changes; repeats of a rejected event are rows of their own."""
    rows = [c for c in changes.columns if c != "sign"]
    return changes.groupBy(*rows).agg(F.sum("sign").alias("n")).where("n > 0").select(*rows, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("__n")).drop("__n")


def kinds(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Counts of new events by kind and gap bucket of the time since the segment began, in tens of ms, to be added up."""

    def change(before: list[Event], after: list[Event], new: list[Event], rejected: list[tuple[Event, str]]) -> list[tuple]:
        found = Counter((event.kind, sum((event.elapsed_ms or 0) // 10 >= bound for bound in GAP_BOUNDS)) for event in new)
        return [(*key, n) for key, n in found.items()]

    return by_segment(events, change, KIND, idle_ms)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote; its state goes at once, its rows with the program."""
    spark = stream.sparkSession
    home = temporary_folder(spark, "stream")
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).format("parquet").option("path", f"{home}/out").start().awaitTermination()
    remove(spark, f"{home}/state")
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def write_segments(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = None):
    """The writer of a stream's events as Parquet, partitioned by the hour they came in; a file closes with its trigger,
    every ``seconds`` or, without, once all that is there is written."""
    hourly = stream.withColumn("hour", F.date_format("recorded_at", "yyyy-MM-dd-HH"))
    when = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return hourly.writeStream.partitionBy("hour").option("checkpointLocation", checkpoint).trigger(**when).format("parquet").option("path", path)
