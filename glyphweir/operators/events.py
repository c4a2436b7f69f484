"""Commits and revisions of typing sessions: corrections, continuous windows, labels and buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds in milliseconds of the buckets of gaps; a last bucket is open.
GAP_BOUNDS = (8, 16, 24, 32, 48, 64, 96, 160)


def delivered_once(events: DataFrame, *columns: str | Column) -> DataFrame:
    """One row per event with its ``event_id`` and the columns named, else with all but the time it was received.

    Deliveries of one event are alike, so this is a distinct of what is read: only those columns leave the scan, it combines
    in every task and needs no sort. Deliveries that differ in a column that is read stay apart."""
    own = columns or [c for c in events.columns if c not in ("recorded_at", "event_id", "document_change")]
    return events.where("event_id is not null").select("event_id", *own).distinct()


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("pos", "event_id")


SEGMENT = ("session_id", "segment_seq")


def gap_bucket(gap: Column) -> Column:
    """Number of bounds at or below a gap."""
    return sum((F.when(gap >= b, 1).otherwise(0) for b in GAP_BOUNDS), F.lit(0))


def corrections(events: DataFrame, max_gap: int) -> DataFrame:
    """Deletions that undo a commit and what replaced it, per segment in order.

    Kinds: replaced (a revision that deletes and inserts), deleted_then_inserted (a deletion, and next a commit at its
    place), each within ``max_gap`` ms of the event before. Ambiguous places count for nothing; a clock that runs backward
    gives no correction."""
    w = in_order(*SEGMENT)
    change = F.col("change")
    own = events.select(
        *SEGMENT, "event_id", "kind", "pos", "elapsed_ms", change["start"].alias("start"), F.coalesce(change["deleted"], F.lit("")).alias("deleted"), F.coalesce(change["inserted"], F.lit("")).alias("inserted"), (change["evidence"] != "Ambiguous").alias("reliable")
    )
    before = ["kind", "start", "deleted", "inserted", "reliable", "elapsed_ms"]
    seen = own.select("*", *(F.lag(c).over(w).alias(f"last_{c}") for c in before))
    gap = F.col("elapsed_ms") - F.col("last_elapsed_ms")
    near = gap.between(0, max_gap) & F.col("reliable") & F.col("last_reliable")
    inside = (F.col("start") >= F.col("last_start")) & (F.col("start") + F.length("deleted") <= F.col("last_start") + F.length("last_inserted"))
    kind = (
        F.when(near & (F.col("kind") == "Revision") & (F.col("deleted") != "") & (F.col("inserted") != "") & (F.col("last_kind") == "Commit") & inside, "replaced")
        .when(near & (F.col("kind") == "Commit") & (F.col("last_kind") == "Revision") & (F.col("last_deleted") != "") & (F.col("last_inserted") == "") & (F.col("start") == F.col("last_start")), "deleted_then_inserted")
    )
    was = F.when(F.col("kind") == "Revision", F.col("deleted")).otherwise(F.col("last_deleted"))
    return seen.withColumn("correction", kind).where("correction is not null").select("event_id", *SEGMENT, "correction", was.alias("removed"), F.col("inserted").alias("replacement"), gap.alias("gap_ms"))


def windows(events: DataFrame, max_gap: int, extra: Column | None = None) -> DataFrame:
    """Runs of commits, each at the end of the one before and within ``max_gap`` ms: adds ``window_no`` per segment.

    Anything but such a commit ends a run. One shuffle, by session and segment; a segment is bounded in events."""
    w = in_order(*SEGMENT)
    change = F.col("change")
    end = change["start"] + F.length(F.coalesce(change["inserted"], F.lit("")))
    ok = (F.col("kind") == "Commit") & (change["evidence"] != "Ambiguous") & (F.coalesce(change["deleted"], F.lit("")) == "")
    if extra is not None:
        ok = ok & extra
    marked = events.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("end", end)
    follows = F.lag("ok").over(w) & F.col("ok") & (change["start"] == F.lag("end").over(w)) & (F.col("elapsed_ms") - F.lag("elapsed_ms").over(w)).between(0, max_gap)
    begun = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    numbered = marked.withColumn("begun", begun).withColumn("window_no", F.sum("begun").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("ok").drop("ok", "begun", "end")
