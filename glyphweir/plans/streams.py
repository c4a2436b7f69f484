"""Queries that run as streams, over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweir.plans import views as V
from glyphweir.plans.sessions_sql import SQL as SESSIONS_SQL
from glyphweir.session import remove, temporary_folder
from glyphweir.sources.tables import table
from glyphweir.streaming import sessions as S


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return S.flat(S.event_stream(spark, folder, table(spark, folder, "capsule_events").schema))


def stream_corrections(spark: SparkSession, folder: str) -> DataFrame:
    found = S.settled(S.run_to_table(S.corrections(_stream(spark, folder), 10_000)))
    return found.where("reject is null").select("event_id", "correction", "removed", "replacement", "gap_ms")


def stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that changed no state, by reason."""
    return S.settled(S.run_to_table(S.corrections(_stream(spark, folder), 10_000))).where("reject is not null").groupBy("reject").agg(F.count("*").alias("n"))


def stream_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.run_to_table(S.kinds(_stream(spark, folder))).groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def stream_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries written as hourly segments and read again: how many, and how many events, each hour has."""
    home = temporary_folder(spark, "segments")
    S.write_segments(_stream(spark, folder), f"{home}/out", f"{home}/state").start().awaitTermination()
    remove(spark, f"{home}/state")
    return spark.read.schema("event_id bigint, hour string").parquet(f"{home}/out").groupBy("hour").agg(F.count("*").alias("n_deliveries"), F.count_distinct("event_id").alias("n_events"))


QUERIES = {f.__name__: f for f in (stream_corrections, stream_rejects, stream_kind_counts, stream_segments)}
_BUCKET = "(" + " + ".join(f"CASE WHEN elapsed_ms // 10 >= {b} THEN 1 ELSE 0 END" for b in (8, 16, 24, 32, 48, 64, 96, 160)) + ")"
SQL = {
    "stream_corrections": "SELECT event_id, correction, removed, replacement, gap_ms FROM (" + SESSIONS_SQL["correction_delete_insert"] + ")",
    "stream_rejects": f"WITH {V.EVENTS} SELECT 'repeated' AS reject, (SELECT count(*) FROM capsule_events WHERE event_id IS NOT NULL) - count(*) AS n FROM ev HAVING n > 0",
    "stream_kind_counts": f"WITH {V.EVENTS} SELECT kind, {_BUCKET} AS bucket, count(*) AS n FROM ev GROUP BY 1, 2",
    "stream_segments": "SELECT strftime(recorded_at, '%Y-%m-%d-%H') AS hour, count(*) AS n_deliveries, count(DISTINCT event_id) AS n_events FROM capsule_events WHERE event_id IS NOT NULL GROUP BY 1",
}
