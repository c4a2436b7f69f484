"""Queries on typing sessions: corrections, windows, labels, preferences, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweir.functions import codec
from glyphweir.functions import keys as K
from glyphweir.functions.scoring import boost
from glyphweir.operators import events as E
from glyphweir.operators import lexicon as L
from glyphweir.operators import memory as M
from glyphweir.plans import views as V
from glyphweir.sources.tables import table

GAP = 2_000


def _segment() -> Window:
    return Window.partitionBy("session_id", "segment_seq").orderBy("pos", "event_id")


#: The place of an event in its session; comparing places needs no window over a session, which may hold a third of all rows.
_PLACE = ("segment_seq", "pos", "event_id")


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "keys", "keys_complete", "composition", "start", "deleted", "inserted", "reliable", "code")


def _read(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Events once, with only these columns of theirs and of their changes read."""
    c = F.col("change")
    made = {
        "start": c["start"], "deleted": F.coalesce(c["deleted"], F.lit("")), "inserted": F.coalesce(c["inserted"], F.lit("")), "reliable": F.coalesce(c["evidence"] != "Ambiguous", F.lit(False)),
        "code": K.typed_letters(F.coalesce("keys", F.array().cast("array<string>"))), "evidence": c["evidence"],
    }
    return V.events(spark, folder, *(made.get(n, F.col(n)).alias(n) for n in columns))


def event_monotonic_check(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with their events, how often their clock runs backward and whether their places are without holes."""
    back = F.lag("elapsed_ms").over(_segment()) > F.col("elapsed_ms")
    own = V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms").withColumn("back", F.coalesce(back, F.lit(False)))
    return own.groupBy("session_id", "segment_seq").agg(F.count("*").alias("n_events"), F.count_if("back").alias("n_back"), (F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("whole"))


def event_windows_gap_contig(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of commits that follow each other in place and within two seconds."""
    runs = E.windows(V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "change"), GAP)
    return runs.groupBy("session_id", "segment_seq", "window_no").agg(F.count("*").alias("n_commits"), F.min("event_id").alias("first_event"), (F.max("elapsed_ms") - F.min("elapsed_ms")).alias("span_ms")).where("n_commits > 1").drop("window_no")


def correction_delete_insert(spark: SparkSession, folder: str) -> DataFrame:
    return E.corrections(V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "change"), 10_000)


def window_exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Commits by the first reason that keeps them out of replay; the reasons exclude each other and add up."""
    own = _read(spark, folder, "kind", "keys", "keys_complete", "composition", "reliable", "code").where("kind = 'Commit'").withColumn("full", codec.full_code(F.replace("composition", F.lit("'"), F.lit(" "))))
    words = V.words(spark, folder).select(F.col("code").alias("full"), F.lit(True).alias("known")).distinct()
    reason = (
        F.when(~F.coalesce("keys_complete", F.lit(False)) | F.col("keys").isNull(), "incomplete_keys")
        .when(F.length("code") == 0, "no_letters")
        .when(F.length("code") > 64, "too_long")
        .when(F.col("full").isNull(), "unencodable")
        .when(F.col("code") != F.col("full"), "other_code")
        .when(~F.col("reliable"), "ambiguous_place")
        .when(F.col("known").isNull(), "no_word")
        .otherwise("kept")
    )
    return own.join(words, "full", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of each session: events of either kind, keys, deletions, gaps between commits of a segment."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "keys", "deleted", "inserted").withColumn("gap", F.when((F.col("kind") == "Commit") & (F.lag("kind").over(_segment()) == "Commit"), F.col("elapsed_ms") - F.lag("elapsed_ms").over(_segment())))
    own = own.withColumn("gap", F.when(F.col("gap") >= 0, F.col("gap")))
    edits = F.size(F.filter("keys", lambda k: k.isin("BS", "DEL", "LEFT", "RIGHT", "HOME", "END")))
    return own.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "Commit").alias("n_commits"), F.count_if(F.col("kind") == "Revision").alias("n_revisions"), F.coalesce(F.sum(F.when(F.col("keys").isNotNull(), F.size("keys"))), F.lit(0)).alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col("keys").isNotNull(), edits)), F.lit(0)).alias("n_edit_keys"), F.sum(F.length("inserted")).alias("n_inserted"), F.sum(F.length("deleted")).alias("n_deleted"),
        F.count("gap").alias("n_gaps"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"), F.sum("gap").alias("sum_gap"),
    )


def session_summary_merge(spark: SparkSession, folder: str) -> DataFrame:
    """All sessions' summaries merged, with what must hold: gaps fewer than commits, least <= mean <= most."""
    s = session_summary(spark, folder)
    total = s.agg(F.count("*").alias("n_sessions"), *(F.expr(f"try_sum({c})").alias(c) for c in ("n_commits", "n_revisions", "n_keys", "n_gaps", "sum_gap")), F.min("least_gap").alias("least_gap"), F.max("most_gap").alias("most_gap"))
    holds = (F.col("n_gaps") <= F.col("n_commits")) & F.coalesce((F.col("least_gap") * F.col("n_gaps") <= F.col("sum_gap")) & (F.col("sum_gap") <= F.col("most_gap") * F.col("n_gaps")), F.lit(True))
    return total.withColumn("holds", holds)


def key_interpreter(spark: SparkSession, folder: str) -> DataFrame:
    """The code that each commit's keys leave, or why there is none."""
    own = V.events(spark, folder, "kind", "keys").where("kind = 'Commit' and keys is not null").withColumn("e", K.effective_code(F.col("keys")))
    return own.select("event_id", F.col("e.code").alias("code"), F.col("e.fault").alias("fault"))


def single_span_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The one span in which each revision changes what it replaced."""
    own = _read(spark, folder, "kind", "deleted", "inserted").where("kind = 'Revision'").withColumn("d", K.single_span(F.col("deleted"), F.col("inserted"))).where("d is not null")
    return own.select("event_id", "d.start", "d.deleted", "d.inserted", "d.ambiguous")


def half_pair_gap_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between events of a segment in nine buckets; where the clock runs backward there is none. In tens of ms."""
    gap = F.col("elapsed_ms") - F.lag("elapsed_ms").over(_segment())
    own = V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms").withColumn("gap", gap).where("gap >= 0")
    return own.groupBy(E.gap_bucket(F.floor(F.col("gap") / 10)).alias("bucket")).agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Commits with their label: Rejected if the next event deletes at their place, Accepted if it commits, else Unknown."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "start", "deleted", "inserted", "code")
    next_kind, next_start, next_deleted = (F.lead(c).over(_segment()) for c in ("kind", "start", "deleted"))
    gap = F.col("elapsed_ms") - F.lag("elapsed_ms").over(_segment())
    label = F.when(next_kind.isNull(), "Unknown").when((next_kind == "Revision") & (next_deleted != "") & (next_start >= F.col("start")) & (next_start < F.col("start") + F.greatest(F.length("inserted"), F.lit(1))), "Rejected").when(next_kind == "Commit", "Accepted").otherwise("Unknown")
    return own.withColumn("label", label).withColumn("gap", gap).where("kind = 'Commit'")


def decision_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _labels(spark, folder).select("event_id", "label")


def transposition_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptance per first pair of keys and gap bucket, shrunk to the bucket's and that to the prior 0.56; the tier.

    Personal only from 24 labels of the bucket or 8 of the pair on; 0.72 and 0.40 part the tiers; at most one step from
    the cold tier, which is the middle one."""
    own = _labels(spark, folder).where("label <> 'Unknown' and gap >= 0 and length(code) >= 2")
    rows = own.select(F.left("code", F.lit(2)).alias("pair"), E.gap_bucket(F.floor(F.col("gap") / 10)).alias("bucket"), (F.col("label") == "Accepted").cast("int").alias("ok"))
    per = rows.groupBy("pair", "bucket").agg(F.count("*").alias("n"), F.sum("ok").alias("k"))
    every = per.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("k").alias("bk"))
    both = per.join(every, "bucket")
    whole = (0.56 * 16 + F.col("bk")) / (16 + F.col("bn"))
    pair = (whole * 8 + F.col("k")) / (8 + F.col("n"))
    value = F.when((F.col("bn") >= 24) | (F.col("n") >= 8), pair).otherwise(F.lit(0.56))
    tier = F.when(F.col("p") >= 0.72, "Primary").when(F.col("p") >= 0.40, "Secondary").otherwise("Shadow")
    return both.withColumn("p", F.round(value, 6)).select("pair", "bucket", "n", "p", tier.alias("tier"))


def online_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels per bucket and pair, as the calibrator counts them."""
    own = _labels(spark, folder).where("gap >= 0 and length(code) >= 2")
    return own.groupBy(E.gap_bucket(F.floor(F.col("gap") / 10)).alias("bucket"), "label").agg(F.count("*").alias("n"), F.count_distinct(F.left("code", F.lit(2))).alias("n_pairs"))


def freeze_lookback(spark: SparkSession, folder: str) -> DataFrame:
    """Of each segment the events of its last thirty seconds, at most the last 50, and whether that is all of them."""
    last = Window.partitionBy("session_id", "segment_seq")
    own = V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms").withColumn("marker", F.max("elapsed_ms").over(last)).where("elapsed_ms >= marker - 30000")
    placed = own.withColumn("back", F.row_number().over(last.orderBy(F.desc("pos"), F.desc("event_id"))))
    return placed.groupBy("session_id", "segment_seq").agg(F.count_if(F.col("back") <= 50).alias("n_kept"), (F.count("*") <= 50).alias("complete"), F.min(F.when(F.col("back") <= 50, F.col("elapsed_ms"))).alias("from_ms"))


def freeze_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the last three finished episodes of each segment; a commit finishes one."""
    back = Window.partitionBy("session_id", "segment_seq").orderBy(F.desc("pos"), F.desc("event_id"))
    own = V.events(spark, folder, "session_id", "segment_seq", "pos", "kind").withColumn("episode", F.sum((F.col("kind") == "Commit").cast("bigint")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return own.where("episode between 1 and 3").groupBy("session_id", "segment_seq", "episode").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


def _selections(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, code, text, n, last): how often and when last a session chose a text for a code."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "kind", "inserted", "code").where("kind = 'Commit' and code <> '' and inserted <> ''").withColumn("t", F.struct(*_PLACE))
    return own.groupBy("session_id", "code", F.col("inserted").alias("text")).agg(F.count("*").alias("n"), F.max("t").alias("last"))


def _preference() -> list[Column]:
    return [F.desc(F.least("n", F.lit(4))), F.desc("last"), F.desc("n"), F.asc("text")]


def preferred_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text each session prefers for a code: chosen most often (four times are enough), then last."""
    return L.first_by(_selections(spark, folder), ["session_id", "code"], *_preference()).select("session_id", "code", "text", "n")


def suppression_last_action(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that a session took back and didn't commit again: the last action on a text counts."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "kind", "deleted", "inserted").withColumn("text", F.when(F.col("kind") == "Commit", F.col("inserted")).otherwise(F.col("deleted"))).where("text <> ''").withColumn("t", F.struct(*_PLACE))
    last = own.groupBy("session_id", "text").agg(F.max_by("kind", "t").alias("kind"), F.max("t").alias("t"))
    return last.where("kind = 'Revision'").select("session_id", "text")


def anchored_suffix_inherit(spark: SparkSession, folder: str) -> DataFrame:
    """For short codes with an anchored start, the text preferred for the full codes they shorten, chosen twice at least."""
    own = _selections(spark, folder).where("length(code) % 2 = 0 and length(code) >= 4")
    codes = codec.pairs_of(F.col("code"))
    shorts = F.transform(F.sequence(F.lit(1), F.size(codes) - 1), lambda k: F.concat(F.array_join(F.slice(codes, F.lit(1), k), ""), codec.all_short(F.slice(codes, k + 1, F.size(codes) - k))))
    rows = own.where("n >= 2").select("session_id", "text", "n", "last", F.explode(F.array_distinct(shorts)).alias("short"))
    return L.first_by(rows, ["session_id", "short"], *_preference()).select("session_id", "short", "text", "n")


def context_preference(spark: SparkSession, folder: str) -> DataFrame:
    """After the text before, the text a session supports for a code: choices less rejections, four of each at most."""
    own = _labels(spark, folder).withColumn("before", F.lag("inserted").over(_segment())).where("before <> '' and code <> '' and inserted <> ''").withColumn("t", F.struct(*_PLACE))
    per = own.groupBy("session_id", "before", "code", F.col("inserted").alias("text")).agg(F.count_if(F.col("label") != "Rejected").alias("chosen"), F.count_if(F.col("label") == "Rejected").alias("rejected"), F.max("t").alias("last"))
    support = F.greatest(F.least("chosen", F.lit(4)) - F.least("rejected", F.lit(4)), F.lit(0))
    return L.first_by(per.withColumn("support", support).where("support > 0"), ["session_id", "before", "code"], F.desc("support"), F.desc("last"), F.asc("text")).select("session_id", "before", "code", "text", "support")


def session_mru(spark: SparkSession, folder: str) -> DataFrame:
    """The last text of each of a session's 128 most recent codes."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "kind", "inserted", "code").where("kind = 'Commit' and code <> '' and inserted <> ''").withColumn("t", F.struct(*_PLACE))
    last = own.groupBy("session_id", "code").agg(F.max(F.struct("t", F.col("inserted").alias("text"))).alias("v")).select("session_id", "code", "v.*")
    return L.ranked(last, ["session_id"], F.desc("t"), limit=128).select("session_id", "rank", "code", "text")


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    """(code, text, frequency, public_rank): words of each full code."""
    best = L.first_by(V.words(spark, folder), ["code", "text"], F.desc("frequency")).select("code", "text", "frequency")
    return L.ranked(best, ["code"], F.desc("frequency"), F.asc("text"), limit=50, name="public_rank")


def promote_text(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each code a session typed, its preferred text put behind the first word, the length kept."""
    pool = _pool(spark, folder).groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("public_rank", "text"))), lambda x: x["text"]).alias("words"))
    own = preferred_text(spark, folder).join(pool, "code")
    rest = F.filter(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda w: w != F.col("text"))
    moved = F.when(F.get("words", F.lit(0)) == F.col("text"), F.col("words")).otherwise(F.slice(F.concat(F.slice("words", 1, 1), F.array("text"), rest), F.lit(1), F.greatest(F.size("words"), F.lit(2))))
    return own.select("session_id", "code", F.array_join(moved, "|").alias("words"))


def adaptive_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of each word of a code for a session: the public share mixed with the smoothed personal one.

    The mix is 0.25 E / (E + 4) with E the session's evidence for the code; smoothing 0.5."""
    pool = _pool(spark, folder)
    own = _selections(spark, folder).select("session_id", "code", "text", F.col("n").alias("e"))
    asked = own.select("session_id", "code").distinct().join(pool, "code").join(own, ["session_id", "code", "text"], "left").withColumn("e", F.coalesce("e", F.lit(0)))
    w = Window.partitionBy("session_id", "code")
    total, n, mass = F.sum("e").over(w), F.count("*").over(w), F.sum("frequency").over(w)
    mix = 0.25 * total / (total + 4)
    value = (1 - mix) * F.col("frequency") / mass + mix * (F.col("e") + 0.5) / (total + 0.5 * n)
    return asked.select("session_id", "code", "text", F.round(value, 6).alias("p"))


def personal_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that a session chose twice at least for a code and that no word of that code has; at most eight."""
    own = _selections(spark, folder).where("n >= 2").join(_pool(spark, folder).select("code", "text"), ["code", "text"], "left_anti")
    return L.ranked(own, ["session_id", "code"], F.desc("n"), F.desc("last"), F.asc("text"), limit=8).select("session_id", "code", "rank", "text", "n")


def adaptive_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a session's codes with its own texts merged in: these get the mass 0.05 E / (E + 4), the words the rest."""
    own = personal_coverage(spark, folder).select("session_id", "code", "text", "n")
    mass = own.groupBy("session_id", "code").agg(F.sum("n").alias("e")).withColumn("cover", 0.05 * F.col("e") / (F.col("e") + 4))
    pool = _pool(spark, folder)
    share = pool.withColumn("q", F.col("frequency") / F.sum("frequency").over(Window.partitionBy("code"))).select("code", "text", "q")
    public = mass.join(share, "code").select("session_id", "code", "text", F.round((1 - F.col("cover")) * F.col("q"), 9).alias("p"), F.lit("public").alias("source"))
    mine = own.join(mass, ["session_id", "code"]).select("session_id", "code", "text", F.round(F.col("cover") * F.col("n") / F.col("e"), 9).alias("p"), F.lit("personal").alias("source"))
    return L.ranked(public.unionByName(mine), ["session_id", "code"], F.desc("p"), F.asc("source"), F.asc("text"), limit=50).select("session_id", "code", "rank", "text", "source", F.round("p", 6).alias("p"))


def tier_by_recency(spark: SparkSession, folder: str) -> DataFrame:
    """A session's commits by the tier of memory they are in: 128 recent, 1,024 medium, up to 8,192 long, the rest gone."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "kind", "inserted").where("kind = 'Commit' and inserted <> ''")
    # The age is the place in the segment plus what later segments hold: no window over a whole session's events.
    later = Window.partitionBy("session_id").orderBy(F.desc("segment_seq")).rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("session_id", "segment_seq").agg(F.count("*").alias("n")).select("session_id", "segment_seq", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    own = own.withColumn("age", F.row_number().over(Window.partitionBy("session_id", "segment_seq").orderBy(F.desc("pos"), F.desc("event_id")))).join(before, ["session_id", "segment_seq"]).withColumn("age", F.col("age") + F.col("before"))
    tier = F.when(F.col("age") <= M.RECENT, "recent").when(F.col("age") <= M.RECENT + M.MEDIUM, "medium").when(F.col("age") <= M.LONG, "long").otherwise("evicted")
    return own.groupBy("session_id", tier.alias("tier")).agg(F.count("*").alias("n"), F.count_distinct("inserted").alias("n_texts"))


def _before(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds how often the session has learned ``key`` in runs before this one, not in this run: predict, then learn."""
    per = rows.groupBy("session_id", "run", key.alias("__k")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("session_id", "__k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    known = per.withColumn(name, F.coalesce(F.sum("m").over(w), F.lit(0))).drop("m")
    return rows.withColumn("__k", key).join(known, ["session_id", "run", "__k"]).drop("__k")


def personal_causal(spark: SparkSession, folder: str) -> DataFrame:
    """Commits of words in runs: their public place, and their place once the session's earlier runs lift them."""
    runs = E.windows(V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "keys", "change"), GAP).withColumn("code", K.typed_letters(F.coalesce("keys", F.array().cast("array<string>"))))
    own = runs.select("session_id", "event_id", F.struct("segment_seq", "window_no").alias("run"), "code", F.col("change.inserted").alias("text")).where("text <> ''")
    ranks = _pool(spark, folder).select("code", "text", "public_rank")
    seen = _before(own, F.col("text"), "count").join(ranks, ["code", "text"])
    place = F.greatest(F.col("public_rank") - 1 - boost(F.col("count")), F.lit(0)) + 1
    return seen.select("event_id", "public_rank", "count", place.alias("place"))


def frozen_vs_causal(spark: SparkSession, folder: str) -> DataFrame:
    """Commits by whether the session's whole other history (frozen) or only its earlier runs (causal) know their text."""
    runs = E.windows(V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "change"), GAP)
    own = runs.select("session_id", "event_id", F.struct("segment_seq", "window_no").alias("run"), F.col("change.inserted").alias("text")).where("text <> ''")
    causal = _before(own, F.col("text"), "causal")
    frozen = F.count("*").over(Window.partitionBy("session_id", "text")) - F.count("*").over(Window.partitionBy("session_id", "text", "run"))
    rows = causal.withColumn("frozen", frozen)
    kind = F.when((F.col("frozen") > 0) & (F.col("causal") > 0), "both").when(F.col("frozen") > 0, "frozen_only").when(F.col("causal") > 0, "causal_only").otherwise("neither")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("causal").alias("causal"), F.sum("frozen").alias("frozen"))


def personal_retraction(spark: SparkSession, folder: str) -> DataFrame:
    """Words each session learned and still keeps after later edits took some back; a segment is a document of its own."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "kind", "start", "deleted", "inserted", "reliable")
    per = M.fold(own, ["session_id", "segment_seq"], ["pos", "event_id"], M.retract, "session_id string, segment_seq bigint, text string, learned bigint, kept bigint")
    return per.groupBy("session_id", "text").agg(F.sum("learned").alias("learned"), F.sum("kept").alias("kept"))


def pending_span_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of what each session's memory holds, by code and text: the end of a segment confirms what is left of it;
    tiers go by recency over the whole session."""
    own = _read(spark, folder, "session_id", "segment_seq", "pos", "kind", "start", "deleted", "inserted", "reliable", "code")
    left = M.fold(own, ["session_id", "segment_seq"], ["pos", "event_id"], M.pending_at_end, "session_id string, segment_seq bigint, place bigint, code string, text string")
    age = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("segment_seq"), F.desc("place")))
    weight = F.when(F.col("age") <= M.RECENT, M.TIER_WEIGHT["recent"]).when(F.col("age") <= M.RECENT + M.MEDIUM, M.TIER_WEIGHT["medium"]).otherwise(M.TIER_WEIGHT["long"])
    return left.withColumn("age", age).where(F.col("age") <= M.LONG).groupBy("session_id", "code", "text").agg(F.sum(weight).alias("weight"))


def commit_tail_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Commits whose end was deleted right after them."""
    return M.fold(_read(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "start", "deleted", "inserted", "reliable"), ["session_id", "segment_seq"], ["pos", "event_id"], M.tail_trims, "session_id string, segment_seq bigint, event_id bigint, committed string, left string, n_edits bigint").drop("session_id", "segment_seq")


def rolling_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """What a buffer of 4,096 characters per session holds at its end, and how many events it dropped."""

    def step(key, rows):
        ring = M.Ring(4_096)
        for n, row in enumerate(rows):
            ring.add(n, row.size)
        return [(len(ring.rows), ring.size, ring.dropped)]

    size = F.length("inserted") + F.length("deleted") + F.coalesce(F.size("keys"), F.lit(0)) + 16
    return M.fold(_flat(spark, folder).select("session_id", "segment_seq", "pos", "event_id", "elapsed_ms", size.alias("size")), ["session_id"], ["segment_seq", "pos", "event_id"], step, "session_id string, n_kept bigint, size bigint, n_dropped bigint")


def composition_fsm(spark: SparkSession, folder: str) -> DataFrame:
    """Effects of all keys of commits, by the state that the composition is in after them."""

    def step(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(s, e) for keys in batch.column("keys").to_pylist() for s, _, e in M.composition_steps(keys)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["state", "effect"])

    own = V.events(spark, folder, "keys").where("keys is not null").select("keys")
    return own.mapInArrow(step, "state string, effect string").groupBy("state", "effect").agg(F.count("*").alias("n"))


def segment_continuity(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions whose segments don't follow one another: a number is missing or the record times run backward."""
    rows = table(spark, folder, "capsule_events").where("event_id is not null").groupBy("session_id", "segment_seq").agg(F.min("recorded_at").alias("begin"))
    w = Window.partitionBy("session_id").orderBy("segment_seq")
    seen = rows.withColumn("hole", F.coalesce(F.col("segment_seq") != F.lag("segment_seq").over(w) + 1, F.col("segment_seq") != 0)).withColumn("back", F.coalesce(F.col("begin") < F.lag("begin").over(w), F.lit(False)))
    return seen.groupBy("session_id").agg(F.count("*").alias("n_segments"), F.count_if("hole").alias("n_holes"), F.count_if("back").alias("n_back")).where("n_holes > 0 or n_back > 0")


def feedback_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Events per kind, evidence of place and producer's version."""
    own = _read(spark, folder, "session_id", "kind", "evidence", "producer_version")
    return own.groupBy("kind", "evidence", "producer_version").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"))


def integrity_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Integrity counters of all events: deliveries, repeats, incomplete keys, missing parts."""
    raw = table(spark, folder, "capsule_events").where("event_id is not null")
    once = V.events(spark, folder, "keys_complete", "keys", "change")
    return once.agg(F.count("*").alias("n_events"), F.count_if(~F.coalesce("keys_complete", F.lit(False))).alias("n_incomplete"), F.count_if(F.col("keys").isNull()).alias("n_no_keys"), F.count_if(F.col("change.deleted").isNull()).alias("n_no_deleted"), F.count_if(F.col("change.inserted").isNull()).alias("n_no_inserted")).withColumn("n_deliveries", raw.agg(F.count("*")).scalar())


def incremental_tail_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a session's words from a snapshot of all segments but its last and the tail folded in: as from all."""
    own = _read(spark, folder, "session_id", "segment_seq", "kind", "inserted").where("kind = 'Commit' and inserted <> ''")
    last = Window.partitionBy("session_id")
    marked = own.withColumn("tail", F.col("segment_seq") == F.max("segment_seq").over(last))
    snapshot = marked.where("not tail").groupBy("session_id", "inserted").agg(F.count("*").alias("n"))
    tail = marked.where("tail").groupBy("session_id", "inserted").agg(F.count("*").alias("n"))
    return snapshot.unionByName(tail).groupBy("session_id", F.col("inserted").alias("text")).agg(F.sum("n").alias("n"))


def paint_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Frames painted if the first key of a syllable waits for the second: five delays by three cadences, over all codes."""
    codes = V.commits(spark, folder).where("observed <> ''").select(F.length("observed").alias("n"))
    grid = F.flatten(F.transform(F.array(*map(F.lit, (16, 32, 48, 80, 120))), lambda d: F.transform(F.array(*map(F.lit, (40, 90, 160))), lambda g: F.struct(d.alias("delay"), g.alias("gap")))))
    odd, even = F.ceil(F.col("n") / 2), F.floor(F.col("n") / 2)
    return codes.select("n", F.inline(grid)).groupBy("delay", "gap").agg(F.sum(even + F.when(F.col("delay") <= F.col("gap"), odd).otherwise(0)).cast("bigint").alias("n_painted"), F.sum(F.when(F.col("delay") > F.col("gap"), odd).otherwise(0)).cast("bigint").alias("n_suppressed"))


QUERIES = {
    f.__name__: f
    for f in (
        event_monotonic_check, event_windows_gap_contig, correction_delete_insert, window_exclusion_reasons, session_summary, session_summary_merge, key_interpreter, single_span_diff, half_pair_gap_histogram, decision_labels,
        transposition_calibration, online_label_counts, freeze_lookback, freeze_episodes, preferred_text, suppression_last_action, anchored_suffix_inherit, context_preference, session_mru, promote_text, adaptive_mixture,
        personal_coverage, adaptive_merge, tier_by_recency, personal_causal, frozen_vs_causal, personal_retraction, pending_span_fold, commit_tail_trim, rolling_buffer, composition_fsm, segment_continuity, feedback_summary,
        integrity_merge, incremental_tail_fold, paint_audit,
    )
}
