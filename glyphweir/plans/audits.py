"""Queries that audit lexicons, rankings, recorders and packages: recalls, histograms, evidence, guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweir.functions import codec
from glyphweir.functions.scoring import boost
from glyphweir.operators import adaptive as A
from glyphweir.operators import language, lattice, noisy, snapshots
from glyphweir.operators import events as E
from glyphweir.operators import lexicon as L
from glyphweir.operators import memory as M
from glyphweir.plans import corpus, extras
from glyphweir.plans import sessions as P
from glyphweir.plans import views as V
from glyphweir.plans.corpus_sql import _CBI, _CHARS, _LAYERS
from glyphweir.plans.decoding import _ANCHORED, _CONSERVATIVE, _INTENDED, _KINDS, _SHORT, _margins
from glyphweir.plans.sessions_sql import _EV, _POOL, _PREF, _RUNS, _SEL
from glyphweir.session import cut, unfolded
from glyphweir.sources.tables import table

# The keys and events of a recorder, the candidates of a page.
MOST_KEYS, MOST_EVENTS, PAGE = 128, 4_096, 7
#: Longest code in which swapped keys of syllables are looked up, and how many words of one are looked at.
SWAP_KEYS, SWAP_DEPTH = 16, 6


def sentence_ids(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader that allows each id once and no empty sentence would turn away: deliveries, ids, repeats, empty ones."""
    rows = table(spark, folder, "ud_sentences").where("id is not null")
    per = rows.groupBy("id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.size("tokens"), F.lit(0))).alias("size"))
    return per.agg(F.sum("n").alias("n_deliveries"), F.count("*").alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("size") <= 0).alias("n_empty"))


def runtime_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of the core with the supplement bound to each: off where it has none, core only where one of its rows is no
    entry, else on, with the entries that load."""
    def packages(name: str) -> DataFrame:
        rows = table(spark, folder, name)
        now = L.entries(rows).select("entry_id", "reason").join(rows.where("package_id is not null").groupBy("entry_id").agg(F.min("package_id").alias("package_id")), "entry_id")
        return now.groupBy("package_id").agg(F.count_if(F.col("reason").isNull()).alias("n_entries"), F.count("reason").alias("n_bad"))

    core, more = packages("technical_overlay"), packages("technical_overlay_mirror").withColumnsRenamed({"n_entries": "n_more", "n_bad": "n_bad_more"})
    status = F.when(F.col("n_more").isNull(), "off").when(F.col("n_bad_more") > 0, "core_only").otherwise("on")
    return core.join(more, "package_id", "left").select("package_id", status.alias("status"), (F.col("n_entries") + F.when(F.col("n_bad_more") == 0, F.col("n_more")).otherwise(0)).alias("n_loaded"))


def provenance_check(spark: SparkSession, folder: str) -> DataFrame:
    """A provenance record per package, written, read and held against its manifest: digest and compatible schema."""
    own = extras.manifest_check(spark, folder)
    text = F.concat(F.lit("schema=package-1\nrevision="), F.col("package_id").cast("string"), F.lit("\npayload="), F.col("digest"), F.lit("\nentries="), F.col("entry_count").cast("string"))
    record = F.concat(F.lit("schema=provenance-1\npackage_schema=package-1\nmanifest_sha256="), F.sha2(text, 256))
    read = own.withColumn("text", text).withColumn("lines", F.split(record, "\n"))
    field = lambda i, key: F.regexp_extract(F.get("lines", F.lit(i)), rf"\A{key}=(.*)\z", 1)
    holds = (F.size("lines") == 3) & (field(0, "schema") == "provenance-1") & (field(1, "package_schema") == "package-1") & (field(2, "manifest_sha256") == F.sha2("text", 256))
    return read.select("package_id", field(2, "manifest_sha256").alias("manifest_sha256"), holds.alias("holds"))


def evidence_prefix_scan(spark: SparkSession, folder: str) -> DataFrame:
    """For the short codes of a session, of three keys and more, the full codes with the same two first keys that they may
    stand for: all syllables in full up to one, of those after it the first keys."""
    own = P._selections(spark, folder).select("session_id", "code").distinct()
    full = own.where(F.length("code") % 2 == 0).select("session_id", F.col("code").alias("entry"), F.left("code", F.lit(2)).alias("prefix"))
    short = own.where(F.length("code") >= 3).select("session_id", F.col("code").alias("short"), F.left("code", F.lit(2)).alias("prefix"))
    cut = F.length("entry") - F.length("short")
    stands = (cut > 0) & lattice.is_anchored_suffix(F.col("entry"), cut, F.col("short"))
    return short.join(full, ["session_id", "prefix"]).where(stands).select("session_id", "short", "entry")


CONFIG = ("max_mix", "saturation", "smoothing", "recent", "medium", "long")


def config_is_valid(c: dict[str, Column]) -> Column:
    """Whether a memory's settings are finite, in range and weigh newer evidence no less than older."""
    finite = [~F.isnan(c[n]) & (F.abs(c[n]) != float("inf")) for n in CONFIG]
    ranges = (c["max_mix"] >= 0) & (c["max_mix"] < 1) & (c["saturation"] > 0) & (c["smoothing"] > 0) & (c["recent"] > 0) & (c["long"] >= 0) & (c["recent"] >= c["medium"]) & (c["medium"] >= c["long"])
    for own in finite:
        ranges = ranges & own
    return ranges


def config_validation(spark: SparkSession, folder: str) -> DataFrame:
    """A grid of settings with whether each is valid."""
    values = {"max_mix": (-0.1, 0.25, 1.0), "saturation": (0.0, 4.0), "smoothing": (0.0, 0.5), "recent": (0.0, 4.0), "medium": (2.0, 5.0), "long": (-1.0, 1.0, 3.0)}
    grid = spark.range(1).select(F.lit(0).alias("one"))
    for name, own in values.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, own))).alias(name))
    return grid.select(*CONFIG, config_is_valid({n: F.col(n) for n in CONFIG}).alias("valid"))


def _swapped(i: Column) -> Column:
    code = F.col("observed")
    return F.concat(F.left(code, i * 2), F.substring(code, i * 2 + 2, F.lit(1)), F.substring(code, i * 2 + 1, F.lit(1)), F.substring(code, i * 2 + 3, F.length(code) + 1))


def span_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """Words by the full code in which the keys of one syllable are swapped, or of both of two; for two only if neither swap
    alone gives a word."""
    words = V.words(spark, folder)
    codes = V.observed(spark, folder).where((F.length("observed") % 2 == 0) & (F.length("observed") <= SWAP_KEYS))
    one = codes.select("observed", F.explode(F.sequence(F.lit(0), (F.length("observed") / 2 - 1).cast("int"))).alias("first"))
    unlike = F.substring("observed", F.col("first") * 2 + 1, F.lit(1)) != F.substring("observed", F.col("first") * 2 + 2, F.lit(1))
    one = one.where(unlike).select("observed", "first", F.lit(1).alias("n_syllables"), _swapped(F.col("first")).alias("intended"))
    code = F.col("observed")
    halves = [F.substring(code, F.lit(i), F.lit(1)) for i in (1, 2, 3, 4)]
    two = codes.where((F.length("observed") == 4) & (halves[0] != halves[1]) & (halves[2] != halves[3])).select("observed", F.lit(0).alias("first"), F.lit(2).alias("n_syllables"), F.concat(halves[1], halves[0], halves[3], halves[2]).alias("intended"))
    asked = one.unionByName(two)
    found = noisy.decode_exact(asked.select(F.col("intended").alias("observed")), words, SWAP_DEPTH).select(F.col("observed").alias("intended"), "rank", "text")
    hit = asked.join(found.select("intended").distinct(), "intended")
    single = hit.where("n_syllables = 1").select("observed").distinct()
    kept = hit.join(single.withColumn("known", F.lit(2)), (hit.observed == single.observed) & (hit.n_syllables == F.col("known")), "left_anti")
    return kept.join(found, "intended").select("observed", "first", "n_syllables", "intended", "rank", "text")


def swap_recovery_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of a code with two adjacent keys swapped, in full or with anchored suffixes, that the code as typed doesn't
    give: the best five by score, then place, then text."""
    words, codes = V.words(spark, folder), V.observed(spark, folder)
    n = F.length("observed")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & (F.substring("observed", i, F.lit(1)) != F.substring("observed", i + 1, F.lit(1))))
    made = F.transform(places, lambda i: F.struct(i.alias("place"), F.concat(F.left("observed", i - 1), F.substring("observed", i + 1, F.lit(1)), F.substring("observed", i, F.lit(1)), F.substring("observed", i + 2, n + 1)).alias("swapped")))
    swaps = unfolded(codes.select("observed", F.inline(made)))
    edges = lattice.noisy_edges(swaps.select(F.col("swapped").alias("observed")), words, 10, corrections=False)
    anchored = edges.where(lattice.is_anchored_suffix(F.col("code"), F.col("abbreviated"), F.col("spelling")))
    found = lattice.sentences(anchored, words, top=5).select(F.col("observed").alias("swapped"), "text", "score")
    primary = lattice.sentences(lattice.noisy_edges(codes, words, 10), words, top=5, literals=True, codes=codes).select("observed", "text")
    best = L.first_by(swaps.join(found, "swapped").join(primary, ["observed", "text"], "left_anti"), ["observed", "text"], F.desc("score"), F.asc("place"))
    return L.ranked(best, ["observed"], F.desc("score"), F.asc("place"), F.asc("text"), limit=5).select("observed", "rank", "text", "place", "score")


def sentence_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of sentences written by first keys, how many are among the first 1, 5 and 10 sentences read."""
    cases, words = extras.authored_cases(spark, folder), V.words(spark, folder)
    codes = cases.select("observed").distinct()
    ranks = lattice.sentences(lattice.noisy_edges(codes, words, 10), words, top=10, literals=True, codes=codes).select("observed", F.col("text").alias("expected"), "rank")
    return cases.join(ranks, ["observed", "expected"], "left").agg(F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 5, 10)))


def labelled_rejection_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """At nine thresholds of the margin per key, codes whose first word is the text committed that are accepted, and others
    that are rejected; without a word there is no margin."""
    each = _margins(spark, folder).withColumn("right", F.coalesce(F.col("first") == F.col("expected"), F.lit(False)))
    rows = each.select("right", "margin", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("threshold"))
    accepted = F.coalesce(F.col("margin") >= F.col("threshold"), F.lit(False))
    return rows.groupBy("threshold").agg(F.count_if("right").alias("n_right"), F.count_if(F.col("right") & accepted).alias("right_accepted"), F.count_if(~F.col("right")).alias("n_wrong"), F.count_if(~F.col("right") & ~accepted).alias("wrong_rejected"), F.count_if(~F.col("right") & F.col("margin").isNotNull()).alias("wrong_with_margin"))


def character_oracle(spark: SparkSession, folder: str) -> DataFrame:
    """Where commits don't have the first word: whether characters' transitions would prefer the text committed, by which of
    the two is longer, over all and per transition."""
    train = corpus._characters(spark, folder, "train")
    size = train.select(F.explode("items").alias("c")).agg(F.count_distinct("c")).scalar()
    wanted = V.commits(spark, folder).where("observed <> '' and text <> ''").select("event_id", "observed", F.col("text").alias("answer"))
    first = noisy.decode(wanted.select("observed").distinct(), V.words(spark, folder), 1).select("observed", F.col("text").alias("base"))
    rows = wanted.join(first, "observed").where("answer <> base")
    texts = rows.select(F.col("answer").alias("text")).union(rows.select("base")).distinct()
    scored = language.score_sequences(texts.select("text", language.characters(F.col("text")).alias("items")), "text", "items", language.bigrams(train), size)
    for name in ("answer", "base"):
        rows = rows.join(scored.select(F.col("text").alias(name), F.col("score").alias(f"s_{name}"), F.col("n_transitions").alias(f"n_{name}")), name)

    def outcome(a: Column, b: Column) -> Column:
        return F.when(a > b, "answer").when(a < b, "base").otherwise("tie")

    length = F.length("answer") - F.length("base")
    longer = F.when(length > 0, "answer").when(length < 0, "base").otherwise("same")
    whole, mean = outcome(F.col("s_answer"), F.col("s_base")), outcome(F.round(F.col("s_answer") / F.col("n_answer"), 6), F.round(F.col("s_base") / F.col("n_base"), 6))
    return rows.groupBy(longer.alias("longer"), whole.alias("whole"), mean.alias("mean")).agg(F.count("*").alias("n"))


def summary_configurations(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions merged per configuration, which is the producer's version: only those of one version throughout may be; the
    others are counted as mixed."""
    own = P._read(spark, folder, "session_id", "producer_version", "elapsed_ms", "kind").groupBy("session_id").agg(
        F.count_distinct("producer_version").alias("n_versions"), F.min("producer_version").alias("version"), F.count("*").alias("n_events"), F.count_if(F.col("kind") == "Commit").alias("n_commits"), F.max("elapsed_ms").alias("elapsed_ms"))
    name = F.when(F.col("n_versions") == 1, F.col("version")).otherwise(F.lit("(mixed)"))
    return own.groupBy(name.alias("configuration")).agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.sum("n_commits").alias("n_commits"), F.sum("elapsed_ms").alias("elapsed_ms"))


def _strategies(words: DataFrame) -> DataFrame:
    """(text, code, strategy, own): each text's best entry by each way to write its code."""
    c = F.col("codes")
    modes = {"full": F.col("code"), "anchored": codec.anchored_tail(c), "conservative": codec.conservative_tail(c), "short": codec.all_short(c)}
    return L.best_by_text(words).select("text", "code", "frequency", F.inline(F.array(*(F.struct(F.lit(m).alias("strategy"), x.alias("own")) for m, x in modes.items()))))


def rank_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """For each way to write codes, at which of ten places words stand among those written alike."""
    ranked = L.ranked(_strategies(V.words(spark, folder)), ["strategy", "own"], F.desc("frequency"), F.asc("text"))
    bins = [F.count_if(F.col("rank") == k).alias(f"at_{k}") for k in range(1, 11)]
    return ranked.groupBy("strategy").agg(F.count("*").alias("attempts"), F.sum(F.length("own")).alias("n_keys"), *(F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 5, 10)), *bins)


def gate_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Words typed short where at most so many share the short code, by two placements of what is short (all but the first
    syllable, or the last alone): first places gained and lost against full codes, and words that come into ten or fall out."""
    own = _strategies(V.words(spark, folder)).where("strategy in ('anchored', 'conservative') and length(code) >= 4").withColumn("fan", F.count("*").over(Window.partitionBy("strategy", "own")))
    limits = F.array(*(F.struct(F.lit(i).alias("gate"), F.lit(n).alias("most")) for i, n in enumerate((0, 1, 2, 4, 8, 16, 1 << 30))))
    each = own.select("text", "code", "frequency", "strategy", "own", "fan", F.inline(limits)).withColumn("typed", F.when(F.col("fan") <= F.col("most"), F.col("own")).otherwise(F.col("code")))
    after = L.ranked(each, ["strategy", "gate", "typed"], F.desc("frequency"), F.asc("text"), name="after")
    both = L.ranked(after, ["strategy", "gate", "code"], F.desc("frequency"), F.asc("text"), name="before")
    a, b = F.col("after"), F.col("before")
    return both.groupBy("strategy", "gate").agg(F.count("*").alias("n"), F.sum(F.length("code") - F.length("typed")).alias("keys_saved"), F.count_if((a == 1) & (b > 1)).alias("gained"), F.count_if((a > 1) & (b == 1)).alias("lost"), F.count_if((a <= 10) & (b > 10)).alias("recovered"), F.count_if((a > 10) & (b <= 10)).alias("dropped"))


def decode_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """For each typed code one number of its ten first words in order: 31 times what came before, plus the sizes of a word's
    text and spelling."""
    found = noisy.decode(V.observed(spark, folder), V.words(spark, folder), 10)
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("rank", (F.octet_length("text") + F.length("spelling")).cast("bigint").alias("size")))), lambda x: x["size"])
    return found.groupBy("observed").agg(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a * 31 + x).alias("checksum"))


def _pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "personal_pair_counts").distinct().groupBy(F.col("previous_word").alias("prev"), F.col("current_word").alias("cur")).agg(F.sum("n").alias("n"))


def pair_features(spark: SparkSession, folder: str) -> DataFrame:
    """Of the sentences' adjacent words: the strongest transition in any cache, and the mean of ln(1 + count)."""
    steps = language.transitions(V.spoken(spark, folder), "items", "id").join(_pair_counts(spark, folder), ["prev", "cur"], "left")
    return steps.groupBy("id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("strongest"), F.round(F.sum(F.log1p(F.coalesce("n", F.lit(0)))) / F.count("*"), 6).alias("bonus"))


def cache_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence in a session's cache for the first ten words of the codes it typed after the text before: the word, the
    ordered pair, the exact code; word and pair together, and word and code, lift three places at most."""
    w = Window.partitionBy("session_id", "segment_seq").orderBy("pos", "event_id")
    own = V.commits(spark, folder).where("observed <> ''").withColumn("before", F.lag("text").over(w)).where("before is not null")
    pool = P._pool(spark, folder).where("public_rank <= 10").select(F.col("code").alias("observed"), "text", "public_rank")
    asked = own.select("session_id", "before", "observed").distinct().join(pool, "observed")
    word = table(spark, folder, "personal_word_counts").distinct().groupBy("session_id", F.col("word").alias("text")).agg(F.sum("n").alias("word_n"))
    pair = table(spark, folder, "personal_pair_counts").distinct().groupBy("session_id", F.col("previous_word").alias("before"), F.col("current_word").alias("text")).agg(F.sum("n").alias("pair_n"))
    code = V.commits(spark, folder).where("observed <> ''").groupBy("session_id", "observed", "text").agg(F.count("*").alias("code_n"))
    rows = asked.join(word, ["session_id", "text"], "left").join(pair, ["session_id", "before", "text"], "left").join(code, ["session_id", "observed", "text"], "left")
    rows = rows.fillna(0, ["word_n", "pair_n", "code_n"])
    lift = F.least(F.col("pair_n"), F.lit(2))
    return rows.select("session_id", "before", "observed", "text", "word_n", "pair_n", "code_n", F.least(boost(F.col("word_n")) + lift, F.lit(3)).cast("bigint").alias("with_pair"), F.least(boost(F.col("word_n")) + boost(F.col("code_n")), F.lit(3)).cast("bigint").alias("hybrid"))


def discovery_slot(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each code a session typed, its preferred text put behind the first word that isn't protected, the length
    kept; with one word protected and fewer than three, nothing comes in."""
    pool = P._pool(spark, folder).groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("public_rank", "text"))), lambda x: x["text"]).alias("words"))
    own = P.preferred_text(spark, folder).join(pool, "code")
    n, at = F.size("words"), F.array_position("words", F.col("text"))
    slot = F.least(F.lit(2), n - 1)  # behind the protected word and the first ordinary one
    moved = F.concat(F.slice(F.array_remove("words", F.col("text")), F.lit(1), slot), F.array("text"), F.slice(F.array_remove("words", F.col("text")), slot + 1, n))
    shown = F.when((at > 0) & (at - 1 <= slot), F.col("words")).when((at == 0) & (n < 3), F.col("words")).otherwise(F.slice(moved, F.lit(1), n))
    return own.select("session_id", "code", F.array_join(shown, "|").alias("words"))


def candidate_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each code in pages, and where a reader that asks for the third page is put: at the last there is."""
    per = P._pool(spark, folder).groupBy("code").agg(F.count("*").alias("n"))
    start = F.when(F.lit(2 * PAGE) < F.col("n"), F.lit(2 * PAGE)).otherwise(F.floor((F.col("n") - 1) / PAGE) * PAGE)
    return per.select("code", "n", F.ceil(F.col("n") / PAGE).alias("n_pages"), start.cast("bigint").alias("start"))


def edit_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """The edit between a commit's code and the letters typed, in words."""
    own = V.commits(spark, folder).withColumn("intended", codec.full_code(F.replace("composition", F.lit("'"), F.lit(" ")))).where("observed <> '' and intended <> ''")
    edit = own.select("event_id", "observed", "intended", noisy.classify(F.col("observed"), F.col("intended")).alias("e")).where("e is not null").select("event_id", "observed", "intended", "e.*")
    i = F.col("place") + 1
    key = lambda text, at: F.substring(text, at, F.lit(1))
    # The sentences in which an edit is explained.
    said = (
        F.when(F.col("kind") == "exact", "原样匹配，没有纠错")
        .when(F.col("kind") == "neighbour", F.format_string("第 %d 键发生邻键替换：本想按 %s，实际按到 %s", i, key("intended", i), key("observed", i)))
        .when(F.col("kind") == "swap", F.format_string("第 %d、%d 键顺序颠倒：原顺序为 %s", i, i + 1, F.substring("intended", i, F.lit(2))))
        .when(F.col("kind") == "missing", F.format_string("第 %d 键遗漏：本应按 %s", i, key("intended", i)))
        .otherwise(F.format_string("第 %d 键多按：多出了 %s", i, key("observed", i)))
    )
    return edit.select("event_id", said.alias("said"))


def key_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """What a buffer of 128 keys holds once the keys of an event are in it: one key too many empties it, and then the keys are
    no longer complete."""
    n = F.size("keys")
    own = V.events(spark, folder, "keys").where(n > 0).select(n.alias("n"))
    kept = (F.col("n") - 1) % MOST_KEYS + 1
    return own.groupBy("n").agg(F.count("*").alias("n_events"), F.max(kept).alias("kept"), F.max(F.floor((F.col("n") - 1) / MOST_KEYS)).alias("resets"))


def composition_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Compositions of a segment in order: each goes on with the one before if either begins with the other, else it is a new
    one; an empty one changes nothing."""
    own = P._read(spark, folder, "session_id", "segment_seq", "pos", "composition").where("composition <> ''")
    before = F.lag("composition").over(P._segment())
    kind = F.when(before.isNull(), "first").when(F.startswith("composition", before) | F.startswith(before, F.col("composition")), "same").otherwise("new")
    return own.withColumn("state", kind).groupBy("state").agg(F.count("*").alias("n"))


def recorder_failure(spark: SparkSession, folder: str) -> DataFrame:
    """Segments as a recorder keeps them that stays failed: events up to the first that breaks a rule (clock, keys, number),
    the reason, and how many are refused from there on."""
    w = P._segment()
    own = P._read(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "keys")
    fault = F.when(F.lag("elapsed_ms").over(w) > F.col("elapsed_ms"), "clock").when(F.size("keys") > MOST_KEYS, "keys").when(F.row_number().over(w) > MOST_EVENTS, "events")
    marked = own.withColumn("fault", fault).withColumn("at", F.row_number().over(w))
    per = marked.groupBy("session_id", "segment_seq").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("at", "fault"))).alias("first"), F.count("*").alias("n"))
    kept = F.coalesce(F.col("first.at") - 1, F.col("n"))
    return per.select("session_id", "segment_seq", kept.cast("bigint").alias("n_recorded"), (F.col("n") - kept).cast("bigint").alias("n_refused"), F.col("first.fault").alias("reason"))


def held_out_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of two to four Han characters that are no word, all of whose characters are: each once, where it stands first."""
    known = V.words(spark, folder).select("text").distinct()
    forms = V.spoken(spark, folder).select("id", F.posexplode("items").alias("pos", "text")).where(F.col("text").rlike(r"\A[㐀-䶿一-鿿]{2,4}\z"))
    first = forms.join(known, "text", "left_anti").groupBy("text").agg(F.min(F.struct("id", "pos")).alias("v"))
    letters = first.select("text", F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c")).distinct()
    lacking = letters.join(known.withColumnRenamed("text", "c"), "c", "left_anti").select("text").distinct()
    return first.join(lacking, "text", "left_anti").select("text", "v.id", "v.pos")


def loose_commit_words(spark: SparkSession, folder: str) -> DataFrame:
    """Commits of words that stand in no run of commits: what is learned from them, per word."""
    own = V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms", "kind", "change")
    runs = E.windows(own, P.GAP).withColumn("n", F.count("*").over(Window.partitionBy("session_id", "segment_seq", "window_no"))).where("n > 1").select("event_id")
    loose = own.where("kind = 'Commit'").select("event_id", F.col("change.inserted").alias("text")).where("text <> ''").join(runs, "event_id", "left_anti")
    return loose.join(V.words(spark, folder).select("text").distinct(), "text").groupBy("text").agg(F.count("*").alias("n"))


def stroke_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Codes typed that are strokes, in canonical letters: u is s and v is z."""
    plain = F.when(F.col("observed").rlike(r"\A[hspnzuv]+\z"), F.translate("observed", "uv", "sz"))
    return V.observed(spark, folder).select("observed", plain.alias("strokes")).where("strokes is not null")


def layer_changes(spark: SparkSession, folder: str) -> DataFrame:
    """With 0 to 3 supplemental words a code: codes whose six first words change, and whose first word does."""
    rows = corpus._layers(spark, folder, 3)
    core = rows.where("source = 'core'")
    plain = L.ranked(core, ["code"], F.asc("band"), F.asc("band_rank"), F.asc("text"), limit=6).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"].alias("plain"))
    caps = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cap")).where((F.col("band") != 2) | (F.col("band_rank") <= F.col("cap")))
    shown = L.ranked(caps, ["code", "cap"], F.asc("band"), F.asc("band_rank"), F.asc("text"), limit=6).groupBy("cap", "code").agg(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"].alias("shown"))
    both = shown.join(plain, "code")
    return both.groupBy("cap").agg(F.count("*").alias("n_codes"), F.count_if(F.col("shown") != F.col("plain")).alias("n_changed"), F.count_if(F.get("shown", F.lit(0)) != F.get("plain", F.lit(0))).alias("n_first_changed"))


def character_readings(spark: SparkSession, folder: str) -> DataFrame:
    """The reading that each single character is looked up by: the most frequent one."""
    return L.best_by_text(V.words(spark, folder).where(F.char_length("text") == 1)).select("text", "pinyin", "code", "frequency")


def best_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    """Of the ways to cut a sentence that reads a code, the best by score and a third of the mean ln(1 + count) of its
    transitions; ties by the strongest transition, then the score."""
    found = corpus.sentence_variants(spark, folder).where("unresolved = 0 and not used_error")
    keys = ["observed", "rank", "text", "score"]
    steps = language.transitions(found, "segments", *keys).join(_pair_counts(spark, folder), ["prev", "cur"], "left")
    features = steps.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("strongest"), (F.sum(F.log1p(F.coalesce("n", F.lit(0)))) / F.count("*")).alias("bonus"))
    rows = found.join(features, keys, "left").fillna(0, ["strongest", "bonus"]).withColumn("context", F.round(F.col("score") + F.col("bonus") / 3, 6))
    return L.first_by(rows, ["observed", "text"], F.desc("context"), F.desc("strongest"), F.desc("score"), F.asc("rank")).select("observed", "text", F.array_join("segments", "|").alias("segments"), "strongest", "context")


def paint_coalescer(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of a segment's events, 40 ms apart, painted by a coalescer whose frames take 5 ms: how many are painted at once,
    by its timer and never, for five delays."""

    def step(key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        sizes = [row.n for row in rows]
        return [(delay, *M.coalesced(sizes, 40, 5, delay)) for delay in (16, 32, 48, 80, 120)]

    own = V.commits(spark, folder).where("observed <> ''").select("session_id", "segment_seq", "pos", "event_id", F.length("observed").alias("n"))
    found = M.fold(own, ["session_id", "segment_seq"], ["pos", "event_id"], step, "session_id string, segment_seq bigint, delay bigint, at_once bigint, by_timer bigint, never bigint")
    return found.groupBy("delay").agg(*(F.sum(c).alias(c) for c in ("at_once", "by_timer", "never")))


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    """Selections of all sessions in batches of a segment, in the order of the segments."""
    own = P._read(spark, folder, "session_id", "segment_seq", "pos", "kind", "inserted", "code").where("kind = 'Commit' and code <> '' and inserted <> ''")
    rows = own.select(F.col("segment_seq").alias("created"), F.col("session_id").alias("process"), F.lit(0).alias("sequence"), F.struct("pos", "event_id").cast("struct<pos: int, event_id: bigint>").alias("at"), "code", F.col("inserted").alias("text"))
    rows = rows.withColumn("number", F.concat(F.lpad(F.col("at.pos").cast("string"), 10, "0"), F.lit("-"), F.lpad(F.col("at.event_id").cast("string"), 19, "0"))).drop("at")
    return cut(snapshots.name_batches(rows, "created", "process", "sequence"))


def checkpoint_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Memory loaded and refreshed in five situations: by which way, from how many batches and selections, and whether the
    state is that of a full replay."""
    every = _batches(spark, folder)
    middle = every.agg(F.max("created")).first()[0]
    old = every.where(F.col("created") < F.lit(middle))
    first, whole = snapshots.full(old), snapshots.full(every)
    late = snapshots.full(every.where(F.col("created") >= F.lit(middle)))
    found = {
        "tail_after": (snapshots.load(every, [first]), every), "tail_before": (snapshots.load(every, [late]), every), "foreign_names": (snapshots.load(old, [whole]), old),
        "refresh_same": (snapshots.refresh(every, whole, []), every), "refresh_tail": (snapshots.refresh(every, first, []), every), "refresh_lost": (snapshots.refresh(old, whole, [first]), old),
    }
    rows = None
    for name, (memory, source) in found.items():
        want = snapshots.fold(source).withColumnsRenamed({"n": "m", "last": "end"})
        both = memory.state.join(want, ["code", "text"], "full")
        one = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_selections"), F.bool_and(F.equal_null("n", "m") & F.equal_null("last", "end")).alias("whole")).select(F.lit(name).alias("situation"), F.lit(memory.way).alias("way"), "n_selections", F.coalesce("whole", F.lit(True)).alias("whole"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def recent_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The 8,192 entries of all sessions' memory that were chosen last, per code: how many, and the text preferred."""
    state = snapshots.recent(snapshots.fold(_batches(spark, folder)), M.LONG)
    return state.groupBy("code").agg(F.count("*").alias("n_entries"), F.sum("n").alias("n")).join(snapshots.preferred(state).select("code", "text"), "code")


_REPORT = ", ".join(f"{c} bigint" for c in A.REPORT)


def scenario_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Six scenarios under four profiles: the report of each."""
    grid = spark.createDataFrame([(s, p) for s in A.SCENARIOS for p in A.PROFILES], "scenario string, profile string")

    def run(batches):
        for frame in batches:
            rows = [(s, p, *(report[c] for c in A.REPORT)) for s, p in zip(frame["scenario"], frame["profile"]) for report in (A.replay(A.scenario(s), A.PROFILES[p]),)]
            yield pd.DataFrame(rows, columns=["scenario", "profile", *A.REPORT])

    return grid.mapInPandas(run, f"scenario string, profile string, {_REPORT}")


def adaptive_report(spark: SparkSession, folder: str) -> DataFrame:
    """All sessions replayed under four profiles with the words of each code as pool: the end of a segment confirms, a text
    that a revision takes back without another in its place is forgotten."""
    lists = P._pool(spark, folder).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("public_rank", "text", "frequency"))).alias("pool"))
    own = P._read(spark, folder, "session_id", "segment_seq", "pos", "kind", "start", "deleted", "inserted", "reliable", "code")

    def events(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment = None
        for row in rows:
            if segment is not None and row.segment_seq != segment:
                yield ("confirm",)
            segment = row.segment_seq
            if not row.reliable:
                continue
            if row.deleted or row.inserted:
                yield ("edit", row.start, len(row.deleted), len(row.inserted))
            if row.kind == "Commit" and row.code and row.inserted:
                yield ("commit", row.code, row.inserted, row.start, [(c["text"], float(c["frequency"])) for c in row.pool or ()])
            elif row.kind == "Revision" and row.deleted and not row.inserted and row.code:
                yield ("forget", row.code, row.deleted)

    def step(key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        return [(name, *(report[c] for c in A.REPORT)) for name, report in A.replay_all(events(rows), A.PROFILES).items()]

    found = M.fold(own, ["session_id"], ["segment_seq", "pos", "event_id"], step, f"session_id string, profile string, {_REPORT}", lists)
    return found.groupBy("profile").agg(*(F.sum(c).alias(c) for c in A.REPORT))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_ids, runtime_layers, provenance_check, evidence_prefix_scan, config_validation, span_recovery, swap_recovery_sentences, sentence_recall, labelled_rejection_sweep, character_oracle, summary_configurations, rank_histogram,
        gate_outcomes, decode_checksum, pair_features, cache_evidence, discovery_slot, candidate_pages, edit_explanations, key_buffer, composition_sessions, recorder_failure, held_out_tokens, loose_commit_words, stroke_letters, layer_changes,
        character_readings, best_segmentation, paint_coalescer, checkpoint_loads, recent_entries, scenario_suite, adaptive_report,
    )
}

_LEX, _OBS, _DEC = "WITH RECURSIVE " + V.LEX, "WITH RECURSIVE " + V.LEX + ", " + V.EVENTS, "WITH RECURSIVE " + V.DECODED
_BEST = "bt AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY text ORDER BY frequency DESC, pinyin, code) = 1)"
_WAYS = f"{_BEST}, wy AS (SELECT text, code, frequency, 'full' AS strategy, code AS own FROM bt UNION ALL SELECT text, code, frequency, 'anchored', {_ANCHORED} FROM bt UNION ALL SELECT text, code, frequency, 'conservative', {_CONSERVATIVE} FROM bt UNION ALL SELECT text, code, frequency, 'short', {_SHORT} FROM bt)"
_PAIRS = "pp AS (SELECT previous_word AS prev, current_word AS cur, sum(n) AS n FROM (SELECT DISTINCT * FROM personal_pair_counts) GROUP BY 1, 2)"
_ALIAS = "(WITH RECURSIVE g AS (SELECT intended AS observed, '' AS code, 0 AS done FROM {asked} WHERE length(intended) % 2 = 0 UNION ALL SELECT observed, code || CASE WHEN o.v = 1 THEN substr(observed, done + 1, 1) || 'v' ELSE substr(observed, done + 1, 2) END, done + 2 FROM g, (VALUES (0), (1)) o(v) WHERE done < length(observed) AND (o.v = 0 OR regexp_full_match(substr(observed, done + 1, 2), '[jqxy]u'))) SELECT DISTINCT observed, code FROM g WHERE done = length(observed))"


def _packages(name: str, tag: str) -> str:
    return f"{V.renamed(V.RAW.format(table=name), tag)}, pk{tag} AS (SELECT package_id, count(*) FILTER (reason IS NULL) AS n_ok, count(reason) AS n_bad FROM ent{tag} JOIN (SELECT entry_id, min(package_id) AS package_id FROM {name} WHERE package_id IS NOT NULL GROUP BY 1) USING (entry_id) GROUP BY 1)"


SQL = {
    "sentence_ids": "WITH p AS (SELECT id, count(*) AS n, max(coalesce(len(tokens), 0)) AS size FROM ud_sentences WHERE id IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_deliveries, count(*) AS n_ids, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (size = 0) AS n_empty FROM p",
    "runtime_layers": f"WITH {_packages('technical_overlay', 'a')}, {_packages('technical_overlay_mirror', 'b')} SELECT a.package_id, CASE WHEN b.package_id IS NULL THEN 'off' WHEN b.n_bad > 0 THEN 'core_only' ELSE 'on' END AS status, a.n_ok + CASE WHEN b.n_bad = 0 THEN b.n_ok ELSE 0 END AS n_loaded FROM pka a LEFT JOIN pkb b ON a.package_id = b.package_id",
    "provenance_check": "SELECT package_id, sha256('schema=package-1' || chr(10) || 'revision=' || package_id || chr(10) || 'payload=' || digest || chr(10) || 'entries=' || entry_count) AS manifest_sha256, true AS holds FROM (" + extras.SQL["manifest_check"] + ")",
    "evidence_prefix_scan": _EV + f", {_SEL}, c AS (SELECT DISTINCT session_id, code FROM sl) SELECT s.session_id, s.code AS short, f.code AS entry FROM c s JOIN c f ON s.session_id = f.session_id AND left(s.code, 2) = left(f.code, 2) WHERE length(s.code) >= 3 AND length(f.code) % 2 = 0 AND length(f.code) > length(s.code) AND 2 * length(s.code) > length(f.code) AND s.code = left(f.code, 2 * length(s.code) - length(f.code)) || coalesce(list_aggregate(list_transform(range(2 * length(s.code) - length(f.code) + 1, length(f.code), 2), lambda i: substr(f.code, i, 1)), 'string_agg', ''), '')",
    "config_validation": "SELECT max_mix::DOUBLE AS max_mix, saturation::DOUBLE AS saturation, smoothing::DOUBLE AS smoothing, recent::DOUBLE AS recent, medium::DOUBLE AS medium, long::DOUBLE AS long, max_mix >= 0 AND max_mix < 1 AND saturation > 0 AND smoothing > 0 AND recent > 0 AND long >= 0 AND recent >= medium AND medium >= long AS valid FROM (VALUES (-0.1), (0.25), (1.0)) a(max_mix), (VALUES (0.0), (4.0)) b(saturation), (VALUES (0.0), (0.5)) c(smoothing), (VALUES (0.0), (4.0)) d(recent), (VALUES (2.0), (5.0)) e(medium), (VALUES (-1.0), (1.0), (3.0)) f(long)",
    "span_recovery": _OBS + f""", ok AS (SELECT observed FROM obs WHERE length(observed) % 2 = 0 AND length(observed) <= {SWAP_KEYS}),
ask AS (SELECT observed, CAST(i AS INTEGER) AS first, 1 AS n_syllables, left(observed, i * 2) || substr(observed, i * 2 + 2, 1) || substr(observed, i * 2 + 1, 1) || substr(observed, i * 2 + 3) AS intended FROM ok, range(0, length(observed) // 2) r(i) WHERE substr(observed, i * 2 + 1, 1) <> substr(observed, i * 2 + 2, 1)
  UNION ALL SELECT observed, 0, 2, observed[2] || observed[1] || observed[4] || observed[3] FROM ok WHERE length(observed) = 4 AND observed[1] <> observed[2] AND observed[3] <> observed[4]),
f AS (SELECT a.observed AS intended, text, lex.code, frequency FROM {_ALIAS.format(asked='ask')} a JOIN lex USING (code) QUALIFY row_number() OVER (PARTITION BY a.observed, text ORDER BY frequency DESC, lex.code) = 1),
r AS (SELECT intended, row_number() OVER (PARTITION BY intended ORDER BY frequency DESC, text, code) AS rank, text FROM f QUALIFY rank <= {SWAP_DEPTH}), h AS (SELECT * FROM ask WHERE intended IN (SELECT intended FROM r))
SELECT observed, first, n_syllables, intended, rank, text FROM h JOIN r USING (intended) WHERE n_syllables = 1 OR observed NOT IN (SELECT observed FROM h WHERE n_syllables = 1)""",
    "labelled_rejection_sweep": _DEC + """, w AS (SELECT observed, max(text) AS expected FROM com WHERE observed <> '' GROUP BY 1), m AS (SELECT w.observed, coalesce(d.text = expected, false) AS ok, round((d.score + 8.0 * length(w.observed)) / length(w.observed), 6) AS margin FROM w LEFT JOIN dec d ON d.observed = w.observed AND d.rank = 1)
SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (ok) AS n_right, count(*) FILTER (ok AND coalesce(margin >= t, false)) AS right_accepted, count(*) FILTER (NOT ok) AS n_wrong, count(*) FILTER (NOT ok AND NOT coalesce(margin >= t, false)) AS wrong_rejected, count(*) FILTER (NOT ok AND margin IS NOT NULL) AS wrong_with_margin FROM m, range(0, 9) r(t) GROUP BY 1""",
    "character_oracle": _DEC + f""", {V.UD}, {_CHARS}, {_CBI}, w AS (SELECT event_id, com.observed, com.text AS answer, d.text AS base FROM com JOIN dec d ON d.observed = com.observed AND d.rank = 1 WHERE com.observed <> '' AND com.text <> '' AND com.text <> d.text),
tx AS (SELECT text, list_concat(['^'], string_split(text, ''), ['$']) AS items FROM (SELECT answer AS text FROM w UNION SELECT base FROM w)), st AS (SELECT text, items[i] AS prev, items[i + 1] AS cur, count(*) AS times FROM tx, range(1, len(items)) r(i) GROUP BY 1, 2, 3),
sc AS (SELECT text, sum(times) AS n, round(sum(times * ln((coalesce(bg.n, 0) + 0.5) / (coalesce(t.total, 0) + 0.5 * (SELECT count(DISTINCT f) FROM (SELECT unnest(items) AS f FROM chs WHERE split = 'train'))))), 6) AS s FROM st LEFT JOIN bg USING (prev, cur) LEFT JOIN (SELECT DISTINCT prev, total FROM bg) t USING (prev) GROUP BY 1)
SELECT CASE WHEN length(answer) > length(base) THEN 'answer' WHEN length(answer) < length(base) THEN 'base' ELSE 'same' END AS longer, CASE WHEN a.s > b.s THEN 'answer' WHEN a.s < b.s THEN 'base' ELSE 'tie' END AS whole,
CASE WHEN round(a.s / a.n, 6) > round(b.s / b.n, 6) THEN 'answer' WHEN round(a.s / a.n, 6) < round(b.s / b.n, 6) THEN 'base' ELSE 'tie' END AS mean, count(*) AS n FROM w JOIN sc a ON a.text = answer JOIN sc b ON b.text = base GROUP BY ALL""",
    "summary_configurations": f"WITH {V.EVENTS}, s AS (SELECT session_id, count(DISTINCT producer_version) AS v, min(producer_version) AS p, count(*) AS n, count(*) FILTER (kind = 'Commit') AS c, max(elapsed_ms) AS e FROM ev GROUP BY 1) SELECT CASE WHEN v = 1 THEN p ELSE '(mixed)' END AS configuration, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(c) AS BIGINT) AS n_commits, CAST(sum(e) AS BIGINT) AS elapsed_ms FROM s GROUP BY 1",
    "rank_histogram": _LEX + f", {_WAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy, own ORDER BY frequency DESC, text) AS rank FROM wy) SELECT strategy, count(*) AS attempts, CAST(sum(length(own)) AS BIGINT) AS n_keys, " + ", ".join(f"count(*) FILTER (rank <= {k}) AS top{k}" for k in (1, 5, 10)) + ", " + ", ".join(f"count(*) FILTER (rank = {k}) AS at_{k}" for k in range(1, 11)) + " FROM r GROUP BY 1",
    "gate_outcomes": _LEX + f""", {_WAYS}, f AS (SELECT *, count(*) OVER (PARTITION BY strategy, own) AS fan FROM wy WHERE strategy IN ('anchored', 'conservative') AND length(code) >= 4), e AS (SELECT *, CASE WHEN fan <= most THEN own ELSE code END AS typed FROM f, (VALUES (0, 0), (1, 1), (2, 2), (3, 4), (4, 8), (5, 16), (6, 1073741824)) v(gate, most)),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy, gate, typed ORDER BY frequency DESC, text) AS a, row_number() OVER (PARTITION BY strategy, gate, code ORDER BY frequency DESC, text) AS b FROM e)
SELECT strategy, gate, count(*) AS n, CAST(sum(length(code) - length(typed)) AS BIGINT) AS keys_saved, count(*) FILTER (a = 1 AND b > 1) AS gained, count(*) FILTER (a > 1 AND b = 1) AS lost, count(*) FILTER (a <= 10 AND b > 10) AS recovered, count(*) FILTER (a > 10 AND b <= 10) AS dropped FROM r GROUP BY 1, 2""",
    "decode_checksum": _DEC + " SELECT observed, CAST(sum((strlen(text) + length(spelling)) * pow(31::DOUBLE, n - rank)::BIGINT) AS BIGINT) AS checksum FROM (SELECT *, count(*) OVER (PARTITION BY observed) AS n FROM dec WHERE rank <= 10) GROUP BY 1",
    "pair_features": "WITH " + V.UD + f", {_PAIRS}, t AS (SELECT id, items[i] AS prev, items[i + 1] AS cur FROM spk, range(1, len(items)) r(i)) SELECT id, CAST(coalesce(max(n), 0) AS BIGINT) AS strongest, round(sum(ln(1 + coalesce(n, 0))) / count(*), 6) AS bonus FROM t LEFT JOIN pp USING (prev, cur) GROUP BY 1",
    "cache_evidence": f"""WITH RECURSIVE {V.EVENTS}, {_POOL}, b AS (SELECT DISTINCT session_id, before, observed FROM (SELECT *, lag(text) OVER (PARTITION BY session_id, segment_seq ORDER BY pos, event_id) AS before FROM com WHERE observed <> '') WHERE before IS NOT NULL),
w AS (SELECT session_id, word AS text, sum(n) AS n FROM (SELECT DISTINCT * FROM personal_word_counts) GROUP BY 1, 2), p AS (SELECT session_id, previous_word AS before, current_word AS text, sum(n) AS n FROM (SELECT DISTINCT * FROM personal_pair_counts) GROUP BY 1, 2, 3), c AS (SELECT session_id, observed, text, count(*) AS n FROM com WHERE observed <> '' GROUP BY 1, 2, 3),
j AS (SELECT b.session_id, b.before, b.observed, pl.text, CAST(coalesce(w.n, 0) AS BIGINT) AS word_n, CAST(coalesce(p.n, 0) AS BIGINT) AS pair_n, coalesce(c.n, 0) AS code_n FROM b JOIN pl ON pl.code = b.observed AND pr <= 10 LEFT JOIN w ON w.session_id = b.session_id AND w.text = pl.text LEFT JOIN p ON p.session_id = b.session_id AND p.before = b.before AND p.text = pl.text LEFT JOIN c ON c.session_id = b.session_id AND c.observed = b.observed AND c.text = pl.text),
l AS (SELECT *, CASE WHEN word_n >= 4 THEN 3 WHEN word_n >= 2 THEN 2 WHEN word_n >= 1 THEN 1 ELSE 0 END AS a, CASE WHEN code_n >= 4 THEN 3 WHEN code_n >= 2 THEN 2 WHEN code_n >= 1 THEN 1 ELSE 0 END AS d FROM j)
SELECT session_id, before, observed, text, word_n, pair_n, code_n, CAST(least(a + least(pair_n, 2), 3) AS BIGINT) AS with_pair, CAST(least(a + d, 3) AS BIGINT) AS hybrid FROM l""",
    "discovery_slot": _EV + f""", {_SEL}, {_POOL}, ww AS (SELECT code, list(text ORDER BY pr) AS ws FROM pl GROUP BY 1), pt AS (SELECT session_id, code, text FROM sl QUALIFY row_number() OVER (PARTITION BY session_id, code ORDER BY {_PREF}) = 1), j AS (SELECT *, coalesce(list_position(ws, text), 0) AS p, least(2, len(ws) - 1) AS s, list_filter(ws, lambda w: w <> text) AS rest FROM pt JOIN ww USING (code))
SELECT session_id, code, array_to_string(CASE WHEN p > 0 AND p - 1 <= s THEN ws WHEN p = 0 AND len(ws) < 3 THEN ws ELSE list_concat(rest[1:s], [text], rest[s + 1:])[1:len(ws)] END, '|') AS words FROM j""",
    "candidate_pages": f"WITH RECURSIVE {_POOL} SELECT code, count(*) AS n, (count(*) + {PAGE - 1}) // {PAGE} AS n_pages, CASE WHEN count(*) > {2 * PAGE} THEN {2 * PAGE} ELSE (count(*) - 1) // {PAGE} * {PAGE} END AS start FROM pl GROUP BY 1",
    "edit_explanations": f"WITH {V.EVENTS}, {V.NEAR}, {_INTENDED}, {_KINDS} SELECT event_id, CASE kind WHEN 'exact' THEN '原样匹配，没有纠错' WHEN 'neighbour' THEN '第 ' || (f + 1) || ' 键发生邻键替换：本想按 ' || substr(intended, f + 1, 1) || '，实际按到 ' || substr(observed, f + 1, 1) WHEN 'swap' THEN '第 ' || (f + 1) || '、' || (f + 2) || ' 键顺序颠倒：原顺序为 ' || substr(intended, f + 1, 2) WHEN 'missing' THEN '第 ' || (f + 1) || ' 键遗漏：本应按 ' || substr(intended, f + 1, 1) ELSE '第 ' || (f + 1) || ' 键多按：多出了 ' || substr(observed, f + 1, 1) END AS said FROM knd WHERE kind IS NOT NULL AND intended <> ''",
    "key_buffer": f"WITH {V.EVENTS} SELECT CAST(len(keys) AS INTEGER) AS n, count(*) AS n_events, CAST((len(keys) - 1) % {MOST_KEYS} + 1 AS INTEGER) AS kept, (len(keys) - 1) // {MOST_KEYS} AS resets FROM ev WHERE len(keys) > 0 GROUP BY len(keys)",
    "composition_sessions": _EV + " SELECT CASE WHEN b IS NULL THEN 'first' WHEN starts_with(composition, b) OR starts_with(b, composition) THEN 'same' ELSE 'new' END AS state, count(*) AS n FROM (SELECT composition, lag(composition) OVER (PARTITION BY session_id, segment_seq ORDER BY pos, event_id) AS b FROM fl WHERE composition <> '') GROUP BY 1",
    "recorder_failure": _EV + f", m AS (SELECT session_id, segment_seq, row_number() OVER w AS k, CASE WHEN lag(elapsed_ms) OVER w > elapsed_ms THEN 'clock' WHEN len(keys) > {MOST_KEYS} THEN 'keys' WHEN row_number() OVER w > {MOST_EVENTS} THEN 'events' END AS fault FROM fl WINDOW w AS (PARTITION BY session_id, segment_seq ORDER BY pos, event_id)), p AS (SELECT session_id, segment_seq, min(k) FILTER (fault IS NOT NULL) AS a, arg_min(fault, k) FILTER (fault IS NOT NULL) AS reason, count(*) AS n FROM m GROUP BY 1, 2) SELECT session_id, segment_seq, coalesce(a - 1, n) AS n_recorded, n - coalesce(a - 1, n) AS n_refused, reason FROM p",
    "held_out_tokens": _LEX + f", {V.UD}, t AS (SELECT id, unnest(items) AS text, generate_subscripts(items, 1) - 1 AS pos FROM spk), k AS (SELECT DISTINCT text FROM lex), f AS (SELECT text, min(struct_pack(id := id, pos := pos)) AS v FROM t WHERE regexp_full_match(text, '[㐀-䶿一-鿿]{{2,4}}') AND text NOT IN (SELECT text FROM k) GROUP BY 1) SELECT text, v.id AS id, CAST(v.pos AS INTEGER) AS pos FROM f WHERE list_has_all((SELECT coalesce(list(text), []) FROM k WHERE length(text) = 1), string_split(text, ''))".replace("{{2,4}}", "{2,4}"),
    "stroke_letters": f"WITH {V.EVENTS} SELECT observed, translate(observed, 'uv', 'sz') AS strokes FROM obs WHERE regexp_full_match(observed, '[hspnzuv]+')",
    "character_readings": _LEX + f", {_BEST} SELECT text, pinyin, code, frequency FROM bt WHERE length(text) = 1",
}
SQL["loose_commit_words"] = _EV + f", {_RUNS}, {V.LEX}, w AS (SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY session_id, segment_seq, wn) AS n FROM rn) WHERE n > 1) SELECT inserted AS text, count(*) AS n FROM fl WHERE kind = 'Commit' AND inserted <> '' AND event_id NOT IN (SELECT event_id FROM w) AND inserted IN (SELECT text FROM lex) GROUP BY 1"
SQL["layer_changes"] = _LAYERS + """, r AS (SELECT code, CASE WHEN r = 1 THEN 1 ELSE 3 END AS band, r, text FROM co), s AS (SELECT code, 2 AS band, r, text FROM nv WHERE r <= 3),
p AS (SELECT code, list(text ORDER BY k) AS plain FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY band, r, text) AS k FROM r) WHERE k <= 6 GROUP BY 1), c AS (SELECT r.*, cap FROM r, range(0, 4) t(cap) UNION ALL SELECT s.*, cap FROM s, range(0, 4) t(cap) WHERE r <= cap),
m AS (SELECT code, cap, list(text ORDER BY k) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY code, cap ORDER BY band, r, text) AS k FROM c) WHERE k <= 6 GROUP BY 1, 2)
SELECT CAST(cap AS INTEGER) AS cap, count(*) AS n_codes, count(*) FILTER (shown <> plain) AS n_changed, count(*) FILTER (shown[1] <> plain[1]) AS n_first_changed FROM m JOIN p USING (code) GROUP BY 1"""
_CHOSEN = "ch AS (SELECT segment_seq, session_id, pos, event_id, code, inserted AS text FROM fl WHERE kind = 'Commit' AND code <> '' AND inserted <> '')"
SQL["checkpoint_loads"] = _EV + f", {_CHOSEN}, m AS (SELECT max(segment_seq) AS s FROM ch), n AS (SELECT count(*) AS a, count(*) FILTER (segment_seq < s) AS o FROM ch, m) SELECT situation, way, CASE WHEN older THEN o ELSE a END AS n_selections, true AS whole FROM n, (VALUES ('tail_after', 'checkpoint', false), ('tail_before', 'full', false), ('foreign_names', 'full', true), ('refresh_same', 'same', false), ('refresh_tail', 'tail', false), ('refresh_lost', 'checkpoint', true)) v(situation, way, older)"
SQL["recent_entries"] = _EV + f", {_CHOSEN}, s AS (SELECT code, text, count(*) AS n, max(struct_pack(a := segment_seq, b := session_id, c := pos, d := event_id)) AS last FROM ch GROUP BY 1, 2 ORDER BY last DESC, code, text LIMIT {M.LONG}) SELECT code, count(*) AS n_entries, CAST(sum(n) AS BIGINT) AS n, first(text ORDER BY least(n, 4) DESC, last DESC, n DESC, text) AS text FROM s GROUP BY 1"
