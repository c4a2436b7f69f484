"""Queries on transitions, sentences and re-ranked words."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweir.functions import codec
from glyphweir.functions.scoring import BIGRAM_SHARE, UNIGRAM_SHARE, boost, conditional
from glyphweir.operators import language, lattice, noisy, readings, sampling
from glyphweir.operators import lexicon as L
from glyphweir.operators.sieve import filter_of, passes
from glyphweir.plans import views as V
from glyphweir.plans.decoding import _pool
from glyphweir.session import block_count, cut, shuffle_width, shuffled, unfolded
from glyphweir.sources.tables import table

#: Words of a span and layer that a reading with transitions over short and mistyped spellings may use.
NOISY_KEPT = 3
#: Logarithms of whole numbers below this differ in the ninth place.
EXACT = 300_000_000
#: Bytes of events whose codes make a cell of protocol_context.
CELL_BYTES = 8 << 20


def bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return language.bigrams(V.spoken(spark, folder, ("train",))).select("prev", "cur", "n", "total")


def bigram_score(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out sentences scored by the transitions of the training split."""
    train = language.bigrams(V.spoken(spark, folder, ("train",)))
    size = V.spoken(spark, folder, ("train",)).select(F.explode("items").alias("f")).agg(F.count_distinct("f")).scalar()
    return language.score_sequences(V.spoken(spark, folder, ("dev", "test")), "id", "items", train, size)


def _characters(spark: SparkSession, folder: str, *splits: str) -> DataFrame:
    own = V.spoken(spark, folder, splits).select("id", F.array_join("items", "").alias("text")).where("text <> ''")
    return own.select("id", language.characters(F.col("text")).alias("items"))


def char_bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return language.bigrams(_characters(spark, folder, "train")).select("prev", "cur", "n", "total")


def char_text_score(spark: SparkSession, folder: str) -> DataFrame:
    train = _characters(spark, folder, "train")
    size = train.select(F.explode("items").alias("c")).agg(F.count_distinct("c")).scalar()
    return language.score_sequences(_characters(spark, folder, "dev", "test"), "id", "items", language.bigrams(train), size)


def lm_stats(spark: SparkSession, folder: str) -> DataFrame:
    own = V.spoken(spark, folder, ("train",))
    pairs = language.transitions(own)
    size = own.select(F.explode("items").alias("f")).agg(F.count_distinct("f")).scalar()
    return pairs.agg(F.count_distinct("prev", "cur").alias("n_types"), F.count("*").alias("n_instances"), F.count_distinct("prev").alias("n_contexts")).withColumn("vocabulary", size)


def lattice_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Full-code edges of all typed codes, per code."""
    edges = lattice.exact_edges(V.observed(spark, folder), V.words(spark, folder))
    return edges.groupBy("observed").agg(F.count("*").alias("n_edges"), F.count_distinct("low").alias("n_starts"), F.max("high").alias("furthest"))


def noisy_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Clean and corrected edges of the typed codes, kept per part, by kind of edge."""
    edges = lattice.noisy_edges(V.observed(spark, folder), V.words(spark, folder), 5)
    return edges.groupBy("kind", "abbreviated").agg(F.count("*").alias("n_edges"), F.count_distinct("observed").alias("n_codes"))


def complete_sentence(spark: SparkSession, folder: str) -> DataFrame:
    """The five best ways to read a typed code as words in full code."""
    words = V.words(spark, folder)
    found = lattice.sentences(lattice.exact_edges(V.observed(spark, folder), words, keep=20), words, top=5)
    return found.select("observed", "rank", "text", "score")


def sentence_kbest_unigram(spark: SparkSession, folder: str) -> DataFrame:
    """The three best sentences of every typed code, with short spellings, one edit and unresolved keys."""
    words, codes = V.words(spark, folder), V.observed(spark, folder)
    return lattice.sentences(lattice.noisy_edges(codes, words, 20), words, top=3, literals=True, codes=codes)


def _transitions(spark: SparkSession, folder: str, words: DataFrame) -> tuple[DataFrame, int]:
    """(prev, cur, n) of all caches between words, and the number of words."""
    known = words.select("text").distinct()
    pairs = table(spark, folder, "personal_pair_counts").distinct().groupBy(F.col("previous_word").alias("prev"), F.col("current_word").alias("cur")).agg(F.sum("n").alias("n"))
    return pairs, max(known.count(), 1)


def _with_transitions(spark: SparkSession, folder: str, codes: DataFrame, words: DataFrame, edges: DataFrame) -> DataFrame:
    pairs, size = _transitions(spark, folder, words)
    model = language.model(pairs, size)
    return lattice.sentences(edges, words, top=3, literals=True, codes=codes, model=model, transitions=pairs.where("prev is not null and cur is not null") if model is None else None, size=size)


def sentence_kbest_bigram(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the transitions of all caches, but on full codes at even places only: no short spellings, no edit."""
    words, codes = V.words(spark, folder), V.observed(spark, folder)
    return _with_transitions(spark, folder, codes, words, lattice.exact_edges(codes, words))


def sentence_kbest_bigram_noisy(spark: SparkSession, folder: str) -> DataFrame:
    """The same over short spellings and one edit as well; of a span the NOISY_KEPT best of each layer stay."""
    words, codes = V.words(spark, folder), V.observed(spark, folder)
    return _with_transitions(spark, folder, codes, words, lattice.noisy_edges(codes, words, NOISY_KEPT))


def sentence_lanes(spark: SparkSession, folder: str) -> DataFrame:
    words, codes = V.words(spark, folder), V.observed(spark, folder)
    return lattice.lanes(lattice.noisy_edges(codes, words, 20), words, top=5)


def sentence_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three ways to cut the same sentence into words."""
    words, top = V.words(spark, folder), 9
    return lattice.sentences(lattice.exact_edges(V.observed(spark, folder), _ahead(words, top)), words, top=top, per_text=3)


def _ahead(words: DataFrame, keep: int) -> DataFrame:
    """``words`` without those that ``keep`` others of the code surely precede in any sentence: as long and heavier, or as heavy
    and before them by text. A path over one of the rest has ``keep`` other texts before it. See EXACT."""
    placed = L.ranked(words.withColumn("n", F.length("text")), ["code", "n"], F.desc("frequency"), F.asc("text"), name="place")
    return placed.where((F.col("place") <= keep) | (F.col("frequency") >= EXACT)).drop("n", "place")


def literal_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Typed codes that no word begins: every key stays unresolved."""
    codes = V.observed(spark, folder)
    table_ = L.spelling_table(V.words(spark, folder)).select("spelling").distinct()
    parts = codes.select("observed", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("observed")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.length("observed") - i + 1, F.lit(lattice.SPELLING_LIMIT))), lambda n: F.substring("observed", i, n))))).alias("spelling")).distinct()
    spelled = parts.join(table_, "spelling", "left_semi").select("observed").distinct()
    text = F.array_join(F.transform(F.filter(F.split("observed", ""), lambda c: c != ""), lambda c: F.concat(F.lit("〔"), c, F.lit("〕"))), "")
    return codes.join(spelled, "observed", "left_anti").select("observed", text.alias("text"), F.round(-8.0 * F.length("observed"), 3).alias("score"))


def _cuts(codes: DataFrame) -> DataFrame:
    """(observed, at, c1, c2): codes cut in two behind each even place."""
    n = F.length("observed")
    cuts = codes.where((n >= 4) & (n % 2 == 0)).select("observed", F.explode(F.sequence(F.lit(2), n - 2, F.lit(2))).alias("at"))
    return unfolded(cuts.withColumn("c1", F.left("observed", F.col("at"))).withColumn("c2", F.substring("observed", F.col("at") + 1, n)))


def _first_of_each_text(entries: Column, keep: int) -> Column:
    """Of structs in order, the first of each text, and of these the first ``keep``."""
    texts = entries["text"]
    once = F.filter(entries, lambda e, i: F.array_position(texts, e["text"]) == i + 1)
    return F.slice(F.when(F.size(F.array_distinct(texts)) == F.size(entries), entries).otherwise(once), 1, keep)


def _two_words(codes: DataFrame, words: DataFrame, keep: int) -> DataFrame:
    """(observed, best) with the (cost, text, at) of the ``keep`` best texts of codes read as two words in full code, by score and text.

    The pairs of a cut are made in its row and only the best leave it. A word of ``ahead`` - 1 others that are heavier, or as
    heavy and long and before it, makes with any word texts that rank behind theirs: two words, behind ``a`` - 1 and ``b`` - 1
    such words, have a + b - 2 distinct texts before theirs at least, and so have none of the best if a + b - 1 > keep. Among
    words of one length pairs are distinct texts, so a * b - 1 of them stand before. Rounding makes no ties of whole
    frequencies below EXACT; heavier ones all stay."""
    best = L.best_by_text(words).select("text", "code", "frequency", F.length("text").alias("n"))
    heavier = F.rank().over(Window.partitionBy("code").orderBy(F.desc("frequency")))
    alike = F.row_number().over(Window.partitionBy("code", "frequency", "n").orderBy("text"))
    place = F.row_number().over(Window.partitionBy("code", "n").orderBy(F.desc("frequency"), "text"))
    free = F.col("frequency") >= EXACT
    kept = best.select("*", F.when(free, 1).otherwise(heavier + alike - 1).alias("ahead"), F.when(free, 1).otherwise(place).alias("place")).where(F.col("ahead") <= keep)
    lists = cut(kept.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("ahead", "place", "text", F.ln("frequency").alias("value")))).alias("own")))  # read three times
    known = filter_of(lists.select("code"), lists)
    cuts = unfolded(_cuts(codes).where(passes(known, F.col("c1")) & passes(known, F.col("c2"))))  # most cuts aren't between words
    rows = cuts.join(lists.select(F.col("code").alias("c1"), F.col("own").alias("a")), "c1").join(shuffled(lists.select(F.col("code").alias("c2"), F.col("own").alias("b"))), "c2")
    able = lambda x: lambda y: (x["ahead"] + y["ahead"] - 1 <= keep) & (x["place"] * y["place"] <= keep)
    pair = lambda x: lambda y: F.struct((-F.round(x["value"] + y["value"], 9)).alias("cost"), F.concat(x["text"], y["text"]).alias("text"))
    pairs = F.array_sort(F.flatten(F.transform("a", lambda x: F.transform(F.filter("b", able(x)), pair(x)))))
    made = rows.select("observed", "at", pairs.alias("pairs"))
    once = F.size(F.array_distinct(F.col("pairs")["text"])) == F.size("pairs")
    few = F.when(once, F.slice("pairs", 1, keep)).otherwise(F.col("pairs"))
    # A row for each cut, and not for each reading, is shuffled, once.
    cut_rows = made.select("observed", F.transform(few, lambda p: F.struct(p["cost"], p["text"], F.col("at").alias("at"))).alias("few"))
    found = cut_rows.groupBy("observed").agg(F.sort_array(F.flatten(F.collect_list("few"))).alias("every"))
    return found.select("observed", _first_of_each_text(F.col("every"), keep).alias("best"))


def _best_two_words(codes: DataFrame, words: DataFrame, keep: int) -> DataFrame:
    """(observed, rank, text, score, at) of the same."""
    each = F.transform("best", lambda e, i: F.struct((i + 1).alias("rank"), e["text"], (-e["cost"]).alias("score"), e["at"]))
    return _two_words(codes, words, keep).select("observed", F.inline(each))


def protocol_decode(spark: SparkSession, folder: str) -> DataFrame:
    """The five best readings of typed codes as two words."""
    return _best_two_words(V.observed(spark, folder), V.words(spark, folder), 5).select("observed", "rank", "text", F.round("score", 6).alias("score"))


def continuous_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Commits read as two words: rank of the text committed, and keys that a short last word would save."""
    own = cut(V.commits(spark, folder).where("observed <> ''").groupBy("observed", "text").agg(F.count("*").alias("times")))  # read twice
    readings_ = _two_words(own.select("observed").distinct(), V.words(spark, folder), 10)
    joined = own.join(shuffled(readings_), "observed", "left")
    place = F.array_position(F.col("best")["text"], F.col("text"))
    each = joined.select("observed", "times", F.when(place > 0, place).alias("rank"), F.when(place > 0, F.col("best")[F.when(place > 0, place - 1).cast("int")]["at"]).alias("at"))
    saved = (F.length("observed") - F.col("at")) / 2 - 1
    times = F.col("times")
    first = (F.coalesce(F.sum(F.when(F.col("rank") <= k, times)), F.lit(0)).alias(f"top{k}") for k in (1, 3, 5, 10))
    return each.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n"), *first, F.coalesce(F.sum(F.length("observed") * times), F.lit(0)).alias("n_keys"), F.coalesce(F.sum(saved * times), F.lit(0)).cast("bigint").alias("keys_saved"))


def interactive_query(spark: SparkSession, folder: str) -> DataFrame:
    """Words in full code, then pairs of one-syllable words, then two-word readings; a text once, at its first place."""
    words, codes = V.words(spark, folder), V.observed(spark, folder)
    exact = noisy.decode_exact(codes, words, 10).select("observed", F.lit(1).alias("lane"), "rank", "text")
    pool = _pool(words, 24)
    a, b = (pool.select(F.col("key").alias(f"k{i}"), F.col("part").alias(f"p{i}"), F.col("part_rank").alias(f"r{i}")) for i in (1, 2))
    pairs = codes.where(F.length("observed") == 4).withColumn("k1", F.left("observed", F.lit(2))).withColumn("k2", F.right("observed", F.lit(2))).join(a, "k1").join(b, "k2").withColumn("text", F.concat("p1", "p2"))
    pairs = L.ranked(L.first_by(pairs, ["observed", "text"], F.asc(F.col("r1") + F.col("r2")), F.asc("r1")), ["observed"], F.asc(F.col("r1") + F.col("r2")), F.asc("r1"), F.asc("text"), limit=50)
    two = _two_words(codes, words, 20).select("observed", F.transform("best", lambda e, i: F.struct(F.lit(3).alias("lane"), (i + 1).alias("rank"), e["text"])).alias("own"))
    every = exact.unionByName(pairs.select("observed", F.lit(2).alias("lane"), "rank", "text")).select("observed", F.array(F.struct("lane", "rank", "text")).alias("own")).unionByName(two)
    lanes = every.groupBy("observed").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("own"))
    each = lanes.select("observed", F.posexplode(_first_of_each_text(F.col("own"), 20)).alias("place", "own"))
    return each.select("observed", (F.col("place") + 1).alias("rank"), "own.lane", "own.text")


def _readings(codes: DataFrame, words: DataFrame, top: int, shortcuts: bool = False) -> DataFrame:
    """The ``top`` readings of codes as any number of words in full code under all their codes; with ``shortcuts`` the last may be short."""
    edges = lattice.shortcut_edges(codes, words, top) if shortcuts else lattice.exact_edges(codes, words, keep=top)
    return lattice.sentences(edges, words, top=top, spelled=True)


def _fixed_readings(parts: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """(id, rank, text, score) of sequences of codes (id, codes) whose words' bounds are fixed; none where a code has no word."""
    total = F.ln(words.agg(F.sum("frequency")).scalar())
    best = L.ranked(words, ["code"], F.desc("frequency"), F.asc("text"), limit=top).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("rank", "text", (F.ln("frequency") - total).alias("value")))).alias("own"))
    steps = unfolded(parts.select("id", F.size("codes").alias("n"), F.posexplode("codes").alias("pos", "code"))).join(best, "code")
    whole = steps.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "own"))).alias("steps")).where(F.size("steps") == F.col("n"))

    def run(batches):
        for frame in batches:
            rows = [(i, k, text, round(-cost, 6)) for i, steps in zip(frame["id"], frame["steps"]) for k, (cost, text) in enumerate(lattice.fixed_paths([[(w["text"], w["value"]) for w in s["own"]] for s in steps], top), 1)]
            yield pd.DataFrame(rows, columns=["id", "rank", "text", "score"])

    return whole.select("id", "steps").mapInPandas(run, "id string, rank int, text string, score double")


def protocol_decode_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The five best readings as any number of words: of typed codes in full, with a short last word, of sentences at fixed bounds."""
    words, codes = cut(V.words(spark, folder)), V.observed(spark, folder)  # words are read by each mode
    known = L.best_by_text(words).select("text", "code")
    forms = V.spoken(spark, folder).select("id", F.size("items").alias("n"), F.posexplode("items").alias("pos", "text"))
    coded = unfolded(forms.where(passes(filter_of(known.select("text"), words), F.col("text")))).join(known, "text")  # only what may be a word is shuffled
    parts = coded.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "code")))["code"].alias("codes")).where(F.size("codes") == F.col("n"))
    fixed = _fixed_readings(parts, words, 5).select(F.lit("fixed").alias("mode"), F.col("id").alias("observed"), "rank", "text", "score")
    return lattice.full_and_shortcut(codes, words, 5).unionByName(fixed)


def continuous_composition_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Commits read as any number of words: rank of the text committed, and keys that a short last word would save."""
    own = V.commits(spark, folder).where("observed <> ''")
    ranks = _readings(own, V.words(spark, folder), 10)
    joined = own.join(ranks.select("observed", "text", "rank", F.element_at("codes", -1).alias("last")), ["observed", "text"], "left")
    saved = F.length("last") / 2 - 1
    return joined.agg(F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 3, 5, 10)), F.coalesce(F.sum(F.length("observed")), F.lit(0)).alias("n_keys"), F.coalesce(F.sum(saved), F.lit(0)).cast("bigint").alias("keys_saved"))


def interactive_query_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Words in full code, pairs of one-syllable words, complete sentences, other resolved sentences; else the code itself."""
    words, codes = V.words(spark, folder), V.observed(spark, folder)
    exact = noisy.decode_exact(codes, words, 20).select("observed", F.lit(1).alias("lane"), "rank", "text")
    pool = _pool(words, 24)
    a, b = (pool.select(F.col("key").alias(f"k{i}"), F.col("part").alias(f"p{i}"), F.col("part_rank").alias(f"r{i}")) for i in (1, 2))
    pairs = codes.where(F.length("observed") == 4).withColumn("k1", F.left("observed", F.lit(2))).withColumn("k2", F.right("observed", F.lit(2))).join(a, "k1").join(b, "k2").withColumn("text", F.concat("p1", "p2"))
    pairs = L.ranked(L.first_by(pairs, ["observed", "text"], F.asc(F.col("r1") + F.col("r2")), F.asc("r1")), ["observed"], F.asc(F.col("r1") + F.col("r2")), F.asc("r1"), F.asc("text"), limit=50)
    # Earlier lanes hold twenty exact words at most, so forty sentences fill the rest.
    whole = _readings(codes, words, 40)
    other = lattice.sentences(lattice.noisy_edges(codes, words, 40), words, top=40, literals=True, codes=codes).where("unresolved = 0")
    every = exact.unionByName(pairs.select("observed", F.lit(2).alias("lane"), "rank", "text"))
    for lane, found in ((3, whole), (4, other)):
        every = every.unionByName(found.select("observed", F.lit(lane).alias("lane"), "rank", "text"))
    every = every.unionByName(codes.select("observed", F.lit(5).alias("lane"), F.lit(1).alias("rank"), F.col("observed").alias("text")))
    once = L.first_by(every.withColumnRenamed("rank", "lane_rank"), ["observed", "text"], F.asc("lane"), F.asc("lane_rank"))
    return L.ranked(once, ["observed"], F.asc("lane"), F.asc("lane_rank"), limit=20).where("lane < 5 or rank = 1").select("observed", "rank", "lane", "text")


def protocol_context_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best readings as any number of words, ranked without and with the caches' transitions: places of the texts committed."""
    pairs = table(spark, folder, "personal_pair_counts").distinct().groupBy(F.col("previous_word").alias("prev"), F.col("current_word").alias("cur")).agg(F.sum("n").alias("n"))
    wanted = V.commits(spark, folder).where("observed <> ''").select("observed", "text").distinct()
    pool = _readings(wanted, V.words(spark, folder), 10).select("observed", "text", "rank", "score", "segments")
    steps = language.transitions(pool.withColumn("items", F.col("segments")).select("observed", "text", "items"), "items", "observed", "text")
    gains = steps.join(pairs, ["prev", "cur"]).groupBy("observed", "text").agg(F.sum(F.log1p("n")).alias("gain"))
    rows = pool.join(gains, ["observed", "text"], "left").withColumn("context", F.round(F.col("score") + F.coalesce("gain", F.lit(0.0)), 6))
    placed = L.ranked(rows.withColumnRenamed("rank", "plain"), ["observed"], F.desc("context"), F.asc("plain"), name="aware")
    hits = wanted.join(placed.select("observed", "text", "plain", "aware"), ["observed", "text"])
    return hits.agg(F.count("*").alias("n"), F.count_if(F.col("plain") == 1).alias("plain_first"), F.count_if(F.col("aware") == 1).alias("aware_first"), F.count_if(F.col("aware") < F.col("plain")).alias("improved"), F.count_if(F.col("aware") > F.col("plain")).alias("worsened"))


def _layers(spark: SparkSession, folder: str, admitted: int) -> DataFrame:
    """(code, band, band_rank, text, source): the best core word, new supplemental words, the other core words."""
    core = L.ranked(L.first_by(V.words(spark, folder), ["code", "text"], F.desc("frequency")), ["code"], F.desc("frequency"), F.asc("text"), name="r")
    more = L.first_by(V.words(spark, folder, "technical_overlay_mirror"), ["code", "text"], F.desc("frequency"))
    novel = L.ranked(more.join(core.select("code", "text"), ["code", "text"], "left_anti"), ["code"], F.desc("frequency"), F.asc("text"), limit=admitted, name="r")
    bands = core.select("code", F.when(F.col("r") == 1, 1).otherwise(3).alias("band"), F.col("r").alias("band_rank"), "text", F.lit("core").alias("source"))
    return bands.unionByName(novel.select("code", F.lit(2).alias("band"), F.col("r").alias("band_rank"), "text", F.lit("supplement").alias("source")))


def layer_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Words per code: the best core word stays first, at most one supplemental word, then the rest of the core."""
    return L.ranked(_layers(spark, folder, 1), ["code"], F.asc("band"), F.asc("band_rank"), F.asc("text"), limit=20).select("code", "rank", "text", "source")


def layer_audit(spark: SparkSession, folder: str) -> DataFrame:
    """With 1, 2 and 3 supplemental words per code: how many are admitted, on how many codes, and first words kept."""
    rows = _layers(spark, folder, 3)
    caps = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cap")).where((F.col("band") != 2) | (F.col("band_rank") <= F.col("cap")))
    per = caps.groupBy("cap", "code").agg(F.count_if(F.col("band") == 2).alias("n"), F.count_if(F.col("band") == 1).alias("core"))
    return per.groupBy("cap").agg(F.sum("n").alias("n_admitted"), F.count_if(F.col("n") > 0).alias("n_codes"), F.count_if((F.col("core") == 0) & (F.col("n") > 0)).alias("n_new_codes"), F.count_if(F.col("core") == 1).alias("n_first_kept"))


def _compositions(codes: DataFrame, core: DataFrame, more: DataFrame) -> DataFrame:
    """(observed, rank, text, added) of the six best compositions of codes with one word of ``more`` that ``core`` lacks."""
    codes = codes.where((F.length("observed") >= 6) & (F.length("observed") % 2 == 0))
    by_weight = [F.desc("frequency"), F.asc("text")]
    known = L.ranked(more.where(F.length("code") >= 4), ["code"], *by_weight, name="place").join(core.select("text", "code"), ["text", "code"], "left_anti")
    extra = L.ranked(known, ["code"], F.asc("place"), limit=4, name="turn").select("text", "code", "place", F.lit(True).alias("extra"))
    own = L.ranked(core, ["code"], *by_weight, limit=4, name="place").select("text", "code", "place", F.lit(False).alias("extra"))
    edges = lattice.spans(codes, True).join(own.unionByName(extra), F.col("piece") == F.col("code"))
    grouped = edges.repartition(shuffle_width(codes.sparkSession), "observed").groupBy("observed").agg(F.sort_array(F.collect_list(F.struct("place", "text", "low", "high", "extra"))).alias("edges")).where(F.exists("edges", lambda e: e["extra"]))

    def run(batches):
        for frame in batches:
            rows = []
            for observed, found in zip(frame["observed"], frame["edges"]):
                words, added = {}, {}
                for e in found:
                    span = (e["low"] // 2, e["high"] // 2)
                    if e["extra"]:
                        added.setdefault(span, []).append((e["place"], e["text"]))
                    else:
                        words.setdefault(span, []).append(e["text"])
                rows += [(observed, k, text, word) for k, (text, word) in enumerate(lattice.compositions(len(observed) // 2, words, added, 4, 6), 1)]
            yield pd.DataFrame(rows, columns=["observed", "rank", "text", "added"])

    return grouped.mapInPandas(run, "observed string, rank int, text string, added string")


def supplemental_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of six keys or more read with exactly one supplemental word of two syllables or more among core words.

    Core paths have any number of words, of the four best of a span, and four paths stay at a place. The longest supplemental
    span comes first, then fewer core words, then the ranks of the supplemental and the core words, then the place."""
    return _compositions(V.observed(spark, folder), V.words(spark, folder), V.words(spark, folder, "technical_overlay_mirror"))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """How often any cache has a word."""
    return table(spark, folder, "personal_word_counts").distinct().groupBy(F.col("word").alias("text")).agg(F.sum("n").alias("count"))


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    return noisy.decode(V.observed(spark, folder), V.words(spark, folder), 10)


def frozen_pool_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten words of each code; those in full code without edits permute among their own places by cached use."""
    pool = _decoded(spark, folder).join(shuffled(_evidence(spark, folder)), "text", "left").withColumn("eligible", (F.col("kind") == "exact") & (F.col("abbreviated") == 0))
    by = Window.partitionBy("observed", "eligible")
    turn = F.row_number().over(by.orderBy(F.desc(F.coalesce("count", F.lit(0))), "rank"))
    placed = pool.withColumn("turn", turn).withColumn("slots", F.sort_array(F.collect_list("rank").over(by)))  # ten at most
    return placed.select("observed", "text", "code", "rank", F.get("slots", F.col("turn") - 1).alias("new_rank"))


def hybrid_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The same pool by score + 0.5 ln(1 + cached use), all words."""
    value = F.round(F.col("score") + 0.5 * F.log1p(F.coalesce("count", F.lit(0))), 6)
    pool = _decoded(spark, folder).join(_evidence(spark, folder), "text", "left").withColumn("hybrid", value)
    return L.ranked(pool, ["observed"], F.desc("hybrid"), F.asc("rank"), name="new_rank").select("observed", "text", "code", "rank", "new_rank", "hybrid")


def conservative_top1(spark: SparkSession, folder: str) -> DataFrame:
    """Codes whose first word gives way: another of the first six has more cached use, at least 3, and costs at most 1."""
    exact = _decoded(spark, folder).where("rank <= 6 and kind = 'exact'").join(shuffled(_evidence(spark, folder)), "text", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    leader = F.max(F.when(F.col("rank") == 1, F.struct("text", "score", "count"))).over(Window.partitionBy("observed"))
    rivals = exact.withColumn("leader", leader).where("rank > 1 and count >= 3 and count > leader.count and round(leader.score - score, 6) <= 1.0")
    return L.first_by(rivals, ["observed"], F.desc("count"), F.asc("rank")).select("observed", F.col("leader.text").alias("leader"), F.col("text").alias("winner"), "count")


def hybrid_metrics_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Commits of words: how often the first and the first five places have them, for six weights of cached use."""
    wanted = V.commits(spark, folder).where("observed <> ''").groupBy("observed", "text").agg(F.count("*").alias("times"))
    pool = _decoded(spark, folder).join(_evidence(spark, folder), "text", "left")
    weights = F.array(*(F.lit(w) for w in (0.0, 0.125, 0.25, 0.5, 1.0, 2.0)))
    each = pool.select("*", F.explode(weights).alias("weight")).withColumn("hybrid", F.round(F.col("score") + F.col("weight") * F.log1p(F.coalesce("count", F.lit(0))), 6))
    placed = L.ranked(each, ["observed", "weight"], F.desc("hybrid"), F.asc("rank"), name="new_rank")
    best = placed.groupBy("observed", "weight", "text").agg(F.min("new_rank").alias("new_rank"))
    hits = best.join(wanted, ["observed", "text"])
    return hits.groupBy("weight").agg(F.sum("times").alias("n"), *(F.sum(F.when(F.col("new_rank") <= k, F.col("times")).otherwise(0)).alias(f"top{k}") for k in (1, 5)))


def public_context_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten words of each commit's code, re-ranked by the transition from the word committed before it."""
    w = Window.partitionBy("session_id", "segment_seq").orderBy("pos", "event_id")
    own = V.commits(spark, folder).where("observed <> ''").withColumn("before", F.lag("text").over(w)).where("before is not null")
    asked = own.select("observed", "before").distinct()
    pairs = table(spark, folder, "personal_pair_counts").distinct().groupBy(F.col("previous_word").alias("before"), F.col("current_word").alias("text")).agg(F.sum("n").alias("n"))
    totals = pairs.groupBy("before").agg(F.sum("n").alias("total"))
    words = V.words(spark, folder)
    size, mass = words.agg(F.count_distinct("text")).scalar(), words.agg(F.sum("frequency")).scalar()
    pool = L.first_by(_decoded(spark, folder), ["observed", "text"], F.asc("rank")).select("observed", "text", "rank", "frequency")
    scored = asked.join(shuffled(totals), "before", "left").join(shuffled(pool), "observed")
    both = F.concat("before", "text")
    followed = passes(filter_of(pairs.select(both), pairs), both)  # the other rows surely have no transition and stay in their task
    scored = scored.where(followed).join(shuffled(pairs), ["before", "text"], "left").unionByName(scored.where(~followed).withColumn("n", F.lit(None).cast("bigint")))
    value = UNIGRAM_SHARE * F.ln(F.col("frequency") / mass) + BIGRAM_SHARE * conditional(F.col("n"), F.col("total"), size)
    ranked = L.ranked(scored.withColumn("context", F.round(value, 6)), ["observed", "before"], F.desc("context"), F.asc("rank"), name="new_rank")
    return ranked.where("new_rank = 1").select("observed", "before", "text", "rank", "context")


def context_oracle(spark: SparkSession, folder: str) -> DataFrame:
    """Where commits don't have the first word: whether the transition before them would have preferred the text committed."""
    w = Window.partitionBy("session_id", "segment_seq").orderBy("pos", "event_id")
    own = V.commits(spark, folder).where("observed <> ''").withColumn("before", F.lag("text").over(w)).where("before is not null").select("event_id", "observed", "before", F.col("text").alias("answer"))
    first = _decoded(spark, folder).where("rank = 1").select("observed", F.col("text").alias("base"))
    pairs = table(spark, folder, "personal_pair_counts").distinct().groupBy(F.col("previous_word").alias("before"), F.col("current_word").alias("text")).agg(F.sum("n").alias("n"))
    joined = own.join(first, "observed").where("answer <> base")
    for name in ("answer", "base"):
        joined = joined.join(pairs.select("before", F.col("text").alias(name), F.col("n").alias(f"n_{name}")), ["before", name], "left")
    a, b = (F.coalesce(f"n_{c}", F.lit(0)) for c in ("answer", "base"))
    outcome = F.when(a > b, "win").when(a < b, "lose").otherwise("tie")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min(a - b).alias("least"), F.max(a - b).alias("most"))


def failure_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    """Commits of words by what stands against finding them: their text isn't first, isn't among ten, or their code is shared."""
    words = V.words(spark, folder)
    own = V.commits(spark, folder).where("observed <> ''").join(words.select("text").distinct(), "text", "left_semi").withColumn("full", codec.full_code(F.replace("composition", F.lit("'"), F.lit(" "))))
    fan = words.groupBy(F.col("code").alias("full")).agg(F.count_distinct("text").alias("fan"))
    ranks = _decoded(spark, folder).groupBy("observed", "text").agg(F.min("rank").alias("rank"))
    joined = own.join(ranks, ["observed", "text"], "left").join(fan, "full", "left")
    reason = F.when(F.col("rank") == 1, "first").when(F.col("rank").isNotNull(), "deeper").when(F.coalesce("fan", F.lit(0)) == 0, "other_reading").when(F.col("observed") != F.col("full"), "mistyped").otherwise("crowded")
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.max("fan").alias("most_texts"))


def _text_places(wanted: DataFrame, words: DataFrame, pairs: DataFrame, n_cells: int) -> DataFrame:
    """One row of counts over (observed, text) of ``wanted``: texts that are readings of their code as two words, by their
    places without and with the transitions ``pairs`` (first, second, n).

    All texts of a code are ranked, but none leaves its task: codes are parted into cells, and a cell gets the words of each
    code it needs once."""
    n = F.length("observed")
    best = cut(L.best_by_text(words).select("text", "code", "frequency"))  # read four times
    asked = wanted.where((n >= 4) & (n % 2 == 0) & F.col("text").isNotNull()).groupBy("observed").agg(F.collect_set("text").alias("texts")).withColumn("cell", F.pmod(F.hash("observed"), F.lit(n_cells)))
    a, b = (best.select(F.col("text").alias(t), F.col("code").alias(c)) for t, c in (("first", "c1"), ("second", "c2")))
    known = pairs.join(a, "first").join(b, "second").groupBy(F.concat("c1", "c2").alias("observed")).agg(F.collect_list(F.struct("first", "second", "n")).alias("pairs"))
    rows = asked.join(known, "observed", "left").select("cell", "observed", "texts", "pairs")
    at = F.sequence(F.lit(2), n - 2, F.lit(2))
    halves = F.flatten(F.transform(at, lambda i: F.array(F.left("observed", i), F.substring("observed", i + 1, n))))
    cells = unfolded(asked.select("cell", F.explode(halves).alias("code")).groupBy("code").agg(F.collect_set("cell").alias("cells")))
    own = F.sort_array(F.collect_list(F.struct("text", F.ln("frequency").alias("value"))))
    lists = cells.join(best.groupBy("code").agg(own.alias("own")), "code").select(F.explode("cells").alias("cell"), "code", F.col("own")["text"].alias("texts"), F.col("own")["value"].alias("values"))

    def run(codes: pa.Table, words: pa.Table) -> pa.Table:
        held = readings.Lists(zip(*(words.column(c).to_pylist() for c in ("code", "texts", "values"))))
        counts = [0] * 5
        for batch in codes.to_batches(max_chunksize=10_000):
            for observed, texts, steps in zip(*(batch.column(c).to_pylist() for c in ("observed", "texts", "pairs"))):
                for _, plain, aware in readings.places(held, observed, texts, {(s["first"], s["second"]): s["n"] for s in steps or ()}):
                    for i, one in enumerate((1, plain == 1, aware == 1, aware < plain, aware > plain)):
                        counts[i] += one
        return pa.table({c: pa.array([v], pa.int64()) for c, v in zip(names, counts)})

    names = ["n", "plain_first", "aware_first", "improved", "worsened"]
    found = rows.groupBy("cell").cogroup(lists.groupBy("cell")).applyInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


def protocol_context(spark: SparkSession, folder: str) -> DataFrame:
    """Two-word readings ranked without and with the caches' transitions: places of the texts committed."""
    pairs = table(spark, folder, "personal_pair_counts").distinct().groupBy(F.col("previous_word").alias("first"), F.col("current_word").alias("second")).agg(F.sum("n").alias("n"))
    wanted = V.observed_texts(spark, folder)
    return _text_places(wanted, V.words(spark, folder), pairs, block_count(wanted, CELL_BYTES))


def paired_rank_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of committed texts for the code typed against the code in full: improved, same, worse, dropped, recovered."""
    words = V.words(spark, folder)
    own = V.commits(spark, folder).where("observed <> ''").withColumn("full", codec.full_code(F.replace("composition", F.lit("'"), F.lit(" ")))).where("full <> ''").select("event_id", "observed", "full", "text")
    codes = own.select("observed").union(own.select(F.col("full"))).distinct()
    ranks = noisy.decode(codes, words, 10).groupBy("observed", "text").agg(F.min("rank").alias("rank"))
    typed = own.join(ranks, ["observed", "text"], "left").withColumnRenamed("rank", "a")
    both = typed.join(ranks.select(F.col("observed").alias("full"), "text", F.col("rank").alias("b")), ["full", "text"], "left")
    a, b = F.col("a"), F.col("b")
    return both.agg(
        F.count("*").alias("n"), F.count_if((a < b) | (a.isNotNull() & b.isNull())).alias("improved"), F.count_if(a == b).alias("same"), F.count_if((a > b) | (a.isNull() & b.isNotNull())).alias("worsened"),
        F.count_if(a.isNull() & b.isNotNull()).alias("dropped"), F.count_if(a.isNotNull() & b.isNull()).alias("recovered"), F.count_if(a.isNull() & b.isNull()).alias("hidden"),
        F.coalesce(F.sum(F.when(b.isNotNull(), F.coalesce(a, F.lit(11)) - b)), F.lit(0)).alias("degradation"),
    )


def candidate_lab_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and choices that each word takes by its short code against its full one."""
    words = L.best_by_text(V.words(spark, folder).where(F.size("codes") >= 2))
    short = codec.anchored_tail(F.col("codes"))
    placed = L.ranked(words.withColumn("short", short), ["short"], F.desc("frequency"), F.asc("text"))
    actions = F.length("short") + 1 + F.when(F.col("rank") > 1, 1).otherwise(0)
    return placed.where("rank <= 10").select("text", "short", "rank", actions.alias("actions"), (F.length("code") + 1 - actions).alias("saved"))


def retained_visible_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Of the ten first words for a typed code, how many stay among those for the code without its last key."""
    own = V.observed(spark, folder).where(F.length("observed") > 1).withColumn("shorter", F.left("observed", F.length("observed") - 1))
    codes = own.select("observed").union(own.select("shorter")).distinct()
    shown = noisy.decode(codes, V.words(spark, folder), 10).select("observed", "text").distinct()
    longer = own.join(shown, "observed").select("observed", "shorter", "text")
    kept = longer.join(shown.select(F.col("observed").alias("shorter"), "text", F.lit(1).alias("kept")), ["shorter", "text"], "left")
    return kept.groupBy("observed").agg(F.count("*").alias("n_texts"), F.count("kept").alias("n_kept"))


def spread_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred sentences at even distances by id."""
    return sampling.spread(V.sentences(spark, folder).select("id"), 100, "id").select("sample", "id")


def fit_dev_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth training sentence kept for development."""
    return sampling.every(V.sentences(spark, folder).where("split = 'train'").select("id"), 5, 4, "id").select("id", "held_out")


def _two_token_windows(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """(id, pos, phrase) of adjacent forms of 2 to 6 characters together."""
    own = V.spoken(spark, folder, (split,))
    n = F.size("items")
    parts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(i.alias("pos"), F.concat(F.get("items", i - 1), F.get("items", i)).alias("phrase")))
    return own.where(n > 1).select("id", F.inline(parts)).where(F.length("phrase").between(2, 6))


def first_unseen_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Of the test sentences, as the task says, each one's first window that no sentence before took."""
    return sampling.greedy_first_unseen(_two_token_windows(spark, folder, "test"), "id", "pos", "phrase")


def whitelist_shortcuts(spark: SparkSession, folder: str) -> DataFrame:
    """First keys of two-word phrases of training sentences that stand for one phrase only, seen twice at least."""
    best = L.best_by_text(V.words(spark, folder)).select("text", codec.all_short(F.col("codes")).alias("short"))
    own = language.transitions(V.spoken(spark, folder, ("train",)))
    a, b = (best.select(F.col("text").alias(t), F.col("short").alias(s)) for t, s in (("prev", "s1"), ("cur", "s2")))
    phrases = own.groupBy("prev", "cur").agg(F.count("*").alias("n")).join(a, "prev").join(b, "cur").groupBy(F.concat("s1", "s2").alias("short"), F.concat("prev", "cur").alias("phrase")).agg(F.sum("n").alias("n"))
    return phrases.groupBy("short").agg(F.count("*").alias("n_phrases"), F.max("phrase").alias("phrase"), F.sum("n").alias("n")).where("n_phrases = 1 and n >= 2").select("short", "phrase", "n")


def personal_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """For each session's typed codes, the first words after its own cache lifts them by at most three places."""
    own = V.commits(spark, folder).where("observed <> ''").select("session_id", "observed").distinct()
    cache = table(spark, folder, "personal_word_counts").distinct().groupBy("session_id", F.col("word").alias("text")).agg(F.sum("n").alias("count"))
    pool = L.first_by(_decoded(spark, folder), ["observed", "text"], F.asc("rank")).select("observed", "text", "rank")
    lifted = own.join(pool, "observed").join(cache, ["session_id", "text"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    place = F.greatest(F.col("rank") - 1 - boost(F.col("count")), F.lit(0))
    ranked = L.ranked(lifted.withColumn("place", place), ["session_id", "observed"], F.asc("place"), F.desc("count"), F.asc("rank"), F.asc("text"), name="new_rank")
    return ranked.where("new_rank <= 3").select("session_id", "observed", "text", "rank", "new_rank")


QUERIES = {
    f.__name__: f
    for f in (
        bigram_counts, bigram_score, char_bigram_counts, char_text_score, lm_stats, lattice_edges, noisy_lattice, complete_sentence, sentence_kbest_unigram, sentence_kbest_bigram, sentence_kbest_bigram_noisy, sentence_lanes, sentence_variants, literal_fallback,
        protocol_decode_whole, continuous_composition_whole, interactive_query_whole, protocol_context_whole,
        protocol_decode, continuous_composition, interactive_query, layer_merge, layer_audit, supplemental_composition, frozen_pool_rerank, hybrid_rerank, conservative_top1, hybrid_metrics_grid, public_context_rerank, context_oracle,
        failure_decomposition, protocol_context, paired_rank_stats, candidate_lab_actions, retained_visible_texts, spread_sample, fit_dev_split, first_unseen_greedy, whitelist_shortcuts, personal_promotion,
    )
}
