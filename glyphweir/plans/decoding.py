"""Queries on lexicons, codes and words for codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweir.functions import codec
from glyphweir.functions import keys as K
from glyphweir.functions.scoring import ABBREVIATION_COST, safe_ratio
from glyphweir.operators import lexicon as L
from glyphweir.operators import noisy
from glyphweir.operators.sampling import order_statistics
from glyphweir.plans import views as V
from glyphweir.session import shuffled
from glyphweir.sources.tables import table

#: Most entries of a lexicon slice, and words shown for a code.
SLICE, FIRST = 120_000, 10


def lexicon_build(spark: SparkSession, folder: str) -> DataFrame:
    return V.words(spark, folder).select("text", "code", "pinyin", "frequency", F.size("codes").alias("n_syllables"))


def lexicon_reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows by why they are no entry; a row whose text and code came before is a duplicate."""
    rows = L.entries(table(spark, folder, "technical_overlay"))
    again = F.row_number().over(Window.partitionBy("text", "code", F.col("reason").isNull()).orderBy("entry_id")) > 1
    reason = F.coalesce("reason", F.when(again, "duplicate"), F.lit("accepted"))
    return rows.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n_rows"))


def lexicon_slice_topn(spark: SparkSession, folder: str) -> DataFrame:
    return L.top_slice(table(spark, folder, "technical_overlay"), SLICE)


def lexicon_anti_list(spark: SparkSession, folder: str) -> DataFrame:
    """Entries without the texts that any cache has as a word, but for those it has at least five times in all."""
    listed = table(spark, folder, "personal_word_counts").distinct().groupBy("word").agg(F.sum("n").alias("n")).where("n < 5")
    return V.words(spark, folder).join(listed, F.col("text") == F.col("word"), "left_anti").select("text", "code", "frequency")


def lexicon_compare(spark: SparkSession, folder: str) -> DataFrame:
    return L.compare(V.words(spark, folder), V.words(spark, folder, "technical_overlay_mirror"))


def best_entry_by_text(spark: SparkSession, folder: str) -> DataFrame:
    return L.best_by_text(V.words(spark, folder)).select("text", "code", "frequency")


def token_fallback_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences all of whose forms are words or spelled by one-character words, by how their forms were covered."""
    known = V.words(spark, folder).select("text").distinct()
    singles = known.where(F.length("text") == 1).select(F.col("text").alias("c"), F.lit(1).alias("single"))
    tokens = V.spoken(spark, folder).select("id", F.posexplode("items").alias("pos", "form"))
    seen = tokens.join(known.select(F.col("text").alias("form"), F.lit(1).alias("word")), "form", "left")
    letters = seen.where("word is null").select("id", "pos", F.explode(F.filter(F.split("form", ""), lambda c: c != "")).alias("c"))
    spelled = letters.join(singles, "c", "left").groupBy("id", "pos").agg(F.min(F.coalesce("single", F.lit(0))).alias("spelled"))
    covered = seen.join(spelled, ["id", "pos"], "left").groupBy("id").agg(F.count("word").alias("n_words"), F.count_if(F.col("word").isNull() & (F.coalesce("spelled", F.lit(0)) == 1)).alias("n_spelled"), F.count("*").alias("n"))
    return covered.agg(F.count("*").alias("n_sentences"), F.count_if(F.col("n") == F.col("n_words") + F.col("n_spelled")).alias("n_covered"), F.sum("n_words").alias("n_words"), F.sum("n_spelled").alias("n_spelled"))


def syllable_codes(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("codes")
    return V.words(spark, folder).select("text", "code", codec.anchored_tail(c).alias("anchored"), codec.conservative_tail(c).alias("conservative"), codec.all_short(c).alias("short"))


def pinyin_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Every syllable encoded by rule; the table has the codes expected."""
    return table(spark, folder, "pinyin_syllables").select("syllable", codec.encode_syllable(F.col("syllable")).alias("code"))


def tone_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Syllables with a tone mark on their first vowel, plain again."""
    vowel = "regexp_extract(syllable, '[aeiouv]', 0)"
    marked = F.expr(f"if({vowel} = '', syllable, overlay(syllable placing translate({vowel}, 'aeiouv', 'áéíóúǘ') from locate({vowel}, syllable) for 1))")
    return table(spark, folder, "pinyin_syllables").select("syllable", marked.alias("marked")).select("syllable", "marked", codec.strip_tones(F.col("marked")).alias("plain"))


def spelling_enumeration(spark: SparkSession, folder: str) -> DataFrame:
    return L.spelling_table(V.words(spark, folder)).groupBy("text", "code").agg(F.count("*").alias("n_spellings"), F.count_distinct("spelling").alias("n_distinct"), F.max("abbreviated").alias("most_abbreviated"), F.min("spelling").alias("first_spelling"))


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges of the prefix tree of full codes, words, the most words of a code and all spellings."""
    words = V.words(spark, folder)
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.left("code", n))).alias("p"))
    most = words.groupBy("code").agg(F.count("*").alias("n")).agg(F.max("n"))
    one = words.agg(F.count("*").alias("n_words"), F.sum(F.pow(F.lit(2), F.size("codes"))).cast("bigint").alias("n_spellings"))
    nodes = prefixes.agg(F.count_distinct("p").alias("n"))
    return one.select("n_words", "n_spellings", (nodes.scalar() + 1).alias("n_nodes"), nodes.scalar().alias("n_edges"), most.scalar().alias("most_per_code"))


def code_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return V.words(spark, folder).groupBy("code").agg(F.count_distinct("text").alias("n_texts")).groupBy("n_texts").agg(F.count("*").alias("n_codes"))


def codebook_ambiguity(spark: SparkSession, folder: str) -> DataFrame:
    """Collisions of two-key codes, fan-out of first keys, and codes that two first keys could spell as well."""
    syllables = table(spark, folder, "pinyin_syllables").distinct()
    codes = syllables.groupBy("code").agg(F.count("*").alias("n"))
    first = syllables.groupBy(F.left("code", F.lit(1)).alias("key")).agg(F.count("*").alias("n"))
    split = codes.join(first.select(F.col("key").alias("a"), F.lit(1).alias("x")), F.left("code", F.lit(1)) == F.col("a"), "left_semi").join(first.select(F.col("key").alias("b")), F.right("code", F.lit(1)) == F.col("b"), "left_semi")
    one = codes.agg(F.count("*").alias("n_codes"), F.count_if(F.col("n") > 1).alias("n_collisions"), F.max("n").alias("most_labels"), F.min(F.when(F.col("n") > 1, F.col("code"))).alias("first_collision"))
    return one.select("*", syllables.agg(F.count("*")).scalar().alias("n_syllables"), first.agg(F.max("n")).scalar().alias("most_per_key"), first.agg(F.max_by("key", F.struct("n", "key"))).scalar().alias("widest_key"), split.agg(F.count("*")).scalar().alias("n_splittable"))


def fibonacci_parses(spark: SparkSession, folder: str) -> DataFrame:
    """Ways to cut a run of keys into syllables of one or two keys, by its length."""
    return spark.sql("WITH RECURSIVE f(n, ways, after) AS (SELECT 1, 1L, 2L UNION ALL SELECT n + 1, after, ways + after FROM f WHERE n < 24) SELECT n, ways FROM f")


def key_neighbors_join(spark: SparkSession, folder: str) -> DataFrame:
    """Of adjacent keys in typed codes, how many pairs are neighbours on the keyboard."""
    codes = V.commits(spark, folder).select("observed").where(F.length("observed") > 1)
    pairs = codes.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("observed") - 1), lambda i: F.substring("observed", i, F.lit(2)))).alias("p"))
    near = K.neighbour_table(spark).select(F.concat("intended", "actual").alias("p"), F.lit(True).alias("near"))
    return pairs.groupBy("p").agg(F.count("*").alias("n")).join(F.broadcast(near), "p").select("p", "n")


def hypotheses_one_edit(spark: SparkSession, folder: str) -> DataFrame:
    return noisy.hypotheses(V.observed(spark, folder)).groupBy("observed").agg(F.count_distinct("intended").alias("n_intended"), F.min("intended").alias("first_intended"))


def edit_classify(spark: SparkSession, folder: str) -> DataFrame:
    """The edit between the code of each commit's composition and the letters typed."""
    own = V.commits(spark, folder).withColumn("intended", codec.full_code(F.replace("composition", F.lit("'"), F.lit(" ")))).where("observed <> '' and intended <> ''")
    edit = noisy.classify(F.col("observed"), F.col("intended"))
    return own.select("event_id", edit["kind"].alias("kind"), edit["place"].alias("place")).where("kind is not null")


def decode_word_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = noisy.decode(V.observed(spark, folder), V.words(spark, folder), FIRST)
    return found.select("observed", "rank", "text", "code", "spelling", "kind", F.round("score", 6).alias("score"))


def decode_exact_full_code(spark: SparkSession, folder: str) -> DataFrame:
    return noisy.decode_exact(V.observed(spark, folder), V.words(spark, folder), FIRST).select("observed", "rank", "text", "code", "frequency")


def decode_with_abbreviation(spark: SparkSession, folder: str) -> DataFrame:
    """Words for first-key codes: the all-short code of each word, decoded without edits."""
    words = V.words(spark, folder)
    codes = words.select(codec.all_short(F.col("codes")).alias("observed")).distinct()
    table_ = L.spelling_table(words).withColumnRenamed("spelling", "observed")
    scored = table_.join(codes, "observed").withColumn("score", F.round(F.ln("frequency") - ABBREVIATION_COST * F.col("abbreviated"), 9))
    best = L.first_by(scored, ["observed", "text", "code"], F.desc("score"), F.asc("abbreviated"))
    return L.ranked(best, ["observed"], F.desc("score"), F.asc("abbreviated"), F.asc("text"), F.asc("code"), limit=FIRST).select("observed", "rank", "text", "abbreviated", F.round("score", 6).alias("score"))


def _pool(words: DataFrame, width: int) -> DataFrame:
    """(key, part, part_rank): the ``width`` first characters' texts of each two-key code."""
    singles = words.where(F.length("code") == 2)
    best = L.first_by(singles, ["code", "text"], F.desc("frequency"))
    return L.ranked(best, ["code"], F.desc("frequency"), F.asc("text"), limit=width).select(F.col("code").alias("key"), F.col("text").alias("part"), F.col("rank").alias("part_rank"), F.col("frequency").alias("weight"))


def char_pair_product(spark: SparkSession, folder: str) -> DataFrame:
    """For typed codes of four keys the products of one-syllable words, at most 24 by 24, the 50 heaviest."""
    pool = _pool(V.words(spark, folder), 24)
    codes = V.observed(spark, folder).where(F.length("observed") == 4)
    a, b = (pool.select(F.col("key").alias(f"k{i}"), F.col("part").alias(f"p{i}"), F.col("part_rank").alias(f"r{i}"), F.col("weight").alias(f"w{i}")) for i in (1, 2))
    pairs = codes.withColumn("k1", F.left("observed", F.lit(2))).withColumn("k2", F.right("observed", F.lit(2))).join(a, "k1").join(b, "k2")
    once = L.first_by(pairs.withColumn("text", F.concat("p1", "p2")), ["observed", "text"], F.asc(F.col("r1") + F.col("r2")), F.asc("r1"))
    return L.ranked(once, ["observed"], F.asc(F.col("r1") + F.col("r2")), F.asc("r1"), F.asc("text"), limit=50).select("observed", "rank", "text")


def _swaps(codes: DataFrame, inside: bool) -> DataFrame:
    """(observed, place, swapped): adjacent unequal keys swapped; ``inside`` a syllable only."""
    n = F.length("observed")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & ((i % 2 == 1) if inside else F.lit(True)) & (F.substring("observed", i, F.lit(1)) != F.substring("observed", i + 1, F.lit(1))))
    made = F.transform(places, lambda i: F.struct(i.alias("place"), F.concat(F.left("observed", i - 1), F.substring("observed", i + 1, F.lit(1)), F.substring("observed", i, F.lit(1)), F.substring("observed", i + 2, n + 1)).alias("swapped")))
    return codes.where(n > 1).select("observed", F.inline(made))


def swap_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """Words by the full code after one swap, without those of the code as typed."""
    words = V.words(spark, folder)
    codes = V.observed(spark, folder)
    primary = codes.join(words.select(F.col("code").alias("observed"), "text"), "observed")
    found = _swaps(codes, False).join(words, F.col("swapped") == F.col("code")).join(primary, ["observed", "text"], "left_anti")
    best = L.first_by(found, ["observed", "text"], F.desc("frequency"), F.asc("place"), F.asc("code"))
    return L.ranked(best, ["observed"], F.desc("frequency"), F.asc("place"), F.asc("text"), limit=FIRST).select("observed", "rank", "text", F.col("place").cast("bigint").alias("place"))


def auto_transposition_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Whether one swap inside a syllable, and only one, makes an exact code of a typed code that has no word."""
    known = V.words(spark, folder).select("code").distinct()
    codes = V.observed(spark, folder)
    hits = _swaps(codes, True).join(known, F.col("swapped") == F.col("code"), "left_semi").groupBy("observed").agg(F.count("*").alias("n_hits"))
    exact = codes.join(known, F.col("observed") == F.col("code"), "left_semi").withColumn("exact", F.lit(True))
    decision = (
        F.when(F.length("observed") % 2 != 0, "keep_odd")
        .when(F.length("observed") > 16, "keep_long")
        .when(F.col("exact"), "keep_exact")
        .when(F.coalesce("n_hits", F.lit(0)) == 0, "keep_no_hit")
        .when(F.col("n_hits") > 1, "keep_ambiguous")
        .otherwise("promote")
    )
    return codes.join(hits, "observed", "left").join(exact, "observed", "left").select("observed", decision.alias("decision"))


def protocol_codes(spark: SparkSession, folder: str) -> DataFrame:
    """For each way to write a code: distinct codes, collisions and the most texts of one."""
    c = F.col("codes")
    modes = {"full": F.col("code"), "anchored": codec.anchored_tail(c), "conservative": codec.conservative_tail(c), "short": codec.all_short(c)}
    rows = V.words(spark, folder).select("text", F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), x.alias("own")) for m, x in modes.items()))))
    per = rows.groupBy("mode", "own").agg(F.count_distinct("text").alias("n"))
    return per.groupBy("mode").agg(F.count("*").alias("n_codes"), F.count_if(F.col("n") > 1).alias("n_collisions"), F.max("n").alias("most_texts"))


def collision_gate_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Words whose code may be shortened if the short code has at most so many texts, by limit and letters saved."""
    words = V.words(spark, folder).where(F.size("codes") >= 2).withColumn("short", codec.anchored_tail(F.col("codes")))
    fan = words.groupBy("short").agg(F.count_distinct("text").alias("fan"))
    limits = F.array(*(F.struct(F.lit(i).alias("gate"), F.lit(n).alias("most")) for i, n in enumerate((0, 1, 2, 4, 8, 16, 1 << 30))))
    each = words.join(fan, "short").select("code", "short", "fan", F.inline(limits))
    return each.groupBy("gate").agg(F.count("*").alias("n_words"), F.count_if(F.col("fan") <= F.col("most")).alias("n_short"), F.sum(F.when(F.col("fan") <= F.col("most"), F.length("code") - F.length("short")).otherwise(0)).cast("bigint").alias("keys_saved"))


def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Of commits whose text is a word, how many have it among the first 1, 5 and 10 words for the keys typed, by edit."""
    words, own = V.words(spark, folder), V.commits(spark, folder).where("observed <> ''")
    wanted = own.join(words.select("text").distinct(), "text", "left_semi").withColumn("intended", codec.full_code(F.replace("composition", F.lit("'"), F.lit(" "))))
    kind = F.coalesce(noisy.classify(F.col("observed"), F.col("intended"))["kind"], F.lit("other"))
    ranks = noisy.decode(wanted.select("observed").distinct(), words, 10).groupBy("observed", "text").agg(F.min("rank").alias("rank"))
    joined = wanted.select("observed", "text", kind.alias("kind")).join(ranks, ["observed", "text"], "left")
    return joined.groupBy("kind").agg(F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 5, 10)))


def oov_exposure(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of sentences that are no word, by split."""
    words = V.words(spark, folder).select("text").distinct()
    forms = V.spoken(spark, folder).select("split", F.explode("items").alias("text")).groupBy("split", "text").agg(F.count("*").alias("n"))
    joined = forms.join(words.withColumn("known", F.lit(True)), "text", "left")
    totals = joined.groupBy("split").agg(F.sum("n").alias("n_forms"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_unknown"), F.count_if(F.col("known").isNull()).alias("n_distinct_unknown"))
    return totals.withColumn("rate", F.round(safe_ratio(F.col("n_unknown"), F.col("n_forms")), 6))


def _margins(spark: SparkSession, folder: str) -> DataFrame:
    """(observed, expected, known, first, margin): lead per key of the best word over an unresolved code; null without a word."""
    words = V.words(spark, folder)
    wanted = V.commits(spark, folder).where("observed <> ''").groupBy("observed").agg(F.max("text").alias("text"))
    known = wanted.join(shuffled(words.select("text", F.lit(True).alias("known")).distinct()), "text", "left").select("observed", F.col("text").alias("expected"), F.coalesce("known", F.lit(False)).alias("known"))
    best = shuffled(noisy.decode(wanted.select("observed"), words, 1).select("observed", F.col("text").alias("first"), "score"))
    return known.join(best, "observed", "left").withColumn("margin", F.round((F.col("score") + 8.0 * F.length("observed")) / F.length("observed"), 6))


def rejection_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """At nine thresholds, codes of known texts that are accepted and of unknown ones that are rejected; no margin is rejected."""
    each = _margins(spark, folder).select("known", "margin", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("threshold"))
    accepted = F.coalesce(F.col("margin") >= F.col("threshold"), F.lit(False))
    return each.groupBy("threshold").agg(F.count_if(F.col("known") & accepted).alias("accepted_known"), F.count_if(~F.col("known") & ~accepted).alias("rejected_unknown"), F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_unknown"))


def margin_range(spark: SparkSession, folder: str) -> DataFrame:
    return _margins(spark, folder).groupBy("known").agg(F.count("*").alias("n"), F.count("margin").alias("n_margins"), F.min("margin").alias("least"), F.max("margin").alias("most"))


def prefix_trajectory(spark: SparkSession, folder: str) -> DataFrame:
    return _trajectories(V.words(spark, folder))


def _trajectories(words: DataFrame) -> DataFrame:
    """For each prefix of a word's code, whether the word is among the 10 first by spellings; odd against even prefixes."""
    top = L.ranked(L.first_by(L.spelling_table(words), ["spelling", "text"], F.desc("frequency"), F.asc("abbreviated")), ["spelling"], F.desc("frequency"), F.asc("abbreviated"), F.asc("text"), limit=10)
    steps = words.select("text", "code", F.explode(F.sequence(F.lit(1), F.size("codes"))).alias("syllable"))
    for name, length in (("odd", F.col("syllable") * 2 - 1), ("even", F.col("syllable") * 2)):
        shown = top.select(F.col("spelling").alias(f"p_{name}"), "text", F.lit(True).alias(name))
        steps = steps.withColumn(f"p_{name}", F.left("code", length)).join(shown, [f"p_{name}", "text"], "left")
    odd, even = (F.coalesce(c, F.lit(False)) for c in ("odd", "even"))
    return steps.groupBy("syllable").agg(F.count("*").alias("n"), F.count_if(odd & even).alias("both"), F.count_if(odd & ~even).alias("lost"), F.count_if(~odd & even).alias("gained"), F.count_if(~odd & ~even).alias("absent"))


def word_shortened_codes(spark: SparkSession, folder: str) -> DataFrame:
    """How many codes each word may be typed by if a suffix of its syllables is written short, and the longest saving."""
    forms = F.transform(F.sequence(F.lit(1), F.size("codes")), lambda k: F.concat(F.array_join(F.slice("codes", F.lit(1), k), ""), codec.all_short(F.slice("codes", k + 1, F.greatest(F.size("codes") - k, F.lit(0))))))
    return V.words(spark, folder).select("text", "code", F.size(F.array_distinct(forms)).alias("n_codes"), F.array_min(F.transform(forms, F.length)).alias("shortest"))


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Exact order statistics of the ranking times per pool depth."""
    runs = table(spark, folder, "context_lab_runs").distinct().where("ranking_millis is not null")
    per = runs.groupBy("pool_depth", F.col("ranking_millis").alias("v")).agg(F.count("*").alias("times"))
    return order_statistics(per, "pool_depth", "v", "times")


QUERIES = {
    f.__name__: f
    for f in (
        decode_word_topk, lexicon_build, lexicon_reject_reasons, lexicon_slice_topn, lexicon_anti_list, lexicon_compare, best_entry_by_text, token_fallback_cover, syllable_codes, pinyin_codec, tone_strip,
        spelling_enumeration, index_stats, code_fanout, codebook_ambiguity, fibonacci_parses, key_neighbors_join, hypotheses_one_edit, edit_classify, decode_exact_full_code, decode_with_abbreviation,
        char_pair_product, swap_recovery, auto_transposition_decision, protocol_codes, collision_gate_sweep, recall_at_k, oov_exposure, rejection_sweep, margin_range, prefix_trajectory, word_shortened_codes, latency_summary,
    )
}

_LEX, _OBS = "WITH RECURSIVE " + V.LEX, "WITH RECURSIVE " + V.LEX + ", " + V.EVENTS
_DEC = "WITH RECURSIVE " + V.DECODED
_CODES = "list_transform(range(1, length(code), 2), lambda i: substr(code, i, 2))"
_COMPARE = f"""WITH {V.renamed(V.LEX, 'a')}, {V.renamed(V.RAW.format(table='technical_overlay_mirror'), 'b')},
t AS (SELECT a.text AS l, b.text AS r FROM (SELECT DISTINCT text FROM lexa) a FULL JOIN (SELECT DISTINCT text FROM lexb) b USING (text)),
i AS (SELECT a.text AS l, b.text AS r FROM lexa a FULL JOIN lexb b ON a.text = b.text AND a.code = b.code),
c AS (SELECT a.code AS l, b.code AS r FROM (SELECT DISTINCT code FROM lexa) a FULL JOIN (SELECT DISTINCT code FROM lexb) b USING (code)),
x AS (SELECT a.text AS l, b.text AS r FROM (SELECT * FROM lexa QUALIFY row_number() OVER (PARTITION BY code ORDER BY frequency DESC, text) = 1) a JOIN (SELECT * FROM lexb QUALIFY row_number() OVER (PARTITION BY code ORDER BY frequency DESC, text) = 1) b USING (code))
SELECT """ + ", ".join(f"(SELECT count(*) FROM {t} WHERE {w}) AS {n}_{s}" for t, n in (("t", "text"), ("i", "identity"), ("c", "code")) for s, w in (("shared", "l IS NOT NULL AND r IS NOT NULL"), ("only_left", "r IS NULL"), ("only_right", "l IS NULL"))) + ", (SELECT count(*) FROM x WHERE l = r) AS top_same, (SELECT count(*) FROM x WHERE l <> r) AS top_changed"
_MODES = "full code, anchored"
_SHORT = "list_aggregate(list_transform(range(1, length(code), 2), lambda i: substr(code, i, 1)), 'string_agg', '')"
_ANCHORED = f"left(code, 2) || coalesce(list_aggregate(list_transform(range(3, length(code), 2), lambda i: substr(code, i, 1)), 'string_agg', ''), '')"
_CONSERVATIVE = "CASE WHEN length(code) > 2 THEN left(code, length(code) - 1) ELSE code END"
_SWAP = "sw AS (SELECT observed, i AS place, left(observed, i - 1) || substr(observed, i + 1, 1) || substr(observed, i, 1) || substr(observed, i + 2) AS swapped FROM obs, range(1, length(observed)) t(i) WHERE substr(observed, i, 1) <> substr(observed, i + 1, 1))"
_INTENDED = "itd AS (SELECT event_id, observed, text, (SELECT CASE WHEN count(*) = count(y.code) THEN string_agg(y.code, '' ORDER BY i) END FROM (SELECT unnest(string_split(composition, '''')) AS s, generate_subscripts(string_split(composition, ''''), 1) AS i) LEFT JOIN pinyin_syllables y ON y.syllable = s) AS intended FROM com WHERE observed <> '')"
_KINDS = """knd AS (SELECT event_id, observed, text, intended, f, CASE WHEN observed = intended THEN 'exact'
  WHEN length(intended) = length(observed) + 1 AND left(intended, f) || substr(intended, f + 2) = observed THEN 'missing'
  WHEN length(observed) = length(intended) + 1 AND left(observed, f) || substr(observed, f + 2) = intended THEN 'extra'
  WHEN length(observed) = length(intended) AND len(u) = 1 AND EXISTS (SELECT 1 FROM nb WHERE nb.intended = substr(k.intended, f + 1, 1) AND nb.actual = substr(observed, f + 1, 1)) THEN 'neighbour'
  WHEN length(observed) = length(intended) AND len(u) = 2 AND u[2] = u[1] + 1 AND substr(observed, u[1] + 1, 1) = substr(intended, u[2] + 1, 1) AND substr(observed, u[2] + 1, 1) = substr(intended, u[1] + 1, 1) THEN 'swap' END AS kind
  FROM (SELECT *, coalesce(u[1], least(length(observed), length(intended))) AS f FROM (SELECT *, list_filter(range(0, least(length(observed), length(intended))), lambda i: substr(observed, i + 1, 1) <> substr(intended, i + 1, 1)) AS u FROM itd)) k)"""
_MARGIN = _DEC + """, wnt AS (SELECT observed, max(text) AS text FROM com WHERE observed <> '' GROUP BY 1),
mrg AS (SELECT w.observed, w.text IN (SELECT text FROM lex) AND w.text IS NOT NULL AS known, round((d.score + 8.0 * length(w.observed)) / length(w.observed), 6) AS margin FROM wnt w LEFT JOIN dec d ON d.observed = w.observed AND d.rank = 1)"""

SQL = {
    "lexicon_build": _LEX + "SELECT text, code, pinyin, frequency, length(code) // 2 AS n_syllables FROM lex",
    "lexicon_reject_reasons": _LEX + ", d AS (SELECT *, row_number() OVER (PARTITION BY text, code, reason IS NULL ORDER BY entry_id) AS k FROM ent) SELECT coalesce(reason, CASE WHEN k > 1 THEN 'duplicate' END, 'accepted') AS reason, count(*) AS n_rows FROM d GROUP BY 1",
    "lexicon_slice_topn": _LEX + f", s AS (SELECT * FROM ent WHERE reason IS NULL ORDER BY frequency DESC, entry_id LIMIT {SLICE}) SELECT text, code, frequency FROM s QUALIFY row_number() OVER (PARTITION BY text, code ORDER BY frequency DESC, entry_id) = 1",
    "lexicon_anti_list": _LEX + "SELECT text, code, frequency FROM lex WHERE text NOT IN (SELECT word FROM (SELECT DISTINCT * FROM personal_word_counts) WHERE word IS NOT NULL GROUP BY word HAVING sum(n) < 5)",
    "lexicon_compare": _COMPARE,
    "best_entry_by_text": _LEX + "SELECT text, code, frequency FROM lex QUALIFY row_number() OVER (PARTITION BY text ORDER BY frequency DESC, pinyin, code) = 1",
    "token_fallback_cover": f"""WITH {V.LEX}, {V.UD}, t AS (SELECT id, unnest(items) AS form, generate_subscripts(items, 1) AS pos FROM spk), k AS (SELECT DISTINCT text FROM lex),
m AS (SELECT id, form IN (SELECT text FROM k) AS word, list_has_all((SELECT coalesce(list(text), []) FROM k WHERE length(text) = 1), list_filter(string_split(form, ''), lambda c: c <> '')) AS spelled FROM t),
s AS (SELECT id, count(*) AS n, count(*) FILTER (word) AS w, count(*) FILTER (NOT word AND spelled) AS p FROM m GROUP BY 1)
SELECT count(*) AS n_sentences, count(*) FILTER (n = w + p) AS n_covered, CAST(sum(w) AS BIGINT) AS n_words, CAST(sum(p) AS BIGINT) AS n_spelled FROM s""",
    "syllable_codes": _LEX + f"SELECT text, code, {_ANCHORED} AS anchored, {_CONSERVATIVE} AS conservative, {_SHORT} AS short FROM lex",
    "pinyin_codec": "SELECT syllable, code FROM pinyin_syllables",
    "tone_strip": "SELECT syllable, CASE WHEN regexp_matches(syllable, '[aeiouv]') THEN regexp_replace(syllable, '[aeiouv]', translate(regexp_extract(syllable, '[aeiouv]'), 'aeiouv', 'áéíóúǘ')) ELSE syllable END AS marked, syllable AS plain FROM pinyin_syllables",
    "spelling_enumeration": _LEX + f", {V.SPELLINGS} SELECT text, code, count(*) AS n_spellings, count(DISTINCT spelling) AS n_distinct, max(abbreviated) AS most_abbreviated, min(spelling) AS first_spelling FROM spl GROUP BY 1, 2",
    "index_stats": _LEX + ", p AS (SELECT DISTINCT left(code, n) AS p FROM lex, range(1, length(code) + 1) t(n)) SELECT count(*) AS n_words, CAST(sum(pow(2, length(code) // 2)) AS BIGINT) AS n_spellings, (SELECT count(*) + 1 FROM p) AS n_nodes, (SELECT count(*) FROM p) AS n_edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM lex GROUP BY code)) AS most_per_code FROM lex",
    "code_fanout": _LEX + "SELECT n_texts, count(*) AS n_codes FROM (SELECT code, count(DISTINCT text) AS n_texts FROM lex GROUP BY 1) GROUP BY 1",
    "codebook_ambiguity": """WITH s AS (SELECT DISTINCT syllable, code FROM pinyin_syllables), c AS (SELECT code, count(*) AS n FROM s GROUP BY 1), f AS (SELECT left(code, 1) AS k, count(*) AS n FROM s GROUP BY 1)
SELECT count(*) AS n_codes, count(*) FILTER (n > 1) AS n_collisions, max(n) AS most_labels, min(code) FILTER (n > 1) AS first_collision, (SELECT count(*) FROM s) AS n_syllables, (SELECT max(n) FROM f) AS most_per_key, (SELECT k FROM f ORDER BY n DESC, k DESC LIMIT 1) AS widest_key,
(SELECT count(*) FROM c WHERE left(code, 1) IN (SELECT k FROM f) AND right(code, 1) IN (SELECT k FROM f)) AS n_splittable FROM c""",
    "fibonacci_parses": "WITH RECURSIVE f(n, ways, after) AS (SELECT 1, 1::BIGINT, 2::BIGINT UNION ALL SELECT n + 1, after, ways + after FROM f WHERE n < 24) SELECT n, ways FROM f",
    "key_neighbors_join": f"WITH {V.EVENTS}, {V.NEAR} SELECT substr(observed, i, 2) AS p, count(*) AS n FROM com, range(1, length(observed)) t(i) WHERE substr(observed, i, 2) IN (SELECT intended || actual FROM nb) GROUP BY 1",
    "hypotheses_one_edit": f"WITH {V.EVENTS}, {V.NEAR}, {V.HYPOTHESES.format(codes='obs')} SELECT observed, count(DISTINCT intended) AS n_intended, min(intended) AS first_intended FROM hyp GROUP BY 1",
    "edit_classify": f"WITH {V.EVENTS}, {V.NEAR}, {_INTENDED}, {_KINDS} SELECT event_id, kind, CASE WHEN kind <> 'exact' THEN f END AS place FROM knd WHERE kind IS NOT NULL AND intended <> ''",
    "decode_word_topk": _DEC + f" SELECT observed, rank, text, code, spelling, kind, round(score, 6) AS score FROM dec WHERE rank <= {FIRST}",
    "decode_exact_full_code": _OBS + f""", ask AS (SELECT DISTINCT observed, code FROM (WITH RECURSIVE g AS (SELECT observed, '' AS code, 0 AS done FROM obs WHERE length(observed) % 2 = 0 UNION ALL
  SELECT observed, code || CASE WHEN o.v = 1 THEN substr(observed, done + 1, 1) || 'v' ELSE substr(observed, done + 1, 2) END, done + 2 FROM g, (VALUES (0), (1)) o(v) WHERE done < length(observed) AND (o.v = 0 OR regexp_full_match(substr(observed, done + 1, 2), '[jqxy]u'))) SELECT observed, code FROM g WHERE done = length(observed))),
f AS (SELECT observed, text, lex.code, frequency FROM ask JOIN lex USING (code) QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY frequency DESC, lex.code) = 1)
SELECT observed, row_number() OVER (PARTITION BY observed ORDER BY frequency DESC, text, code) AS rank, text, code, frequency FROM f QUALIFY rank <= {FIRST}""",
    "decode_with_abbreviation": _LEX + f""", {V.SPELLINGS}, q AS (SELECT DISTINCT {_SHORT} AS observed FROM lex), s AS (SELECT observed, text, code, abbreviated, round(ln(frequency) - 0.85 * abbreviated, 9) AS score FROM q JOIN spl ON spelling = observed QUALIFY row_number() OVER (PARTITION BY observed, text, code ORDER BY score DESC, abbreviated) = 1)
SELECT observed, row_number() OVER (PARTITION BY observed ORDER BY score DESC, abbreviated, text, code) AS rank, text, abbreviated, round(score, 6) AS score FROM s QUALIFY rank <= {FIRST}""",
    "char_pair_product": _OBS + """, b AS (SELECT code, text, max(frequency) AS frequency FROM lex WHERE length(code) = 2 GROUP BY 1, 2), p AS (SELECT code, text, row_number() OVER (PARTITION BY code ORDER BY frequency DESC, text) AS r FROM b QUALIFY r <= 24),
x AS (SELECT observed, a.text || c.text AS text, a.r AS r1, c.r AS r2 FROM obs JOIN p a ON a.code = left(observed, 2) JOIN p c ON c.code = right(observed, 2) WHERE length(observed) = 4 QUALIFY row_number() OVER (PARTITION BY observed, a.text || c.text ORDER BY a.r + c.r, a.r) = 1)
SELECT observed, row_number() OVER (PARTITION BY observed ORDER BY r1 + r2, r1, text) AS rank, text FROM x QUALIFY rank <= 50""",
    "swap_recovery": _OBS + f", {_SWAP}, " + """f AS (SELECT observed, place, text, frequency, code FROM sw JOIN lex ON swapped = code WHERE NOT EXISTS (SELECT 1 FROM lex l2 WHERE l2.code = observed AND l2.text = lex.text) QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY frequency DESC, place, code) = 1)
SELECT observed, row_number() OVER (PARTITION BY observed ORDER BY frequency DESC, place, text) AS rank, text, place FROM f QUALIFY rank <= """ + str(FIRST),
    "auto_transposition_decision": _OBS + f", {_SWAP}, " + """h AS (SELECT observed, count(*) AS n FROM sw WHERE place % 2 = 1 AND swapped IN (SELECT code FROM lex) GROUP BY 1)
SELECT obs.observed, CASE WHEN length(obs.observed) % 2 <> 0 THEN 'keep_odd' WHEN length(obs.observed) > 16 THEN 'keep_long' WHEN obs.observed IN (SELECT code FROM lex) THEN 'keep_exact' WHEN coalesce(n, 0) = 0 THEN 'keep_no_hit' WHEN n > 1 THEN 'keep_ambiguous' ELSE 'promote' END AS decision FROM obs LEFT JOIN h USING (observed)""",
    "protocol_codes": _LEX + f", m AS (SELECT 'full' AS mode, code AS own, text FROM lex UNION ALL SELECT 'anchored', {_ANCHORED}, text FROM lex UNION ALL SELECT 'conservative', {_CONSERVATIVE}, text FROM lex UNION ALL SELECT 'short', {_SHORT}, text FROM lex), p AS (SELECT mode, own, count(DISTINCT text) AS n FROM m GROUP BY 1, 2) SELECT mode, count(*) AS n_codes, count(*) FILTER (n > 1) AS n_collisions, max(n) AS most_texts FROM p GROUP BY 1",
    "collision_gate_sweep": _LEX + f", w AS (SELECT text, code, {_ANCHORED} AS short FROM lex WHERE length(code) >= 4), f AS (SELECT short, count(DISTINCT text) AS fan FROM w GROUP BY 1), g AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 4), (4, 8), (5, 16), (6, 1073741824)) v(gate, most)) SELECT gate, count(*) AS n_words, count(*) FILTER (fan <= most) AS n_short, CAST(sum(CASE WHEN fan <= most THEN length(code) - length(short) ELSE 0 END) AS BIGINT) AS keys_saved FROM w JOIN f USING (short), g GROUP BY 1",
    "recall_at_k": _DEC + f", {_INTENDED}, {_KINDS}, w AS (SELECT observed, text, coalesce(kind, 'other') AS kind FROM knd WHERE text IN (SELECT text FROM lex)), r AS (SELECT observed, text, min(rank) AS rank FROM dec WHERE rank <= 10 GROUP BY 1, 2) SELECT kind, count(*) AS n, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 10) AS top10 FROM w LEFT JOIN r USING (observed, text) GROUP BY 1",
    "oov_exposure": f"WITH {V.LEX}, {V.UD}, f AS (SELECT split, unnest(items) AS form FROM spk), g AS (SELECT split, form, count(*) AS n, form IN (SELECT text FROM lex) AS known FROM f GROUP BY 1, 2) SELECT split, CAST(sum(n) AS BIGINT) AS n_forms, CAST(coalesce(sum(n) FILTER (NOT known), 0) AS BIGINT) AS n_unknown, count(*) FILTER (NOT known) AS n_distinct_unknown, round(coalesce(sum(n) FILTER (NOT known), 0) / sum(n), 6) AS rate FROM g GROUP BY 1",
    "rejection_sweep": _MARGIN + " SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (known AND coalesce(margin >= t, false)) AS accepted_known, count(*) FILTER (NOT known AND NOT coalesce(margin >= t, false)) AS rejected_unknown, count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_unknown FROM mrg, range(0, 9) r(t) GROUP BY 1",
    "margin_range": _MARGIN + " SELECT known, count(*) AS n, count(margin) AS n_margins, min(margin) AS least, max(margin) AS most FROM mrg GROUP BY 1",
    "prefix_trajectory": f"""WITH RECURSIVE {V.LEX}, {V.SPELLINGS},
b AS (SELECT spelling, text, frequency, abbreviated FROM spl QUALIFY row_number() OVER (PARTITION BY spelling, text ORDER BY frequency DESC, abbreviated) = 1), tp AS (SELECT spelling, text FROM b QUALIFY row_number() OVER (PARTITION BY spelling ORDER BY frequency DESC, abbreviated, text) <= 10),
st AS (SELECT text, code, CAST(s AS INTEGER) AS syllable FROM lex, range(1, length(code) // 2 + 1) r(s)), m AS (SELECT syllable, (left(code, syllable * 2 - 1), text) IN (SELECT (spelling, text) FROM tp) AS o, (left(code, syllable * 2), text) IN (SELECT (spelling, text) FROM tp) AS e FROM st)
SELECT syllable, count(*) AS n, count(*) FILTER (o AND e) AS both, count(*) FILTER (o AND NOT e) AS lost, count(*) FILTER (NOT o AND e) AS gained, count(*) FILTER (NOT o AND NOT e) AS absent FROM m GROUP BY 1""",
    "word_shortened_codes": _LEX + f", c AS (SELECT text, code, {_CODES} AS cs FROM lex), f AS (SELECT text, code, array_to_string(cs[1:k], '') || coalesce(list_aggregate(list_transform(cs[k + 1:], lambda x: left(x, 1)), 'string_agg', ''), '') AS own FROM c, range(1, len(cs) + 1) t(k)) SELECT text, code, CAST(count(DISTINCT own) AS INTEGER) AS n_codes, CAST(min(length(own)) AS INTEGER) AS shortest FROM f GROUP BY 1, 2",
    "latency_summary": "WITH r AS (SELECT DISTINCT * FROM context_lab_runs WHERE ranking_millis IS NOT NULL), o AS (SELECT pool_depth, list(ranking_millis ORDER BY ranking_millis) AS v FROM r GROUP BY 1) SELECT pool_depth, len(v) AS n, v[1] AS least, v[len(v) // 2 + 1] AS median, v[CAST(ceil(len(v) * 95 / 100) AS INTEGER)] AS p95, v[len(v)] AS most FROM o",
}
