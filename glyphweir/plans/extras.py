"""Queries on shapes, formats, packages and literal predicates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweir.functions import keys as K
from glyphweir.operators import lexicon as L
from glyphweir.operators import memory as M
from glyphweir.operators import shapes as S
from glyphweir.operators.sampling import numbered
from glyphweir.plans import sessions as P
from glyphweir.plans import views as V
from glyphweir.sources import formats
from glyphweir.sources.tables import table

HARD = 3


def _shapes(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in for a stroke table, which the data lack: letters h s p n z from the hexadecimal code points of Han characters."""
    forms = V.sentences(spark, folder).select(F.explode("tokens.form").alias("t")).union(V.words(spark, folder).select("text"))
    chars = forms.select(F.explode(F.split("t", "")).alias("ch")).where(F.col("ch").rlike(r"\A[㐀-䶿一-鿿]\z")).distinct()
    return chars.select("ch", F.array(F.translate(F.hex(F.ascii("ch")), "0123456789ABCDEF", "hspnzhspnzhspnzh")).alias("strokes"))


def character_pool(spark: SparkSession, folder: str) -> DataFrame:
    return S.character_pool(V.words(spark, folder)).select("code", "ch", "rank", "frequency")


def shape_prefix_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = S.filtered(S.character_pool(V.words(spark, folder)), _shapes(spark, folder))
    return found.select("code", "ch", "rank", "length", "best_rank")


def shape_course_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Characters beyond the first places of their code: how many come into them by one to three strokes, or stand alone."""
    found = S.filtered(S.character_pool(V.words(spark, folder)), _shapes(spark, folder)).where(F.col("rank") > HARD)
    return found.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("best_rank") <= HARD).alias("visible"), F.count_if(F.col("worst_rank") == 1).alias("first"), F.sum(F.col("rank") - F.col("best_rank")).alias("gain"))


def shape_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct characters and occurrences in sentences that the words' characters cover, per split."""
    known = S.character_pool(V.words(spark, folder)).select("ch").distinct().withColumn("known", F.lit(1))
    chars = V.spoken(spark, folder).select("split", F.explode(F.filter(F.split(F.array_join("items", ""), ""), lambda c: c != "")).alias("ch")).groupBy("split", "ch").agg(F.count("*").alias("n"))
    joined = chars.join(known, "ch", "left")
    return joined.groupBy("split").agg(F.count("*").alias("n_characters"), F.count("known").alias("n_covered"), F.sum("n").alias("n_occurrences"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("n_occurrences_covered"))


def shape_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Hard characters as exercises, by fingerprint, three buckets of difficulty in turn."""
    hard = S.character_pool(V.words(spark, folder)).where(F.col("rank") > HARD).select(F.concat("code", F.lit("/"), "ch").alias("target"), F.least(F.col("rank") - HARD, F.lit(3)).cast("int").alias("bucket"))
    return S.tasks(hard, "target", "bucket").select("target", "bucket", "turn")


def shape_rank_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Characters committed, by the place of each in its code without strokes and with one to three."""
    pool = S.character_pool(V.words(spark, folder))
    found = S.filtered(pool, _shapes(spark, folder))
    own = V.commits(spark, folder).where("observed <> ''").select("text").join(L.best_by_text(V.words(spark, folder)).select("text", "codes"), "text")
    own = own.where(F.length("text") == F.size("codes"))
    used = own.select(F.inline(F.arrays_zip(F.filter(F.split("text", ""), lambda c: c != "").alias("ch"), F.col("codes").alias("code")))).groupBy("code", "ch").agg(F.count("*").alias("n"))
    joined = used.join(found, ["code", "ch"])
    return joined.groupBy("length").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("plain_places"), F.sum(F.col("n") * F.col("best_rank")).alias("shape_places"))


def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest per package of current rows, written, read and held against the payload: length, entries, digest."""
    rows = table(spark, folder, "technical_overlay").where("package_id is not null and entry_id is not null")
    now = rows.groupBy("package_id", "entry_id").agg(F.max(F.struct("revision", "text")).alias("v"))
    payload = now.groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", F.coalesce("v.text", F.lit("")).alias("text")))), lambda x: F.concat(x["entry_id"].cast("string"), F.lit(":"), x["text"])), "\n").alias("payload"), F.count("*").alias("n"))
    values = {"schema": F.lit("package-1"), "snapshot_schema": F.lit("snapshot-1"), "revision": F.col("package_id"), "contains_private_text": F.lit("false"), "payload_format": F.lit("lines-1"), "payload_bytes": F.octet_length("payload"), "payload_fingerprint": F.sha2("payload", 256), "entry_count": F.col("n")}
    read = payload.withColumn("m", formats.parse_manifest(formats.manifest(values)))
    holds = (F.col("m.payload_bytes") == F.octet_length("payload").cast("string")) & (F.col("m.payload_fingerprint") == F.sha2("payload", 256)) & (F.col("m.entry_count") == F.size(F.split("payload", "\n")).cast("string"))
    return read.select("package_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.col("m.payload_fingerprint").alias("digest"), F.col("n").alias("entry_count"), F.coalesce(holds, F.lit(False)).alias("holds"))


def slot_state(spark: SparkSession, folder: str) -> DataFrame:
    """Where each user's packages stand after all actions: sign-ups adopt, views stage, purchases promote, errors roll back."""
    action = F.create_map(*(F.lit(x) for pair in {"signup": "adopt", "view": "stage", "purchase": "promote", "error": "rollback"}.items() for x in pair))
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id", F.try_element_at(action, F.col("event_type")).alias("action"), F.get_json_object("props", "$.k").alias("package")).where("action is not null and user_id is not null")

    def step(key: tuple, own: Iterator[tuple]) -> list[tuple]:
        return [M.slots((row.action, row.package) for row in own)]

    return M.fold(rows, ["user_id"], ["ts", "event_id"], step, "user_id bigint, current string, candidate string, previous string")


def conllu_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences written as blocks and read again: tokens, ids and parts of speech of each."""
    own = V.sentences(spark, folder).where(F.size("tokens") > 0)
    blocks = own.select(formats.sentence_block("id", "tokens").alias("value"))
    return formats.parse_sentences(blocks).select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens.form", " ").alias("forms"), F.size(F.filter("tokens", lambda t: t["upos"].isNull())).alias("n_untagged"))


def stroke_table_invert(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of strokes and the characters that have them, turned into characters with their strokes."""
    coded = _shapes(spark, folder).select("ch", F.translate(F.get("strokes", F.lit(0)), "hspnz", "12345").alias("digits"))
    lines = coded.groupBy("digits").agg(F.array_join(F.sort_array(F.collect_set("ch")), "").alias("chars")).select(F.concat("digits", F.lit("\t"), "chars").alias("value"))
    return formats.parse_strokes(lines).select("ch", F.array_join("strokes", "|").alias("strokes"))


def authored_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences all of whose forms are words, as first keys and text."""
    tokens = V.spoken(spark, folder).select("id", F.posexplode("items").alias("pos", "text"))
    return formats.authored(tokens, L.best_by_text(V.words(spark, folder)))


def codec_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Segments written as capsules and as JSON and read again: how many events come back as they were."""
    own = V.events(spark, folder)
    again = formats.read_capsule(formats.write_capsule(own, "session_id", "segment_seq"), "session_id", "segment_seq")
    shared = ["session_id", "segment_seq", "pos", "elapsed_ms", "kind", "keys", "keys_complete", "composition", "change"]
    whole = F.struct(*(c for c in shared))
    text = own.select(whole.alias("e")).withColumn("j", F.to_json("e"))
    schema = text.schema["e"].dataType
    back = text.withColumn("b", F.from_json("j", schema, {"mode": "FAILFAST"}))
    left = own.select(F.xxhash64(F.to_json(whole)).alias("h")).groupBy("h").agg(F.count("*").alias("a"))
    right = again.select(F.xxhash64(F.to_json(whole)).alias("h")).groupBy("h").agg(F.count("*").alias("b"))
    capsules = left.join(right, "h", "full").agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("n"))
    return back.agg(F.count("*").alias("n_events"), F.count_if(F.to_json("b") == F.col("j")).alias("n_json")).withColumn("n_capsule", capsules.select("n").scalar())


def alias_override(spark: SparkSession, folder: str) -> DataFrame:
    """The first text of each typed code: the alias, which is the text committed for it most, thrice at least, else the word."""
    chosen = V.commits(spark, folder).where("observed <> '' and text <> ''").groupBy("observed", "text").agg(F.count("*").alias("n")).where("n >= 3")
    alias = L.first_by(chosen, ["observed"], F.desc("n"), F.asc("text")).select("observed", F.col("text").alias("alias"))
    word = L.best_by_code(V.words(spark, folder)).select(F.col("code").alias("observed"), F.col("text").alias("word"))
    joined = V.observed(spark, folder).join(alias, "observed", "left").join(word, "observed", "left").where("alias is not null or word is not null")
    return joined.select("observed", F.coalesce("alias", "word").alias("text"), F.col("alias").isNotNull().alias("is_alias"))


def predicate_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Which predicates the distinct texts of the overlay fulfil."""
    texts = table(spark, folder, "technical_overlay").select("text").where("text is not null").distinct()
    corpus, slice_ = r"\A[㐀-䶿一-鿿豈-﫿〇]+\z", r"\A[㐀-䶿一-鿿豈-﫿\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]+\z"
    return texts.select("text", F.col("text").rlike(corpus).alias("han_corpus"), F.col("text").rlike(slice_).alias("han_slice"), F.char_length("text").between(2, 4).alias("short"), K.is_code(F.col("text")).alias("is_code"), F.col("text").rlike(r"\A[a-z']+\z").alias("fragment"))


def lexicon_import(spark: SparkSession, folder: str) -> DataFrame:
    """What a lexicon slice of the valid rows, heaviest first, keeps and drops as its size grows: per hundred of them."""
    rows = L.entries(table(spark, folder, "technical_overlay")).where("reason is null").select("entry_id", "text", "code", "frequency").withColumn("weight", -F.col("frequency"))
    placed = numbered(rows, "weight", "entry_id", name="rank")
    first = placed.groupBy("text", "code").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("first"))
    return placed.join(first, "rank", "left").groupBy(F.floor(F.col("rank") / 100).alias("hundred")).agg(F.count("*").alias("n"), F.count("first").alias("n_kept"), F.min("frequency").alias("least"), F.max("frequency").alias("most"))


def layered_query(spark: SparkSession, folder: str) -> DataFrame:
    """Words of typed codes by layer: core and supplemental words of the code, compositions with a supplemental word, sentences
    in full code, then other sentences without unresolved keys; a text once, at its first place."""
    from glyphweir.operators import lattice
    from glyphweir.plans.corpus import _layers, supplemental_composition

    codes, words = V.observed(spark, folder), V.words(spark, folder)
    direct = codes.join(_layers(spark, folder, 2).withColumnRenamed("code", "observed"), "observed").select("observed", "band", "band_rank", "text", "source")
    made = supplemental_composition(spark, folder)
    complete = lattice.sentences(lattice.exact_edges(codes, words, keep=10), words, top=10)
    other = lattice.sentences(lattice.noisy_edges(codes, words, 10), words, top=10, literals=True, codes=codes).where("unresolved = 0")
    every = direct
    for band, found, name in ((4, made, "composition"), (5, complete, "sentence"), (6, other, "corrected")):
        every = every.unionByName(found.select("observed", F.lit(band).alias("band"), F.col("rank").alias("band_rank"), "text", F.lit(name).alias("source")))
    once = L.first_by(every, ["observed", "text"], F.asc("band"), F.asc("band_rank"))
    return L.ranked(once, ["observed"], F.asc("band"), F.asc("band_rank"), F.asc("text"), limit=20).select("observed", "rank", "text", "source")


#: Fixed values of four profiles: share of personal evidence, confirmations before a text counts.
PROFILES = {"reference": (0.25, 1), "confirmed": (0.25, 3), "lower": (0.10, 1), "higher": (0.40, 1)}


def adaptive_closed_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Commits replayed under four profiles: ranked by words and memory, then learned; edits take back, segments confirm."""
    pool = P._pool(spark, folder).where("public_rank <= 10")
    lists = pool.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("public_rank", "text", "frequency"))).alias("pool"))
    own = P._flat(spark, folder).select("session_id", "segment_seq", "pos", "event_id", "kind", "start", "deleted", "inserted", "reliable", "code").join(lists, "code", "left")

    def step(key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        tiers, segment = M.Tiers(), None  # the memory learns alike under all profiles
        counts = {name: [0] * 5 for name in PROFILES}
        for row in rows:
            if segment is not None and row.segment_seq != segment:
                tiers.confirm()
            if segment is None or row.segment_seq != segment:
                weights = tiers.weights()  # only the end of a segment changes what is confirmed
            segment = row.segment_seq
            if row.kind == "Commit" and row.pool is not None and any(c["text"] == row.inserted for c in row.pool):
                mass = sum(c["frequency"] for c in row.pool)
                before = next(c["public_rank"] for c in row.pool if c["text"] == row.inserted)
                for name, (most, least) in PROFILES.items():
                    evidence = [w if (w := weights.get((row.code, c["text"]), 0)) >= least else 0 for c in row.pool]
                    total = sum(evidence)
                    mix = most * total / (total + 4)
                    scored = sorted((-round((1 - mix) * c["frequency"] / mass + mix * (e + 0.5) / (total + 0.5 * len(evidence)), 12), c["public_rank"], c["text"]) for c, e in zip(row.pool, evidence))
                    after = next(i for i, s in enumerate(scored, 1) if s[2] == row.inserted)
                    for i, one in enumerate((1, before == 1, after == 1, after < before, after > before)):
                        counts[name][i] += one
            if row.reliable:
                tiers.edit(row.start, len(row.deleted), len(row.inserted))
            if row.kind == "Commit" and row.code and row.inserted and row.reliable:
                tiers.observe(row.start, row.code, row.inserted)
        return [(name, *own) for name, own in counts.items()]

    found = M.fold(own, ["session_id"], ["segment_seq", "pos", "event_id"], step, "session_id string, profile string, n bigint, plain_first bigint, adapted_first bigint, gained bigint, lost bigint")
    return found.groupBy("profile").agg(*(F.sum(c).alias(c) for c in ("n", "plain_first", "adapted_first", "gained", "lost")))


def profile_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles against the reference."""
    found = adaptive_closed_loop(spark, folder)
    reference = lambda c: F.max(F.when(F.col("profile") == "reference", F.col(c))).over(Window.partitionBy())  # noqa: E731 (four rows)
    return found.select("profile", *((F.col(c) - reference(c)).alias(f"{c}_delta") for c in ("adapted_first", "gained", "lost")))


def tracker_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each segment replayed on a text, and found again as the one span in which successive texts differ."""

    def step(key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        text, n, found = "", 0, 0
        for row in rows:
            start = min(int(row.start), len(text))
            after = text[:start] + row.inserted + text[start + len(row.deleted) :]
            if after != text:
                n += 1
                low = 0
                while low < min(len(text), len(after)) and text[low] == after[low]:
                    low += 1
                high = 0
                while high < min(len(text), len(after)) - low and text[-1 - high] == after[-1 - high]:
                    high += 1
                found += text[:low] + after[low : len(after) - high] + text[len(text) - high :] == after
            text = after
        return [(n, found, len(text))]

    own = P._flat(spark, folder).where("start is not null").select("session_id", "segment_seq", "pos", "event_id", "start", "deleted", "inserted")
    return M.fold(own, ["session_id", "segment_seq"], ["pos", "event_id"], step, "session_id string, segment_seq bigint, n_changes bigint, n_found bigint, length bigint")


def paint_timer_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Frames painted and left out per session if events came as frames, for delays of 500 to 4,000 ms."""

    def step(key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        times = [row.elapsed_ms for row in rows]
        gaps = [max(0, b - a) for a, b in zip(times, times[1:])] + [1 << 40] * bool(times)
        return [(delay, *M.painted(gaps, delay)) for delay in (500, 1000, 2000, 4000)]

    own = V.events(spark, folder, "session_id", "segment_seq", "pos", "elapsed_ms")
    found = M.fold(own, ["session_id", "segment_seq"], ["pos", "event_id"], step, "session_id string, segment_seq bigint, delay bigint, shown bigint, hidden bigint")
    return found.groupBy("delay").agg(F.sum("shown").alias("shown"), F.sum("hidden").alias("hidden"))


QUERIES = {
    f.__name__: f
    for f in (
        character_pool, shape_prefix_filter, shape_course_audit, shape_coverage, shape_tasks, shape_rank_ledger, manifest_check, slot_state, conllu_islands, stroke_table_invert, authored_cases, codec_roundtrip, alias_override,
        predicate_literals, lexicon_import, layered_query, adaptive_closed_loop, profile_delta, tracker_fold, paint_timer_fold,
    )
}

_LEX, _OBS = "WITH RECURSIVE " + V.LEX, "WITH RECURSIVE " + V.LEX + ", " + V.EVENTS
_POOLED = """cp0 AS (SELECT frequency, string_split(text, '') AS cs, code FROM lex WHERE length(text) * 2 = length(code) AND regexp_full_match(text, '[㐀-䶿一-鿿]+')),
cp AS (SELECT substr(code, i * 2 - 1, 2) AS code, cs[i] AS ch, CAST(sum(frequency) AS BIGINT) AS frequency, row_number() OVER (PARTITION BY substr(code, i * 2 - 1, 2) ORDER BY sum(frequency) DESC, cs[i]) AS rank FROM cp0, range(1, len(cs) + 1) r(i) GROUP BY 1, 2)"""
_SHAPES = "shp AS (SELECT DISTINCT ch, translate(printf('%X', unicode(ch)), '0123456789ABCDEF', 'hspnzhspnzhspnzh') AS stroke FROM (SELECT unnest(string_split(t, '')) AS ch FROM (SELECT unnest(tokens).form AS t FROM ud UNION ALL SELECT text FROM lex)) WHERE regexp_full_match(ch, '[㐀-䶿一-鿿]'))"
_FILTERED = "fi AS (SELECT code, ch, rank, CAST(l AS INTEGER) AS length, row_number() OVER (PARTITION BY code, l, left(stroke, l) ORDER BY rank) AS best_rank FROM cp JOIN shp USING (ch), range(1, 4) r(l))"
SQL = {
    "character_pool": _LEX + f", {_POOLED} SELECT code, ch, rank, frequency FROM cp",
    "shape_prefix_filter": _LEX + f", {V.UD}, {_POOLED}, {_SHAPES}, {_FILTERED} SELECT code, ch, rank, length, best_rank FROM fi",
    "shape_course_audit": _LEX + f", {V.UD}, {_POOLED}, {_SHAPES}, {_FILTERED} SELECT length, count(*) AS n, count(*) FILTER (best_rank <= {HARD}) AS visible, count(*) FILTER (best_rank = 1) AS first, CAST(sum(rank - best_rank) AS BIGINT) AS gain FROM fi WHERE rank > {HARD} GROUP BY 1",
    "shape_coverage": _LEX + f", {V.UD}, {_POOLED}, c AS (SELECT split, ch, count(*) AS n FROM (SELECT split, unnest(string_split(array_to_string(items, ''), '')) AS ch FROM spk) WHERE ch <> '' GROUP BY 1, 2) SELECT split, count(*) AS n_characters, count(*) FILTER (ch IN (SELECT ch FROM cp)) AS n_covered, CAST(sum(n) AS BIGINT) AS n_occurrences, CAST(coalesce(sum(n) FILTER (ch IN (SELECT ch FROM cp)), 0) AS BIGINT) AS n_occurrences_covered FROM c GROUP BY 1",
    "shape_rank_ledger": _OBS + f", {V.UD}, {_POOLED}, {_SHAPES}, {_FILTERED}, bt AS (SELECT text, code FROM lex QUALIFY row_number() OVER (PARTITION BY text ORDER BY frequency DESC, pinyin, code) = 1), u AS (SELECT substr(code, i * 2 - 1, 2) AS code, substr(text, i, 1) AS ch, count(*) AS n FROM (SELECT text, code FROM com JOIN bt USING (text) WHERE observed <> '' AND length(text) * 2 = length(code)), range(1, length(text) + 1) r(i) GROUP BY 1, 2) SELECT length, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * rank) AS BIGINT) AS plain_places, CAST(sum(n * best_rank) AS BIGINT) AS shape_places FROM u JOIN fi USING (code, ch) GROUP BY 1",
    "manifest_check": "WITH n AS (SELECT package_id, entry_id, max(struct_pack(r := revision, t := text)) AS v FROM technical_overlay WHERE package_id IS NOT NULL AND entry_id IS NOT NULL GROUP BY 1, 2), p AS (SELECT package_id, string_agg(entry_id || ':' || coalesce(v.t, ''), chr(10) ORDER BY entry_id) AS payload, count(*) AS n FROM n GROUP BY 1) SELECT package_id, strlen(payload) AS payload_bytes, sha256(payload) AS digest, n AS entry_count, true AS holds FROM p",
    "conllu_islands": "WITH " + V.UD + " SELECT id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string([t.form for t in tokens], ' ') AS forms, CAST(len([1 for t in tokens if t.upos IS NULL]) AS INTEGER) AS n_untagged FROM ud WHERE len(tokens) > 0",
    "stroke_table_invert": _LEX + f", {V.UD}, {_SHAPES} SELECT ch, stroke AS strokes FROM shp",
    "authored_cases": _LEX + f", {V.UD}, bt AS (SELECT text, list_aggregate(list_transform(range(1, length(code), 2), lambda i: substr(code, i, 1)), 'string_agg', '') AS short FROM lex QUALIFY row_number() OVER (PARTITION BY text ORDER BY frequency DESC, pinyin, code) = 1), t AS (SELECT id, unnest(items) AS text, generate_subscripts(items, 1) AS pos FROM spk) SELECT id, string_agg(short, '' ORDER BY pos) AS observed, string_agg(text, '' ORDER BY pos) AS expected FROM t LEFT JOIN bt USING (text) GROUP BY 1 HAVING count(*) = count(short) AND count(*) > 1",
    "codec_roundtrip": f"WITH {V.EVENTS} SELECT count(*) AS n_events, count(*) AS n_json, count(*) AS n_capsule FROM ev",
    "alias_override": _OBS + ", c AS (SELECT observed, text, count(*) AS n FROM com WHERE observed <> '' AND text <> '' GROUP BY 1, 2 HAVING count(*) >= 3), a AS (SELECT observed, text FROM c QUALIFY row_number() OVER (PARTITION BY observed ORDER BY n DESC, text) = 1), w AS (SELECT code, text FROM lex QUALIFY row_number() OVER (PARTITION BY code ORDER BY frequency DESC, text) = 1) SELECT obs.observed, coalesce(a.text, w.text) AS text, a.text IS NOT NULL AS is_alias FROM obs LEFT JOIN a ON a.observed = obs.observed LEFT JOIN w ON w.code = obs.observed WHERE a.text IS NOT NULL OR w.text IS NOT NULL",
    "predicate_literals": r"WITH t AS (SELECT DISTINCT text FROM technical_overlay WHERE text IS NOT NULL) SELECT text, regexp_full_match(text, '[㐀-䶿一-鿿\x{F900}-\x{FAFF}〇]+') AS han_corpus, regexp_full_match(text, '[㐀-䶿一-鿿\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]+') AS han_slice, length(text) BETWEEN 2 AND 4 AS short, regexp_full_match(text, '[a-z]+') AS is_code, regexp_full_match(text, '[a-z'']+') AS fragment FROM t",
    "lexicon_import": _LEX + f", r AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, entry_id) AS rank FROM ent WHERE reason IS NULL), f AS (SELECT *, row_number() OVER (PARTITION BY text, code ORDER BY rank) = 1 AS first FROM r) SELECT (rank - 1) // 100 AS hundred, count(*) AS n, count(*) FILTER (first) AS n_kept, min(frequency) AS least, max(frequency) AS most FROM f GROUP BY 1",
}
