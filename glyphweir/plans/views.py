"""What the queries share: the lexicon, sentences and events of a data folder, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweir.functions import keys as K
from glyphweir.operators import events as E
from glyphweir.operators import lexicon as L
from glyphweir.sources.tables import table


def words(spark: SparkSession, folder: str, name: str = "technical_overlay") -> DataFrame:
    return L.lexicon(table(spark, folder, name))


def events(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    return E.delivered_once(table(spark, folder, "capsule_events"), *columns)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """Commits with all their keys: (event_id, session_id, segment_seq, pos, elapsed_ms, observed, text, composition)."""
    rows = table(spark, folder, "capsule_events").where("kind = 'Commit' and keys_complete and keys is not null")
    return E.delivered_once(rows, "session_id", "segment_seq", "pos", "elapsed_ms", K.typed_letters(F.col("keys")).alias("observed"), F.col("change.inserted").alias("text"), "composition")


def observed(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct codes typed."""
    rows = table(spark, folder, "capsule_events").where("event_id is not null and kind = 'Commit' and keys_complete and keys is not null")
    return rows.select(K.typed_letters(F.col("keys")).alias("observed")).where("observed <> ''").distinct()


def observed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct codes typed with the texts committed."""
    rows = table(spark, folder, "capsule_events").where("event_id is not null and kind = 'Commit' and keys_complete and keys is not null")
    return rows.select(K.typed_letters(F.col("keys")).alias("observed"), F.col("change.inserted").alias("text")).where("observed <> ''").distinct()


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(id, split, source, tokens) of each sentence once."""
    return table(spark, folder, "ud_sentences").where("id is not null").select("id", "split", "source", "tokens").distinct()


def spoken(spark: SparkSession, folder: str, splits: tuple[str, ...] = ()) -> DataFrame:
    """(id, split, items): the forms of each sentence in order without punctuation."""
    own = table(spark, folder, "ud_sentences").where("id is not null")
    if splits:
        own = own.where(F.col("split").isin(*splits))
    keep = F.filter("tokens", lambda t: t["upos"].isNull() | (t["upos"] != "PUNCT"))
    return own.select("id", "split", F.transform(keep, lambda t: t["form"]).alias("items")).distinct()


#: SQL of the same; each part may be put after WITH and joined by commas.
RAW = r"""
cur AS (SELECT entry_id, max(struct_pack(r := revision, t := text, p := pinyin, f := frequency)) AS v FROM {table} WHERE entry_id IS NOT NULL GROUP BY 1),
raw AS (SELECT entry_id, v.t AS text, v.p AS pinyin, v.f AS frequency, string_split(replace(replace(lower(trim(regexp_replace(v.p, '\s+', ' ', 'g'))), 'u:', 'v'), 'ü', 'v'), ' ') AS parts FROM cur),
syl AS (SELECT entry_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM raw WHERE pinyin IS NOT NULL),
coded AS (SELECT entry_id, array_to_string(list(y.code ORDER BY i), '') AS code, count(*) AS n, count(y.code) AS known FROM syl LEFT JOIN pinyin_syllables y ON s = y.syllable GROUP BY 1),
ent AS (SELECT raw.entry_id, text, pinyin, frequency, n, known, code,
  CASE WHEN coalesce(text, '') = '' THEN 'no_text' WHEN coalesce(trim(pinyin), '') = '' THEN 'no_pinyin' WHEN n <> known THEN 'unsupported_pinyin' WHEN n > 12 THEN 'too_long' WHEN coalesce(frequency, 0) <= 0 THEN 'no_frequency' END AS reason
  FROM raw LEFT JOIN coded USING (entry_id)),
lex AS (SELECT text, code, min(lower(pinyin)) AS pinyin, max(frequency) AS frequency FROM ent WHERE reason IS NULL GROUP BY 1, 2)"""
LEX = RAW.format(table="technical_overlay")


def renamed(sql: str, suffix: str) -> str:
    """The lexicon's SQL with other names, to have it twice."""
    import re

    return re.sub(r"\b(cur|raw|syl|coded|ent|lex)\b", lambda m: m.group(1) + suffix, sql)


EVENTS = """
ev AS (SELECT DISTINCT event_id, session_id, segment_seq, pos, elapsed_ms, kind, keys, keys_complete, composition, change, producer_version FROM capsule_events WHERE event_id IS NOT NULL),
com AS (SELECT event_id, session_id, segment_seq, pos, elapsed_ms, array_to_string(list_filter(keys, lambda k: regexp_full_match(k, '[a-z]')), '') AS observed, change.inserted AS text, composition FROM ev WHERE kind = 'Commit' AND keys_complete AND keys IS NOT NULL),
obs AS (SELECT DISTINCT observed FROM com WHERE observed <> '')"""

UD = """
ud AS (SELECT id, any_value(split) AS split, any_value(source) AS source, any_value(tokens) AS tokens FROM ud_sentences WHERE id IS NOT NULL GROUP BY 1),
spk AS (SELECT id, split, [t.form for t in tokens if t.upos IS NULL OR t.upos <> 'PUNCT'] AS items FROM ud)"""

SPELLINGS = """
spl AS (WITH RECURSIVE g AS (SELECT text, code, frequency, '' AS spelling, 0 AS abbreviated, 0 AS done FROM lex
  UNION ALL SELECT text, code, frequency, spelling || CASE WHEN o.short = 1 THEN substr(code, done * 2 + 1, 1) ELSE substr(code, done * 2 + 1, 2) END, abbreviated + o.short, done + 1 FROM g, (VALUES (0), (1)) o(short) WHERE done * 2 < length(code))
  SELECT text, code, frequency, spelling, abbreviated FROM g WHERE done * 2 = length(code))"""

NEAR = "nb AS (SELECT left(p, 1) AS intended, right(p, 1) AS actual FROM (SELECT unnest([" + ", ".join(f"'{p}'" for p in K.PAIRS) + "]) AS p))"

HYPOTHESES = """
hyp AS (SELECT o AS observed, intended, arg_min(kind, r) AS kind FROM (
  SELECT observed AS o, observed AS intended, 'exact' AS kind, 0 AS r FROM {codes}
  UNION ALL SELECT observed, left(observed, i - 1) || substr(observed, i + 1, 1) || substr(observed, i, 1) || substr(observed, i + 2), 'swap', 1 FROM {codes}, range(1, length(observed)) t(i) WHERE substr(observed, i, 1) <> substr(observed, i + 1, 1)
  UNION ALL SELECT observed, left(observed, i - 1) || nb.actual || substr(observed, i + 1), 'neighbour', 2 FROM {codes}, range(1, length(observed) + 1) t(i), nb WHERE nb.intended = substr(observed, i, 1)
  UNION ALL SELECT observed, left(observed, i - 1) || substr(observed, i + 1), 'extra', 4 FROM {codes}, range(1, length(observed) + 1) t(i)) WHERE intended <> '' GROUP BY 1, 2)"""

MATCHES = """
mat AS (SELECT h.observed, text, code, spelling, abbreviated, h.kind, frequency FROM hyp h JOIN spl s ON h.intended = s.spelling
  UNION ALL SELECT DISTINCT o.observed, text, code, spelling, abbreviated, 'missing', frequency FROM (SELECT *, unnest(range(1, length(spelling) + 1)) AS i FROM spl) s JOIN {codes} o ON o.observed = left(spelling, i - 1) || substr(spelling, i + 1)),
sco AS (SELECT *, round(ln(frequency) - CASE kind WHEN 'exact' THEN 0 WHEN 'swap' THEN 2.25 WHEN 'neighbour' THEN 2.75 ELSE 3.0 END - 0.85 * abbreviated, 9) AS score, CASE kind WHEN 'exact' THEN 0 WHEN 'swap' THEN 1 WHEN 'neighbour' THEN 2 WHEN 'missing' THEN 3 ELSE 4 END AS kr FROM mat),
bst AS (SELECT * FROM sco QUALIFY row_number() OVER (PARTITION BY observed, text, code ORDER BY score DESC, abbreviated, kr, text, spelling, code) = 1),
dec AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY score DESC, abbreviated, kr, text, spelling, code) AS rank FROM bst)"""

DECODED = f"{LEX}, {EVENTS}, {SPELLINGS}, {NEAR}, {HYPOTHESES.format(codes='obs')}, {MATCHES.format(codes='obs')}"
