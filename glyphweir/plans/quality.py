"""Queries on loading and comparing data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweir.operators import copy_diff, line_parse
from glyphweir.sources.tables import table

OVERLAY_FIELDS = ["text", "pinyin", "frequency"]


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return line_parse.parse_deliveries(table(spark, folder, "technical_overlay_lines"), table(spark, folder, "pinyin_syllables"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).where("reason is not null").select("line_id", "reason")


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).where("reason is null").select("line_id", "package_id", "text", "pinyin", "frequency")


def p1_edits(spark: SparkSession, folder: str) -> DataFrame:
    """How often each sequence of edits states each reason."""
    kinds = F.array_join(F.transform("operations", lambda o: F.substring_index(o, "@", 1)), "+")
    return _parsed(spark, folder).where("reason is not null").groupBy("reason", kinds.alias("edits")).agg(F.count("*").alias("n_lines"))


def _copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "technical_overlay"), table(spark, folder, "technical_overlay_mirror")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copy_diff.compare_copies(*_copies(spark, folder), "entry_id", OVERLAY_FIELDS, ["revision"])


def p3_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Keys in either copy, from the blocks' bitmaps."""
    blocks = copy_diff.presence_blocks(*_copies(spark, folder), "entry_id", ["revision"])
    counts = ["in_primary", "in_mirror", "in_both", "only_primary", "only_mirror"]
    return blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_edits": p1_edits, "p3_found": p3_found, "p3_presence": p3_presence}

_P1 = r"""
WITH own AS (SELECT line_id, package_id, CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS l FROM technical_overlay_lines),
data AS (SELECT *, regexp_replace(l, '("([^"]|"")*")', 'q', 'g') AS bare FROM own
  WHERE rtrim(l, ' ') <> '' AND NOT starts_with(l, '#') AND l <> 'text' || chr(9) || 'pinyin' || chr(9) || 'frequency' AND l <> chr(65279) || 'text' || chr(9) || 'pinyin' || chr(9) || 'frequency'),
shape AS (SELECT *, regexp_full_match(l, '(?s)("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS quoted_well, length(bare) - length(replace(bare, chr(9), '')) + 1 AS columns FROM data),
parts AS (SELECT *, CASE WHEN quoted_well AND columns = 3 THEN regexp_extract(l, '(?s)^("(?:[^"]|"")*"|[^"\t]*)\t("(?:[^"]|"")*"|[^"\t]*)\t("(?:[^"]|"")*"|[^"\t]*)$', ['a', 'b', 'c']) END AS f FROM shape),
plain AS (SELECT *, CASE WHEN starts_with(f.a, '"') THEN replace(substr(f.a, 2, length(f.a) - 2), '""', '"') ELSE f.a END AS t,
  replace(replace(lower(CASE WHEN starts_with(f.b, '"') THEN replace(substr(f.b, 2, length(f.b) - 2), '""', '"') ELSE f.b END), 'u:', 'v'), 'ü', 'v') AS p,
  CASE WHEN starts_with(f.c, '"') THEN replace(substr(f.c, 2, length(f.c) - 2), '""', '"') ELSE f.c END AS n FROM parts),
said AS (SELECT line_id, package_id, t, p, n, CASE WHEN NOT quoted_well THEN 'broken_quote' WHEN columns <> 3 THEN 'column_count'
  WHEN rtrim(t, ' ') = '' OR regexp_matches(t, '[\x00-\x08\x0A-\x1F\x7F\x{FFFD}]') THEN 'bad_text'
  WHEN len(string_split(p, ' ')) > 12 OR NOT list_has_all((SELECT list(syllable) FROM pinyin_syllables), string_split(p, ' ')) THEN 'bad_pinyin'
  WHEN NOT regexp_full_match(n, '[0-9]+') OR COALESCE(TRY_CAST(n AS HUGEINT), 0) NOT BETWEEN 1 AND 9223372036854775807 THEN 'bad_frequency' END AS reason FROM plain)
"""

SQL = {
    "p1_found": _P1 + "SELECT line_id, reason FROM said WHERE reason IS NOT NULL",
    "p1_loaded": _P1 + "SELECT line_id, package_id, t AS text, p AS pinyin, CAST(n AS BIGINT) AS frequency FROM said WHERE reason IS NULL",
    "p3_found": """
WITH p AS (SELECT entry_id, max(struct_pack(r := revision, a := text, b := pinyin, c := frequency)) AS v FROM technical_overlay WHERE entry_id IS NOT NULL GROUP BY 1),
m AS (SELECT entry_id, max(struct_pack(r := revision, a := text, b := pinyin, c := frequency)) AS v FROM technical_overlay_mirror WHERE entry_id IS NOT NULL GROUP BY 1),
j AS (SELECT COALESCE(p.entry_id, m.entry_id) AS entry_id, p.entry_id IS NULL AS no_p, m.entry_id IS NULL AS no_m, p.v AS pv, m.v AS mv FROM p FULL JOIN m ON p.entry_id = m.entry_id)
SELECT entry_id, 'missing_in_mirror' AS difference FROM j WHERE no_m
UNION ALL SELECT entry_id, 'missing_in_primary' FROM j WHERE no_p
UNION ALL SELECT entry_id, 'text' FROM j WHERE NOT no_p AND NOT no_m AND pv.a IS DISTINCT FROM mv.a
UNION ALL SELECT entry_id, 'pinyin' FROM j WHERE NOT no_p AND NOT no_m AND pv.b IS DISTINCT FROM mv.b
UNION ALL SELECT entry_id, 'frequency' FROM j WHERE NOT no_p AND NOT no_m AND pv.c IS DISTINCT FROM mv.c""",
    "p3_presence": """
WITH p AS (SELECT DISTINCT entry_id FROM technical_overlay WHERE entry_id IS NOT NULL), m AS (SELECT DISTINCT entry_id FROM technical_overlay_mirror WHERE entry_id IS NOT NULL),
j AS (SELECT p.entry_id AS a, m.entry_id AS b FROM p FULL JOIN m ON p.entry_id = m.entry_id)
SELECT count(a) AS in_primary, count(b) AS in_mirror, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both, count(*) FILTER (b IS NULL) AS only_primary, count(*) FILTER (a IS NULL) AS only_mirror FROM j""",
}
