"""SQL of the queries on transitions, sentences and re-ranked words."""

from __future__ import annotations

from glyphweir.plans import views as V
from glyphweir.plans.decoding import _ANCHORED, _INTENDED, _SHORT

_UD, _OBS, _LEX = "WITH RECURSIVE " + V.UD, "WITH RECURSIVE " + V.LEX + ", " + V.EVENTS, "WITH RECURSIVE " + V.LEX
_DEC = "WITH RECURSIVE " + V.DECODED
_BI = """
tr AS (SELECT items[i] AS prev, items[i + 1] AS cur FROM spk, range(1, len(items)) r(i) WHERE split = 'train'),
bg AS (SELECT prev, cur, n, CAST(sum(n) OVER (PARTITION BY prev) AS BIGINT) AS total FROM (SELECT prev, cur, count(*) AS n FROM tr GROUP BY 1, 2))"""
_CHARS = "chs AS (SELECT id, split, list_concat(['^'], list_filter(string_split(array_to_string(items, ''), ''), lambda c: c <> ''), ['$']) AS items FROM spk WHERE array_to_string(items, '') <> '')"
_CBI = _BI.replace("FROM spk,", "FROM chs,")


def _scored(source: str, vocabulary: str) -> str:
    return f"""
st AS (SELECT id, items[i] AS prev, items[i + 1] AS cur, count(*) AS times FROM {source}, range(1, len(items)) r(i) WHERE split IN ('dev', 'test') GROUP BY 1, 2, 3)
SELECT id, CAST(sum(times) AS BIGINT) AS n_transitions, CAST(coalesce(sum(times) FILTER (bg.n IS NOT NULL), 0) AS BIGINT) AS n_observed,
round(sum(times * ln((coalesce(bg.n, 0) + 0.5) / (coalesce(t.total, 0) + 0.5 * {vocabulary}))), 6) AS score FROM st LEFT JOIN bg USING (prev, cur) LEFT JOIN (SELECT DISTINCT prev, total FROM bg) t USING (prev) GROUP BY 1"""


_EDGES = """ed AS (SELECT observed, lo AS low, hi AS high, text, code, frequency FROM obs, range(0, length(observed), 2) a(lo), range(lo + 2, least(length(observed), lo + 24) + 1, 2) b(hi), lex
  WHERE length(observed) % 2 = 0 AND code = substr(observed, lo + 1, hi - lo))"""
_TWO = """bt AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY text ORDER BY frequency DESC, pinyin, code) = 1),
tw AS (SELECT observed, cutp, a.text AS first, b.text AS second, b.code AS c2, round(ln(a.frequency) + ln(b.frequency), 9) AS score FROM obs, range(2, length(observed) - 1, 2) r(cutp) JOIN bt a ON a.code = left(observed, cutp) JOIN bt b ON b.code = substr(observed, cutp + 1) WHERE length(observed) >= 4 AND length(observed) % 2 = 0),
t1 AS (SELECT *, first || second AS text FROM tw QUALIFY row_number() OVER (PARTITION BY observed, first || second ORDER BY score DESC, cutp) = 1),
t2 AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY score DESC, text) AS rank FROM t1)"""
_PAIRS = """b2 AS (SELECT code, text, max(frequency) AS frequency FROM lex WHERE length(code) = 2 GROUP BY 1, 2), p2 AS (SELECT code, text, row_number() OVER (PARTITION BY code ORDER BY frequency DESC, text) AS r FROM b2 QUALIFY r <= 24),
x2 AS (SELECT observed, a.text || c.text AS text, a.r AS r1, c.r AS r2 FROM obs JOIN p2 a ON a.code = left(observed, 2) JOIN p2 c ON c.code = right(observed, 2) WHERE length(observed) = 4 QUALIFY row_number() OVER (PARTITION BY observed, a.text || c.text ORDER BY a.r + c.r, a.r) = 1)"""
_LAYERS = f"""WITH {V.renamed(V.LEX, 'a')}, {V.renamed(V.RAW.format(table='technical_overlay_mirror'), 'b')},
co AS (SELECT code, text, row_number() OVER (PARTITION BY code ORDER BY frequency DESC, text) AS r FROM lexa),
nv AS (SELECT code, text, row_number() OVER (PARTITION BY code ORDER BY frequency DESC, text) AS r FROM lexb WHERE (code, text) NOT IN (SELECT (code, text) FROM lexa))"""
_EVI = "evd AS (SELECT word AS text, sum(n) AS count FROM (SELECT DISTINCT * FROM personal_word_counts) GROUP BY 1)"
_POOL = f"pool AS (SELECT d.*, e.count FROM dec d LEFT JOIN evd e USING (text) WHERE d.rank <= 10)"
_BEFORE = "bef AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY session_id, segment_seq ORDER BY pos, event_id) AS before FROM com WHERE observed <> '') WHERE before IS NOT NULL)"
_PP = "pp AS (SELECT previous_word AS before, current_word AS text, sum(n) AS n FROM (SELECT DISTINCT * FROM personal_pair_counts) GROUP BY 1, 2)"

SQL = {
    "bigram_counts": _UD + f", {_BI} SELECT prev, cur, n, total FROM bg",
    "bigram_score": _UD + f", {_BI}, {_scored('spk', '(SELECT count(DISTINCT f) FROM (SELECT unnest(items) AS f FROM spk WHERE split = ' + chr(39) + 'train' + chr(39) + '))')}",
    "char_bigram_counts": _UD + f", {_CHARS}, {_CBI} SELECT prev, cur, n, total FROM bg",
    "char_text_score": _UD + f", {_CHARS}, {_CBI}, {_scored('chs', '(SELECT count(DISTINCT f) FROM (SELECT unnest(items) AS f FROM chs WHERE split = ' + chr(39) + 'train' + chr(39) + '))')}",
    "lm_stats": _UD + f", {_BI} SELECT (SELECT count(*) FROM bg) AS n_types, count(*) AS n_instances, count(DISTINCT prev) AS n_contexts, (SELECT count(DISTINCT f) FROM (SELECT unnest(items) AS f FROM spk WHERE split = 'train')) AS vocabulary FROM tr",
    "lattice_edges": _OBS + f", {_EDGES} SELECT observed, count(*) AS n_edges, count(DISTINCT low) AS n_starts, max(high) AS furthest FROM ed GROUP BY 1",
    "complete_sentence": _OBS + f""", {_EDGES}, path AS (SELECT observed, 0 AS cutp, '' AS text, 0.0::DOUBLE AS score, 0 AS n FROM obs UNION ALL SELECT p.observed, e.high, p.text || e.text, p.score + ln(e.frequency / (SELECT sum(frequency) FROM lex)), n + 1 FROM path p JOIN ed e ON e.observed = p.observed AND e.low = p.cutp),
done AS (SELECT observed, text, round(score, 9) AS score, score AS exact, n FROM path WHERE cutp = length(observed) QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY round(score, 9) DESC, n) = 1)
SELECT observed, CAST(row_number() OVER (PARTITION BY observed ORDER BY score DESC, n, text) AS INTEGER) AS rank, text, round(exact, 6) AS score FROM done QUALIFY rank <= 5""",
    "literal_fallback": _OBS + f", {V.SPELLINGS}, sp AS (SELECT DISTINCT spelling FROM spl), hit AS (SELECT DISTINCT observed FROM obs, range(1, length(observed) + 1) a(i), range(1, least(length(observed) - i + 1, 24) + 1) b(n) WHERE substr(observed, i, n) IN (SELECT spelling FROM sp)) SELECT observed, '〔' || array_to_string(string_split(observed, ''), '〕〔') || '〕' AS text, round(-8.0 * length(observed), 3) AS score FROM obs WHERE observed NOT IN (SELECT observed FROM hit)",
    "protocol_decode": _OBS + f", {_TWO} SELECT observed, rank, text, round(score, 6) AS score FROM t2 WHERE rank <= 5",
    "continuous_composition": _OBS + f", {_TWO} SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 10) AS top10, CAST(sum(length(com.observed)) AS BIGINT) AS n_keys, CAST(coalesce(sum(length(c2) // 2 - 1), 0) AS BIGINT) AS keys_saved FROM com LEFT JOIN t2 ON t2.observed = com.observed AND t2.text = com.text AND t2.rank <= 10 WHERE com.observed <> ''",
    "interactive_query": _OBS
    + f""", {_TWO}, {_PAIRS}, ask AS (SELECT DISTINCT observed, code FROM (WITH RECURSIVE g AS (SELECT observed, '' AS code, 0 AS done FROM obs WHERE length(observed) % 2 = 0 UNION ALL
  SELECT observed, code || CASE WHEN o.v = 1 THEN substr(observed, done + 1, 1) || 'v' ELSE substr(observed, done + 1, 2) END, done + 2 FROM g, (VALUES (0), (1)) o(v) WHERE done < length(observed) AND (o.v = 0 OR regexp_full_match(substr(observed, done + 1, 2), '[jqxy]u'))) SELECT observed, code FROM g WHERE done = length(observed))),
e1 AS (SELECT observed, text, lex.code, frequency FROM ask JOIN lex USING (code) QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY frequency DESC, lex.code) = 1),
al AS (SELECT observed, 1 AS lane, row_number() OVER (PARTITION BY observed ORDER BY frequency DESC, text, code) AS lr, text FROM e1 QUALIFY lr <= 10
  UNION ALL SELECT observed, 2, row_number() OVER (PARTITION BY observed ORDER BY r1 + r2, r1, text) AS lr, text FROM x2 QUALIFY lr <= 50
  UNION ALL SELECT observed, 3, rank, text FROM t2 WHERE rank <= 20),
fs AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY lane, lr) = 1)
SELECT observed, row_number() OVER (PARTITION BY observed ORDER BY lane, lr) AS rank, lane, text FROM fs QUALIFY rank <= 20""",
    "layer_merge": _LAYERS + ", b AS (SELECT code, CASE WHEN r = 1 THEN 1 ELSE 3 END AS band, r, text, 'core' AS source FROM co UNION ALL SELECT code, 2, r, text, 'supplement' FROM nv WHERE r <= 1) SELECT code, row_number() OVER (PARTITION BY code ORDER BY band, r, text) AS rank, text, source FROM b QUALIFY rank <= 20",
    "layer_audit": _LAYERS + ", cs AS (SELECT code, count(*) FILTER (s = 'n' AND r <= cap) AS n, count(*) FILTER (s = 'c' AND r = 1) AS core, cap FROM (SELECT code, r, 'c' AS s FROM co UNION ALL SELECT code, r, 'n' FROM nv), (VALUES (1), (2), (3)) v(cap) GROUP BY code, cap) SELECT cap, CAST(sum(n) AS BIGINT) AS n_admitted, count(*) FILTER (n > 0) AS n_codes, count(*) FILTER (core = 0 AND n > 0) AS n_new_codes, count(*) FILTER (core = 1) AS n_first_kept FROM cs GROUP BY 1",
    "frozen_pool_rerank": _DEC + f""", {_EVI}, {_POOL}, pl AS (SELECT observed, text, code, rank, kind = 'exact' AND abbreviated = 0 AS ok, row_number() OVER (PARTITION BY observed, ok ORDER BY rank) AS slot, row_number() OVER (PARTITION BY observed, ok ORDER BY coalesce(count, 0) DESC, rank) AS turn FROM pool)
SELECT a.observed, a.text, a.code, a.rank, b.rank AS new_rank FROM pl a JOIN pl b ON a.observed = b.observed AND a.ok = b.ok AND a.turn = b.slot""",
    "hybrid_rerank": _DEC + f", {_EVI}, {_POOL}, h AS (SELECT *, round(score + 0.5 * ln(1 + coalesce(count, 0)), 6) AS hybrid FROM pool) SELECT observed, text, code, rank, row_number() OVER (PARTITION BY observed ORDER BY hybrid DESC, rank) AS new_rank, hybrid FROM h",
    "conservative_top1": _DEC + f", {_EVI}, {_POOL}, l AS (SELECT observed, text AS leader, score AS lead, coalesce(count, 0) AS lc FROM pool WHERE rank = 1 AND kind = 'exact') SELECT observed, leader, text AS winner, CAST(count AS BIGINT) AS count FROM pool JOIN l USING (observed) WHERE rank BETWEEN 2 AND 6 AND kind = 'exact' AND count >= 3 AND count > lc AND round(lead - score, 6) <= 1.0 QUALIFY row_number() OVER (PARTITION BY observed ORDER BY count DESC, rank) = 1",
    "hybrid_metrics_grid": _DEC + f""", {_EVI}, {_POOL}, w AS (SELECT observed, text, count(*) AS times FROM com WHERE observed <> '' GROUP BY 1, 2), h AS (SELECT observed, text, weight, row_number() OVER (PARTITION BY observed, weight ORDER BY round(score + weight * ln(1 + coalesce(count, 0)), 6) DESC, rank) AS nr FROM pool, (VALUES (0.0::DOUBLE), (0.125), (0.25), (0.5), (1.0), (2.0)) v(weight)),
m AS (SELECT observed, text, weight, min(nr) AS nr FROM h GROUP BY 1, 2, 3) SELECT weight, CAST(sum(times) AS BIGINT) AS n, CAST(sum(CASE WHEN nr <= 1 THEN times ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN nr <= 5 THEN times ELSE 0 END) AS BIGINT) AS top5 FROM m JOIN w USING (observed, text) GROUP BY 1""",
    "public_context_rerank": _DEC + f""", {_BEFORE}, {_PP}, ask AS (SELECT DISTINCT observed, before FROM bef), pl AS (SELECT observed, text, min(rank) AS rank, arg_min(frequency, rank) AS frequency FROM dec WHERE rank <= 10 GROUP BY 1, 2),
c AS (SELECT a.observed, a.before, p.text, p.rank, round(0.35 * ln(p.frequency / (SELECT sum(frequency) FROM lex)) + 0.65 * ln((coalesce(pp.n, 0) + 0.5) / (coalesce(t.total, 0) + 0.5 * (SELECT count(DISTINCT text) FROM lex))), 6) AS context FROM ask a JOIN pl p USING (observed) LEFT JOIN pp ON pp.before = a.before AND pp.text = p.text LEFT JOIN (SELECT before, sum(n) AS total FROM pp GROUP BY 1) t ON t.before = a.before)
SELECT observed, before, text, rank, context FROM c QUALIFY row_number() OVER (PARTITION BY observed, before ORDER BY context DESC, rank) = 1""",
    "context_oracle": _DEC + f""", {_BEFORE}, {_PP}, j AS (SELECT coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM bef JOIN dec ON dec.observed = bef.observed AND dec.rank = 1 LEFT JOIN pp x ON x.before = bef.before AND x.text = bef.text LEFT JOIN pp y ON y.before = bef.before AND y.text = dec.text WHERE bef.text <> dec.text)
SELECT CASE WHEN a > b THEN 'win' WHEN a < b THEN 'lose' ELSE 'tie' END AS outcome, count(*) AS n, CAST(min(a - b) AS BIGINT) AS least, CAST(max(a - b) AS BIGINT) AS most FROM j GROUP BY 1""",
    "failure_decomposition": _DEC + f""", {_INTENDED}, r AS (SELECT observed, text, min(rank) AS rank FROM dec WHERE rank <= 10 GROUP BY 1, 2), f AS (SELECT code, count(DISTINCT text) AS fan FROM lex GROUP BY 1)
SELECT CASE WHEN rank = 1 THEN 'first' WHEN rank IS NOT NULL THEN 'deeper' WHEN coalesce(fan, 0) = 0 THEN 'other_reading' WHEN i.observed <> intended THEN 'mistyped' ELSE 'crowded' END AS reason, count(*) AS n, max(fan) AS most_texts FROM itd i LEFT JOIN r USING (observed, text) LEFT JOIN f ON f.code = intended WHERE i.text IN (SELECT text FROM lex) GROUP BY 1""",
    "protocol_context": _OBS + f""", {_TWO}, {_PP}, w AS (SELECT DISTINCT observed, text FROM com WHERE observed <> ''), c AS (SELECT tw.observed, cutp, first || second AS text, score, round(score + ln(1 + coalesce(n, 0)), 9) AS context FROM tw LEFT JOIN pp ON pp.before = first AND pp.text = second),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY context DESC, score DESC, cutp) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY score DESC, text) AS plain, row_number() OVER (PARTITION BY observed ORDER BY context DESC, text) AS aware FROM o)
SELECT count(*) AS n, count(*) FILTER (plain = 1) AS plain_first, count(*) FILTER (aware = 1) AS aware_first, count(*) FILTER (aware < plain) AS improved, count(*) FILTER (aware > plain) AS worsened FROM w JOIN k USING (observed, text)""",
    "paired_rank_stats": f"""WITH RECURSIVE {V.LEX}, {V.EVENTS}, {_INTENDED}, own AS (SELECT event_id, observed, text, intended FROM itd WHERE intended <> ''), q AS (SELECT observed FROM own UNION SELECT intended FROM own), {V.SPELLINGS}, {V.NEAR}, {V.HYPOTHESES.format(codes='q')}, {V.MATCHES.format(codes='q')},
r AS (SELECT observed, text, min(rank) AS rank FROM dec WHERE rank <= 10 GROUP BY 1, 2), j AS (SELECT x.rank AS a, y.rank AS b FROM own LEFT JOIN r x ON x.observed = own.observed AND x.text = own.text LEFT JOIN r y ON y.observed = intended AND y.text = own.text)
SELECT count(*) AS n, count(*) FILTER (a < b OR (a IS NOT NULL AND b IS NULL)) AS improved, count(*) FILTER (a = b) AS same, count(*) FILTER (a > b OR (a IS NULL AND b IS NOT NULL)) AS worsened, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS dropped, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS recovered, count(*) FILTER (a IS NULL AND b IS NULL) AS hidden, CAST(coalesce(sum(coalesce(a, 11) - b) FILTER (b IS NOT NULL), 0) AS BIGINT) AS degradation FROM j""",
    "candidate_lab_actions": _LEX + f", bt AS (SELECT * FROM lex WHERE length(code) >= 4 QUALIFY row_number() OVER (PARTITION BY text ORDER BY frequency DESC, pinyin, code) = 1), p AS (SELECT text, code, {_ANCHORED} AS short, frequency FROM bt), r AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY frequency DESC, text) AS rank FROM p) SELECT text, short, rank, length(short) + 1 + CASE WHEN rank > 1 THEN 1 ELSE 0 END AS actions, length(code) - length(short) - CASE WHEN rank > 1 THEN 1 ELSE 0 END AS saved FROM r WHERE rank <= 10",
    "retained_visible_texts": f"""WITH RECURSIVE {V.LEX}, {V.EVENTS}, own AS (SELECT observed, left(observed, length(observed) - 1) AS shorter FROM obs WHERE length(observed) > 1), q AS (SELECT observed FROM own UNION SELECT shorter FROM own), {V.SPELLINGS}, {V.NEAR}, {V.HYPOTHESES.format(codes='q')}, {V.MATCHES.format(codes='q')},
s AS (SELECT DISTINCT observed, text FROM dec WHERE rank <= 10) SELECT o.observed, count(*) AS n_texts, count(*) FILTER ((shorter, text) IN (SELECT (observed, text) FROM s)) AS n_kept FROM own o JOIN s USING (observed) GROUP BY 1""",
    "spread_sample": "WITH s AS (SELECT DISTINCT id FROM ud_sentences WHERE id IS NOT NULL), p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM s), k AS (SELECT t.k AS sample, (t.k * n + n // 2) // least(100, n) AS w FROM (SELECT count(*) AS n FROM s), range(0, 100) t(k) WHERE t.k < least(100, n)) SELECT sample, id FROM p JOIN k ON i = w",
    "fit_dev_split": _UD + " SELECT id, (row_number() OVER (ORDER BY id) - 1) % 5 = 4 AS held_out FROM ud WHERE split = 'train'",
    "whitelist_shortcuts": _UD + f", {V.LEX}, {_BI}, bt AS (SELECT text, {_SHORT} AS short FROM lex QUALIFY row_number() OVER (PARTITION BY text ORDER BY frequency DESC, pinyin, code) = 1), p AS (SELECT a.short || b.short AS short, prev || cur AS phrase, sum(n) AS n FROM bg JOIN bt a ON a.text = prev JOIN bt b ON b.text = cur GROUP BY 1, 2) SELECT short, max(phrase) AS phrase, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1 HAVING count(*) = 1 AND sum(n) >= 2",
    "personal_promotion": _DEC + """, own AS (SELECT DISTINCT session_id, observed FROM com WHERE observed <> ''), ca AS (SELECT session_id, word AS text, sum(n) AS c FROM (SELECT DISTINCT * FROM personal_word_counts) GROUP BY 1, 2), pl AS (SELECT observed, text, min(rank) AS rank FROM dec WHERE rank <= 10 GROUP BY 1, 2),
l AS (SELECT own.session_id, own.observed, pl.text, rank, coalesce(c, 0) AS c FROM own JOIN pl USING (observed) LEFT JOIN ca ON ca.session_id = own.session_id AND ca.text = pl.text)
SELECT session_id, observed, text, rank, row_number() OVER (PARTITION BY session_id, observed ORDER BY greatest(rank - 1 - CASE WHEN c >= 4 THEN 3 WHEN c >= 2 THEN 2 WHEN c >= 1 THEN 1 ELSE 0 END, 0), c DESC, rank, text) AS new_rank FROM l QUALIFY new_rank <= 3""",
}
