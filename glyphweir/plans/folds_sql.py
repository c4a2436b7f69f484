"""SQL of queries that fold events or paths in order, by recursion."""

from __future__ import annotations

from glyphweir.plans import views as V
from glyphweir.plans.corpus_sql import _EDGES, _OBS, _PP, _UD
from glyphweir.plans.sessions_sql import _EV

_ORDER = "row_number() OVER (PARTITION BY session_id, segment_seq ORDER BY pos, event_id)"

#: The ten best readings of typed codes as any number of words, with the texts and codes of each one's best cut.
_READ = f"""{_EDGES}, path AS (SELECT observed, 0 AS cutp, '' AS text, []::VARCHAR[] AS texts, []::VARCHAR[] AS codes, 0.0::DOUBLE AS score FROM obs UNION ALL SELECT p.observed, e.high, p.text || e.text, list_append(p.texts, e.text), list_append(p.codes, e.code), p.score + ln(e.frequency / (SELECT sum(frequency) FROM lex)) FROM path p JOIN ed e ON e.observed = p.observed AND e.low = p.cutp),
one AS (SELECT *, -round(score, 9) AS cost FROM path WHERE cutp = length(observed) QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY -round(score, 9), len(texts), texts, codes) = 1),
rd AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY cost, len(texts), text) AS rank FROM one QUALIFY rank <= 10)"""

#: Edges of typed codes over all spellings and one edit, the best five of each use, as lattice.noisy_edges keeps them.
_PIECES = "spn AS (SELECT observed AS whole, lo, hi, substr(observed, lo + 1, hi - lo) AS piece FROM obs, range(0, length(observed)) a(lo), range(lo + 1, least(length(observed), lo + 24) + 1) b(hi)), pcs AS (SELECT DISTINCT piece AS observed FROM spn)"
_KEPT = """en2 AS (SELECT observed, text, code, frequency, min(place) FILTER (place.kd = 'exact') AS ex, min(place) FILTER (place.kd <> 'exact') AS ed FROM (SELECT *, struct_pack(cost := -score, ab := abbreviated, lk := kr, sp := spelling, kd := kind) AS place FROM sco) GROUP BY ALL),
own AS (SELECT observed, text, code, ex AS v, coalesce(ed < ex, false) AS beaten FROM en2 WHERE ex IS NOT NULL UNION ALL SELECT observed, text, code, ed, false FROM en2 WHERE ed IS NOT NULL AND (ex IS NULL OR ed < ex)),
lay AS (SELECT *, unnest(CASE WHEN v.kd <> 'exact' THEN ['edited'] WHEN beaten THEN ['spent'] ELSE ['spent', 'unspent'] END) AS layer FROM own),
txt AS (SELECT * FROM lay QUALIFY row_number() OVER (PARTITION BY observed, layer, text ORDER BY v.cost, text, v.ab, v.lk, v.sp, code) = 1),
trn AS (SELECT * EXCLUDE (layer), unnest(CASE WHEN v.kd IN ('exact', 'swap') AND length(code) > 2 * v.ab AND v.sp = left(code, length(code) - 2 * v.ab) || coalesce(list_aggregate(list_transform(range(length(code) - 2 * v.ab + 1, length(code), 2), lambda i: substr(code, i, 1)), 'string_agg', ''), '') THEN [layer, layer || ' apart'] ELSE [layer] END) AS layer FROM txt),
kep AS (SELECT DISTINCT observed, text, code, v.kd AS kind, v.ab AS abbreviated FROM (SELECT * FROM trn QUALIFY row_number() OVER (PARTITION BY observed, layer ORDER BY v.cost, text, v.ab, v.lk, v.sp, code) <= 5))"""

SQL = {
    "noisy_lattice": f"WITH RECURSIVE {V.LEX}, {V.EVENTS}, {_PIECES}, {V.SPELLINGS}, {V.NEAR}, {V.HYPOTHESES.format(codes='pcs')}, {V.MATCHES.format(codes='pcs')}, {_KEPT} SELECT kind, abbreviated, count(*) AS n_edges, count(DISTINCT whole) AS n_codes FROM spn JOIN kep ON kep.observed = piece GROUP BY 1, 2",
    "continuous_composition_whole": _OBS + f", {_READ} SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 10) AS top10, CAST(sum(length(com.observed)) AS BIGINT) AS n_keys, CAST(coalesce(sum(length(codes[-1]) // 2 - 1), 0) AS BIGINT) AS keys_saved FROM com LEFT JOIN rd ON rd.observed = com.observed AND rd.text = com.text WHERE com.observed <> ''",
    "protocol_context_whole": _OBS + f""", {_READ}, {_PP}, wnt AS (SELECT DISTINCT observed, text FROM com WHERE observed <> ''), stp AS (SELECT r.observed, r.text, sum(ln(1 + n)) AS gain FROM (SELECT observed, text, texts[i] AS a, texts[i + 1] AS b FROM rd, range(1, len(texts)) t(i)) r JOIN pp ON pp.before = a AND pp.text = b GROUP BY 1, 2),
plc AS (SELECT rd.observed, rd.text, rank AS plain, row_number() OVER (PARTITION BY rd.observed ORDER BY round(round(score, 6) + coalesce(gain, 0), 6) DESC, rank) AS aware FROM rd LEFT JOIN stp ON stp.observed = rd.observed AND stp.text = rd.text)
SELECT count(*) AS n, count(*) FILTER (plain = 1) AS plain_first, count(*) FILTER (aware = 1) AS aware_first, count(*) FILTER (aware < plain) AS improved, count(*) FILTER (aware > plain) AS worsened FROM wnt JOIN plc USING (observed, text)""",
    "first_unseen_greedy": _UD + """, win AS (SELECT id, CAST(i AS INTEGER) AS pos, items[i] || items[i + 1] AS phrase FROM spk, range(1, len(items)) r(i) WHERE split = 'test' AND length(items[i] || items[i + 1]) BETWEEN 2 AND 6),
grp AS (SELECT id, list(struct_pack(pos := pos, phrase := phrase) ORDER BY pos) AS own, row_number() OVER (ORDER BY id) AS k FROM win GROUP BY 1),
f AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS id, NULL::STRUCT(pos INTEGER, phrase VARCHAR) AS v, []::VARCHAR[] AS taken UNION ALL SELECT k, id, v, CASE WHEN v IS NULL THEN taken ELSE list_append(taken, v.phrase) END FROM (SELECT grp.k, grp.id, list_filter(own, lambda x: NOT list_contains(taken, x.phrase))[1] AS v, taken FROM f JOIN grp ON grp.k = f.k + 1))
SELECT id, v.pos AS pos, v.phrase AS phrase FROM f WHERE v IS NOT NULL""",
    "paint_timer_fold": f"""WITH {V.EVENTS}, g AS (SELECT {_ORDER} AS i, lead(elapsed_ms) OVER (PARTITION BY session_id, segment_seq ORDER BY pos, event_id) - elapsed_ms AS gap FROM ev),
s AS (SELECT delay, i % 2 = 0 OR gap IS NULL OR delay <= greatest(gap, 0) AS painted FROM g, (VALUES (500), (1000), (2000), (4000)) d(delay)) SELECT CAST(delay AS BIGINT) AS delay, count(*) FILTER (painted) AS shown, count(*) FILTER (NOT painted) AS hidden FROM s GROUP BY 1""",
    "single_span_diff": _EV + """, r AS (SELECT event_id, deleted AS a, inserted AS b, least(length(deleted), length(inserted)) AS m FROM fl WHERE kind = 'Revision' AND deleted <> inserted),
c AS (SELECT *, list_max(list_filter(range(0, m + 1), lambda k: left(a, k) = left(b, k))) AS p, list_max(list_filter(range(0, m + 1), lambda k: right(a, k) = right(b, k))) AS s FROM r), k AS (SELECT *, least(s, m - p) AS q FROM c)
SELECT event_id, CAST(p AS INTEGER) AS start, substr(a, p + 1, length(a) - p - q) AS deleted, substr(b, p + 1, length(b) - p - q) AS inserted, p + s > m AS ambiguous FROM k""",
    "key_interpreter": f"""WITH RECURSIVE {V.EVENTS}, e AS (SELECT event_id, keys FROM ev WHERE kind = 'Commit' AND keys IS NOT NULL),
f AS (SELECT event_id, keys, 0 AS i, '' AS t, 0 AS cur, false AS chosen, NULL::VARCHAR AS fault FROM e UNION ALL
  SELECT event_id, keys, i + 1,
    CASE WHEN regexp_full_match(k, '[a-z]') THEN left(t, cur) || k || substr(t, cur + 1) WHEN k = 'BS' AND cur > 0 THEN left(t, cur - 1) || substr(t, cur + 1) WHEN k = 'DEL' THEN left(t, cur) || substr(t, cur + 2) ELSE t END,
    CASE WHEN regexp_full_match(k, '[a-z]') THEN cur + 1 WHEN k IN ('BS', 'LEFT') THEN greatest(cur - 1, 0) WHEN k = 'RIGHT' THEN least(cur + 1, length(t)) WHEN k = 'HOME' THEN 0 WHEN k = 'END' THEN length(t) ELSE cur END,
    chosen OR k IN ('SP', 'ENTER') OR regexp_full_match(k, '[0-9]'),
    CASE WHEN fault IS NOT NULL THEN fault WHEN chosen THEN 'after_selection' WHEN k = 'ESC' THEN 'cancelled' WHEN starts_with(k, 'S+') THEN 'shifted' WHEN NOT regexp_full_match(k, '[a-z0-9]') AND k NOT IN ('SP', 'ENTER', 'BS', 'DEL', 'LEFT', 'RIGHT', 'HOME', 'END') THEN 'unknown_key' END
  FROM (SELECT *, keys[i + 1] AS k FROM f WHERE i < len(keys)))
SELECT event_id, CASE WHEN fault IS NULL THEN t END AS code, fault FROM f WHERE i = len(keys)""",
    "composition_fsm": f"""WITH RECURSIVE {V.EVENTS}, e AS (SELECT event_id, keys FROM ev WHERE keys IS NOT NULL),
f AS (SELECT event_id, keys, 0 AS i, 'idle' AS s, 0 AS n, '' AS effect FROM e UNION ALL
  SELECT event_id, keys, i + 1,
    CASE WHEN letter THEN 'composing' WHEN s = 'idle' THEN 'idle' WHEN k = 'BS' THEN CASE WHEN n > 1 THEN 'composing' ELSE 'idle' END WHEN k IN ('PGDN', 'PGUP', 'TAB') THEN 'paging' WHEN k = 'ESC' OR chosen THEN 'idle' ELSE s END,
    CASE WHEN letter THEN CASE WHEN s = 'idle' THEN 1 ELSE n + 1 END WHEN s = 'idle' THEN n WHEN k = 'BS' THEN greatest(n - 1, 0) WHEN k = 'ESC' OR chosen THEN 0 ELSE n END,
    CASE WHEN letter THEN 'edit' WHEN s = 'idle' THEN 'pass' WHEN k = 'BS' THEN 'edit' WHEN k IN ('PGDN', 'PGUP', 'TAB') THEN 'page' WHEN k = 'ESC' THEN 'cancel' WHEN chosen THEN 'commit' ELSE 'pass' END
  FROM (SELECT *, keys[i + 1] AS k, regexp_full_match(keys[i + 1], '[a-z]') AS letter, keys[i + 1] IN ('SP', 'ENTER') OR regexp_full_match(keys[i + 1], '[0-9]+') AS chosen FROM f WHERE i < len(keys)))
SELECT s AS state, effect, count(*) AS n FROM f WHERE i > 0 GROUP BY 1, 2""",
    "sentence_variants": _OBS + f""", {_EDGES}, path AS (SELECT observed, 0 AS cutp, '' AS text, []::VARCHAR[] AS texts, []::VARCHAR[] AS codes, 0.0::DOUBLE AS score FROM obs UNION ALL SELECT p.observed, e.high, p.text || e.text, list_append(p.texts, e.text), list_append(p.codes, e.code), p.score + ln(e.frequency / (SELECT sum(frequency) FROM lex)) FROM path p JOIN ed e ON e.observed = p.observed AND e.low = p.cutp),
w AS (SELECT *, -round(score, 9) AS cost FROM path WHERE cutp = length(observed)), v AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY observed, text ORDER BY cost, len(texts), texts, codes) <= 3)
SELECT observed, CAST(row_number() OVER (PARTITION BY observed ORDER BY cost, len(texts), text, texts, codes) AS INTEGER) AS rank, text, texts AS segments, 0 AS unresolved, false AS used_error, round(score, 6) AS score FROM v QUALIFY rank <= 9""",
    "slot_state": """WITH RECURSIVE a AS (SELECT user_id, json_extract_string(props, '$.k') AS p, CASE event_type WHEN 'signup' THEN 'adopt' WHEN 'view' THEN 'stage' WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'rollback' END AS act, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error') AND user_id IS NOT NULL),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::VARCHAR AS c, NULL::VARCHAR AS s, NULL::VARCHAR AS b FROM a UNION ALL
  SELECT f.user_id, a.i,
    CASE WHEN act = 'adopt' AND c IS NULL THEN p WHEN act = 'promote' AND s IS NOT NULL THEN s WHEN act = 'rollback' AND b IS NOT NULL THEN b ELSE c END,
    CASE WHEN act = 'stage' AND c IS NOT NULL AND p <> c AND p IS DISTINCT FROM b THEN p WHEN act = 'promote' AND s IS NOT NULL THEN NULL ELSE s END,
    CASE WHEN act IN ('promote') AND s IS NOT NULL THEN c WHEN act = 'rollback' AND b IS NOT NULL THEN c ELSE b END
  FROM f JOIN a ON a.user_id = f.user_id AND a.i = f.i + 1)
SELECT user_id, c AS current, s AS candidate, b AS previous FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "tracker_fold": _EV + f""", o AS (SELECT session_id, segment_seq, start, length(deleted) AS d, inserted, {_ORDER} AS i FROM fl WHERE start IS NOT NULL),
t AS (SELECT DISTINCT session_id, segment_seq, 0::BIGINT AS i, '' AS text, 0::BIGINT AS n FROM o UNION ALL
  SELECT session_id, segment_seq, i, after, n + CASE WHEN after <> text THEN 1 ELSE 0 END FROM (SELECT t.session_id, t.segment_seq, o.i, t.text, t.n, left(t.text, least(start, length(t.text))) || inserted || substr(t.text, least(start, length(t.text)) + d + 1) AS after FROM t JOIN o ON o.session_id = t.session_id AND o.segment_seq = t.segment_seq AND o.i = t.i + 1))
SELECT session_id, segment_seq, n AS n_changes, n AS n_found, length(text) AS length FROM t QUALIFY row_number() OVER (PARTITION BY session_id, segment_seq ORDER BY i DESC) = 1""",
}
