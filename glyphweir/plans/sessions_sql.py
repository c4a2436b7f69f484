"""SQL of the queries on typing sessions."""

from __future__ import annotations

from glyphweir.plans import views as V
from glyphweir.plans.decoding import _INTENDED
from glyphweir.plans.sessions import GAP

_EV = f"WITH RECURSIVE {V.EVENTS}, fl AS (SELECT event_id, session_id, segment_seq, pos, elapsed_ms, kind, keys, keys_complete, composition, change.start AS start, coalesce(change.deleted, '') AS deleted, coalesce(change.inserted, '') AS inserted, coalesce(change.evidence <> 'Ambiguous', false) AS reliable, coalesce(array_to_string(list_filter(keys, lambda k: regexp_full_match(k, '[a-z]')), ''), '') AS code FROM ev)"
_W = "(PARTITION BY session_id, segment_seq ORDER BY pos, event_id)"
_S = "(PARTITION BY session_id ORDER BY segment_seq, pos, event_id)"
_RUNS = f"""ok AS (SELECT *, kind = 'Commit' AND reliable AND deleted = '' AS ok, start + length(inserted) AS fin FROM fl),
fo AS (SELECT *, coalesce(lag(ok) OVER w AND ok AND start = lag(fin) OVER w AND elapsed_ms - lag(elapsed_ms) OVER w BETWEEN 0 AND {GAP}, false) AS follows FROM ok WINDOW w AS {_W}),
rn AS (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, segment_seq ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS wn FROM fo) WHERE ok)"""
_BUCKET = "(" + " + ".join(f"CASE WHEN gap // 10 >= {b} THEN 1 ELSE 0 END" for b in (8, 16, 24, 32, 48, 64, 96, 160)) + ")"
_LABELS = f"""lb0 AS (SELECT *, lead(kind) OVER w AS nk, lead(start) OVER w AS ns, lead(deleted) OVER w AS nd, elapsed_ms - lag(elapsed_ms) OVER w AS gap FROM fl WINDOW w AS {_W}),
lb AS (SELECT *, CASE WHEN nk IS NULL THEN 'Unknown' WHEN nk = 'Revision' AND nd <> '' AND ns >= start AND ns < start + greatest(length(inserted), 1) THEN 'Rejected' WHEN nk = 'Commit' THEN 'Accepted' ELSE 'Unknown' END AS label FROM lb0 WHERE kind = 'Commit')"""
_SEL = f"sl AS (SELECT session_id, code, inserted AS text, count(*) AS n, max(t) AS last FROM (SELECT *, row_number() OVER {_S} AS t FROM fl WHERE kind = 'Commit' AND code <> '' AND inserted <> '') GROUP BY 1, 2, 3)"
_PREF = "least(n, 4) DESC, last DESC, n DESC, text"
_POOL = f"{V.LEX}, pl AS (SELECT code, text, max(frequency) AS frequency, row_number() OVER (PARTITION BY code ORDER BY max(frequency) DESC, text) AS pr FROM lex GROUP BY 1, 2 QUALIFY pr <= 50)"
_SUMMARY = f"""g AS (SELECT *, CASE WHEN kind = 'Commit' AND lag(kind) OVER w = 'Commit' AND elapsed_ms >= lag(elapsed_ms) OVER w THEN elapsed_ms - lag(elapsed_ms) OVER w END AS gap FROM fl WINDOW w AS {_W}),
sm AS (SELECT session_id, count(*) FILTER (kind = 'Commit') AS n_commits, count(*) FILTER (kind = 'Revision') AS n_revisions, CAST(coalesce(sum(len(keys)), 0) AS BIGINT) AS n_keys, CAST(coalesce(sum(len(list_filter(keys, lambda k: k IN ('BS', 'DEL', 'LEFT', 'RIGHT', 'HOME', 'END')))), 0) AS BIGINT) AS n_edit_keys,
CAST(sum(length(inserted)) AS BIGINT) AS n_inserted, CAST(sum(length(deleted)) AS BIGINT) AS n_deleted, count(gap) AS n_gaps, min(gap) AS least_gap, max(gap) AS most_gap, CAST(sum(gap) AS BIGINT) AS sum_gap FROM g GROUP BY 1)"""
_COVER = f"cv AS (SELECT session_id, code, row_number() OVER (PARTITION BY session_id, code ORDER BY n DESC, last DESC, text) AS rank, text, n FROM sl WHERE n >= 2 AND (code, text) NOT IN (SELECT (code, text) FROM pl) QUALIFY rank <= 8)"

SQL = {
    "event_monotonic_check": _EV + f", b AS (SELECT *, coalesce(lag(elapsed_ms) OVER {_W} > elapsed_ms, false) AS back FROM fl) SELECT session_id, segment_seq, count(*) AS n_events, count(*) FILTER (back) AS n_back, max(pos) - min(pos) + 1 = count(*) AS whole FROM b GROUP BY 1, 2",
    "event_windows_gap_contig": _EV + f", {_RUNS} SELECT session_id, segment_seq, count(*) AS n_commits, min(event_id) AS first_event, max(elapsed_ms) - min(elapsed_ms) AS span_ms FROM rn GROUP BY session_id, segment_seq, wn HAVING count(*) > 1",
    "correction_delete_insert": _EV + f""", l AS (SELECT *, lag(kind) OVER w AS lk, lag(start) OVER w AS ls, lag(deleted) OVER w AS ld, lag(inserted) OVER w AS li, lag(reliable) OVER w AS lr, elapsed_ms - lag(elapsed_ms) OVER w AS gap FROM fl WINDOW w AS {_W}),
c AS (SELECT *, CASE WHEN gap BETWEEN 0 AND 10000 AND reliable AND lr THEN CASE WHEN kind = 'Revision' AND deleted <> '' AND inserted <> '' AND lk = 'Commit' AND start >= ls AND start + length(deleted) <= ls + length(li) THEN 'replaced' WHEN kind = 'Commit' AND lk = 'Revision' AND ld <> '' AND li = '' AND start = ls THEN 'deleted_then_inserted' END END AS correction FROM l)
SELECT event_id, session_id, segment_seq, correction, CASE WHEN kind = 'Revision' THEN deleted ELSE ld END AS removed, inserted AS replacement, gap AS gap_ms FROM c WHERE correction IS NOT NULL""",
    "window_exclusion_reasons": _EV + f""", {V.LEX}, f2 AS (SELECT *, (SELECT CASE WHEN count(*) = count(y.code) THEN string_agg(y.code, '' ORDER BY i) END FROM (SELECT unnest(string_split(composition, '''')) AS s, generate_subscripts(string_split(composition, ''''), 1) AS i) LEFT JOIN pinyin_syllables y ON y.syllable = s) AS intended FROM fl WHERE kind = 'Commit')
SELECT CASE WHEN NOT coalesce(keys_complete, false) OR keys IS NULL THEN 'incomplete_keys' WHEN length(code) = 0 THEN 'no_letters' WHEN length(code) > 64 THEN 'too_long' WHEN intended IS NULL THEN 'unencodable' WHEN code <> intended THEN 'other_code' WHEN NOT reliable THEN 'ambiguous_place' WHEN intended NOT IN (SELECT code FROM lex) THEN 'no_word' ELSE 'kept' END AS reason, count(*) AS n FROM f2 GROUP BY 1""",
    "session_summary": _EV + f", {_SUMMARY} SELECT * FROM sm",
    "session_summary_merge": _EV + f", {_SUMMARY}, t AS (SELECT count(*) AS n_sessions, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n_commits", "n_revisions", "n_keys", "n_gaps", "sum_gap")) + ", min(least_gap) AS least_gap, max(most_gap) AS most_gap FROM sm) SELECT *, n_gaps <= n_commits AND coalesce(least_gap * n_gaps <= sum_gap AND sum_gap <= most_gap * n_gaps, true) AS holds FROM t",
    "half_pair_gap_histogram": _EV + f", g AS (SELECT elapsed_ms - lag(elapsed_ms) OVER {_W} AS gap FROM fl) SELECT {_BUCKET} AS bucket, count(*) AS n, min(gap) AS least, max(gap) AS most FROM g WHERE gap >= 0 GROUP BY 1",
    "decision_labels": _EV + f", {_LABELS} SELECT event_id, label FROM lb",
    "transposition_calibration": _EV + f""", {_LABELS}, r AS (SELECT left(code, 2) AS pair, {_BUCKET} AS bucket, count(*) AS n, sum(CASE WHEN label = 'Accepted' THEN 1 ELSE 0 END) AS k FROM lb WHERE label <> 'Unknown' AND gap >= 0 AND length(code) >= 2 GROUP BY 1, 2),
b AS (SELECT bucket, sum(n) AS bn, sum(k) AS bk FROM r GROUP BY 1), p AS (SELECT pair, bucket, n, round(CASE WHEN bn >= 24 OR n >= 8 THEN ((0.56::DOUBLE * 16 + bk) / (16 + bn) * 8 + k) / (8 + n) ELSE 0.56 END, 6) AS p FROM r JOIN b USING (bucket))
SELECT pair, bucket, n, p, CASE WHEN p >= 0.72 THEN 'Primary' WHEN p >= 0.40 THEN 'Secondary' ELSE 'Shadow' END AS tier FROM p""",
    "online_label_counts": _EV + f", {_LABELS} SELECT {_BUCKET} AS bucket, label, count(*) AS n, count(DISTINCT left(code, 2)) AS n_pairs FROM lb WHERE gap >= 0 AND length(code) >= 2 GROUP BY 1, 2",
    "freeze_lookback": _EV + ", m AS (SELECT *, max(elapsed_ms) OVER (PARTITION BY session_id, segment_seq) AS marker FROM fl), p AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment_seq ORDER BY pos DESC, event_id DESC) AS back FROM m WHERE elapsed_ms >= marker - 30000) SELECT session_id, segment_seq, count(*) FILTER (back <= 50) AS n_kept, count(*) <= 50 AS complete, min(elapsed_ms) FILTER (back <= 50) AS from_ms FROM p GROUP BY 1, 2",
    "freeze_episodes": _EV + ", e AS (SELECT *, CAST(sum(CASE WHEN kind = 'Commit' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, segment_seq ORDER BY pos DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM fl) SELECT session_id, segment_seq, episode, count(*) AS n_events, min(event_id) AS first_event FROM e WHERE episode BETWEEN 1 AND 3 GROUP BY 1, 2, 3",
    "preferred_text": _EV + f", {_SEL} SELECT session_id, code, text, n FROM sl QUALIFY row_number() OVER (PARTITION BY session_id, code ORDER BY {_PREF}) = 1",
    "suppression_last_action": _EV + f", a AS (SELECT session_id, kind, CASE WHEN kind = 'Commit' THEN inserted ELSE deleted END AS text, row_number() OVER {_S} AS t FROM fl WHERE CASE WHEN kind = 'Commit' THEN inserted ELSE deleted END <> '') SELECT session_id, text FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY session_id, text ORDER BY t DESC) = 1) WHERE kind = 'Revision'",
    "anchored_suffix_inherit": _EV + f", {_SEL}, s AS (SELECT DISTINCT session_id, text, n, last, left(code, k * 2) || list_aggregate(list_transform(range(k * 2 + 1, length(code), 2), lambda i: substr(code, i, 1)), 'string_agg', '') AS short FROM sl, range(1, length(code) // 2) r(k) WHERE length(code) % 2 = 0 AND length(code) >= 4 AND n >= 2) SELECT session_id, short, text, n FROM s QUALIFY row_number() OVER (PARTITION BY session_id, short ORDER BY {_PREF}) = 1",
    "context_preference": _EV + f""", {_LABELS}, c AS (SELECT *, row_number() OVER {_S} AS t FROM (SELECT *, lag(inserted) OVER {_W} AS before FROM lb) WHERE before <> '' AND code <> '' AND inserted <> ''), p AS (SELECT session_id, before, code, inserted AS text, count(*) FILTER (label <> 'Rejected') AS a, count(*) FILTER (label = 'Rejected') AS b, max(t) AS last FROM c GROUP BY 1, 2, 3, 4), q AS (SELECT *, greatest(least(a, 4) - least(b, 4), 0) AS support FROM p)
SELECT session_id, before, code, text, support FROM q WHERE support > 0 QUALIFY row_number() OVER (PARTITION BY session_id, before, code ORDER BY support DESC, last DESC, text) = 1""",
    "session_mru": _EV + f", t AS (SELECT session_id, code, inserted AS text, row_number() OVER {_S} AS t FROM fl WHERE kind = 'Commit' AND code <> '' AND inserted <> ''), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id, code ORDER BY t DESC) = 1) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t DESC) AS rank, code, text FROM l QUALIFY rank <= 128",
    "promote_text": _EV + f", {_SEL}, {_POOL}, ww AS (SELECT code, list(text ORDER BY pr) AS ws FROM pl GROUP BY 1), pt AS (SELECT session_id, code, text FROM sl QUALIFY row_number() OVER (PARTITION BY session_id, code ORDER BY {_PREF}) = 1) SELECT session_id, code, array_to_string(CASE WHEN ws[1] = text THEN ws ELSE list_concat([ws[1], text], list_filter(ws[2:], lambda w: w <> text))[1:greatest(len(ws), 2)] END, '|') AS words FROM pt JOIN ww USING (code)",
    "adaptive_mixture": _EV + f""", {_SEL}, {_POOL}, k AS (SELECT DISTINCT session_id, code FROM sl), a AS (SELECT k.session_id, k.code, pl.text, frequency, coalesce(sl.n, 0) AS e FROM k JOIN pl USING (code) LEFT JOIN sl ON sl.session_id = k.session_id AND sl.code = k.code AND sl.text = pl.text),
b AS (SELECT *, sum(e) OVER w AS t, count(*) OVER w AS m, sum(frequency) OVER w AS f FROM a WINDOW w AS (PARTITION BY session_id, code)) SELECT session_id, code, text, round((1 - 0.25::DOUBLE * t / (t + 4)) * frequency / f + 0.25::DOUBLE * t / (t + 4) * (e + 0.5) / (t + 0.5 * m), 6) AS p FROM b""",
    "personal_coverage": _EV + f", {_SEL}, {_POOL}, {_COVER} SELECT session_id, code, rank, text, n FROM cv",
    "adaptive_merge": _EV + f""", {_SEL}, {_POOL}, {_COVER}, ms AS (SELECT session_id, code, sum(n) AS e, 0.05::DOUBLE * sum(n) / (sum(n) + 4) AS cover FROM cv GROUP BY 1, 2), sh AS (SELECT code, text, frequency / sum(frequency) OVER (PARTITION BY code) AS q FROM pl),
u AS (SELECT session_id, code, text, round((1 - cover) * q, 9) AS p, 'public' AS source FROM ms JOIN sh USING (code) UNION ALL SELECT cv.session_id, cv.code, text, round(cover * n / e, 9), 'personal' FROM cv JOIN ms ON ms.session_id = cv.session_id AND ms.code = cv.code)
SELECT session_id, code, row_number() OVER (PARTITION BY session_id, code ORDER BY p DESC, source, text) AS rank, text, source, round(p, 6) AS p FROM u QUALIFY rank <= 50""",
    "tier_by_recency": _EV + ", a AS (SELECT session_id, inserted, row_number() OVER (PARTITION BY session_id ORDER BY segment_seq DESC, pos DESC, event_id DESC) AS age FROM fl WHERE kind = 'Commit' AND inserted <> '') SELECT session_id, CASE WHEN age <= 128 THEN 'recent' WHEN age <= 1152 THEN 'medium' WHEN age <= 8192 THEN 'long' ELSE 'evicted' END AS tier, count(*) AS n, count(DISTINCT inserted) AS n_texts FROM a GROUP BY 1, 2",
    "personal_causal": _EV + f""", {_RUNS}, {_POOL}, r AS (SELECT * FROM rn WHERE inserted <> ''), m AS (SELECT session_id, segment_seq, wn, inserted, count(*) AS m FROM r GROUP BY 1, 2, 3, 4), c AS (SELECT *, CAST(coalesce(sum(m) OVER (PARTITION BY session_id, inserted ORDER BY segment_seq, wn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM m)
SELECT r.event_id, pr AS public_rank, c.n AS count, greatest(pr - 1 - CASE WHEN c.n >= 4 THEN 3 WHEN c.n >= 2 THEN 2 WHEN c.n >= 1 THEN 1 ELSE 0 END, 0) + 1 AS place FROM r JOIN c ON c.session_id = r.session_id AND c.segment_seq = r.segment_seq AND c.wn = r.wn AND c.inserted = r.inserted JOIN pl ON pl.code = r.code AND pl.text = r.inserted""",
    "frozen_vs_causal": _EV + f""", {_RUNS}, r AS (SELECT * FROM rn WHERE inserted <> ''), m AS (SELECT session_id, segment_seq, wn, inserted, count(*) AS m FROM r GROUP BY 1, 2, 3, 4), c AS (SELECT *, CAST(coalesce(sum(m) OVER (PARTITION BY session_id, inserted ORDER BY segment_seq, wn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS causal, CAST(sum(m) OVER (PARTITION BY session_id, inserted) - m AS BIGINT) AS frozen FROM m)
SELECT CASE WHEN frozen > 0 AND causal > 0 THEN 'both' WHEN frozen > 0 THEN 'frozen_only' WHEN causal > 0 THEN 'causal_only' ELSE 'neither' END AS kind, CAST(sum(m) AS BIGINT) AS n, CAST(sum(m * causal) AS BIGINT) AS causal, CAST(sum(m * frozen) AS BIGINT) AS frozen FROM c GROUP BY 1""",
    "segment_continuity": "WITH s AS (SELECT session_id, segment_seq, min(recorded_at) AS b FROM capsule_events WHERE event_id IS NOT NULL GROUP BY 1, 2), h AS (SELECT *, coalesce(segment_seq <> lag(segment_seq) OVER w + 1, segment_seq <> 0) AS hole, coalesce(b < lag(b) OVER w, false) AS back FROM s WINDOW w AS (PARTITION BY session_id ORDER BY segment_seq)) SELECT session_id, count(*) AS n_segments, count(*) FILTER (hole) AS n_holes, count(*) FILTER (back) AS n_back FROM h GROUP BY 1 HAVING count(*) FILTER (hole OR back) > 0",
    "feedback_summary": f"WITH {V.EVENTS} SELECT kind, change.evidence AS evidence, producer_version, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM ev GROUP BY 1, 2, 3",
    "integrity_merge": f"WITH {V.EVENTS} SELECT count(*) AS n_events, count(*) FILTER (NOT coalesce(keys_complete, false)) AS n_incomplete, count(*) FILTER (keys IS NULL) AS n_no_keys, count(*) FILTER (change.deleted IS NULL) AS n_no_deleted, count(*) FILTER (change.inserted IS NULL) AS n_no_inserted, (SELECT count(*) FROM capsule_events WHERE event_id IS NOT NULL) AS n_deliveries FROM ev",
    "incremental_tail_fold": _EV + " SELECT session_id, inserted AS text, count(*) AS n FROM fl WHERE kind = 'Commit' AND inserted <> '' GROUP BY 1, 2",
    "paint_audit": f"WITH {V.EVENTS} SELECT delay, gap, CAST(sum(length(observed) // 2 + CASE WHEN delay <= gap THEN (length(observed) + 1) // 2 ELSE 0 END) AS BIGINT) AS n_painted, CAST(sum(CASE WHEN delay > gap THEN (length(observed) + 1) // 2 ELSE 0 END) AS BIGINT) AS n_suppressed FROM com, (VALUES (16), (32), (48), (80), (120)) d(delay), (VALUES (40), (90), (160)) g(gap) WHERE observed <> '' GROUP BY 1, 2",
}
