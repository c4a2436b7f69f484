"""SQL of the queries of this subpackage, where SQL can say them on whole tables."""

from __future__ import annotations

from glyphweir.llm.forms import form_sql

_COUNTS = """
WITH ud AS (SELECT id, any_value(tokens) AS tokens FROM ud_sentences WHERE id IS NOT NULL GROUP BY id),
ov AS (SELECT DISTINCT package_id, entry_id, text FROM technical_overlay WHERE package_id IS NOT NULL AND entry_id IS NOT NULL),
pw AS (SELECT DISTINCT session_id, word, n FROM personal_word_counts WHERE session_id IS NOT NULL),
r AS (SELECT 'ud_form' AS field, t.form AS term, CAST(id AS VARCHAR) AS rec, 1 AS n FROM (SELECT id, unnest(tokens) AS t FROM ud)
  UNION ALL SELECT 'overlay_text', text, CAST(package_id AS VARCHAR), 1 FROM ov
  UNION ALL SELECT 'personal_word', word, session_id, n FROM pw),
totals AS (SELECT 'ud_form' AS field, count(*) AS total FROM ud UNION ALL SELECT 'overlay_text', count(DISTINCT package_id) FROM ov UNION ALL SELECT 'personal_word', count(DISTINCT session_id) FROM pw),
c AS (SELECT field, term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT rec) AS records FROM r WHERE term <> '' GROUP BY ALL),
m AS (SELECT c.*, CASE WHEN occurrences < 3 THEN 'too_rare' WHEN records >= 10 AND records * 10 > total THEN 'too_common' END AS mark FROM c JOIN totals USING (field))
"""

_PAIRS = """
WITH ud AS (SELECT id, any_value(tokens) AS tokens FROM ud_sentences WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT DISTINCT id, t.form AS item FROM (SELECT id, unnest(tokens) AS t FROM ud) WHERE (t.upos IS NULL OR t.upos <> 'PUNCT') AND t.form <> ''),
sc AS (SELECT item, count(*) AS n FROM s GROUP BY 1), sn AS (SELECT count(*) AS n FROM ud),
sp AS (SELECT x.item AS low_item, y.item AS high_item, count(*) AS k FROM s x JOIN s y ON x.id = y.id AND x.item < y.item GROUP BY 1, 2),
p AS (SELECT DISTINCT * FROM personal_pair_counts),
pc AS (SELECT item, sum(n) AS n FROM (SELECT previous_word AS item, n FROM p UNION ALL SELECT current_word, n FROM p WHERE current_word <> previous_word) GROUP BY 1), pn AS (SELECT sum(n) AS n FROM p),
pp AS (SELECT least(previous_word, current_word) AS low_item, greatest(previous_word, current_word) AS high_item, sum(n) AS k, count(DISTINCT session_id) AS sessions FROM p WHERE previous_word <> current_word GROUP BY 1, 2),
j AS (SELECT 'sentence' AS kind, low_item, high_item, k AS together, k AS records, a.n AS a, b.n AS b, sn.n AS total FROM sp JOIN sc a ON a.item = low_item JOIN sc b ON b.item = high_item, sn
  UNION ALL SELECT 'personal_pair', low_item, high_item, k, sessions, a.n, b.n, pn.n FROM pp JOIN pc a ON a.item = low_item JOIN pc b ON b.item = high_item, pn)
"""

_H = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"
_CELLS = ["k", "x - k", "y - k", "n - x - y + k"]
_RATIO = "greatest(0.0, 2 * (" + " + ".join(_H(c) for c in _CELLS) + " - (" + _H("x") + ") - (" + _H("n - x") + ") - (" + _H("y") + ") - (" + _H("n - y") + ") + (" + _H("n") + ")))"

#: The texts' forms, by the operator's own expression over whole tables, and pairs of rows that agree in them.
_FORMS = f"""
WITH o AS (SELECT DISTINCT package_id, entry_id, text FROM technical_overlay WHERE text <> ''),
e AS (SELECT DISTINCT event_id, session_id, segment_seq, change.start AS start, change.inserted AS ins, change.deleted AS del FROM capsule_events),
t AS (SELECT DISTINCT text FROM (SELECT text FROM o UNION ALL SELECT ins FROM e UNION ALL SELECT del FROM e) WHERE text <> ''),
f AS (SELECT text, {form_sql("text")} AS form FROM t),
"""
_P2 = _FORMS + """
x AS (SELECT package_id, entry_id, text, form FROM o JOIN f USING (text)),
i AS (SELECT event_id, session_id, segment_seq, start, text, form FROM e JOIN f ON ins = text),
d AS (SELECT event_id, session_id, segment_seq, start, text, form FROM e JOIN f ON del = text)
SELECT DISTINCT 'overlay_text' AS kind, least(a.entry_id, b.entry_id) AS low_id, greatest(a.entry_id, b.entry_id) AS high_id FROM x a JOIN x b ON a.package_id = b.package_id AND a.form = b.form AND a.text < b.text AND a.entry_id <> b.entry_id
UNION ALL SELECT DISTINCT 'delta_text', least(i.event_id, d.event_id), greatest(i.event_id, d.event_id) FROM i JOIN d ON i.session_id = d.session_id AND i.segment_seq = d.segment_seq AND i.start = d.start AND i.form = d.form AND i.text <> d.text AND i.event_id <> d.event_id"""

_KINDS = _FORMS + """k AS (SELECT DISTINCT kind, text FROM (SELECT 'overlay_text' AS kind, text FROM o UNION ALL SELECT 'delta_inserted', ins FROM e UNION ALL SELECT 'delta_deleted', del FROM e) WHERE text <> '')
SELECT kind, count(*) AS n_texts, count(DISTINCT form) AS n_forms, count(*) FILTER (form <> text) AS n_changed FROM k JOIN f USING (text) GROUP BY 1"""

#: Sentences' strings, compared pair by pair. DuckDB's levenshtein counts bytes, so the characters of a pair are written as
#: one byte each first, of which there are enough for the sentences of the tables.
_NEAR = f"""
WITH u AS (SELECT DISTINCT id, split, tokens FROM ud_sentences WHERE id IS NOT NULL AND split IS NOT NULL),
s AS (SELECT DISTINCT id, split = 'train' AS known, lower(regexp_replace(translate(array_to_string([coalesce(t.form, '') for t in tokens if t.upos IS NULL OR t.upos <> 'PUNCT'], ''), '{"".join(chr(c) for c in range(0xFF01, 0xFF5F))}', '{"".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")}'), '[\\p{{Cf}}\\x{{200B}}-\\x{{200F}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')) AS t FROM u),
d AS (SELECT DISTINCT known, t, length(t) AS n FROM s WHERE t <> ''),
p AS (SELECT a.t AS x, b.t AS y, greatest(a.n, b.n) AS n, array_to_string(list_distinct(string_split(a.t || b.t, '')), '') AS c FROM d a JOIN d b ON a.known AND NOT b.known AND 20 * abs(a.n - b.n) <= 3 * greatest(a.n, b.n)),
k AS (SELECT x, y FROM p WHERE 20 * levenshtein(translate(x, c, left(z, length(c))), translate(y, c, left(z, length(c)))) <= 3 * n),
"""
_NEAR = _NEAR.replace("left(z, length(c))", "left('" + "".join(map(chr, range(1, 128))).replace("'", "''") + "', length(c))").rstrip().rstrip(",")

SQL = {
    "p4_found": _NEAR + " SELECT DISTINCT least(a.id, b.id) AS low_id, greatest(a.id, b.id) AS high_id FROM k JOIN s a ON a.known AND a.t = x JOIN s b ON NOT b.known AND b.t = y",
    "p2_found": _P2,
    "p2_forms": _KINDS,
    "p6_pairs": _PAIRS + f", m AS (SELECT *, CAST(together AS DOUBLE) AS k, CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y, CAST(total AS DOUBLE) AS n FROM j) SELECT kind, low_item, high_item, CAST(together AS BIGINT) AS together, records, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(k * n / (x * y), 4) AS lift, round({_RATIO}, 2) AS likelihood_ratio, {_RATIO} >= 6.63 AS significant FROM m",
    "p5_counts": _COUNTS + "SELECT field, term, occurrences, records, mark FROM m",
    "p5_found": _COUNTS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p6_found": _PAIRS + "SELECT kind, low_item, high_item FROM j WHERE records >= CASE kind WHEN 'sentence' THEN 4 ELSE 3 END AND together * total >= 8 * a * b",
}
