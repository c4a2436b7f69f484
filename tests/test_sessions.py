from datetime import datetime

import pandas as pd
import pytest

from glyphweir.operators import memory as M
from glyphweir.sources import formats
from glyphweir.streaming import sessions as S


def frame(rows):
    return list(pd.DataFrame(rows, columns=["kind", "start", "deleted", "inserted", "reliable", "segment_seq", "code", "event_id", "elapsed_ms"]).itertuples(index=False))


def test_retraction_and_shift():
    rows = [("Commit", 0, "", "ab", True, 0, "x", 1, 0), ("Commit", 2, "", "cd", True, 0, "y", 2, 10), ("Revision", 0, "ab", "", True, 0, "", 3, 20), ("Revision", 0, "cd", "", True, 0, "", 4, 30), ("Commit", 0, "", "ab", False, 0, "x", 5, 40)]
    assert M.retract(("s",), frame(rows)) == [("ab", 2, 1), ("cd", 1, 0)]
    insert_at_edge = [("Commit", 0, "", "ab", True, 0, "x", 1, 0), ("Revision", 0, "", "zz", True, 0, "", 2, 5), ("Revision", 3, "", "q", True, 0, "", 3, 6)]
    assert M.retract(("s",), frame(insert_at_edge)) == [("ab", 1, 0)]  # shifted to 2, then split


def test_tiers():
    t = M.Tiers()
    for i in range(M.RECENT + 1):
        t.observe(i * 2, f"c{i}", "tt")
        t.confirm()
    assert t.weights()[("c0", "tt")] == M.TIER_WEIGHT["medium"] and t.weights()[("c1", "tt")] == M.TIER_WEIGHT["recent"]
    t.forget("c1", "tt")
    assert ("c1", "tt") not in t.weights() and t.weights()[("c0", "tt")] == M.TIER_WEIGHT["recent"]
    for i in range(M.PENDING + 3):
        t.observe(0, f"p{i}", "a")
    assert len(t.pending) == M.PENDING and t.pending[0][2] == "p3"


def test_tail_trims_rings_and_machines():
    rows = [("Commit", 0, "", "abcd", True, 0, "x", 1, 0), ("Revision", 3, "d", "", True, 0, "", 2, 100), ("Revision", 2, "c", "", True, 0, "", 3, 200), ("Revision", 0, "ab", "", True, 0, "", 4, 300)]
    assert M.tail_trims(("s", 0), frame(rows)) == [(1, "abcd", "ab", 2)]
    ring = M.Ring(10)
    for i in range(20):
        ring.add(i, 3)
    assert ring.size == 9 and ring.dropped == 17
    assert M.composition_steps(["a", "b", "BS", "SP", "x", "ESC", "SP"])[-1] == ("idle", "", "pass") and [e for _, _, e in M.composition_steps(["a", "b", "BS", "SP"])] == ["edit", "edit", "edit", "commit"]
    assert M.painted([50, 50, 10, 99], 20) == (3, 1)
    assert M.slots([("stage", "z"), ("adopt", "a"), ("stage", "a"), ("stage", "b"), ("promote", ""), ("rollback", "")]) == ("a", None, "b")
    recent = M.Recent(2)
    for code, text in (("a", "1"), ("b", "2"), ("a", "3"), ("c", "4")):
        recent.select(code, text)
    assert list(recent.texts.items()) == [("a", "3"), ("c", "4")]


EVENT = "event_id bigint, session_id string, segment_seq bigint, pos int, elapsed_ms bigint, recorded_at timestamp, kind string, keys array<string>, keys_complete boolean, composition string, change struct<start: int, deleted: string, inserted: string, evidence: string>"


def test_stream_rejects_repeats_and_clock(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [
        (1, "s", 0, 0, 100, at, "Commit", ["a"], True, "a", (0, "", "ab", "UniqueText")),
        (2, "s", 0, 1, 200, at, "Revision", ["BS"], True, None, (0, "ab", "cd", "UniqueText")),
        (2, "s", 0, 1, 200, at, "Revision", ["BS"], True, None, (0, "ab", "cd", "UniqueText")),
        (3, "s", 0, 2, 150, at, "Commit", None, None, None, (2, None, None, None)),
    ]
    df = spark.createDataFrame(rows, EVENT)
    df.write.parquet(str(tmp_path / "capsule_events.parquet"))
    found = S.run_to_table(S.corrections(S.flat(S.event_stream(spark, str(tmp_path), df.schema)), 1_000)).collect()
    assert sorted((r.event_id, r.correction or "", r.reject or "") for r in found) == [(2, "", "repeated"), (2, "replaced", ""), (3, "", "clock")]


@pytest.mark.parametrize("split", ["one file", "eight files", "shuffled files"])
def test_streams_are_the_same_under_any_split_of_files(spark, tmp_path, small, split):
    import random

    from glyphweir.operators import events as E
    from glyphweir.sources.tables import table

    events = table(spark, small, "capsule_events")
    rows = events.collect()
    want = sorted((r.event_id, r.correction, r.removed, r.replacement, r.gap_ms) for r in E.corrections(E.delivered_once(events), 10_000).collect())
    parts = [rows] if split == "one file" else [rows[k::8] for k in range(8)]
    if split == "shuffled files":
        random.Random(3).shuffle(rows)
        parts = [rows[k * len(rows) // 8 : (k + 1) * len(rows) // 8] for k in range(8)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / f"capsule_events_{k}.parquet"))
    stream = lambda: S.flat(S.event_stream(spark, str(tmp_path), events.schema, 1))
    found = S.settled(S.run_to_table(S.corrections(stream(), 10_000))).collect()
    assert sorted((r.event_id, r.correction, r.removed, r.replacement, r.gap_ms) for r in found if not r.reject) == want and want
    ids = [r.event_id for r in rows if r.event_id is not None]
    assert sum(r.reject == "repeated" for r in found) == len(ids) - len(set(ids))
    assert S.run_to_table(S.kinds(stream())).toPandas()["n"].sum() == len(set(ids))


def test_an_event_between_two_others_takes_their_correction_back():
    held = lambda i, kind, at, deleted, inserted: S.Event(i, i, kind, 0, deleted, inserted, True, at)
    first, middle, last = held(1, "Commit", 0, "", "ab"), held(2, "Commit", 5, "", "x"), held(3, "Revision", 9, "ab", "cd")
    assert list(S.corrections_of([first, last], 100)) == [(3, "replaced", "ab", "cd", 9, None)]
    assert not S.corrections_of([first, middle, last], 100)


def test_formats(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("# note\ntext\tpinyin\tfrequency\n词\tci\t5\n\n库\tku\t7\r\n")
    assert {(r.text, r.code, r.frequency) for r in formats.read_lexicon(spark, str(tmp_path / "lex.tsv")).collect()} == {("词", "ci", 5), ("库", "ku", 7)}
    for bad in ("词\tci", "词\tci\t0", "词\txx\t5", "词\tci\t5\n词\tci\t6"):
        (tmp_path / "bad.tsv").write_text(bad + "\n")
        with pytest.raises(Exception, match="breaks the format"):
            formats.read_lexicon(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "dict.yaml").write_text("---\nname: x\n...\n词\tci\t0\n词\tci\t9\n库\txx\t1\n# c\n樂\tle\t3\nbad\n一\tyi\tx\n")
    shadowed = spark.createDataFrame([("樂",)], "text string")
    rows = {(r.line_no, r.reason, r.frequency if r.reason is None else None) for r in formats.read_dictionary(spark, str(tmp_path / "dict.yaml"), shadowed).collect()}
    assert rows == {(0, None, 1), (1, "duplicate", None), (2, "unsupported_pinyin", None), (4, "shadowed", None), (5, "bad_row", None), (6, "bad_weight", None)}
    (tmp_path / "ud.conllu").write_text("# sent_id = a\n1\t好\t_\tADJ\t_\t_\t_\t_\t_\t_\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n\n# sent_id = b\n1\t吗\t_\t_\t_\t_\t_\t_\t_\t_\n\n")
    got = {r.id: ([(t.form, t.upos) for t in r.tokens], r.n_ranges) for r in formats.read_sentences(spark, str(tmp_path / "ud.conllu")).collect()}
    assert got == {"a": ([("好", "ADJ")], 1), "b": ([("吗", None)], 0)}
    (tmp_path / "strokes.txt").write_text("12\t十丁\n345\t十\nx\ty\n")
    assert {r.ch: r.strokes for r in formats.read_strokes(spark, str(tmp_path / "strokes.txt")).collect()} == {"十": ["hs", "pnz"], "丁": ["hs"]}
    (tmp_path / "bi.tsv").write_text("a b\t3\na\t2\na b\t0\n")
    assert [(r.tokens, r.n) for r in formats.read_transitions(spark, str(tmp_path / "bi.tsv")).collect()] == [(["a", "b"], 3)]
    (tmp_path / "cases.tsv").write_text("q\t词 库\nr\t词 无\n")
    words = formats.read_lexicon(spark, str(tmp_path / "lex.tsv"))
    assert [tuple(r) for r in formats.read_cases(spark, str(tmp_path / "cases.tsv"), words).collect()] == [("q", "ck", "词库")]


def test_pending_at_the_end_of_a_segment():
    rows = [("Commit", 0, "", "ab", True, 0, "x", 1, 0), ("Commit", 2, "", "cd", True, 0, "y", 2, 10), ("Commit", 4, "", "ef", False, 0, "z", 3, 15), ("Revision", 0, "ab", "", True, 0, "", 4, 20)]
    assert M.pending_at_end(("s", 0), frame(rows)) == [(0, "y", "cd")]


def test_order_statistics(spark):
    import math
    import random

    from glyphweir.operators.sampling import order_statistics

    rnd = random.Random(4)
    values = {k: sorted(rnd.randint(1, 12) for _ in range(n)) for k, n in ((1, 1), (2, 4), (3, 37), (4, 100))}
    rows = [(k, v, own.count(v)) for k, own in values.items() for v in set(own)]
    for r in order_statistics(spark.createDataFrame(rows, "k int, v int, times bigint"), "k", "v", "times").collect():
        own = values[r.k]
        assert (r.n, r.least, r.median, r.p95, r.most) == (len(own), own[0], own[len(own) // 2], own[math.ceil(0.95 * len(own)) - 1], own[-1])


def test_strict_readers(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("text\tpinyin\tfrequency\n词\tci\t5\n库\tku\t7\n")
    words = formats.read_lexicon(spark, str(tmp_path / "lex.tsv"))

    def read(reader, text, *more, **how):
        (tmp_path / "f.txt").write_bytes(text.encode())
        return reader(spark, str(tmp_path / "f.txt"), *more, **how).collect()

    def fails(reader, why, text, *more, **how):
        with pytest.raises(Exception, match=f"breaks the format.*{why}"):
            read(reader, text, *more, **how)

    row = "1\t好\t_\tADJ" + "\t_" * 6
    assert [r.id for r in sorted(read(formats.read_sentences, f"# sent_id = a\r\n{row}\r\n\r\n# sent_id = b\r\n{row}\r\n", strict=True))] == ["a", "b"]
    fails(formats.read_sentences, "duplicate id a", f"# sent_id = a\n{row}\n\n# sent_id = a\n{row}\n", strict=True)
    fails(formats.read_sentences, "empty sentence a", "# sent_id = a\n# text = x\n\n", strict=True)
    assert len(read(formats.read_strokes, "# x\n12\t十丁\n345\t十\n", strict=True)) == 2
    for why, text in (("columns", "12"), ("sequence", "16\t十"), ("characters", "12\t十十"), ("characters", "12\t"), ("duplicate", "12\t十\n12\t丁")):
        fails(formats.read_strokes, why, text + "\n", strict=True)
    assert [(r.tokens, r.n) for r in read(formats.read_transitions, "tokens\tcount\n# x\n\n词 库\t3\n", words)] == [(["词", "库"], 3)]
    for why, text in (("columns", "词 库"), ("count", "词 库\t0"), ("too few", "词\t1"), ("unknown token 无", "词 无\t1")):
        fails(formats.read_transitions, why, text + "\n", words)
    assert [tuple(r) for r in read(formats.read_cases, "id\ttokens\nq\t词 库\n", words, strict=True)] == [("q", "ck", "词库")]
    for why, text in (("columns", "q"), ("too few", "q\t词"), ("duplicate id q", "q\t词 库\nq\t库 词"), ("unknown token 无", "q\t词 无")):
        fails(formats.read_cases, why, text + "\n", words, strict=True)
