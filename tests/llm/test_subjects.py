import random

import pytest

from glyphweir.llm import subjects as S

VOCABULARY = {"science": ["显微镜", "催化剂", "同位素", "溶液"], "music": ["大提琴", "和弦", "节拍", "录音棚"], "general": ["谢谢收到了", "窗外下着雨", "今天先到这里"]}
FILL = ["关于{}我补充一点。", "先处理{}再说。", "老师讲{}时提到它。", "没想到{}竟然这样！"]


def document(rnd, subjects, n=8):
    parts = []
    for _ in range(n):
        s = rnd.choice(subjects)
        word = rnd.choice(VOCABULARY[s])
        parts.append(word + "。" if s == "general" else rnd.choice(FILL).format(word))
    return "".join(parts)


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(240):
        subject = ["science", "music", "general"][i % 3]
        own = [subject] if subject == "general" else [subject, subject, "general"]
        docs.append((i, document(rnd, own)))
        labels.append((i, "music" if i % 23 == 0 else subject, "ann"))
    labels += labels[:10] + [(None, "music", "a"), (3, None, "a"), (99999, "music", "a")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    return S.fit(documents, spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string"))


def test_held_out_accuracy(spark, fitted):
    rnd = random.Random(9)
    cases = {i: (["science"], ["music"], ["science", "music"], ["general"])[i % 4] for i in range(80)}
    rows = [(i, document(rnd, own, 12)) for i, own in cases.items()]
    got = {}
    for r in S.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), fitted).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got[i] == set(own) for i, own in cases.items())
    assert right >= 74


def test_a_passing_remark_is_no_case(spark, fitted):
    text = "谢谢收到了。" * 9 + "关于大提琴我补充一点。"
    rows = [(1, text), (2, None), (3, ""), (4, " \n　"), (5, "谢谢收到了。" * 4 + "关于大提琴我补充一点。"), (6, "😀"), (5, "大提琴。")]
    got = sorted((r.doc_id, r.subject) for r in S.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), fitted).collect())
    assert got == [(1, "general"), (5, "music"), (5, "music"), (6, "general")]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "任意文字。")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    rules = S.fit(docs, none)
    assert not rules.weights and [tuple(r) for r in S.classify(docs, rules).collect()] == [(1, "general")]
    assert S.classify(docs.limit(0), rules).count() == 0


def test_units_and_terms():
    assert S.units("甲：你好吗？因为在忙。Well done. v1.2 fine\nＡＢＣ词  (43/128, 7.29 ms)") == ["甲:你好吗", "因为在忙", "well done", " v1.2 fine", "abc词  (43/128, 7.29 ms)"]
    joined = {t[0] for t in S.terms("da ti qin")}
    assert "datiqin" in joined and "datiqin" in {t[0] for t in S.terms("datiqin")}
    assert S.apart([("ab", 0, 0, 2), ("abc", 0, 0, 3), ("c", 0, 2, 3)], {"ab": 0.5, "abc": 0.9, "c": 0.1}) == ["abc"]
    assert all(S.units(x) == [] for x in ("", "...", "12 34"))


def test_redundant_rules_are_pruned():
    rules = {("a",): {"x": 3.0}, ("a", "b"): {"x": 3.1}, ("b",): {"x": 1.0}, ("b", "c"): {"x": 2.0, "y": 1.0}}
    assert S._pruned(rules) == {("a",): {"x": 3.0}, ("b",): {"x": 1.0}, ("b", "c"): {"x": 2.0, "y": 1.0}}


def test_frequent_sets_against_brute_force(spark):
    from collections import Counter
    from itertools import combinations

    rnd = random.Random(4)
    rows = [(rnd.choice("xy"), sorted(rnd.sample("abcdefgh", rnd.randint(0, 6)))) for _ in range(120)]
    want = Counter((c, s) for s, own in rows for n in range(1, S.RULE_TERMS + 1) for c in combinations(own, n))
    often = Counter()
    for (c, _), n in want.items():
        often[c] += n
    got = {(tuple(r.terms), r.subject): r.n for r in S.frequent_sets(spark.createDataFrame(rows, "subject string, terms array<string>"), 5).collect()}
    assert got == {k: n for k, n in want.items() if often[k[0]] >= 5}


def test_many_terms_of_a_sentence_all_count():
    worth = {f"词{chr(0x4E00 + i)}": 0.5 for i in range(40)}
    unit = "，".join(worth)
    assert sorted(S.apart(S.terms(unit, worth), worth)) == sorted(worth)
    assert {p for p in S.terms("显微镜da ti qin") if p[0] in worth or p[0] == "datiqin"} == set(S.terms("显微镜da ti qin", {**worth, "datiqin": 1.0}))
