import random

import pytest
from pyspark.sql import functions as F

from glyphweir.llm import overlap as O


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    return a and b and 20 * distance(a, b) <= 3 * max(len(a), len(b))


def changed(rnd, text, k, alphabet):
    chars = list(text)
    for _ in range(k):
        at = rnd.randrange(len(chars) + 1)
        kind = rnd.choice("idr")
        if kind == "i" or not chars:
            chars.insert(at, rnd.choice(alphabet))
        elif kind == "d":
            del chars[min(at, len(chars) - 1)]
        else:
            chars[min(at, len(chars) - 1)] = rnd.choice(alphabet)
    return "".join(chars)


@pytest.mark.parametrize("alphabet", ["ab", "修改检查的权重词库abc"])
def test_no_near_pair_is_lost(spark, alphabet):
    rnd = random.Random(len(alphabet))
    train = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 3, 6, 7, 13, 14, 20, 27, 34, 60]))) for _ in range(120)]
    other = [changed(rnd, rnd.choice(train), rnd.randint(0, 6), alphabet) for _ in range(150)]
    got = {(r.string_a, r.string_b): r for r in O.near_strings(spark.createDataFrame([(t,) for t in train], "string string"), spark.createDataFrame([(t,) for t in other], "string string")).collect()}
    assert set(got) == {(a, b) for a in set(train) for b in set(other) if near(a, b)}
    for (a, b), row in got.items():
        assert row.distance == distance(a, b) and 0 < row.fraction <= 1
        assert a != b or row.fraction == 1


def test_sentence_string(spark):
    tokens = [(1, "ＡＢ​Ｃ", "X"), (2, "，", "PUNCT"), (3, "词﻿库", None), (4, None, "X")]
    df = spark.createDataFrame([(tokens,), ([],), (None,)], "tokens array<struct<token_id: int, form: string, upos: string>>")
    assert [r[0] for r in df.select(O.sentence_string(F.col("tokens"))).collect()] == ["abc词库", "", None]


def test_cross_split_edge_cases(spark):
    text = "他恰好读取词库木轴的同步回放权重"
    rows = [("a", "train", "s", text), ("a", "train", "s", text), ("b", "dev", None, text), ("c", "test", "t", text[:-1]), ("d", "test", "t", ""), ("e", "dev", "t", None), ("f", "train", None, text), (None, "dev", "t", text), ("g", None, "t", text), ("h", "test", "t", "完全不同的另一句话啊")]
    df = spark.createDataFrame(rows, "id string, split string, source string, string string").withColumn("key", F.lit(1))
    got = sorted((r.train_id, r.other_id, r.distance) for r in O.cross_split(df).collect())
    assert got == [("a", "b", 0), ("a", "c", 1), ("f", "b", 0), ("f", "c", 1)]
    assert O.cross_split(df.limit(0)).count() == 0


def test_long_strings(spark):
    rnd = random.Random(1)
    base = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(1_500))
    rows = [("a", "train", "s", base), ("b", "dev", "s", changed(rnd, base, 100, "xyz")), ("c", "dev", "s", base[::-1])]
    assert [(r.train_id, r.other_id) for r in O.cross_split(spark.createDataFrame(rows, "id string, split string, source string, string string")).collect()] == [("a", "b")]


@pytest.mark.parametrize("share", [O.Fraction(1, 20), O.Fraction(40, 100)])
def test_other_shares(spark, share):
    rnd = random.Random(11)
    train = ["".join(rnd.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(rnd.choice([4, 8, 12, 20, 41]))) for _ in range(40)]
    other = [changed(rnd, rnd.choice(train), rnd.randint(0, 9), "甲乙丙丁戊") for _ in range(80)]
    got = {(r.string_a, r.string_b) for r in O.near_strings(spark.createDataFrame([(t,) for t in train], "string string"), spark.createDataFrame([(t,) for t in other], "string string"), share).collect()}
    assert got == {(a, b) for a in set(train) for b in set(other) if a and b and distance(a, b) <= share * max(len(a), len(b))}


def test_content_defined_cuts_do_not_depend_on_what_stands_before():
    rnd = random.Random(2)
    text = "".join(rnd.choice("修改检查的权重词库abc") for _ in range(300))
    for window in O.WINDOWS:
        chunks = [{(s[p : p + n]) for _, p, n in zip(*O.content_chunks(O.Rolling([s]), window))} for s in (text, "新的开头" + text, text + "尾")]
        assert len(chunks[0]) > 10 and all(len(chunks[0] & c) >= len(chunks[0]) - 2 for c in chunks[1:])
    rows, places, sizes = O.content_chunks(O.Rolling(["", "a", text, "bc"]), 2)
    assert {(1, 0, 1), (3, 0, 2)} <= set(zip(rows.tolist(), places.tolist(), sizes.tolist()))


def test_recall_of_content_defined_chunks_alone(spark):
    """On records with one change in eleven characters or fewer, the chunks alone find nine pairs of ten."""
    rnd = random.Random(12)
    alphabet = [chr(0x4E00 + i) for i in range(1500)]
    train = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(16, 44))) for _ in range(150)]
    other = [changed(rnd, t, rnd.randint(0, len(t) // 11), alphabet) for t in train]
    rows = O.near_strings(spark.createDataFrame([(t,) for t in train], "string string"), spark.createDataFrame([(t,) for t in other], "string string")).collect()
    assert len(rows) >= 150 and sum(r.by_content for r in rows) >= 0.9 * len(rows)
