import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweir.operators.copy_diff import Bitmap, compare_copies, presence_blocks

SCHEMA = "entry_id bigint, text string, pinyin string, frequency bigint, revision int, key string, p string"


def brute(a, b):
    def now(rows):
        best = {}
        for r in rows:
            if r[0] is not None and (r[0] not in best or r[4] > best[r[0]][4]):
                best[r[0]] = r
        return best

    x, y = now(a), now(b)
    out = [(k, "missing_in_mirror") for k in x if k not in y] + [(k, "missing_in_primary") for k in y if k not in x]
    for k in x.keys() & y.keys():
        out += [(k, n) for i, n in ((1, "text"), (2, "pinyin"), (3, "frequency")) if x[k][i] != y[k][i]]
    return sorted(out)


def rows(seed, n):
    rnd = random.Random(seed)
    made = []
    for _ in range(n):
        k = rnd.choice([None, *range(60)])
        rev = rnd.randint(1, 3)
        deep = random.Random(f"{seed % 2}{k}{rev}")
        made.append((k, deep.choice([None, "", "a", "b" * 3]), deep.choice([None, "x", "y"]), deep.choice([None, 1, 2]), rev, "clash", None))
    return made + made[:20]


def test_against_brute_force(spark):
    a, b = rows(1, 150), rows(2, 150)
    got = compare_copies(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "entry_id", ["text", "pinyin", "frequency"], ["revision"])
    assert sorted(map(tuple, got.collect())) == brute(a, b)
    blocks = presence_blocks(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "entry_id", ["revision"]).collect()
    ka, kb = ({r[0] for r in x if r[0] is not None} for x in (a, b))
    assert sum(r.in_both for r in blocks) == len(ka & kb) and sum(r.only_primary for r in blocks) == len(ka - kb)
    assert sorted(k for r in blocks for k in r["keys"]) == sorted(ka | kb)


def test_empty_and_hot(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", None, 1, 1, "", "")] * 500 + [(1, "b", None, 1, 2, "", "")], SCHEMA)
    fields = ["text", "pinyin", "frequency"]
    assert compare_copies(empty, empty, "entry_id", fields, ["revision"]).count() == 0
    assert [tuple(r) for r in compare_copies(one, empty, "entry_id", fields, ["revision"]).collect()] == [(1, "missing_in_mirror")]
    assert [tuple(r) for r in compare_copies(empty, one, "entry_id", fields, ["revision"]).collect()] == [(1, "missing_in_primary")]
    assert compare_copies(one, one, "entry_id", fields, ["revision"]).count() == 0
    long = spark.createDataFrame([(1, "z" * 2_000_000, None, 1, 2, "", "")], SCHEMA)
    assert [tuple(r) for r in compare_copies(one, long, "entry_id", fields, ["revision"]).collect()] == [(1, "text")]


@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)))
@settings(max_examples=300, deadline=None)
def test_bitmaps(a, b):
    p, m = (Bitmap.of(np.array(sorted(x), np.int64)) for x in (a, b))
    for got, want in ((p, a), (p & m, a & b), (p - m, a - b), (m - p, b - a)):
        assert got.ordinals().tolist() == sorted(want) and len(got) == len(want)
    assert len(Bitmap.of(np.arange(1_000_000)).changes) == 2


def test_other_types(spark):
    schema = "k string, v double, at timestamp, r int"
    nan = float("nan")
    a = spark.createDataFrame([("x", 1.0, None, 1), ("y", nan, None, 1), ("z", None, None, None), (None, 1.0, None, 1)], schema)
    b = spark.createDataFrame([("x", 2.0, None, 2), ("x", 1.0, None, 1), ("y", nan, None, 1), ("z", 0.0, None, 3)], schema)
    assert sorted(map(tuple, compare_copies(a, b, "k", ["v", "at"], ["r"]).collect())) == [("x", "v"), ("z", "v")]
