import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from glyphweir.llm import stripes, terms


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(terms, "LOCAL_TERMS", 5)
    rnd = random.Random(2)
    rows = [(rnd.choice("fg"), rnd.choice(["的", "a", "b", "", None, "z" * 100_000, "￿", "😀"]), rnd.randint(1, 3)) for _ in range(300)]
    got = terms.term_counts(spark.createDataFrame(rows, "field string, term string, n int").withColumn("block", F.lit(1))).collect()
    want_n, want_r = Counter(), Counter()
    for f, t, n in rows:
        if t:
            want_n[f, t] += n
            want_r[f, t] += 1
    assert {(r.field, r.term): (r.occurrences, r.records) for r in got} == {k: (want_n[k], want_r[k]) for k in want_n}
    assert len({r.term_id for r in got}) == len(got)
    assert terms.term_counts(spark.createDataFrame([], "field string, term string, n int")).count() == 0


def test_marks(spark):
    counts = spark.createDataFrame([("f", "a", 2, 2), ("f", "b", 3, 3), ("f", "c", 50, 10), ("f", "d", 50, 11), ("g", "e", 9, 9)], "field string, term string, occurrences bigint, records bigint")
    totals = spark.createDataFrame([("f", 100), ("g", 9)], "field string, total bigint")
    assert {r.term: r.mark for r in terms.mark_terms(counts, totals).collect()} == {"a": "too_rare", "b": None, "c": None, "d": "too_common", "e": None}


def baskets(seed, n):
    rnd = random.Random(seed)
    return [[rnd.choice(["的", "a", "b", "c", "d", "e", "f", "g", "", None]) for _ in range(rnd.randint(0, 5))] for _ in range(n)] + [None, [], ["a"] * 9]


def brute(rows):
    sets = [sorted({x for x in r or [] if x}) for r in rows]
    return Counter(p for s in sets for p in combinations(s, 2)), Counter(x for s in sets for x in s), len(rows)


@pytest.mark.parametrize("local", [3, 2_000_000])
def test_basket_pairs(spark, monkeypatch, local):
    monkeypatch.setattr(stripes, "LOCAL_PAIRS", local)
    rows = baskets(4, 80)
    df = spark.createDataFrame([(r, 1) for r in rows], "items array<string>, item int")
    pairs, items, n = brute(rows)
    got = {(r.low_item, r.high_item): r for r in stripes.basket_pairs(df).collect()}
    assert {k: v.records for k, v in got.items()} == dict(pairs)
    for (a, b), r in got.items():
        assert (r.a, r.b, r.total) == (items[a], items[b], n) and math.isclose(r.lift, pairs[a, b] * n / (items[a] * items[b]))
    for lift in (1.0, 1.5, 2.0):
        some = {(r.low_item, r.high_item) for r in stripes.basket_pairs(df, 2, lift).collect()}
        assert some == {k for k, v in pairs.items() if v >= 2 and v * n >= lift * items[k[0]] * items[k[1]]}
    assert stripes.basket_pairs(df.limit(0)).count() == 0


def test_very_long_record(spark):
    rows = [[f"w{i}" for i in range(2_500)], ["w1", "w2"]]
    got = stripes.basket_pairs(spark.createDataFrame([(r,) for r in rows], "items array<string>"))
    assert got.count() == 2_500 * 2_499 // 2 and got.where("low_item = 'w1' and high_item = 'w2'").first().records == 2


def test_weighted_pairs(spark):
    rows = [("s", "a", "b", 2), ("s", "b", "a", 3), ("t", "a", "b", 1), ("t", "a", "a", 5), ("t", None, "b", 7), ("u", "b", "c", 1), ("u", "c", "b", None)]
    df = spark.createDataFrame(rows, "record string, first string, second string, n bigint")
    got = {(r.low_item, r.high_item): (r.together, r.records, r.a, r.b, r.total) for r in stripes.weighted_pairs(df).collect()}
    assert got == {("a", "b"): (6, 2, 11, 14, 19), ("b", "c"): (1, 1, 14, 1, 19)}
    assert stripes.weighted_pairs(df, min_records=2).count() == 1 and stripes.weighted_pairs(df.limit(0)).count() == 0


def test_likelihood_ratio(spark):
    row = spark.createDataFrame([(10, 20, 30, 100)], "k int, a int, b int, n int").select(stripes.likelihood_ratio(*(F.col(c) for c in "kabn")).alias("g")).first()
    table = [10, 10, 20, 60]
    expected = [20 * 30 / 100, 20 * 70 / 100, 80 * 30 / 100, 80 * 70 / 100]
    assert math.isclose(row.g, 2 * sum(o * math.log(o / e) for o, e in zip(table, expected)))
