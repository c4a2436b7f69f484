import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweir.operators import line_parse as P


def plain_reason(line: str) -> str | None:
    """Structure of a line by the definition: broken_quote, column_count or None."""
    fields, at, n = 0, 0, len(line)
    while True:
        fields += 1
        if at < n and line[at] == '"':
            at += 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return "broken_quote"
                if line[end : end + 2] == '""':
                    at = end + 2
                    continue
                at = end + 1
                break
            if at < n and line[at] != "\t":
                return "broken_quote"
        else:
            end = line.find("\t", at)
            end = n if end < 0 else end
            if '"' in line[at:end]:
                return "broken_quote"
            at = end
        if at >= n:
            return None if fields == 3 else "column_count"
        at += 1


@given(st.text(alphabet='a"\t', max_size=24))
@settings(max_examples=600, deadline=None)
def test_cheapest_parse_states_the_reason(line):
    quotes, tabs, operations, fields = P.parse_line(line)
    reason = "broken_quote" if quotes else "column_count" if tabs else None
    assert reason == plain_reason(line)
    assert (fields is None) == bool(quotes or tabs)
    assert len(operations) == quotes + tabs


def brute_cost(line: str) -> tuple[int, int]:
    """Least (quote edits, tab edits) by trying all lines that one edit makes."""
    if plain_reason(line) is None:
        return 0, 0
    for i in range(len(line) + 1):
        for other in {line[:i] + line[i + 1 :], line[:i] + "\t" + line[i:]}:
            if len(other) != len(line) and plain_reason(other) is None and plain_reason(line) == "column_count":
                return 0, 1
    return 1, 0


def test_one_edit_of_tabs_is_found():
    for parts in itertools.product("a\t", repeat=5):
        line = "".join(parts)
        if plain_reason(line) == "column_count" and brute_cost(line) == (0, 1):
            assert P.parse_line(line)[:2] == (0, 1)


def test_fields_of_quoted_lines():
    assert P.parse_line('"a ""b""\tc"\tx y\t"5"')[3] == ['a "b"\tc', "x y", "5"]
    assert P.parse_line('""""\ta\t1')[3] == ['"', "a", "1"]
    assert P.parse_line("\t\t")[3] == ["", "", ""]


def test_a_missing_tab_is_stated_where_the_fields_suit_their_types():
    cases = {"词ci\t7": "insert_tab@1", "词\tci7": "insert_tab@4", "词\tci ku12": "insert_tab@7", "词\tci": "insert_tab@4", "词\tci\t\t7": "delete_tab@4", "词\t7": "insert_tab@1"}
    for line, operation in cases.items():
        quotes, tabs, operations, _ = P.parse_line(line)
        assert (quotes, tabs) == (0, 1) and operations[0] in (operation, operation.replace("@1", "@2"), operation.replace("@4", "@5")), (line, operations)
    assert P.parse_line("词ci7")[2] == ["insert_tab@1", "insert_tab@3"]


def test_clean_lines_need_no_programme(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "词\tci\t7"), (2, "词ci\t7"), (3, '"词"\tci\t7')], "line_id bigint, line string")
    got = {r.line_id: r for r in P.parse_deliveries(lines, spark.createDataFrame([("ci",)], "syllable string")).collect()}
    assert (got[1].reason, got[1].text, list(got[1].operations)) == (None, "词", []) and (got[3].reason, got[3].text) == (None, "词")
    assert (got[2].reason, list(got[2].operations)) == ("column_count", ["insert_tab@1"])


def test_long_lines_end():
    assert P.parse_line('"' + '""' * 20_000 + '"\ta\t1')[:2] == (0, 0)
    assert P.parse_line("a" * 1_000_000 + "\tb\t1")[:2] == (0, 0)


CASES = [
    ("词\tci\t7", None), ("词\tCI lü\t007\r", None), ("词\tci\t9223372036854775807", None), ("词\tci\t9223372036854775808", "bad_frequency"), ("词\tci\t0", "bad_frequency"), ("词\tci\t８", "bad_frequency"), ("词\tci\t 8", "bad_frequency"),
    ("  \tci\t7", "bad_text"), ("\tci\t7", "bad_text"), ("词\x07\tci\t7", "bad_text"), ("词�\tci\t7", "bad_text"), ('"词\t库"\tci\t7', None), ("词\tci  ci\t7", "bad_pinyin"), ("词\t\t7", "bad_pinyin"), ("词\t" + " ".join(["ci"] * 12) + "\t7", None),
    ("词\t" + " ".join(["ci"] * 13) + "\t7", "bad_pinyin"), ("词\tci", "column_count"), ("词\tci\t7\t", "column_count"), ('"词\tci\t7', "broken_quote"), ('词"\tci\t7', "broken_quote"), ('"词" \tci\t7', "broken_quote"),
]


def test_reasons_and_loaded_rows(spark):
    skipped = ["", "   ", "\r", "# note", "text\tpinyin\tfrequency\r", "﻿text\tpinyin\tfrequency", None]
    rows = [(i, line, "clash") for i, line in enumerate([c[0] for c in CASES] + skipped + [CASES[0][0]])]
    lines = spark.createDataFrame(rows, "line_id bigint, line string, reason string")
    syllables = spark.createDataFrame([("ci",), ("lv",), (None,)], "syllable string")
    got = {r.line_id: r for r in P.parse_deliveries(lines, syllables).collect()}
    assert set(got) == set(range(len(CASES))) | {len(rows) - 1}
    for i, (line, reason) in enumerate(CASES):
        assert got[i].reason == reason, line
    assert (got[1].text, got[1].pinyin, got[1].frequency) == ("词", "ci lv", 7)
    assert got[11].text == "词\t库" and got[3].frequency is None


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "line_id bigint, line string")
    assert P.parse_deliveries(lines, spark.createDataFrame([], "syllable string")).count() == 0
    one = spark.createDataFrame([(1, "词\tci\t7")], "line_id bigint, line string")
    assert P.parse_deliveries(one, spark.createDataFrame([], "syllable string")).first().reason == "bad_pinyin"


def test_syllable_table_is_bounded(spark):
    many = spark.range(P.SYLLABLE_BOUND + 1).selectExpr("cast(id as string) as syllable")
    with pytest.raises(ValueError):
        P.parse_deliveries(spark.createDataFrame([(1, "a")], "line_id bigint, line string"), many)
