"""Delivery lines parsed at minimum edit cost: what loads, and why the rest doesn't.

A line is three fields separated by tabs; a field that starts with a quote runs to the next quote that isn't doubled. A line
without quotes and with two tabs is its own parse of cost zero, and Spark splits it. Every other line goes through one
dynamic programme over its quotes, its tabs and its runs of digits, of letters of pinyin and of other characters. Its edits
are: delete a quote, insert one, double one, delete a tab, insert one. An edit of quotes costs more than any number of edits
of tabs, and one of tabs more than any number of characters that don't suit their field's type. So the cheapest parse has a
quote edit exactly if the quoting is broken, otherwise as many tab edits as there are columns too many or too few, and of
those the ones that leave the fields valid. Lines of cost zero whose fields have valid values load.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphweir.sources.tables import small_values

#: Costs: any number of characters of the wrong type and of empty fields is cheaper than one tab edit, any number of those than one quote edit.
TYPE_FAULT, TAB_EDIT, QUOTE_EDIT = 1, 1 << 40, 1 << 80
FIELDS = 3
HEADER = "text\tpinyin\tfrequency"
LARGEST = "9223372036854775807"
MOST_SYLLABLES = 12
#: The syllable table is fixed (405 rows); more than this isn't one.
SYLLABLE_BOUND = 5_000

START, PLAIN, QUOTED, CLOSED = range(4)
KEEP, DROP_QUOTE, OPEN_QUOTE, CLOSE_QUOTE, DOUBLE_QUOTE, DROP_TAB = range(6)
OPERATION = ("", "delete_quote", "insert_quote", "insert_quote", "double_quote", "delete_tab")
#: Classes of runs by symbol: quote, tab, digits, letters and marks of pinyin, blanks, others; and those that each field takes.
RUN = re.compile(r'(?P<q>")|(?P<t>\t)|(?P<d>[0-9]+)|(?P<p>[A-Za-z:üÜ]+)|(?P<b> +)|(?P<o>[^"\t0-9A-Za-z:üÜ ]+)')
SUITS = ("dpbo", "pb", "d")


def _moves() -> dict[str, list[tuple[int, int, int, int, bool]]]:
    """For each symbol the moves (state before, state after, cost, edit, whether each character costs if it doesn't suit).

    No inserted tab is among them: see cheapest_parse."""
    moves: dict[str, list[tuple[int, int, int, int, bool]]] = {s: [] for s in "qtdpbo"}
    for field in range(FIELDS):
        start, plain, quoted, closed = (field * 4 + s for s in (START, PLAIN, QUOTED, CLOSED))
        for symbol in "dpbo":
            wrong = symbol not in SUITS[field]
            moves[symbol] += [(start, plain, 0, KEEP, wrong), (plain, plain, 0, KEEP, wrong), (quoted, quoted, 0, KEEP, wrong), (start, quoted, QUOTE_EDIT, OPEN_QUOTE, wrong)]
        moves["q"] += [(start, quoted, 0, KEEP, False), (quoted, closed, 0, KEEP, False), (closed, quoted, 0, KEEP, False)]
        moves["q"] += [(s, s, QUOTE_EDIT, DROP_QUOTE, False) for s in (start, plain, closed)] + [(quoted, quoted, QUOTE_EDIT, DOUBLE_QUOTE, False)]
        moves["t"] += [(quoted, quoted, 0, KEEP, False), (start, quoted, QUOTE_EDIT, OPEN_QUOTE, False)]
        moves["t"] += [(s, start, TAB_EDIT, DROP_TAB, False) for s in (start, plain, closed)]
        if field + 1 < FIELDS:
            after = (field + 1) * 4 + START
            moves["t"] += [(s, after, TYPE_FAULT if s == start else 0, KEEP, False) for s in (start, plain, closed)] + [(quoted, after, QUOTE_EDIT, CLOSE_QUOTE, False)]
    return moves


MOVES = _moves()
STATES = FIELDS * 4
_NEVER = 1 << 120


def _insert_tabs(cost: list[int], symbol: str) -> list[list[int]]:
    """Lets tabs be inserted before ``symbol`` ("" at the end): raises costs' states in place, and returns for each state the
    states that it came from. A tab may not stand where it would part a quote from what it follows or is followed by: it is
    inserted at a field's start, after a plain run unless a quote comes next, and anywhere at the end."""
    came = [[] for _ in range(STATES)]
    for field in range(FIELDS - 1):
        after = (field + 1) * 4 + START
        for kind in (START, PLAIN, CLOSED):
            if kind == CLOSED and symbol or kind == PLAIN and symbol == "q":
                continue
            before = field * 4 + kind
            price = TAB_EDIT + (TYPE_FAULT if kind == START else 0)
            if cost[before] + price < cost[after]:
                cost[after] = cost[before] + price
                came[after] = [*came[before], before]
    return came


@lru_cache(maxsize=50_000)
def cheapest_parse(symbols: str, sizes: tuple[int, ...]) -> tuple[int, int, tuple[tuple[int, int], ...], tuple[int, ...], tuple[int, ...]]:
    """(quote edits, tab edits, edits as (symbol index, edit), symbol indexes before which a tab is inserted, index of the
    state after each symbol) of the cheapest parse of runs with their symbols and sizes."""
    cost = [_NEVER] * STATES
    cost[START] = 0
    back, inserted = np.zeros((len(symbols), STATES), dtype=np.uint8), []
    for i, symbol in enumerate(symbols):
        inserted.append(_insert_tabs(cost, symbol))
        after, row = [_NEVER] * STATES, back[i]
        for before, state, price, edit, wrong in MOVES[symbol]:
            total = cost[before] + price + (TYPE_FAULT * sizes[i] if wrong else 0)
            if total < after[state]:
                after[state] = total
                row[state] = before * 8 + edit
        cost = after
    inserted.append(_insert_tabs(cost, ""))
    best = (_NEVER, 0, 0)
    for state, total in enumerate(cost):
        field, kind = divmod(state, 4)
        if field < FIELDS - 1 and kind != QUOTED:
            continue  # reached the last field by inserted tabs
        total += (FIELDS - 1 - field) * TAB_EDIT + (QUOTE_EDIT if kind == QUOTED else TYPE_FAULT if kind == START else 0)
        best = min(best, (total, -field, state))
    total, _, state = best
    edits: list[tuple[int, int]] = []
    tabs_at: list[int] = []
    field, kind = divmod(state, 4)
    if kind == QUOTED:
        edits.append((len(symbols), CLOSE_QUOTE))
        tabs_at += [len(symbols)] * (FIELDS - 1 - field)
    states = [0] * len(symbols)
    for i in range(len(symbols), -1, -1):
        while inserted[i][state]:
            tabs_at.append(i)
            state = inserted[i][state][-1]
        if not i:
            break
        states[i - 1] = state
        before, edit = divmod(int(back[i - 1, state]), 8)
        if edit:
            edits.append((i - 1, edit))
        state = before
    quotes, rest = divmod(total, QUOTE_EDIT)
    return quotes, rest // TAB_EDIT, tuple(reversed(edits)), tuple(reversed(tabs_at)), tuple(states)


def parse_line(line: str) -> tuple[int, int, list[str], list[str] | None]:
    """(quote edits, tab edits, operations with their character positions, the fields if the line needs no edit)."""
    found = [(m.lastgroup, m.group()) for m in RUN.finditer(line)]
    symbols, runs = "".join(s for s, _ in found), [run for _, run in found]
    sizes = tuple(map(len, runs))
    quotes, tabs, edits, tabs_at, states = (cheapest_parse if len(symbols) < 64 else cheapest_parse.__wrapped__)(symbols, sizes)
    if not quotes and not tabs:
        fields, quoted = [""] * FIELDS, [False] * FIELDS
        parts: list[list[str]] = [[] for _ in range(FIELDS)]
        field = 0
        for run, symbol, state in zip(runs, symbols, states):
            if state // 4 != field:  # the tab between two fields
                field = state // 4
                continue
            if symbol == "q" and not parts[field]:
                quoted[field] = True
            parts[field].append(run)
        for k, own in enumerate(parts):
            text = "".join(own)
            fields[k] = text[1:-1].replace('""', '"') if quoted[k] else text
        return 0, 0, [], fields
    starts = [0]
    for run in runs:
        starts.append(starts[-1] + len(run))
    operations = sorted([(starts[i], OPERATION[edit]) for i, edit in edits] + [(starts[i], "insert_tab") for i in tabs_at])
    return quotes, tabs, [f"{name}@{at}" for at, name in operations], None


PARSED = T.StructType(
    [
        T.StructField("quote_edits", T.LongType()),
        T.StructField("tab_edits", T.LongType()),
        T.StructField("operations", T.ArrayType(T.StringType())),
        T.StructField("fields", T.ArrayType(T.StringType())),
    ]
)


def _parse_all(lines: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None, None) if line is None else parse_line(line) for line in lines]
    return pd.DataFrame(rows, columns=[f.name for f in PARSED.fields], dtype=object)


def plain_pinyin(pinyin: Column) -> Column:
    """Lower case, with v for the front rounded vowel."""
    return F.replace(F.replace(F.lower(pinyin), F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v"))


def value_fault(text: Column, pinyin: Column, frequency: Column, syllables: list[str]) -> Column:
    """The first of bad_text, bad_pinyin and bad_frequency that applies, else null."""
    spelled = F.split(plain_pinyin(pinyin), " ", -1)
    digits = F.regexp_replace(frequency, "^0+", "")
    return (
        F.when(F.rtrim(text) == "", F.lit("bad_text"))
        .when(text.rlike(r"[\x{0}-\x{8}\x{A}-\x{1F}\x{7F}\x{FFFD}]"), F.lit("bad_text"))
        .when((F.size(spelled) > MOST_SYLLABLES) | ~F.forall(spelled, lambda s: s.isin(syllables)), F.lit("bad_pinyin"))
        .when(~frequency.rlike(r"\A[0-9]+\z"), F.lit("bad_frequency"))
        .when((F.length(digits) == 0) | (F.length(digits) > len(LARGEST)) | ((F.length(digits) == len(LARGEST)) & (digits > LARGEST)), F.lit("bad_frequency"))
    )


def parse_deliveries(lines: DataFrame, syllables: DataFrame, line: str = "line") -> DataFrame:
    """Data lines with ``reason`` (null: valid) and the loaded ``text``, ``pinyin`` and ``frequency``.

    Adds to the columns of ``lines``: reason, operations (the edits of the cheapest parse), text, pinyin (lower case, v),
    frequency; columns of ``lines`` with these names are replaced. A carriage return at the end isn't part of a line.
    Null, empty and blank lines, comments and headers have no row. Repeated lines each have theirs. Long lines cost time
    in proportion to their quotes and tabs. An empty table of syllables makes every pinyin bad. One narrow stage: no
    shuffle; the syllables (at most SYLLABLE_BOUND) are a literal set.
    """
    allowed = small_values(syllables, "syllable", SYLLABLE_BOUND)
    own = F.regexp_replace(F.col(line), r"\r\z", "")
    # Marked so that a filter on the reason stays above the parse: pushed below it, the programme would run twice.
    parse = F.pandas_udf(_parse_all, PARSED).asNondeterministic()
    kept = [c for c in lines.columns if c not in {"reason", "operations", "text", "pinyin", "frequency", "__own", "__parts", "__parsed", "__fields", "__field0", "__field1", "__field2"}]
    data = (
        lines.select(*(F.col(f"`{c}`") for c in kept), own.alias("__own"))
        .where((F.rtrim("__own") != "") & ~F.startswith("__own", F.lit("#")))
        .where((F.col("__own") != HEADER) & (F.col("__own") != "﻿" + HEADER))
        # A line without quotes and with three parts is its own parse; the others' alone go to the programme.
        .withColumn("__parts", F.when(~F.contains("__own", F.lit('"')), F.split("__own", "\t", -1)))
        .withColumn("__parts", F.when(F.size("__parts") == FIELDS, F.col("__parts")))
        .withColumn("__parsed", parse(F.when(F.col("__parts").isNull(), F.col("__own"))))
        .withColumn("__fields", F.coalesce("__parts", "__parsed.fields"))
        .withColumns({f"__field{k}": F.col("__fields")[k] for k in range(FIELDS)})
    )
    text, pinyin, frequency = (F.col(f"__field{k}") for k in range(FIELDS))
    reason = (
        F.when(F.col("__parsed.quote_edits") > 0, F.lit("broken_quote"))
        .when(F.col("__parsed.tab_edits") > 0, F.lit("column_count"))
        .otherwise(value_fault(text, pinyin, frequency, allowed))
    )
    valid = F.col("reason").isNull()
    return (
        data.withColumn("reason", reason)
        .withColumn("operations", F.coalesce("__parsed.operations", F.array().cast("array<string>")))
        .withColumn("text", F.when(valid, text))
        .withColumn("pinyin", F.when(valid, plain_pinyin(pinyin)))
        .withColumn("frequency", F.when(valid, F.expr("try_cast(__field2 as bigint)")))
        .drop("__own", "__parts", "__parsed", "__fields", *(f"__field{k}" for k in range(FIELDS)))
    )
