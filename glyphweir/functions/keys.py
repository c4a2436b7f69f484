"""Keys of a keyboard: neighbours, letters of key tokens, and the code that edited keystrokes leave."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The neighbours of each key.
NEIGHBOURS = {
    "q": "wa", "w": "qeas", "e": "wrsd", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol",
    "a": "qwsz", "s": "weadzx", "d": "ersfxc", "f": "rtdgcv", "g": "tyfhvb", "h": "yugjbn", "j": "uihknm", "k": "iojlm", "l": "opk",
    "z": "asx", "x": "szdc", "c": "dfxv", "v": "fgcb", "b": "ghvn", "n": "hjbm", "m": "jkn",
}
PAIRS = sorted(a + b for a, own in NEIGHBOURS.items() for b in own)


def neighbour_table(spark: SparkSession) -> DataFrame:
    """(intended, actual) of all neighbouring keys."""
    return spark.createDataFrame([(p[0], p[1]) for p in PAIRS], "intended string, actual string")


def is_code(text: Column) -> Column:
    return text.rlike(r"\A[a-z]+\z")


def are_neighbours(intended: Column, actual: Column) -> Column:
    return F.concat(intended, actual).isin(PAIRS)


def typed_letters(keys: Column) -> Column:
    """The letters among key tokens, joined."""
    return F.array_join(F.filter(keys, lambda k: k.rlike(r"\A[a-z]\z")), "")


def effective_code(keys: Column) -> Column:
    """The code that the keys of a commit leave: (code, fault).

    Letters are inserted at the cursor; BS deletes before it and DEL after it, LEFT, RIGHT, HOME and END move it; SP or a
    digit selects. A key after the selection, ESC, a shifted key or another token is a fault and then code is null."""
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(False).alias("chosen"), F.lit(None).cast("string").alias("fault"))

    def step(s: Column, key: Column) -> Column:
        text, at = s["text"], s["at"]
        letter, before = key.rlike(r"\A[a-z]\z"), F.left(text, F.greatest(at, F.lit(0)))
        after = F.substring(text, at + 1, F.length(text) + 1)
        chosen = key.isin("SP", "ENTER") | key.rlike(r"\A[0-9]\z")
        fault = (
            F.when(s["fault"].isNotNull(), s["fault"])
            .when(s["chosen"], F.lit("after_selection"))
            .when(key == "ESC", F.lit("cancelled"))
            .when(F.startswith(key, F.lit("S+")), F.lit("shifted"))
            .when(~letter & ~chosen & ~key.isin("BS", "DEL", "LEFT", "RIGHT", "HOME", "END"), F.lit("unknown_key"))
        )
        made = (
            F.when(letter, F.concat(before, key, after))
            .when((key == "BS") & (at > 0), F.concat(F.left(text, F.greatest(at - 1, F.lit(0))), after))
            .when(key == "DEL", F.concat(before, F.substring(after, F.lit(2), F.length(after) + 1)))
            .otherwise(text)
        )
        moved = (
            F.when(letter, at + 1)
            .when(key.isin("BS", "LEFT"), F.greatest(at - 1, F.lit(0)))
            .when(key == "RIGHT", F.least(at + 1, F.length(text)))
            .when(key == "HOME", F.lit(0))
            .when(key == "END", F.length(text))
            .otherwise(at)
        )
        return F.struct(made.alias("text"), moved.alias("at"), (s["chosen"] | chosen).alias("chosen"), fault.alias("fault"))

    done = F.aggregate(keys, state, step)
    return F.struct(F.when(done["fault"].isNull(), done["text"]).alias("code"), done["fault"].alias("fault"))


def single_span(before: Column, after: Column) -> Column:
    """The one span in which two texts differ: (start, deleted, inserted, ambiguous); null where they are equal.

    ``ambiguous`` says that the same change could be placed elsewhere (a repeated character at its edge)."""
    n, m = F.length(before), F.length(after)
    shortest = F.least(n, m)

    def same(limit: Column, pick) -> Column:
        places = F.sequence(F.lit(0), limit)
        return F.aggregate(places, F.lit(0), lambda s, i: F.when((i < limit) & (s == i) & pick(i), s + 1).otherwise(s))

    prefix = same(shortest, lambda i: F.substring(before, i + 1, F.lit(1)) == F.substring(after, i + 1, F.lit(1)))
    suffix = same(shortest, lambda i: F.substring(before, n - i, F.lit(1)) == F.substring(after, m - i, F.lit(1)))
    kept = F.least(suffix, shortest - prefix)
    span = F.struct(
        prefix.alias("start"),
        F.substring(before, prefix + 1, n - prefix - kept).alias("deleted"),
        F.substring(after, prefix + 1, m - prefix - kept).alias("inserted"),
        (prefix + suffix > shortest).alias("ambiguous"),
    )
    return F.when(before != after, span)


def fnv1a64(data: bytes) -> int:
    """The 64-bit FNV-1a fingerprint of bytes."""
    value = 0xCBF29CE484222325
    for byte in data:
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


def fingerprint(text: Column) -> Column:
    """FNV-1a-64 of the UTF-8 bytes of a text as 16 hexadecimal digits; Spark's 64-bit product would overflow."""

    def all_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f"{fnv1a64(t.encode()):016x}")

    return F.pandas_udf(all_of, "string")(text)
