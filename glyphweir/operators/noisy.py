"""Words for mistyped key codes: the neighbourhood of one edit as equi-joins.

A code may differ from the spelling meant by one neighbouring key, one swap of adjacent keys, one missing or one extra key.
Substitutions, swaps and extra keys are undone on the side of the code; a missing key is found by leaving out each key of
the spellings, which costs the bounded lexicon and not each code 26 letters at every place. Of the many rows of either side
only those leave their task that a filter of the other side lets pass: it loses none and is of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweir.functions.keys import NEIGHBOURS, are_neighbours
from glyphweir.functions.scoring import correction_rank, word_score
from glyphweir.operators.lexicon import first_by, ranked, spelling_table
from glyphweir.operators.sieve import filter_of, passes
from glyphweir.session import cut, spread, unfolded


def _char(text: Column, i: Column) -> Column:
    return F.substring(text, i + 1, F.lit(1))


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.left(text, i), F.substring(text, i + 2, F.length(text) + 1))


def hypotheses(codes: DataFrame, code: str = "observed") -> DataFrame:
    """(observed, intended, kind): what may be meant, but for missing keys; a spelling is named once, by its first kind."""
    text, n, i, kind = F.col("observed"), F.length("observed"), F.col("i"), F.col("kind")
    here, after = _char(text, i), _char(text, i + 1)

    def edits(near: str = "") -> Column:
        own = [("swap", ""), ("extra", ""), *(("neighbour", key) for key in near)]
        return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(key).alias("key")) for k, key in own))

    of_key = F.get(F.array(*(edits(NEIGHBOURS.get(chr(97 + k), "")) for k in range(26))), F.ascii(here) - 97)
    exact = F.array(F.struct(F.lit("exact").alias("kind"), F.lit("").alias("key")))
    places = codes.select(F.col(code).alias("observed")).where(n > 0).select("observed", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    each = places.select("observed", "i", F.inline(F.when(i == n, exact).otherwise(F.coalesce(of_key, edits()))))
    # Leaving out any key of a run of equal ones gives the same spelling.
    once = F.when(kind == "swap", (i + 1 < n) & (here != after)).when(kind == "extra", (n > 1) & ((i == 0) | (_char(text, i - 1) != here))).otherwise(F.lit(True))
    intended = (
        F.when(kind == "neighbour", F.concat(F.left(text, i), F.col("key"), F.substring(text, i + 2, n)))
        .when(kind == "swap", F.concat(F.left(text, i), after, here, F.substring(text, i + 3, n)))
        .when(kind == "extra", _without(text, i))
        .otherwise(text)
    )
    return each.where(once).select("observed", intended.alias("intended"), "kind")


def classify(observed: Column, intended: Column) -> Column:
    """The kind of the one edit between a code and the spelling meant; null if it takes more than one.

    The place of a missing or extra key is the first difference."""
    n, m = F.length(observed), F.length(intended)
    places = F.sequence(F.lit(0), F.greatest(n, m))
    unlike = F.filter(places, lambda i: (i < n) & (i < m) & (_char(observed, i) != _char(intended, i)))
    first = F.coalesce(F.get(unlike, F.lit(0)), F.least(n, m))
    a, b = F.get(unlike, F.lit(0)), F.get(unlike, F.lit(1))
    kind = (
        F.when(observed == intended, "exact")
        .when((m == n + 1) & (_without(intended, first) == observed), "missing")
        .when((n == m + 1) & (_without(observed, first) == intended), "extra")
        .when((n == m) & (F.size(unlike) == 1) & are_neighbours(_char(intended, a), _char(observed, a)), "neighbour")
        .when((n == m) & (F.size(unlike) == 2) & (b == a + 1) & (_char(observed, a) == _char(intended, b)) & (_char(observed, b) == _char(intended, a)), "swap")
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind != "exact", first).alias("place")))


def left_out(table: DataFrame) -> DataFrame:
    """``table`` with each spelling as ``intended`` and, as ``observed``, what is typed if one of its keys is missing."""
    text, i = F.col("spelling"), F.col("i")
    each = table.select("*", F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("i")).where((i == 0) | (_char(text, i - 1) != _char(text, i)))
    return each.withColumn("observed", _without(text, i)).drop("i").withColumnRenamed("spelling", "intended").withColumn("kind", F.lit("missing"))


def matches(codes: DataFrame, words: DataFrame, abbreviations: bool = True) -> DataFrame:
    """(observed, text, code, spelling, abbreviated, kind, frequency, score): every spelling one edit away at most of each
    distinct code."""
    words = cut(words.select("text", "code", "codes", "frequency"))  # read three times
    table = spelling_table(spread(words, "code"))
    if not abbreviations:
        table = table.where("abbreviated = 0")
    spelt = filter_of(table.select("spelling"), words)
    asked = codes.select("observed")
    own = spread(asked.distinct(), "observed")
    direct = unfolded(hypotheses(own).where(passes(spelt, F.col("intended")))).join(table.withColumnRenamed("spelling", "intended"), "intended")
    missing = unfolded(left_out(table).where(passes(filter_of(asked, codes), F.col("observed")))).join(own, "observed")
    columns = ["observed", "text", "code", "intended", "abbreviated", "kind", "frequency"]
    both = direct.select(*columns).unionByName(missing.select(*columns))
    return both.withColumn("score", word_score(F.col("frequency"), F.col("kind"), F.col("abbreviated"))).withColumnRenamed("intended", "spelling")


def candidate_order(*more: Column) -> list[Column]:
    """Score, fewer abbreviations, likelier correction, text, spelling."""
    return [F.desc("score"), F.asc("abbreviated"), correction_rank(F.col("kind")).asc(), *more, F.asc("text"), F.asc("spelling"), F.asc("code")]


def decode(codes: DataFrame, words: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` words for each distinct code of ``observed``; null and empty codes have none.

    Each entry counts once, by its best spelling. Codes are joined by hash; ranks are kept to ``top`` in every task
    before the last shuffle by code. The lexicon side is bounded by its spellings."""
    own = cut(codes.select("observed").where("observed <> ''").distinct())  # read twice
    best = first_by(matches(own, words), ["observed", "text", "code"], *candidate_order())
    return ranked(best, ["observed"], *candidate_order(), limit=top)


def decode_exact(codes: DataFrame, words: DataFrame, top: int = 10) -> DataFrame:
    """Words by their full code only, where u after j, q, x, y may stand for v."""
    from glyphweir.functions.codec import alias_codes

    own = codes.select("observed").where("observed <> '' and length(observed) % 2 = 0").distinct()
    asked = own.select("observed", F.explode(F.array_distinct(alias_codes(F.col("observed")))).alias("code"))
    found = first_by(asked.join(words, "code"), ["observed", "text"], F.desc("frequency"), F.asc("code"))
    return ranked(found, ["observed"], F.desc("frequency"), F.asc("text"), F.asc("code"), limit=top)
