"""Weighted lexicons with key codes, and what they have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweir.functions import codec


def current(rows: DataFrame, key: str, revision: str, *columns: str) -> DataFrame:
    """The columns of the highest revision of each key; reduced in every task before the one shuffle."""
    newest = F.max(F.struct(revision, *columns)).alias("v")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *(F.col(f"v.{c}").alias(c) for c in columns))


def reject_reason(text: Column, codes: Column, pinyin: Column, frequency: Column) -> Column:
    """Why a row can't be an entry; null if it can."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "no_text")
        .when(F.coalesce(F.trim(pinyin), F.lit("")) == "", "no_pinyin")
        .when(codes.isNull(), "unsupported_pinyin")
        .when(F.size(codes) > codec.MOST_SYLLABLES, "too_long")
        .when(F.coalesce(frequency, F.lit(0)) <= 0, "no_frequency")
    )


def entries(rows: DataFrame) -> DataFrame:
    """(entry_id, text, pinyin, code, codes, frequency, reason) of the current rows of an overlay."""
    return _coded(current(rows, "entry_id", "revision", "text", "pinyin", "frequency"))


def _coded(rows: DataFrame) -> DataFrame:
    now = rows.withColumn("codes", codec.syllable_codes(F.col("pinyin")))
    return now.withColumn("code", F.array_join("codes", "")).withColumn("reason", reject_reason(F.col("text"), F.col("codes"), F.col("pinyin"), F.col("frequency")))


def lexicon(rows: DataFrame) -> DataFrame:
    """(text, code, codes, pinyin, frequency): one entry per text and code, with its greatest frequency.

    Packages share texts and spellings, so that these are made distinct before spellings are encoded."""
    spelt = current(rows, "entry_id", "revision", "text", "pinyin", "frequency").where("frequency > 0").groupBy("text", "pinyin").agg(F.max("frequency").alias("frequency"))
    valid = _coded(spelt).where("reason is null")
    merged = valid.groupBy("text", "code").agg(F.min(F.lower("pinyin")).alias("pinyin"), F.max("frequency").alias("frequency"))
    return merged.withColumn("codes", codec.pairs_of(F.col("code")))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def ranked(rows: DataFrame, keys: list[str], *order: Column, limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank in the group; with a limit Spark keeps the best ones in every task before the shuffle."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)


def best_by_text(words: DataFrame) -> DataFrame:
    """The entry of each text with the greatest frequency, then the least pinyin and code."""
    return first_by(words, ["text"], F.desc("frequency"), F.asc("pinyin"), F.asc("code"))


def best_by_code(words: DataFrame) -> DataFrame:
    return first_by(words, ["code"], F.desc("frequency"), F.asc("text"))


def top_slice(rows: DataFrame, size: int) -> DataFrame:
    """The ``size`` heaviest valid rows (ties: the earlier one), then one per text and code: the limit comes first."""
    kept = entries(rows).where("reason is null").orderBy(F.desc("frequency"), F.asc("entry_id")).limit(size)
    return first_by(kept, ["text", "code"], F.desc("frequency"), F.asc("entry_id")).select("text", "code", "frequency")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row of counts: texts, identities and codes that both lexicons or one have, and codes with the same best text."""

    def overlap(keys: list[str], name: str) -> DataFrame:
        a, b = (df.select(*keys).distinct().withColumn(tag, F.lit(1)) for df, tag in ((left, "l"), (right, "r")))
        counts = {"shared": "l is not null and r is not null", "only_left": "r is null", "only_right": "l is null"}
        return a.join(b, keys, "full").agg(*(F.count_if(F.expr(c)).alias(f"{name}_{k}") for k, c in counts.items()))

    tops = best_by_code(left).select("code", F.col("text").alias("l")).join(best_by_code(right).select("code", F.col("text").alias("r")), "code")
    same = tops.agg(F.count_if(F.col("l") == F.col("r")).alias("top_same"), F.count_if(F.col("l") != F.col("r")).alias("top_changed"))
    one = overlap(["text"], "text")
    for other in (overlap(["text", "code"], "identity"), overlap(["code"], "code"), same):
        one = one.select("*", *(other.select(c).scalar().alias(c) for c in other.columns))
    return one


def spelling_table(words: DataFrame) -> DataFrame:
    """(spelling, abbreviated, text, code, frequency): every spelling of every entry."""
    return words.select("text", "code", "frequency", F.inline(codec.spellings(F.col("codes"))))
