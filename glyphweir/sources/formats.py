"""Text formats as DataFrames: dictionaries, sentence files, stroke tables, transition counts, capsules and manifests.

Readers take paths and read them in parallel; where the order of lines matters, a whole block (a sentence, a capsule) is
one row, so no line numbers have to be carried across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweir.functions import codec

LEXICON_HEADER = "text\tpinyin\tfrequency"
CAPSULE_SCHEMA = "event-capsule-1"
MANIFEST_FIELDS = ("schema", "snapshot_schema", "revision", "contains_private_text", "payload_format", "payload_bytes", "payload_fingerprint", "entry_count")


def _fields(line: str | Column = "value") -> Column:
    return F.split(F.regexp_replace(F.col(line) if isinstance(line, str) else line, r"\r\z", ""), "\t", -1)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(text, code, codes, pinyin, frequency) of a strict tab-separated lexicon; raises on reading a line that breaks it.

    Blank lines and comments are skipped. A line must be the header or have three fields that are not empty, a frequency
    above 0 and a pinyin of at most twelve syllables; a text and code may stand once."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")) & (F.regexp_replace("value", r"\r\z", "") != LEXICON_HEADER))
    f = _fields()
    rows = lines.select(f.alias("f"), F.col("value")).withColumn("codes", codec.syllable_codes(F.get("f", F.lit(1))))
    frequency = F.expr("try_cast(get(f, 2) as bigint)")
    fault = (
        F.when((F.size("f") != 3) | F.exists("f", lambda x: x == ""), "columns")
        .when(F.coalesce(frequency, F.lit(0)) <= 0, "frequency")
        .when(F.col("codes").isNull() | (F.size("codes") > codec.MOST_SYLLABLES), "pinyin")
    )
    code = F.array_join("codes", "")
    again = F.count("*").over(Window.partitionBy(F.get("f", F.lit(0)), code)) > 1
    fault = F.coalesce(fault, F.when(again, "duplicate"))
    checked = rows.withColumn("fault", fault).withColumn("ok", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("lexicon line breaks the format ("), "fault", F.lit("): "), "value"))).otherwise(F.lit(True)))
    return checked.where("ok").select(F.get("f", F.lit(0)).alias("text"), code.alias("code"), "codes", F.get("f", F.lit(1)).alias("pinyin"), frequency.alias("frequency"))


def read_dictionary(spark: SparkSession, path: str, shadowed: DataFrame | None = None) -> DataFrame:
    """(line_no, text, pinyin, code, codes, frequency, reason) of a dictionary with a preamble that ends in "...".

    Rows that are no entries stay with their reason: bad_row, bad_weight, shadowed (in ``shadowed``, by text),
    unsupported_pinyin, too_long, duplicate (the first line wins). A weight of 0 counts as 1. The file is one row: such a
    dictionary has a few megabytes."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)(?:^|\n)---\r?\n.*?\n\.\.\.\r?\n(.*)", 1)
    lines = whole.select(F.posexplode(F.split(body, "\n")).alias("line_no", "value")).where((F.regexp_replace("value", r"\r\z", "") != "") & ~F.startswith("value", F.lit("#")))
    rows = lines.select("line_no", _fields().alias("f")).withColumn("codes", codec.syllable_codes(F.get("f", F.lit(1)))).withColumn("code", F.array_join("codes", ""))
    rows = rows.select("line_no", *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("text", "pinyin", "weight"))), F.size("f").alias("n"), "codes", "code")
    rows = rows.withColumn("frequency", F.greatest(F.expr("try_cast(weight as bigint)"), F.lit(1)))
    if shadowed is not None:
        rows = rows.join(shadowed.select("text", F.lit(True).alias("hidden")).distinct(), "text", "left")
    else:
        rows = rows.withColumn("hidden", F.lit(None).cast("boolean"))
    fault = (
        F.when((F.col("n") != 3) | (F.coalesce("text", F.lit("")) == "") | (F.coalesce("pinyin", F.lit("")) == "") | (F.coalesce("weight", F.lit("")) == ""), "bad_row")
        .when(F.expr("try_cast(weight as bigint)").isNull() | F.startswith("weight", F.lit("-")), "bad_weight")
        .when(F.col("hidden"), "shadowed")
        .when(F.col("codes").isNull(), "unsupported_pinyin")
        .when(F.size("codes") > codec.MOST_SYLLABLES, "too_long")
    )
    first = F.row_number().over(Window.partitionBy("text", "code", F.col("reason").isNull()).orderBy("line_no")) > 1
    return rows.withColumn("reason", fault).withColumn("reason", F.coalesce("reason", F.when(first, "duplicate"))).select("line_no", "text", "pinyin", "code", "codes", "frequency", "reason")


def _held(rows: DataFrame, fault: Column, what: str) -> DataFrame:
    """The rows; raises on reading one that has a fault, and names it."""
    said = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit(f"{what} breaks the format ("), fault, F.lit(")"))).cast("boolean")).otherwise(F.lit(True))
    return rows.withColumn("__held", said).where("__held").drop("__held")


def read_sentences(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(id, tokens, n_ranges) of a ten-column sentence file; blocks end at blank lines, so each is one row.

    Rows with a whole number are tokens; ranges and empty nodes are counted. Raises on a block without id or with a row of
    other than ten columns; ``strict`` raises on an id that comes twice and on a sentence without tokens, too. A file whose
    lines end in carriage returns is one row until its blocks are parted."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.explode(F.split("value", r"\r?\n\r?\n")).alias("value"))
    own = parse_sentences(blocks)
    if not strict:
        return own
    again = F.count("*").over(Window.partitionBy("id")) > 1
    return _held(own.withColumn("__again", again), F.when(F.size("tokens") <= 0, F.concat(F.lit("empty sentence "), "id")).when(F.col("__again"), F.concat(F.lit("duplicate id "), "id")), "a sentence").drop("__again")


def parse_sentences(blocks: DataFrame) -> DataFrame:
    """The same for blocks in the column ``value``."""
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x != "")
    own = blocks.where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "").select(lines.alias("lines"))
    head = F.filter("lines", lambda x: F.startswith(x, F.lit("# sent_id = ")))
    rows = F.transform(F.filter("lines", lambda x: ~F.startswith(x, F.lit("#"))), lambda x: F.split(x, "\t", -1))
    parts = own.select(F.replace(F.get(head, F.lit(0)), F.lit("# sent_id = "), F.lit("")).alias("id"), rows.alias("rows"))
    bad = F.col("id").isNull() | F.exists("rows", lambda r: F.size(r) != 10)
    checked = parts.withColumn("ok", F.when(bad, F.raise_error(F.lit("a sentence block breaks the format"))).otherwise(F.lit(True))).where("ok")
    whole = F.filter("rows", lambda r: F.get(r, F.lit(0)).rlike(r"\A[0-9]+\z"))
    tokens = F.transform(whole, lambda r: F.struct(F.get(r, F.lit(0)).cast("int").alias("token_id"), F.get(r, F.lit(1)).alias("form"), F.when(F.get(r, F.lit(3)) != "_", F.get(r, F.lit(3))).alias("upos")))
    return checked.select("id", tokens.alias("tokens"), (F.size("rows") - F.size(whole)).alias("n_ranges"))


def sentence_block(id_: str, tokens: str) -> Column:
    """The block that parse_sentences reads."""
    rows = F.transform(tokens, lambda t: F.concat_ws("\t", t["token_id"].cast("string"), t["form"], F.lit("_"), F.coalesce(t["upos"], F.lit("_")), *(F.lit("_"),) * 6))
    return F.concat(F.lit("# sent_id = "), F.col(id_), F.lit("\n"), F.array_join(rows, "\n"))


def read_strokes(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """As parse_strokes; ``strict`` raises on lines that aren't two columns of 1 to 128 digits 1 to 5 and of different
    characters that show, and on a sequence that comes twice."""
    lines = spark.read.text(path)
    if strict:
        f = _fields()
        rows = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).withColumn("__f", f)
        chars = F.filter(F.split(F.get("__f", F.lit(1)), ""), lambda c: c != "")
        fault = (
            F.when(F.size("__f") != 2, "columns")
            .when(~F.get("__f", F.lit(0)).rlike(r"\A[1-5]{1,128}\z"), "sequence")
            .when((F.size(chars) == 0) | F.get("__f", F.lit(1)).rlike(r"[\s\p{Cc}]") | (F.size(F.array_distinct(chars)) != F.size(chars)), "characters")
            .when(F.count("*").over(Window.partitionBy(F.get("__f", F.lit(0)))) > 1, "duplicate")
        )
        lines = _held(rows.withColumn("__fault", fault), F.col("__fault"), "a stroke line").select("value")
    return parse_strokes(lines)


def parse_strokes(lines: DataFrame) -> DataFrame:
    """(ch, strokes) of lines "digits TAB characters": the sorted stroke codes, in letters, of each character."""
    rows = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select(_fields().alias("f")).where(F.get("f", F.lit(0)).rlike(r"\A[1-5]{1,128}\z"))
    each = rows.select(F.translate(F.get("f", F.lit(0)), "12345", "hspnz").alias("code"), F.explode(F.filter(F.split(F.get("f", F.lit(1)), ""), lambda c: c != "")).alias("ch"))
    return each.groupBy("ch").agg(F.sort_array(F.collect_set("code")).alias("strokes"))


def read_transitions(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """(tokens, n) of lines "tokens separated by blanks TAB count"; lines that break it have no row.

    With ``words`` it is strict: blank lines, comments and the header are skipped, and a line that breaks the format or has a
    token that is no word raises."""
    lines = spark.read.text(path).select(_fields().alias("f"))
    if words is not None:
        rows = lines.where(~F.get("f", F.lit(0)).rlike(r"\A(#.*)?\z") & (F.array_join("f", "\t") != "tokens\tcount")).select("f", F.split(F.trim(F.get("f", F.lit(0))), r"\s+").alias("tokens"), F.expr("try_cast(get(f, 1) as bigint)").alias("n"), F.monotonically_increasing_id().alias("i"))
        known = words.select(F.col("text").alias("token"), F.lit(True).alias("known")).distinct()
        lacking = rows.select("i", F.explode("tokens").alias("token")).join(known, "token", "left").where("known is null").groupBy("i").agg(F.min("token").alias("token"))
        joined = rows.join(lacking, "i", "left")
        fault = F.when(F.size("f") != 2, "columns").when(F.coalesce("n", F.lit(0)) <= 0, "count").when(F.size("tokens") < 2, "too few tokens").when(F.col("token").isNotNull(), F.concat(F.lit("unknown token "), "token"))
        return _held(joined, fault, "a transition line").select("tokens", "n")
    return lines.select(F.split(F.get("f", F.lit(0)), " ").alias("tokens"), F.expr("try_cast(get(f, 1) as bigint)").alias("n")).where((F.size("tokens") > 1) & (F.col("n") > 0))


def read_cases(spark: SparkSession, path: str, words: DataFrame, strict: bool = False) -> DataFrame:
    """(id, observed, expected) of lines "id TAB tokens separated by blanks": first keys and text, if all tokens are words.

    ``strict`` skips blank lines, comments and the header, and raises on other lines that break the format, on an id that
    comes twice, and on a token that is no word."""
    from glyphweir.operators.lexicon import best_by_text

    lines = spark.read.text(path).select(_fields().alias("f"))
    if strict:
        rows = lines.where(~F.get("f", F.lit(0)).rlike(r"\A(#.*)?\z") & (F.array_join("f", "\t") != "id\ttokens"))
        again = F.count("*").over(Window.partitionBy(F.get("f", F.lit(0)))) > 1
        tokens_of = F.split(F.trim(F.get("f", F.lit(1))), r"\s+")
        fault = F.when((F.size("f") != 2) | F.exists("f", lambda x: x == ""), "columns").when(F.size(tokens_of) < 2, "too few tokens").when(F.col("again"), F.concat(F.lit("duplicate id "), F.get("f", F.lit(0))))
        good = _held(rows.withColumn("again", again), fault, "a case")
        tokens = good.select(F.get("f", F.lit(0)).alias("id"), F.posexplode(tokens_of).alias("pos", "text"))
        known = best_by_text(words).select("text", F.lit(True).alias("known"))
        return authored(_held(tokens.join(known, "text", "left"), F.when(F.col("known").isNull(), F.concat(F.lit("unknown token "), "text")), "a case").drop("known"), best_by_text(words))
    lines = lines.where(F.size("f") == 2)
    tokens = lines.select(F.get("f", F.lit(0)).alias("id"), F.posexplode(F.split(F.get("f", F.lit(1)), " ")).alias("pos", "text"))
    return authored(tokens, best_by_text(words))


def authored(tokens: DataFrame, best: DataFrame) -> DataFrame:
    """First keys and text of token rows (id, pos, text) whose tokens are all words."""
    joined = tokens.join(best.select("text", codec.all_short(F.col("codes")).alias("short")), "text", "left")
    parts = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "short", "text"))).alias("p"), F.count_if(F.col("short").isNull()).alias("unknown"), F.count("*").alias("n"))
    return parts.where("unknown = 0 and n > 1").select("id", F.array_join(F.transform("p", lambda x: x["short"]), "").alias("observed"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("expected"))


def _hex(text: Column) -> Column:
    return F.coalesce(F.hex(F.encode(text, "UTF-8")), F.lit("-"))


def _unhex(text: Column) -> Column:
    return F.when(text != "-", F.decode(F.unhex(text), "UTF-8"))


def write_capsule(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, capsule): the events of each key in order as one text of lines, texts in hexadecimal UTF-8."""
    c = F.col("change")
    line = F.concat_ws(
        "\t", F.col("pos").cast("string"), F.col("elapsed_ms").cast("string"), "kind", F.coalesce(F.array_join(F.transform("keys", _hex), ","), F.lit("-")), F.coalesce(F.col("keys_complete").cast("string"), F.lit("-")),
        _hex(F.col("composition")), F.coalesce(c["start"].cast("string"), F.lit("-")), _hex(c["deleted"]), _hex(c["inserted"]), F.coalesce(c["evidence"], F.lit("-")),
    )
    own = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "event_id", line.alias("line")))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return own.select(*keys, F.concat(F.lit(f"{CAPSULE_SCHEMA}\nevents="), F.size("rows").cast("string"), F.lit("\n"), lines, F.lit("\nend")).alias("capsule"))


def read_capsule(capsules: DataFrame, *keys: str) -> DataFrame:
    """The events of capsules; raises if the schema, the number of events or the end is not as written."""
    lines = F.split("capsule", "\n", -1)
    n = F.size(lines)
    good = (F.get(lines, F.lit(0)) == CAPSULE_SCHEMA) & (F.get(lines, F.lit(1)) == F.concat(F.lit("events="), (n - 3).cast("string"))) & (F.get(lines, n - 1) == "end") & (n > 3)
    checked = capsules.withColumn("ok", F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("a capsule breaks the format")).cast("boolean"))).where("ok")
    rows = checked.select(*keys, F.explode(F.slice(lines, F.lit(3), n - 3)).alias("line")).select(*keys, F.split("line", "\t", -1).alias("f"))
    g = lambda i: F.get("f", F.lit(i))
    some = lambda i: F.when(g(i) != "-", g(i))
    typed = F.when(g(3) != "-", F.transform(F.filter(F.split(g(3), ","), lambda k: k != ""), _unhex))
    return rows.select(*keys, g(0).cast("int").alias("pos"), g(1).cast("bigint").alias("elapsed_ms"), g(2).alias("kind"), typed.alias("keys"), some(4).cast("boolean").alias("keys_complete"), _unhex(g(5)).alias("composition"), F.struct(some(6).cast("int").alias("start"), _unhex(g(7)).alias("deleted"), _unhex(g(8)).alias("inserted"), some(9).alias("evidence")).alias("change"))


def manifest(values: dict[str, Column]) -> Column:
    """Lines key=value in the fixed order of fields."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), values[k].cast("string")) for k in MANIFEST_FIELDS))


def parse_manifest(text: Column) -> Column:
    """A struct of the fields, null if a line is missing, unknown or out of order."""
    lines = F.split(text, "\n", -1)
    keys = F.array_join(F.transform(lines, lambda x: F.substring_index(x, "=", 1)), ",")
    values = F.struct(*(F.regexp_extract(F.get(lines, F.lit(i)), "^[^=]*=(.*)$", 1).alias(k) for i, k in enumerate(MANIFEST_FIELDS)))
    return F.when(keys == ",".join(MANIFEST_FIELDS), values)
