"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweir.llm import bpe, forms, overlap, packing, stripes, subjects, terms
from glyphweir.llm.statements import SQL
from glyphweir.sources.tables import table

__all__ = ["QUERIES", "SQL"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    overlay = table(spark, folder, "technical_overlay").select("package_id", F.col("entry_id").alias("id"), "text")
    events = table(spark, folder, "capsule_events")
    at = ["session_id", "segment_seq", "start"]

    def side(name: str) -> DataFrame:
        return events.select("session_id", "segment_seq", F.col("change.start").alias("start"), F.col("event_id").alias("id"), F.col(f"change.{name}").alias("text"))

    entries = forms.alike_pairs(overlay, None, ["package_id"]).select(F.lit("overlay_text").alias("kind"), "low_id", "high_id")
    return entries.unionByName(forms.alike_pairs(side("inserted"), side("deleted"), at).select(F.lit("delta_text").alias("kind"), "low_id", "high_id"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Of each kind of text, how many distinct ones there are as stored and in their one form."""
    overlay = table(spark, folder, "technical_overlay").select(F.lit("overlay_text").alias("kind"), "text")
    events = table(spark, folder, "capsule_events")
    texts = [overlay, *(events.select(F.lit(f"delta_{c}").alias("kind"), F.col(f"change.{c}").alias("text")) for c in ("inserted", "deleted"))]
    all_texts = texts[0].unionByName(texts[1]).unionByName(texts[2]).where("text <> ''").distinct()
    unified = forms.one_form(all_texts, {"text": "form"})
    changed = F.sum((F.col("form") != F.col("text")).cast("bigint"))
    return unified.groupBy("kind").agg(F.count("*").alias("n_texts"), F.count_distinct("form").alias("n_forms"), changed.alias("n_changed"))


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    ud = table(spark, folder, "ud_sentences")
    return ud.select("id", "split", "source", overlap.sentence_string(F.col("tokens")).alias("string"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.cross_split(_sentences(spark, folder))
    return pairs.select(F.least("train_id", "other_id").alias("low_id"), F.greatest("train_id", "other_id").alias("high_id")).distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source: sentences, those found in train, pairs, exact ones, pairs that content-defined chunks find without
    the exact way, and the mean shared fraction."""
    records = _sentences(spark, folder)
    pairs = overlap.cross_split(records)
    best = pairs.groupBy("other_id").agg(F.count("*").alias("pairs"), F.min("distance").alias("distance"), F.max("fraction").alias("fraction"), F.count_if("by_content").alias("by_content"))
    held = records.where("split <> 'train' and id is not null").select("id", "split", "source").distinct()
    joined = held.join(best.withColumnRenamed("other_id", "id"), "id", "left")
    return joined.groupBy("split", F.coalesce("source", F.lit("(none)")).alias("source")).agg(
        F.count("*").alias("n_sentences"),
        F.count("pairs").alias("n_overlapping"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
        F.sum((F.coalesce("distance", F.lit(1)) == 0).cast("bigint")).alias("n_exact"),
        F.coalesce(F.sum("by_content"), F.lit(0)).alias("n_by_content"),
        F.round(F.avg("fraction"), 3).alias("mean_fraction"),
    )


def _term_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records (field, terms, times) of every field, and how many records each field has."""
    none = F.lit(None).cast("array<bigint>")
    ud = table(spark, folder, "ud_sentences").where("id is not null").select("id", F.col("tokens.form").alias("terms")).distinct()
    overlay = table(spark, folder, "technical_overlay").where("package_id is not null and entry_id is not null")
    texts = overlay.select("package_id", "entry_id", "text").distinct().groupBy("package_id", "text").agg(F.count("*").alias("n"))
    words = table(spark, folder, "personal_word_counts").where("session_id is not null")
    cached = words.select("session_id", "word", "n").distinct().groupBy("session_id", "word").agg(F.sum("n").alias("n"))
    rows = [ud.select(F.lit("ud_form").alias("field"), "terms", none.alias("times"))]
    rows += [df.select(F.lit(name).alias("field"), F.array(term).alias("terms"), F.array("n").alias("times")) for df, name, term in ((texts, "overlay_text", "text"), (cached, "personal_word", "word"))]
    ids = [(table(spark, folder, "ud_sentences"), "id", "ud_form"), (overlay, "package_id", "overlay_text"), (words, "session_id", "personal_word")]
    totals = [df.agg(F.count_distinct(key).alias("total")).select(F.lit(name).alias("field"), "total") for df, key, name in ids]
    union = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union(rows), union(totals)


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    records, totals = _term_records(spark, folder)
    return terms.mark_terms(terms.record_counts(records), totals).select("field", "term", "occurrences", "records", "mark")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_counts(spark, folder).where("mark is not null").select("field", "term", "mark")


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    spoken = F.filter("tokens", lambda t: t["upos"].isNull() | (t["upos"] != "PUNCT"))
    return table(spark, folder, "ud_sentences").where("id is not null").select("id", F.transform(spoken, lambda t: t["form"]).alias("items")).distinct()


def _transitions(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "personal_pair_counts")
    return pairs.select(F.col("session_id").alias("record"), F.col("previous_word").alias("first"), F.col("current_word").alias("second"), "n").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs asked for. All are significant: with k expected E times, the ratio is 2 (k ln(k / E) - k + E) at least, which
    for k >= 3 and k >= 8 E is more than 7.2, so the bound of SIGNIFICANT leaves none out."""
    sentences = stripes.basket_pairs(_baskets(spark, folder), 4, 8, stripes.SIGNIFICANT)
    personal = stripes.weighted_pairs(_transitions(spark, folder), 3, 8, stripes.SIGNIFICANT)
    return sentences.select(F.lit("sentence").alias("kind"), "low_item", "high_item").unionByName(personal.select(F.lit("personal_pair").alias("kind"), "low_item", "high_item"))


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of either kind with its counts, lift, likelihood ratio and whether that is significant."""
    own = ["low_item", "high_item", "together", "records", "a", "b", F.round("lift", 4).alias("lift"), F.round("likelihood_ratio", 2).alias("likelihood_ratio"), (F.col("likelihood_ratio") >= stripes.SIGNIFICANT).alias("significant")]
    sentences = stripes.basket_pairs(_baskets(spark, folder)).select(F.lit("sentence").alias("kind"), *own)
    return sentences.unionByName(stripes.weighted_pairs(_transitions(spark, folder)).select(F.lit("personal_pair").alias("kind"), *own))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    sizes = bpe.token_ids(documents, lengths=True)
    return packing.fill_containers(sizes, table(spark, folder, "pack_profiles"), "doc_id", "n_tokens", documents.count())


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, folder), table(spark, folder, "pack_profiles"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, known = table(spark, folder, "documents"), table(spark, folder, "subjects").select("subject")
    rules = subjects.fit(documents, table(spark, folder, "subject_labels").join(F.broadcast(known), "subject", "left_semi"))
    return subjects.classify(documents, rules)


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each subject, and their share of all documents that have one."""
    found = p9_found(spark, folder)
    share = F.col("n_documents") / F.sum("n_documents").over(Window.partitionBy())
    return found.groupBy("subject").agg(F.count("*").alias("n_documents")).withColumn("share", F.round(share, 4))


QUERIES = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
