"""Queries on the project's tables for the problems of training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import table
from .canon import map_values, unmatched
from .frequency import value_frequencies
from .garbled import find_garbled
from .leakage import find_leaks, leaked_items, remove_leaks
from .packing import container_fill, pack_texts
from .splitting import split_texts
from .tokens import WORDS

COUNTED = ["culture", "classification", "period"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_restored(spark, d).select("row_id", "field_name")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "paper_corpus"), "row_id", ["title", "description", "culture"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_mapped(spark, d).select("row_id", "field_name", "entry_id")


def p5_mapped(spark: SparkSession, d: str) -> DataFrame:
    return map_values(table(spark, d, "paper_corpus"), table(spark, d, "canonical_terms"), "row_id", ["culture", "material", "technique", "object_type"])


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched(p5_mapped(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_value_frequencies(spark, d).filter(F.col("mark").isNotNull()).select("field_name", "value_text", "mark")


def p7_value_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return value_frequencies(table(spark, d, "paper_corpus"), COUNTED, "item_id")


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_container_fill(spark: SparkSession, d: str) -> DataFrame:
    return container_fill(p8_assignments(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(p9_stretches(spark, d), "doc_id", "item_id")


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


def p9_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return remove_leaks(table(spark, d, "documents"), p9_stretches(spark, d), "doc_id").select("doc_id", "text", "removed_spans")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_texts(table(spark, d, "documents"), "doc_id", "text", ranks=WORDS, with_text=False)
    return pieces.filter(F.col("piece") == 1).select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), "doc_id", "text")


# ---- properties of the results that SQL can state as well, over whole tables


def p3_properties(spark: SparkSession, d: str) -> DataFrame:
    """By field: values with a lost character, those of them that are reported, reported values without any character beyond ASCII, and reported twice."""
    fields = ["title", "description", "culture"]
    long = table(spark, d, "paper_corpus").select("row_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])))
    found = p3_found(spark, d).groupBy("row_id", "field_name").agg(F.count(F.lit(1)).alias("n"))
    lost, ascii_only = F.col("value").contains("\ufffd"), F.col("value").rlike(r"^[\x00-\x7f]*$")
    return long.join(found, ["row_id", "field_name"], "left").groupBy("field_name").agg(
        F.count(F.when(lost, 1)).alias("with_lost"),
        F.count(F.when(lost & (F.col("n") > 0), 1)).alias("lost_reported"),
        F.count(F.when(ascii_only & (F.col("n") > 0), 1)).alias("ascii_reported"),
        F.count(F.when(F.col("n") > 1, 1)).alias("reported_twice"),
    )


def p5_properties(spark: SparkSession, d: str) -> DataFrame:
    """By field: values that are no label, rows of the mapping, values that are a label but for capitals, and those of them mapped to its entry."""
    mapped, terms = p5_mapped(spark, d), table(spark, d, "canonical_terms")
    folded = terms.groupBy("field_name", F.lower("label").alias("folded")).agg(F.min("entry_id").alias("want"))
    met = mapped.join(folded, (mapped.field_name == folded.field_name) & (F.lower("value_text") == F.col("folded")), "left").select(mapped.field_name, "entry_id", "want")
    return met.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("want").alias("but_for_case"), F.count(F.when(F.col("entry_id") == F.col("want"), 1)).alias("mapped_right")
    )


def p8_properties(spark: SparkSession, d: str) -> DataFrame:
    """Documents, documents placed, containers over the capacity, overlapping pieces, and documents divided although they fit."""
    a = p8_assignments(spark, d)
    fill = a.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("container_start") + F.col("n_tokens")).alias("end"))
    texts = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    kinds = fill.select(F.lit("container").alias("what"), F.lit(1).alias("pieces"), "tokens", "end").unionByName(texts.select(F.lit("text").alias("what"), "pieces", "tokens", F.lit(0).alias("end")))
    box, text = F.col("what") == "container", F.col("what") == "text"
    return kinds.agg(
        F.count(F.when(text, 1)).alias("placed"),
        F.count(F.when(box & (F.col("tokens") > 2048), 1)).alias("over_capacity"),
        F.count(F.when(box & (F.col("end") != F.col("tokens")), 1)).alias("overlapping"),
        F.count(F.when(text & (F.col("pieces") > 1) & (F.col("tokens") <= 2048), 1)).alias("divided_but_fitting"),
    )


def p9_properties(spark: SparkSession, d: str) -> DataFrame:
    """Documents kept when leaks are cut out, those whose text changed without a cut, and those whose text grew."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("before"))
    both = p9_clean_documents(spark, d).join(texts, F.col("doc_id") == F.col("id"))
    return both.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count(F.when((F.col("removed_spans") == 0) & ~F.col("text").eqNullSafe(F.col("before")), 1)).alias("changed_without_cut"),
        F.count(F.when((F.col("removed_spans") > 0) & (F.length("text") >= F.length("before")), 1)).alias("grown"),
    )


def p10_properties(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut (words and signs as tokens), pieces over the limit, with another text than their places, gaps between pieces, repeats of another size, texts not wholly covered."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    order = W.partitionBy("doc_id").orderBy("piece")  # the pieces of one text
    p = split_texts(table(spark, d, "documents"), "doc_id", "text", ranks=WORDS).join(docs, F.col("doc_id") == F.col("id"))
    p = p.withColumns({"before_end": F.lag("end_char").over(order), "next": F.lead("piece").over(order)})
    first, n = F.col("piece") == 1, lambda c: F.count(F.when(c, 1))
    return p.agg(
        n(first).alias("texts"),
        n(F.col("n_tokens") > 1000).alias("over_limit"),
        n(F.col("piece_text") != F.expr("substring(text, CAST(start_char + 1 AS INT), CAST(end_char - start_char AS INT))")).alias("other_text"),
        n(F.col("start_char") > F.col("before_end")).alias("gaps"),
        n(~first & (F.col("n_repeated") != 100)).alias("other_repeats"),
        n(F.col("next").isNull() & (F.col("end_char") != F.length("text")) | first & (F.col("start_char") != 0)).alias("uncovered"),
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p5_found, p5_mapped, p5_unmatched, p7_found, p7_value_frequencies, p8_assignments, p8_container_fill, p9_found, p9_stretches, p9_clean_documents, p10_found, p10_pieces, p3_properties, p5_properties, p8_properties, p9_properties, p10_properties)}
