"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeweave.llm import boilerplate, canonical, mixing, near_duplicates, packing, repeated_lines, residue, tokens, truncation
from noticeweave.session import stored, table


def marked_subsidies(subsidies: DataFrame, keep: tuple = ()) -> DataFrame:
    """Contents of the catalogue with their lines marked: ``(key, plain, codes)``."""
    name = F.coalesce(F.nullif("program_name", F.lit("")), F.get(F.split("dedupe_key", r"\|"), F.lit(2)))
    return boilerplate.marked_pages(subsidies, "id", "official_url", "content", "agency", "title", name, keep)


def comparable_subsidies(spark: SparkSession, d: str) -> DataFrame:
    """``(id, year, batch, text)``: the notices' own text as P1 compares it."""
    marked = marked_subsidies(table(spark, d, "subsidies"), ("dedupe_key",))
    year, batch = near_duplicates.key_parts(F.col("dedupe_key"))
    return near_duplicates.comparable_texts(marked.withColumn("year", year).withColumn("batch", batch))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(comparable_subsidies(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its group, the copies of its text and the number of other texts linked to it."""
    return near_duplicates.near_duplicate_groups(comparable_subsidies(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(marked_subsidies(table(spark, d, "subsidies"))).withColumnRenamed("key", "id")


def p2_contents(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "subsidies")
    out = boilerplate.main_text(s, "id", "content", boilerplate.furniture_lines(marked_subsidies(s)))
    return out.select(F.col("key").alias("id"), F.col("text").alias("content"), "n_removed")


def p4_titles(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_titles(truncation.title_rows(table(spark, d, "crawl_urls"), table(spark, d, "subsidies")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_titles(spark, d).where("truncated").select("tab", "rec_key").distinct()


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(p4_titles(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = repeated_lines.excessive_occurrences(table(spark, d, "subsidies"), "id", "agency", "content")
    return found.select(F.col("key").alias("id"), "line_no").distinct()


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    found = repeated_lines.repeated_line_report(table(spark, d, "subsidies"), "id", "agency", "content")
    return found.withColumnRenamed("source", "agency")


def p5_contents(spark: SparkSession, d: str) -> DataFrame:
    out = repeated_lines.without_repeated_lines(table(spark, d, "subsidies"), "id", "agency", "content")
    return out.select(F.col("key").alias("id"), F.col("text").alias("content"), "n_removed")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_found(table(spark, d, "subsidies"), "id", ["title", "content"]).withColumnRenamed("key", "id")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, d, "subsidies").select("id", "title", "content"), "id", ["title", "content"])


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, source, n_tokens)``, tokenised once."""
    return stored(tokens.with_sizes(table(spark, d, "documents"), "text", ["doc_id", "source"]))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(document_sizes(spark, d), "doc_id", table(spark, d, "token_budgets"))
    return packed.withColumnRenamed("key", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(p7_containers(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    drawn = mixing.draw_mix(document_sizes(spark, d), "doc_id", "source", table(spark, d, "mix_targets"))
    return drawn.withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = document_sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.draw_mix(sizes, "doc_id", "source", targets), mixing.plan_mix(sizes, "source", targets))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"), "doc_id", "text", "url", "source").withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_documents(spark, d).where("residue").select("doc_id").distinct()


def p9_usable(spark: SparkSession, d: str) -> DataFrame:
    """The documents without residue, as they are."""
    docs = table(spark, d, "documents")
    bad = p9_documents(spark, d).where("residue").select("doc_id").distinct()
    return docs.where("text is not null").join(bad, "doc_id", "left_anti").select("doc_id", "text", "lang", "source")


def p9_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validation(table(spark, d, "documents"), "doc_id", "text", "url", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit()}
