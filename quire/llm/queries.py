"""Queries of the text problems, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import descan, encode, leak, oracle, quality, split, truncate
from quire.operators.diff import latest_version
from quire.session import table


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's repaired text and the noise undone."""
    return descan.repair(table(spark, sf_dir, "page_texts"), table(spark, sf_dir, "common_words"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = p1_pages(spark, sf_dir)
    return pages.select("page_id", F.explode("kinds").alias("kind"))


def p3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every page."""
    return quality.statistics(table(spark, sf_dir, "page_texts"), "page_id", "content", table(spark, sf_dir, "common_words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_stats(spark, sf_dir).where("kind <> 'prose' and page_id is not null").select("page_id", "kind")


def p4_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut region with the reason it counts as cut."""
    return truncate.truncated(table(spark, sf_dir, "regions")).where("cut").select("region_id", "source", "label", "reason")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncate.truncated(table(spark, sf_dir, "regions")).where("cut").select("region_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncate.truncation_rates(table(spark, sf_dir, "regions"))


def p4_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden field limit of each source that has one."""
    rows = truncate.features(table(spark, sf_dir, "regions"))
    return truncate.field_limits(latest_version(rows, ["region_id"], ["ingested_at"]))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that an alignment around rare seeds finds to have leaked, edited or not."""
    return _leaks(spark, sf_dir).where("leaked")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs found by alignment; that they share a run is checked exactly after it."""
    return p7_pairs(spark, sf_dir).where(f"run_words >= {leak.RUN}").select("doc_id", "item_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_long(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_long(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False)
    return pieces.where("piece = 0").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_pages": p1_pages, "p3_found": p3_found, "p3_stats": p3_stats, "p4_found": p4_found, "p4_cuts": p4_cuts, "p4_rates": p4_rates, "p4_limits": p4_limits, "p6_ids": p6_ids, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_found": p8_found, "p8_pieces": p8_pieces}
SQL: dict[str, str] = oracle.SQL
