"""Queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import map_to_canonical
from .common import load
from .encoding import encode_corpus
from .leakage import leaked_items
from .markup import convert_pages
from .similar_vectors import similar_vectors
from .splitting import split_pages
from .term_counts import concept_counts
from .truncation import cut_shares, examined_texts


def _threshold(spark: SparkSession, d: str) -> float:
    row = load(spark, d, "search_config").select("generic_concept_threshold").first()  # one row of settings
    return float(row[0]) if row and row[0] is not None else 1.0


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors(load(spark, d, "concept_vectors"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("left_row_idx", "right_row_idx")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every page with its markers; a page delivered twice counts once."""
    once = load(spark, d, "pages").select("paper_id", "page", "text").dropDuplicates(["paper_id", "page"])
    return convert_pages(once).select("paper_id", "page", "clean", "markers")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return convert_pages(load(spark, d, "pages")).select("paper_id", "page", F.explode("families").alias("family")).distinct()


def p3_mapped(spark: SparkSession, d: str) -> DataFrame:
    return map_to_canonical(load(spark, d, "extracted_concepts"), load(spark, d, "normalized_concepts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_mapped(spark, d).select("paper_id", "local_id", "concept_id")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return concept_counts(load(spark, d, "paper_concepts"), load(spark, d, "concepts"), load(spark, d, "papers"), _threshold(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_counts(spark, d).where("mark is not null").select("concept_id", "mark")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """One row per piece of every listed page; a page delivered twice counts once."""
    once = load(spark, d, "pages").select("paper_id", "page", "text").dropDuplicates(["paper_id", "page"])
    cut = split_pages(once, load(spark, d, "index_manifests"))
    return cut.select("paper_id", "page", F.posexplode("pieces").alias("piece", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cut = split_pages(load(spark, d, "pages"), load(spark, d, "index_manifests"))
    return cut.where(F.size("pieces") > 1).select("paper_id", "page").distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(load(spark, d, "documents"), load(spark, d, "heldout_passages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).where("share >= 0.5").select("doc_id", "item_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return cut_shares(examined_texts(load(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return examined_texts(load(spark, d, "documents")).where("cut").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_pairs, p1_found, p2_clean, p2_found, p3_mapped, p3_found, p4_counts, p4_found, p5_pieces, p5_found, p6_ids, p7_matches, p7_found, p8_shares, p8_found)}
