"""Quotes and the text they come from: validation against pages, resolution to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_path, normalize_whitespace


def exploded_evidence(edges: DataFrame, *keys: str, position: str = "edge_pos") -> DataFrame:
    """(keys, edge_pos, evidence_pos, page, quote), one row per quote of each edge."""
    return edges.select(*keys, position, F.posexplode("evidence").alias("evidence_pos", "e")).select(*keys, position, "evidence_pos", "e.page", "e.quote")


def check_evidence(evidence: DataFrame, pages: DataFrame, page_counts: DataFrame, prefix: str | Column = "paper_concepts") -> DataFrame:
    """(paper_id, path, message, edge_pos, evidence_pos) of every quote that isn't in its page.

    evidence: paper_id, edge_pos, evidence_pos, page, quote. A page that isn't there is reported on .page and
    its quote isn't looked for; both sides are compared with white space collapsed, marker lines included. A
    null quote is not found; a page with a null text is there and holds nothing.
    """
    there = pages.select("paper_id", "page", F.lit(True).alias("there"), normalize_whitespace(F.coalesce("text", F.lit(""))).alias("page_text"))
    joined = evidence.join(there, ["paper_id", "page"], "left").join(page_counts.select("paper_id", "page_count"), "paper_id", "left")
    found = F.coalesce(F.col("page_text").contains(normalize_whitespace(F.col("quote"))), F.lit(False))
    base = F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("["), F.col("edge_pos").cast("string"), F.lit("].evidence["), F.col("evidence_pos").cast("string"), F.lit("]"))
    outside = F.col("there").isNull()
    return joined.where(outside | ~found).select(
        "paper_id",
        F.concat(base, F.when(outside, ".page").otherwise(".quote")).alias("path"),
        F.when(outside, F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" is outside 1.."), F.coalesce("page_count", F.lit(0)).cast("string")))
        .otherwise(F.concat(F.lit("is not found in the text of page "), F.col("page").cast("string"))).alias("message"),
        "edge_pos",
        "evidence_pos",
    )


def check_extractions(extractions: dict[str, DataFrame], pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(paper_id, path, message) of every disagreement of the extractions with their pages, in order."""
    out: DataFrame | None = None
    for n, kind in enumerate(("paper_concepts", "concept_relations")):
        issues = check_evidence(exploded_evidence(extractions[kind], "paper_id"), pages, page_counts, kind).withColumn("kind_pos", F.lit(n))
        out = issues if out is None else out.unionByName(issues)
    declared = extractions["papers"].where(~F.col("paper_id").eqNullSafe(F.col("asked_id"))).select(
        F.col("asked_id").alias("paper_id"), error_path("paper_id").alias("path"), F.format_string("is %d, but the paper being checked is %d", "paper_id", "asked_id").alias("message"), F.lit(0).alias("edge_pos"), F.lit(0).alias("evidence_pos"), F.lit(-1).alias("kind_pos")
    )
    return out.unionByName(declared).orderBy("paper_id", "kind_pos", "edge_pos", "evidence_pos").select("paper_id", "path", "message")


def resolve_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, page, quote, chunk_id): each distinct quote with the first chunk of its page that holds it.

    chunk_id is null where none does, as with a quote that straddles a chunk's end; all of these stay in the
    result. White space is collapsed on both sides; a null quote is never found.
    """
    wanted = evidence.select("paper_id", "page", "quote").distinct()
    texts = chunks.select("paper_id", F.explode(F.sequence("page_start", "page_end")).alias("page"), F.col("id").alias("chunk_id"), "idx", normalize_whitespace(F.col("text")).alias("chunk_text"))
    pairs = wanted.withColumn("needle", normalize_whitespace(F.col("quote"))).join(texts, ["paper_id", "page"])
    first = pairs.where(F.col("chunk_text").contains(F.col("needle"))).groupBy("paper_id", "page", "quote").agg(F.min_by("chunk_id", "idx").alias("chunk_id"))
    first = first.select(*[F.col(c).alias(f"f_{c}") for c in ("paper_id", "page", "quote")], "chunk_id")
    same = F.expr("paper_id <=> f_paper_id and page <=> f_page and quote <=> f_quote")
    return wanted.join(first, same, "left").select("paper_id", "page", "quote", "chunk_id")
