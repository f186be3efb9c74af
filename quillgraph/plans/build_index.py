"""Builds the whole index of a corpus; every check reports all its findings before anything is written."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedders import Embedder, embedded
from ..operators.chunking import DEFAULT_MAX_TOKENS, Tokenizer, chunk_pages
from ..operators.evidence import check_extractions, exploded_evidence, resolve_evidence
from ..operators.graph import build_graph
from ..operators.items import embedding_items, numbered
from ..operators.merging import check_normalization
from ..sources import corpus, index_store
from ..sources.folders import shared_folder, written


class Rejected(ValueError):
    """The input can't be built on; reason is a code, rows are the findings, all of them or the first of total."""

    def __init__(self, reason: str, rows: list[dict]):
        self.reason, self.rows = reason, rows
        self.total, self.table = getattr(rows, "total", len(rows)), getattr(rows, "table", None)
        super().__init__(f"{reason}: {self.total} findings" + (f", all in {self.table}" if self.table else ""))


class MissingExtractions(ValueError):
    def __init__(self, paper_ids: list[int]):
        super().__init__(f"papers without extraction: {', '.join(map(str, paper_ids))}")
        self.paper_ids = paper_ids


@dataclass(frozen=True)
class Corpus:
    ledger: DataFrame
    meta: DataFrame
    pages: DataFrame
    extractions: dict[str, DataFrame]


def read_corpus(spark: SparkSession, data_dir: str) -> Corpus:
    """Ledger, papers and extractions; all papers without extraction are reported."""
    ledger = corpus.paper_ledger(spark, data_dir)
    if not ledger.take(1):
        raise ValueError("no papers in the index")
    meta, pages = corpus.papers(spark, data_dir)
    listed = ledger.select("paper_id")
    try:
        rows = corpus.extraction_rows(spark, data_dir, listed)
    except corpus.NotFound:
        raise MissingExtractions([r[0] for r in ledger.orderBy("corpus_pos").select("paper_id").collect()]) from None
    if lost := corpus.missing_extractions(ledger, rows):
        raise MissingExtractions(lost)
    return Corpus(ledger, meta, pages.join(listed, "paper_id", "left_semi"), corpus.flatten_extractions(rows))


class Findings(list):
    """The findings a report names; total counts all of them, and table has them all where there are more than named."""

    def __init__(self, rows: Iterable[dict] = (), total: int | None = None, table: str | None = None):
        super().__init__(rows)
        self.total, self.table = len(self) if total is None else total, table

    def each(self, f: Callable[[dict], dict]) -> Findings:
        """The findings in another form, with the same total."""
        return Findings(map(f, self), self.total, self.table)

    def __add__(self, other: list[dict]) -> Findings:
        tables = [t for t in (self.table, getattr(other, "table", None)) if t]
        return Findings([*self, *other], self.total + getattr(other, "total", len(other)), ", ".join(tables) or None)


def findings(df: DataFrame, most: int = 10_000) -> Findings:
    """Findings for a report. Of more than `most` the report names the first by their columns, and all are written to a table."""
    rows = df.limit(most + 1).collect()
    if len(rows) <= most:
        return Findings(r.asDict(recursive=True) for r in rows)
    path = shared_folder(df.sparkSession, "findings")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return Findings((r.asDict(recursive=True) for r in kept.orderBy(*kept.columns).limit(most).collect()), kept.count(), path)


def build_index(spark: SparkSession, data_dir: str, embedder: Embedder, max_tokens: int = DEFAULT_MAX_TOKENS, tokenizer: Tokenizer | None = None) -> dict[str, int]:
    """Reads the corpus, checks extractions and vocabulary, chunks, resolves quotes, embeds, joins, writes.

    Raises MissingExtractions, Rejected (extraction_mismatch, normalization_mismatch, unresolved_evidence) or a
    SourceError. Returns the counts of what was written.
    """
    c = read_corpus(spark, data_dir)
    counts = c.meta.select(F.col("id").alias("paper_id"), "page_count")
    if rows := findings(check_extractions(c.extractions, c.pages, counts)):
        raise Rejected("extraction_mismatch", rows)
    concepts, general = corpus.normalization(spark, data_dir)
    if rows := findings(check_normalization(concepts, c.extractions["concepts"])):
        raise Rejected("normalization_mismatch", rows)
    chunks = written(chunk_pages(c.pages, max_tokens, tokenizer), "chunks")
    quotes = exploded_evidence(c.extractions["paper_concepts"], "paper_id").unionByName(exploded_evidence(c.extractions["concept_relations"], "paper_id"))
    resolved = written(resolve_evidence(quotes, chunks), "resolved-evidence")
    if rows := findings(resolved.where("chunk_id is null").select("paper_id", "page", "quote").orderBy("paper_id", "page", "quote")):
        raise Rejected("unresolved_evidence", rows)
    order = c.ledger.select("paper_id", "corpus_pos")
    graph = build_graph(order, concepts, c.extractions["paper_concepts"], c.extractions["concept_relations"], general, resolved)
    summaries = c.extractions["papers"].select("paper_id", F.col("summary_ja").alias("text")).join(order, "paper_id")
    items = numbered(embedding_items(chunks.join(order, "paper_id"), summaries, concepts)).withColumn("vector", embedded(F.col("text"), embedder))
    dimension = len(embedder.embed_documents(["dimension"])[0])
    manifest = index_store.Manifest(embedder.model_name, dimension, max_tokens, [r[0] for r in order.orderBy("corpus_pos").collect()])  # the ledger is one file, and so is the manifest
    tables = {"chunks": chunks, "items": items.select("row_idx", "kind", "ref", "paper_id", "text", "vector"), "papers": order, "concepts": graph.concepts, "paper_concepts": graph.paper_concepts, "concept_relations": graph.concept_relations}
    index_store.write_index(spark, data_dir, tables, manifest)
    return index_counts(index_store.read_index(spark, data_dir))


def index_counts(index: index_store.Index) -> dict[str, int]:
    g = index.graph
    return {"papers": len(index.manifest.paper_ids)} | {n: t.count() for n, t in (("chunks", index.chunks), ("items", index.items), ("concepts", g.concepts), ("paper_concepts", g.paper_concepts), ("concept_relations", g.concept_relations))}
