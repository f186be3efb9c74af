"""The knowledge graph as four DataFrames: local ids become slugs, edges collapse, quotes are united."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GraphError(ValueError):
    """The graph can't be built; rows names the first of what is wrong, total counts it all."""

    def __init__(self, message: str, rows: list, total: int | None = None):
        self.rows, self.total = rows, len(rows) if total is None else total
        super().__init__(f"{message}: {', '.join(map(str, rows[:5]))}" + (f" and {self.total - 5} more" if self.total > 5 else ""))


@dataclass(frozen=True)
class Graph:
    """papers(paper_id, corpus_pos), concepts, paper_concepts, concept_relations."""

    papers: DataFrame
    concepts: DataFrame
    paper_concepts: DataFrame
    concept_relations: DataFrame


def slug_bridge(concepts: DataFrame) -> DataFrame:
    """(paper_id, local_id, concept_id): which slug each local concept was merged into."""
    return concepts.select(F.col("id").alias("concept_id"), F.explode("merged_from").alias("r")).select("r.paper_id", "r.local_id", "concept_id")


def concept_nodes(concepts: DataFrame) -> DataFrame:
    """The concepts with paper_count: distinct papers they were merged from, exactly."""
    # an array function, as merged_from lies in the row: no shuffle
    papers = F.array_distinct(F.transform(F.coalesce("merged_from", F.array().cast("array<struct<paper_id:bigint,local_id:string>>")), lambda r: r["paper_id"]))
    return concepts.select("id", "canonical_name", "type", "aliases", "description", F.size(papers).alias("paper_count"))


def document_frequency(concepts: DataFrame, n_papers: int | Column) -> DataFrame:
    """Adds document_frequency; 0 in a corpus without papers."""
    n = F.lit(n_papers) if isinstance(n_papers, int) else n_papers
    return concepts.withColumn("document_frequency", F.when(n > 0, F.col("paper_count") / n).otherwise(F.lit(0.0)))


def with_slugs(edges: DataFrame, bridge: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replaces local ids by slugs; columns maps each local column to its slug column. An unmapped id gives null."""
    out = edges
    for local, slug in columns.items():
        to = bridge.select("paper_id", F.col("local_id").alias(local), F.col("concept_id").alias(slug + "_new"))
        out = out.join(to, ["paper_id", local], "left").drop(local).withColumnRenamed(slug + "_new", slug)
    return out


def collapse_edges(edges: DataFrame, keys: list[str], evidence: str = "evidence", position: str = "edge_pos") -> DataFrame:
    """One edge per key with the distinct evidence of all, in order of first occurrence.

    An edge without evidence keeps an empty list. Each distinct quote is found by a group of its own before the
    lists are gathered, so that an edge repeated a million times gathers each quote once.
    """
    rows = edges.select(*keys, position, F.posexplode_outer(evidence).alias("evidence_pos", "e"))
    once = rows.groupBy(*keys, "e").agg(F.min(F.struct(position, "evidence_pos")).alias("at"))
    gathered = once.groupBy(*keys).agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("at", "e")))).alias("found"))
    return gathered.select(*keys, F.transform("found", lambda x: x["e"]).alias(evidence), F.col(f"first.{position}").alias(position))


def unstated_general_edges(general: DataFrame, stated: DataFrame) -> DataFrame:
    """General-knowledge edges that no paper states with the same ends, direction and relation."""
    keys = ["source_id", "target_id", "relation"]
    return general.join(stated.select(*keys).distinct(), keys, "left_anti")


def stated_relations(relations: DataFrame, bridge: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, paper_ids, first_pos): what papers state, in slugs.

    Relations of unmapped concepts and of a concept with itself are passed over; paper_ids are sorted.
    """
    slugged = with_slugs(relations, bridge, {"source_local": "source_id", "target_local": "target_id"})
    kept = slugged.where("source_id is not null and target_id is not null and source_id <> target_id")
    return kept.groupBy("source_id", "target_id", "relation").agg(F.array_sort(F.collect_set("paper_id")).alias("paper_ids"), F.min("edge_pos").alias("first_pos"))


def build_graph(
    papers: DataFrame, concepts: DataFrame, paper_concepts: DataFrame, concept_relations: DataFrame, general: DataFrame, chunk_evidence: DataFrame, bridge: DataFrame | None = None,
) -> Graph:
    """papers: paper_id, corpus_pos. paper_concepts: paper_id, local_id, relation, evidence, edge_pos.
    concept_relations: paper_id, source_local, target_local, relation, evidence, edge_pos. general: source_id,
    target_id, relation, rationale. chunk_evidence: paper_id, page, quote, chunk_id. With a bridge (paper_id,
    local_id, concept_id; see slug_bridge) of its own, concepts are the nodes as they are.

    Raises GraphError for a local concept without slug and for a quote without chunk.
    """
    nodes = concepts if bridge is not None else concept_nodes(concepts)
    bridge = slug_bridge(concepts) if bridge is None else bridge
    edges = with_slugs(paper_concepts, bridge, {"local_id": "concept_id"})
    relations = with_slugs(concept_relations, bridge, {"source_local": "source_id", "target_local": "target_id"})
    lost = edges.where("concept_id is null").select("paper_id", "relation").unionByName(relations.where("source_id is null or target_id is null").select("paper_id", "relation"))
    if rows := lost.orderBy("paper_id", "relation").limit(20).collect():
        raise GraphError("edges of concepts that are in no normalized concept", [tuple(r) for r in rows], lost.count())
    kept = relations.where("source_id <> target_id")
    node_edges = collapse_edges(_with_chunks(edges, chunk_evidence), ["paper_id", "concept_id", "relation"])
    stated = collapse_edges(_with_chunks(kept, chunk_evidence), ["source_id", "target_id", "relation", "paper_id"])
    paper_origin = stated.select("source_id", "target_id", "relation", F.lit("paper").alias("origin"), "paper_id", "evidence", F.lit(None).cast("string").alias("rationale"))
    added = unstated_general_edges(general, stated).select(
        "source_id", "target_id", "relation", F.lit("general_knowledge").alias("origin"), F.lit(None).cast("bigint").alias("paper_id"), F.lit(None).cast(stated.schema["evidence"].dataType).alias("evidence"), "rationale"
    )
    empty = F.array().cast(stated.schema["evidence"].dataType)
    return Graph(papers, nodes, node_edges.drop("edge_pos"), paper_origin.unionByName(added).withColumn("evidence", F.coalesce("evidence", empty)))


def _with_chunks(edges: DataFrame, chunk_evidence: DataFrame) -> DataFrame:
    """The edges with chunk ids in their evidence; a quote without chunk is an error."""
    keys = [c for c in edges.columns if c not in ("evidence",)]
    rows = edges.select(*keys, F.posexplode_outer("evidence").alias("n", "e")).select(*keys, "n", "e.page", "e.quote")
    joined = rows.join(chunk_evidence.select("paper_id", "page", "quote", "chunk_id"), ["paper_id", "page", "quote"], "left")
    lost = joined.where("chunk_id is null and n is not null").select("paper_id", "page", "quote")
    if rows := lost.orderBy("paper_id", "page", "quote").limit(20).collect():
        raise GraphError("quotes without chunk", [tuple(r) for r in rows], lost.count())
    return joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", F.struct("page", "quote", "chunk_id").alias("e"))))).alias("x")).select(*keys, F.transform("x", lambda v: v["e"]).alias("evidence"))


def graph_edges(graph: Graph) -> DataFrame:
    """The multigraph view: (source, target, key, relation), papers as paper:ID; parallel edges have different keys."""
    a = graph.paper_concepts.select(F.concat(F.lit("paper:"), F.col("paper_id").cast("string")).alias("source"), F.col("concept_id").alias("target"), F.col("relation").alias("key"), "relation")
    b = graph.concept_relations.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.concat_ws(":", "relation", "origin", F.col("paper_id").cast("string")).alias("key"), "relation")
    return a.unionByName(b)
