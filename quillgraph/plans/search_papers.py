"""Search: vectors find papers directly, the graph finds the papers around them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedders import Embedder
from ..operators.graph import Graph
from ..operators.traversal import NeighborhoodTraversal, SearchConfig, TraversalStrategy, edge_id, graph_candidates, rank_reached, reached_papers
from ..operators.vectors import check_search_inputs, concepts_to_papers, group_hits, paper_hits, top_items
from ..sources import corpus, index_store
from ..sources.folders import written
from ..sources.index_store import Index


class ModelMismatch(ValueError):
    def __init__(self, index_model: str, embedder_model: str):
        super().__init__(f"the index was built with {index_model}, the queries would be embedded with {embedder_model}")
        self.index_model, self.embedder_model = index_model, embedder_model


def check_queries(queries: Sequence[str]) -> None:
    """Before anything is read: at least one query, none blank, none twice."""
    if not queries:
        raise ValueError("queries must not be empty")
    if any(not q.strip() for q in queries):
        raise ValueError("queries must not be blank")
    if len(set(queries)) != len(queries):
        raise ValueError("queries must not repeat")


@dataclass(frozen=True)
class Found:
    """What a search finds, as tables: hits (query_id, kind, ref, text, score, rank, paper_id), direct (paper_id,
    best_score, n_hits), reached (paper_id, n_paths, rank), and the paths of these candidates."""

    hits: DataFrame
    direct: DataFrame
    reached: DataFrame
    paths: DataFrame


def search_tables(graph: Graph, items: DataFrame, top: DataFrame, n_papers: int, config: SearchConfig, strategy: TraversalStrategy | None = None) -> Found:
    """From the top items of each query (query_id, row_idx, score, rank) to the candidates.

    Papers are ranked by counts of their paths; paths are only made for the candidates, whose edges are filtered
    before the last join. A strategy of one's own is ranked over all its paths.
    """
    hits = written(paper_hits(top, items, concepts_to_papers(graph.paper_concepts)), "hits")
    direct = written(hits.groupBy("paper_id").agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_hits")), "direct-papers")
    if strategy is None:
        counted = reached_papers(graph, direct, n_papers, config)
    else:
        walked = strategy.traverse(graph, direct, n_papers, config)
        counted = rank_reached(walked)
    reached = written(graph_candidates(counted, direct, config.max_graph_candidates), "reached-papers")
    wanted = direct.select("paper_id").unionByName(reached.select("paper_id"))
    if strategy is None:
        paths = NeighborhoodTraversal().traverse(graph, direct, n_papers, config, wanted)
    else:
        paths = walked.join(wanted.withColumnRenamed("paper_id", "target_paper_id"), "target_paper_id", "left_semi")
    return Found(hits, direct, reached, paths)


def candidates(found: Found, meta: DataFrame) -> DataFrame:
    """(kind, place, paper_id, best_score, n_paths, meta columns), one row per candidate: direct ones by best score,
    then paper; graph ones by number of paths, then paper. meta: paper_id and what is to be told of it."""
    none = F.lit(None)
    direct = found.direct.select(F.lit("direct").alias("kind"), "paper_id", "best_score", none.cast("bigint").alias("n_paths"), none.cast("int").alias("place"))
    around = found.reached.select(F.lit("graph").alias("kind"), "paper_id", none.cast("double").alias("best_score"), "n_paths", F.col("rank").cast("int").alias("place"))
    return direct.unionByName(around).join(meta, "paper_id", "left")


def _paths_of(paths: DataFrame) -> DataFrame:
    """(paper_id, paths) in a defined order: source, hops, target."""
    p = F.struct("source_paper_id", "source_relation", "visited", "edges", "target_relation", "forward")
    return paths.groupBy(F.col("target_paper_id").alias("paper_id")).agg(F.array_sort(F.collect_list(p)).alias("paths"))


def find(spark: SparkSession, data_dir: str, queries: Sequence[str], embedder: Embedder, config: SearchConfig, strategy: TraversalStrategy | None = None) -> tuple[Index, Found]:
    """The index and what the queries find in it, before anything reaches the driver but the queries' vectors."""
    check_queries(queries)
    index = index_store.read_index(spark, data_dir)
    if index.manifest.embedding_model != embedder.model_name:
        raise ModelMismatch(index.manifest.embedding_model, embedder.model_name)
    vectors = embedder.embed_queries(list(queries))
    check_search_inputs(queries, vectors, config.top_k, index.manifest.embedding_dimension)
    top = written(top_items(index.items, range(len(queries)), vectors, config.top_k), "top-items")
    return index, search_tables(index.graph, index.items, top, len(index.manifest.paper_ids), config, strategy)


def search_to_tables(spark: SparkSession, data_dir: str, queries: Sequence[str], embedder: Embedder, output: str, config: SearchConfig | None = None, strategy: TraversalStrategy | None = None) -> dict[str, str]:
    """Writes candidates, hits and paths as parquet tables below output, for results of any size; their paths by name."""
    _, found = find(spark, data_dir, queries, embedder, config or SearchConfig(), strategy)
    meta = corpus.paper_ledger(spark, data_dir).select("paper_id", "title")
    tables = {"candidates": candidates(found, meta), "hits": found.hits, "paths": found.paths}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{output}/{name}")
    return {name: f"{output}/{name}" for name in tables}


def search(spark: SparkSession, data_dir: str, queries: Sequence[str], embedder: Embedder, config: SearchConfig | None = None, strategy: TraversalStrategy | None = None) -> dict:
    """The result of a search as one document: queries, config, direct_candidates, graph_candidates.

    Direct candidates come by best score, then paper id, with every hit and every path that ends at them; graph
    candidates by number of paths, then paper id. The document is gathered whole; search_to_tables writes the
    same as tables. Only the candidates' own metadata files are read.
    """
    config = config or SearchConfig()
    index, tables = find(spark, data_dir, queries, embedder, config, strategy)
    grouped = group_hits(tables.hits).collect()
    graph_rows = tables.reached.collect()
    ids = [r["paper_id"] for r in (*grouped, *graph_rows)]
    keep = spark.createDataFrame([(i,) for i in ids], "paper_id bigint")
    found = {r["paper_id"]: [p.asDict(True) for p in r["paths"]] for r in _paths_of(tables.paths).collect()}
    edges = _edges_of(spark, index.graph, found)
    paths_by = {paper: [_path(p, paper, edges) for p in listed] for paper, listed in found.items()}
    meta = {r["id"]: r for r in corpus.paper_meta(spark, data_dir, ids).select("id", "title", "s3_uri").collect()} if ids else {}
    titles = {r["paper_id"]: r["title"] for r in corpus.paper_ledger(spark, data_dir).join(keep, "paper_id", "left_semi").collect()}
    summaries = {r["paper_id"]: r["text"] for r in index.items.where("kind = 'summary'").select("paper_id", "text").join(keep, "paper_id", "left_semi").collect()}

    def candidate(paper: int, found: list) -> dict:
        uri = meta[paper]["s3_uri"] if paper in meta else None
        return {"paper_id": paper, "title": titles.get(paper), "s3_uri": (uri or "").strip() or None, "summary_ja": summaries.get(paper), "hits": found, "paths": paths_by.get(paper, [])}

    ordered = sorted(grouped, key=lambda r: (-r["best_score"], r["paper_id"]))
    return {
        "queries": list(queries),
        "config": dict(config.__dict__),
        "direct_candidates": [candidate(r["paper_id"], [{"kind": h["kind"], "ref": h["ref"], "query": queries[h["query_id"]], "score": h["score"], "text": h["text"]} for h in r["hits"]]) for r in ordered],
        "graph_candidates": [candidate(r["paper_id"], []) for r in sorted(graph_rows, key=lambda r: r["rank"])],
    }


def _edges_of(spark: SparkSession, graph: Graph, found: dict[int, list[dict]]) -> dict:
    """The stored edges, evidence included, that the candidates' paths stand on, by (paper, concept, relation) or edge id."""
    ends = {(p["source_paper_id"], p["visited"][0], p["source_relation"]) for ps in found.values() for p in ps} | {(paper, p["visited"][-1], p["target_relation"]) for paper, ps in found.items() for p in ps}
    hops = {(e,) for ps in found.values() for p in ps for e in p["edges"]}
    wanted = spark.createDataFrame(sorted(ends), "paper_id bigint, concept_id string, relation string")
    out: dict = {(r["paper_id"], r["concept_id"], r["relation"]): r.asDict(True) for r in graph.paper_concepts.join(wanted, ["paper_id", "concept_id", "relation"], "left_semi").collect()}
    between = graph.concept_relations.withColumn("edge_id", edge_id()).join(spark.createDataFrame(sorted(hops), "edge_id string"), "edge_id", "left_semi")
    return out | {r["edge_id"]: {k: v for k, v in r.asDict(True).items() if k != "edge_id"} for r in between.collect()}


def _path(p: dict, target: int, edges: dict) -> dict:
    return {
        "source_edge": edges[p["source_paper_id"], p["visited"][0], p["source_relation"]],
        "hops": [{"edge": edges[e], "reached_concept_id": c} for e, c in zip(p["edges"], p["visited"][1:], strict=True)],
        "target_edge": edges[target, p["visited"][-1], p["target_relation"]],
    }
