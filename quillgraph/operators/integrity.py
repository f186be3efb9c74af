"""Integrity rules as DataFrames of violations (rule, key, message); all violations, never the first only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vocabulary import CONCEPT_RELATIONS, CONCEPT_TYPES, PAPER_RELATIONS
from .graph import Graph

#: Offenders that a summary names; the rest are counted.
NAMED = 5


def broken(df: DataFrame, rule: str, wrong: Column, key: Column, message: str) -> DataFrame:
    return df.where(F.coalesce(wrong, F.lit(True))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def repeated(df: DataFrame, rule: str, keys: list[str], message: str) -> DataFrame:
    """Keys that several rows have; nulls are equal to each other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]).alias("key"), F.lit(message).alias("message"))


def dangling(df: DataFrame, rule: str, column: str, declared: DataFrame, to: str, message: str) -> DataFrame:
    lost = df.select(F.col(column).alias("key")).distinct().join(declared.select(F.col(to).alias("key")).distinct(), "key", "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col("key").cast("string"), F.lit(message).alias("message"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def summary(violations: DataFrame) -> DataFrame:
    """(rule, message, n, named): offenders sorted as text, the first few named. Only these few are gathered."""
    from pyspark.sql import Window

    order = Window.partitionBy("rule").orderBy("key")
    named = violations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NAMED).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("named"))
    return violations.groupBy("rule", "message").agg(F.count(F.lit(1)).alias("n")).join(named, "rule")


def blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c)) == "", F.lit(True))


def check_chunks(chunks: DataFrame) -> DataFrame:
    return all_of(
        broken(chunks, "chunk_pages", F.col("page_end") < F.col("page_start"), F.col("id"), "page_end is before page_start"),
        broken(chunks, "chunk_id", F.col("id") != F.concat_ws(":", "paper_id", "idx"), F.col("id"), "the id isn't paper:idx"),
        broken(chunks, "chunk_text", blank("text"), F.col("id"), "the text is blank"),
        repeated(chunks, "chunk_unique", ["id"], "the id is repeated"),
    )


def check_items(items: DataFrame, dimension: int) -> DataFrame:
    right = (
        F.when(F.col("kind") == "concept", F.col("paper_id").isNull())
        .when(F.col("kind") == "summary", F.col("ref") == F.col("paper_id").cast("string"))
        .when(F.col("kind") == "chunk", F.col("ref").rlike("^[1-9][0-9]*:(0|[1-9][0-9]*)$") & F.col("ref").startswith(F.concat(F.col("paper_id").cast("string"), F.lit(":"))))
    )
    return all_of(
        broken(items, "item_ref", ~right, F.concat_ws("|", "kind", "ref"), "kind, ref and paper_id disagree"),
        broken(items, "item_vector", F.size("vector") != dimension, F.concat_ws("|", "kind", "ref"), "the vector has another size"),
        repeated(items, "item_unique", ["kind", "ref"], "the item is repeated"),
    )


def check_graph(graph: Graph, n_papers: int) -> DataFrame:
    papers, nodes, edges, relations = graph.papers, graph.concepts, graph.paper_concepts, graph.concept_relations
    has_quotes = F.size(F.coalesce("evidence", F.array().cast(relations.schema["evidence"].dataType))) > 0
    from_paper = F.col("paper_id").isNotNull() & has_quotes & F.col("rationale").isNull()
    general = F.col("paper_id").isNull() & ~has_quotes & ~blank("rationale")
    key = F.concat_ws("|", "source_id", "relation", "target_id")
    return all_of(
        repeated(papers, "paper_unique", ["paper_id"], "the paper is repeated"),
        repeated(nodes, "concept_unique", ["id"], "the concept is repeated"),
        broken(nodes, "concept_slug", ~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.col("id"), "the id is no slug"),
        broken(nodes, "concept_type", ~F.col("type").isin(*[t.value for t in CONCEPT_TYPES]), F.col("id"), "the type is unknown"),
        broken(nodes, "concept_count", F.col("paper_count") > n_papers, F.col("id"), "paper_count exceeds the papers"),
        repeated(edges, "edge_unique", ["paper_id", "concept_id", "relation"], "the edge is repeated"),
        broken(edges, "edge_relation", ~F.col("relation").isin(*[t.value for t in PAPER_RELATIONS]), F.concat_ws("|", "paper_id", "concept_id"), "the relation is unknown"),
        dangling(edges, "edge_paper", "paper_id", papers, "paper_id", "the paper isn't declared"),
        dangling(edges, "edge_concept", "concept_id", nodes, "id", "the concept isn't declared"),
        repeated(relations, "relation_unique", ["source_id", "target_id", "relation", "origin", "paper_id"], "the relation is repeated"),
        broken(relations, "relation_kind", ~F.col("relation").isin(*[t.value for t in CONCEPT_RELATIONS]), key, "the relation is unknown"),
        broken(relations, "relation_self", F.col("source_id") == F.col("target_id"), key, "the relation joins a concept to itself"),
        broken(relations, "relation_origin", ~F.when(F.col("origin") == "paper", from_paper).when(F.col("origin") == "general_knowledge", general), key, "origin, paper, evidence and rationale disagree"),
        dangling(relations, "relation_source", "source_id", nodes, "id", "the source isn't declared"),
        dangling(relations, "relation_target", "target_id", nodes, "id", "the target isn't declared"),
    )


def check_extraction_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rules inside each extraction: unique ids, declared ends, unique edges, no self edges, evidence everywhere."""
    concepts, edges, relations = tables["concepts"], tables["paper_concepts"], tables["concept_relations"]
    ids = concepts.select("paper_id", "local_id").distinct()

    def undeclared(df: DataFrame, column: str, rule: str) -> DataFrame:
        lost = df.select("paper_id", F.col(column).alias("local_id")).distinct().join(ids, ["paper_id", "local_id"], "left_anti")
        return lost.select(F.lit(rule).alias("rule"), F.concat_ws("|", "paper_id", "local_id").alias("key"), F.lit("the concept isn't declared").alias("message"))

    none = tables["papers"].join(concepts.select("paper_id"), "paper_id", "left_anti")
    ends = F.concat_ws("|", "paper_id", "source_local", "target_local")
    return all_of(
        repeated(concepts, "local_unique", ["paper_id", "local_id"], "the local id is repeated"),
        broken(concepts, "local_form", ~F.col("local_id").rlike("^c[1-9][0-9]*$"), F.concat_ws("|", "paper_id", "local_id"), "the local id has another form"),
        broken(concepts, "local_type", ~F.col("type").isin(*[t.value for t in CONCEPT_TYPES]), F.concat_ws("|", "paper_id", "local_id"), "the type is unknown"),
        broken(concepts, "local_name", blank("name"), F.concat_ws("|", "paper_id", "local_id"), "the name is blank"),
        none.select(F.lit("no_concept").alias("rule"), F.col("paper_id").cast("string").alias("key"), F.lit("there is no concept").alias("message")),
        undeclared(edges, "local_id", "edge_declared"),
        undeclared(relations, "source_local", "source_declared"),
        undeclared(relations, "target_local", "target_declared"),
        repeated(edges, "local_edge_unique", ["paper_id", "local_id", "relation"], "the edge is repeated"),
        repeated(relations, "local_relation_unique", ["paper_id", "source_local", "target_local", "relation"], "the relation is repeated"),
        broken(relations, "local_self", F.col("source_local") == F.col("target_local"), ends, "the relation joins a concept to itself"),
        broken(edges, "edge_evidence", F.size("evidence") < 1, F.concat_ws("|", "paper_id", "local_id"), "there is no evidence"),
        broken(relations, "relation_evidence", F.size("evidence") < 1, ends, "there is no evidence"),
    )


def check_normalized(concepts: DataFrame, general: DataFrame) -> DataFrame:
    """Rules of a vocabulary: unique slugs, one owner per local concept, declared and unique general relations with a rationale."""
    refs = concepts.select("id", F.explode("merged_from").alias("r")).select("id", "r.paper_id", "r.local_id")
    key = F.concat_ws("|", "source_id", "relation", "target_id")
    return all_of(
        repeated(concepts, "slug_unique", ["id"], "the slug is repeated"),
        broken(concepts, "merged_from", F.size("merged_from") < 1, F.col("id"), "it is merged from nothing"),
        repeated(refs, "one_owner", ["paper_id", "local_id"], "several concepts own it"),
        repeated(general, "general_unique", ["source_id", "target_id", "relation"], "the relation is repeated"),
        broken(general, "general_self", F.col("source_id") == F.col("target_id"), key, "the relation joins a concept to itself"),
        broken(general, "general_rationale", blank("rationale"), key, "the rationale is blank"),
        dangling(general, "general_source", "source_id", concepts, "id", "the source isn't declared"),
        dangling(general, "general_target", "target_id", concepts, "id", "the target isn't declared"),
    )


def check_grouping(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups hold two concepts at least, and a concept is in one group at most; members: group_id, paper_id, local_id."""
    return all_of(broken(sizes, "group_size", F.col("n") < 2, F.col("group_id"), "the group has fewer than two concepts"), repeated(members, "group_overlap", ["paper_id", "local_id"], "several groups hold it"))


def check_index(graph: Graph, chunks: DataFrame, items: DataFrame, dimension: int, n_papers: int) -> DataFrame:
    """The rules of each table, and those between them: items and what they stand for agree both ways."""
    refs = lambda kind: items.where(F.col("kind") == kind)
    apart = refs("chunk").join(chunks.select(F.col("id").alias("ref"), F.col("text").alias("own")), "ref")
    pairs = (("chunk", chunks.select(F.col("id").alias("ref"))), ("summary", graph.papers.select(F.col("paper_id").cast("string").alias("ref"))), ("concept", graph.concepts.select(F.col("id").alias("ref"))))
    both = [
        x
        for kind, declared in pairs
        for x in (dangling(refs(kind), f"{kind}_item", "ref", declared, "ref", "the item stands for nothing"), dangling(declared, f"{kind}_covered", "ref", refs(kind), "ref", "there is no item for it"))
    ]
    return all_of(
        check_chunks(chunks), check_items(items, dimension), check_graph(graph, n_papers),
        dangling(chunks, "chunk_paper", "paper_id", graph.papers, "paper_id", "the chunk's paper isn't declared"),
        broken(apart, "chunk_item_text", F.col("text") != F.col("own"), F.col("ref"), "item and chunk differ in text"), *both,
    )
