"""The vocabulary of a corpus: candidate pairs, groups, merges, collisions, general relations.

The agent stages are calls by nature; what surrounds them (pairs, solos, collisions, components, checks) is
DataFrames. Nothing is saved unless every stage passes.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedders import Embedder, embedded
from ..functions.text import concept_text
from ..operators import integrity, merging
from ..operators.graph import slug_bridge, stated_relations
from ..operators.vectors import candidate_pairs, top_items
from ..sources import corpus, schemas
from . import prompts
from .agents import StructuredAgent, json_schema
from .build_index import Findings, Rejected, findings, read_corpus

_REFS = "array<struct<paper_id:bigint,local_id:string>>"
GROUPING = f"groups array<{_REFS}>"
MERGE = f"concepts array<struct<id:string,canonical_name:string,type:string,aliases:array<string>,description:string,merged_from:{_REFS}>>"
PROPOSAL = "concept_relations array<struct<source_id:string,target_id:string,relation:string,rationale:string>>"


def ask(stage: str, agent: StructuredAgent, prompt: Callable[[object | None, list[dict]], str], schema: str, check: Callable[[Any], list[dict]], max_attempts: int) -> tuple[Any, int]:
    """An answer without issues and the attempts it took; each retry is told the last answer and its issues."""
    kind = schemas._schema(schema)
    previous, issues = None, []
    for attempt in range(1, max_attempts + 1):
        payload = agent.answer(prompt(previous, issues), json_schema(kind, schemas.OPTIONAL))
        form = schemas.problems(payload, kind)
        issues = [{"path": p.split(": ", 1)[0], "message": p.split(": ", 1)[1]} for p in form] or check(payload)
        if not issues:
            return payload, attempt
        previous = payload
    raise Rejected(stage, issues)


def extracted_pairs(concepts: DataFrame, embedder: Embedder, neighbors: int) -> list[dict]:
    """Candidate pairs of all concepts by exact search, best first; the concepts are numbered in corpus order.

    Every concept is held against every other: this stage is for vocabularies that fit into an agent's prompt, which lists them all.
    """
    order = ["corpus_pos", "pos"]
    from pyspark.sql import Window

    table = concepts.withColumn("row_idx", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("vector", embedded(concept_text(F.col("name"), F.col("aliases"), F.col("description")), embedder)).persist()
    try:
        rows = table.select("row_idx", "vector").orderBy("row_idx").collect()  # the prompt lists every concept
        if len(rows) < 2:
            return []
        found = candidate_pairs(top_items(table, [r[0] for r in rows], np.array([r[1] for r in rows]), neighbors + 1), neighbors)
        names = table.select("row_idx", "paper_id", "local_id")
        left = names.select(F.col("row_idx").alias("left_idx"), F.col("paper_id").alias("left_paper"), F.col("local_id").alias("left_local"))
        right = names.select(F.col("row_idx").alias("right_idx"), F.col("paper_id").alias("right_paper"), F.col("local_id").alias("right_local"))
        return [r.asDict() for r in found.join(left, "left_idx").join(right, "right_idx").orderBy(F.desc("score"), "left_idx", "right_idx").collect()]
    finally:
        table.unpersist()


def normalize(spark: SparkSession, data_dir: str, agent: StructuredAgent, embedder: Embedder, neighbors: int = 5, max_attempts: int = 3, concurrency: int = 4) -> dict:
    """Saves the vocabulary and returns its counts; Rejected names the stage that failed."""
    if min(neighbors, max_attempts, concurrency) < 1:
        raise ValueError("neighbors, max_attempts and concurrency must be at least 1")
    c = read_corpus(spark, data_dir)
    concepts = c.extractions["concepts"].join(c.ledger.select("paper_id", "corpus_pos"), "paper_id").persist()
    try:
        return _normalize(spark, data_dir, agent, embedder, c, concepts, neighbors, max_attempts, concurrency)
    finally:
        concepts.unpersist()


def _normalize(spark, data_dir, agent, embedder, c, concepts, neighbors, max_attempts, concurrency) -> dict:
    listed = [r.asDict() for r in concepts.orderBy("corpus_pos", "pos").collect()]  # agents read every concept
    by_ref = {(x["paper_id"], x["local_id"]): x for x in listed}
    pairs = extracted_pairs(concepts, embedder, neighbors)

    def check_groups(payload: dict) -> list[dict]:
        refs = [(n, m, r["paper_id"], r["local_id"]) for n, g in enumerate(payload["groups"]) for m, r in enumerate(g)]
        rows = spark.createDataFrame([(f"groups[{n}][{m}]", p, i, n) for n, m, p, i in refs], "path string, paper_id bigint, local_id string, group_id int")
        sizes = spark.createDataFrame([(n, len(g)) for n, g in enumerate(payload["groups"])], "group_id int, n int")
        form = findings(integrity.check_grouping(rows, sizes)).each(lambda f: {"path": f"groups[{f['key']}]" if f["rule"] == "group_size" else f["key"], "message": f["message"]})
        return form or findings(merging.unknown_refs(rows, concepts))

    grouping, grouping_attempts = ask("grouping", agent, lambda p, i: prompts.grouping_prompt(listed, pairs, p, i), GROUPING, check_groups, max_attempts)
    groups = [[(r["paper_id"], r["local_id"]) for r in g] for g in grouping["groups"]]
    grouped = {r for g in groups for r in g}
    solos = merging.derive_solo(merging.solo_concepts(concepts, spark.createDataFrame(sorted(grouped), "paper_id bigint, local_id string")))
    pending: list[tuple[list[tuple[int, str]], list[dict] | None]] = [(g, None) for g in groups]
    pending += [([(s["merged_from"][0]["paper_id"], s["merged_from"][0]["local_id"])], [s]) for s in (r.asDict(True) for r in solos.collect())]
    calls = 0
    for rounds in range(1, max_attempts + 1):
        pending, made = _answer(spark, agent, pending, by_ref, max_attempts, concurrency)
        calls += made
        claims = spark.createDataFrame([(x["id"], n) for n, (_, found) in enumerate(pending) for x in found], "slug string, group_id int")
        if not merging.slug_collisions(claims).take(1):
            break
        members = spark.createDataFrame([(n, m, p, i) for n, (g, _) in enumerate(pending) for m, (p, i) in enumerate(g)], "group_id int, pos int, paper_id bigint, local_id string")
        if rounds == max_attempts:
            raise Rejected("merge", [{"path": "concepts", "message": r["message"]} for r in merging.collision_issues(claims, members).collect()])
        joined = merging.combine_groups(members, merging.collision_components(claims)).collect()
        kept = [pending[r["group_id"]] for r in sorted(joined, key=lambda r: r["group_id"]) if r["answered"]]
        pending = kept + [([(x["paper_id"], x["local_id"]) for x in r["refs"]], None) for r in sorted(joined, key=lambda r: r["group_id"]) if not r["answered"]]
    merged = [x for _, found in pending for x in found]
    kind = f"pos int, id string, canonical_name string, type string, aliases array<string>, description string, merged_from {_REFS}"
    vocabulary = spark.createDataFrame([(n, x["id"], x["canonical_name"], x["type"], x.get("aliases") or [], x.get("description") or "", [(r["paper_id"], r["local_id"]) for r in x["merged_from"]]) for n, x in enumerate(merged)], kind)
    if issues := findings(merging.check_normalization(vocabulary, concepts)):
        raise Rejected("merge", issues)
    stated = stated_relations(c.extractions["concept_relations"], slug_bridge(vocabulary))
    known = [r.asDict() for r in stated.orderBy("source_id", "target_id", "relation").collect()]

    def check_proposal(payload: dict) -> list[dict]:
        rows = spark.createDataFrame([(n, e["source_id"], e["target_id"], e["relation"], e.get("rationale")) for n, e in enumerate(payload["concept_relations"])], "pos int, source_id string, target_id string, relation string, rationale string")
        own = integrity.check_normalized(vocabulary, rows).where("rule in ('general_unique', 'general_self', 'general_rationale')")
        return findings(own).each(lambda f: {"path": f["key"], "message": f["message"]}) + findings(merging.check_relations(rows, vocabulary, stated))

    proposal, relation_attempts = ask("relations", agent, lambda p, i: prompts.relations_prompt(merged, known, p, i), PROPOSAL, check_proposal, max_attempts)
    fields = ("id", "canonical_name", "type", "aliases", "description", "merged_from")
    saved = [{f: x.get(f) if x.get(f) is not None else ([] if f == "aliases" else "") for f in fields} for x in merged]
    paths = corpus.save_normalization(spark, data_dir, saved, proposal["concept_relations"])
    return {
        "papers": c.ledger.count(), "concepts": len(merged), "merged_concepts": sum(len(x["merged_from"]) > 1 for x in merged), "concept_relations": len(proposal["concept_relations"]),
        "groups": len(groups), "attempts": {"grouping": grouping_attempts, "merge_calls": calls, "merge_rounds": rounds, "relations": relation_attempts}, "paths": paths,
    }


def _answer(spark, agent, pending, by_ref, max_attempts, concurrency):
    """Merges of the groups without answer, several at a time; the first failing group in group order is reported."""

    def one(n: int, refs: list[tuple[int, str]]):
        members = [by_ref[r] for r in refs]

        def check(payload: dict) -> list[dict]:
            rows = spark.createDataFrame([(n, m, x["type"], [(r["paper_id"], r["local_id"]) for r in x["merged_from"]]) for m, x in enumerate(payload["concepts"])], f"group_id int, pos int, type string, merged_from {_REFS}")
            world = spark.createDataFrame([(n, x["paper_id"], x["local_id"], x["type"]) for x in members], "group_id int, paper_id bigint, local_id string, type string")
            refs_of = rows.select(F.explode("merged_from").alias("r")).select("r.*")
            twice = findings(integrity.repeated(refs_of, "one_owner", ["paper_id", "local_id"], "several concepts own it"))
            return twice.each(lambda f: {"path": f["key"], "message": f["message"]}) or findings(merging.check_group_merge(rows, world)).each(lambda f: {"path": f["path"], "message": f["message"]})

        payload, attempts = ask("merge", agent, lambda p, i: prompts.merge_prompt(members, p, i), MERGE, check, max_attempts)
        return payload["concepts"], attempts

    out, calls, failure = list(pending), 0, None
    with ThreadPoolExecutor(concurrency) as pool:
        asked = {n: pool.submit(one, n, refs) for n, (refs, found) in enumerate(pending) if found is None}
        for n, future in sorted(asked.items()):
            try:
                found, attempts = future.result()
            except Rejected as e:
                rows = [{"path": f"groups[{n}].{i['path']}", "message": i["message"]} for i in e.rows]
                failure = failure or Rejected("merge", Findings(rows, e.total, e.table))
                continue
            calls += attempts
            out[n] = (out[n][0], found)
    if failure:
        raise failure
    return out, calls
