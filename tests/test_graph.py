import random

import pytest

from quillgraph.operators import graph as G
from quillgraph.operators import merging as M
from quillgraph.operators import traversal as T

EV = "array<struct<page:int,quote:string,chunk_id:string>>"


def make(spark, papers, concepts, edges, relations):
    return G.Graph(
        spark.createDataFrame([(p, n) for n, p in enumerate(papers)], "paper_id bigint, corpus_pos int"),
        spark.createDataFrame(concepts, "id string, type string, paper_count int"),
        spark.createDataFrame([(p, c, r, []) for p, c, r in edges], f"paper_id bigint, concept_id string, relation string, evidence {EV}"),
        spark.createDataFrame([(a, b, r, "paper" if p else "general_knowledge", p, [], None) for a, b, r, p in relations], f"source_id string, target_id string, relation string, origin string, paper_id bigint, evidence {EV}, rationale string"),
    )


def plain_walk(papers, concepts, edges, relations, sources, config):
    n = len(papers)
    ok = {c for c, t, k in concepts if t in config.concept_types and k / n <= config.generic_concept_threshold}
    listed = [e for e in edges if e[2] in config.paper_relations]
    out = []

    def go(source, rel, visited, hops):
        for p, c, r in listed:
            if c == visited[-1] and p != source:
                out.append((source, rel, visited, hops, p, r))
        if len(hops) == config.max_hops:
            return
        for a, b, r, p in relations:
            if r not in config.concept_relations:
                continue
            for here, there in ((a, b), (b, a)):
                if here == visited[-1] and there in ok and there not in visited:
                    go(source, rel, (*visited, there), (*hops, (a, r, b, p)))

    for p, c, r in listed:
        if p in sources and c in ok:
            go(p, r, (c,), ())
    return out


@pytest.mark.parametrize("hops", [0, 1, 2])
def test_paths_against_a_plain_walk(spark, hops):
    rng = random.Random(hops)
    papers = list(range(1, 8))
    concepts = [(f"c{n}", rng.choice(["method", "problem", "keyword"]), rng.randint(0, 5)) for n in range(9)]
    edges = sorted({(rng.choice(papers), f"c{rng.randrange(9)}", rng.choice(["uses", "proposes", "mentions"])) for _ in range(30)})
    relations = sorted({(f"c{rng.randrange(9)}", f"c{rng.randrange(9)}", rng.choice(["is_a", "part_of"]), rng.choice([0, 1, 2])) for _ in range(14)})
    relations = [(a, b, r, p or None) for a, b, r, p in relations if a != b]
    config = T.SearchConfig(max_hops=hops, generic_concept_threshold=0.5)
    want = plain_walk(papers, concepts, edges, relations, {1, 2, 3}, config)
    g = make(spark, papers, concepts, edges, relations)
    sources = spark.createDataFrame([(1,), (2,), (3,), (3,)], "paper_id bigint")
    paths = T.NeighborhoodTraversal().traverse(g, sources, 7, config)
    got = sorted((r["source_paper_id"], r["source_relation"], tuple(r["visited"]), r["n_hops"], r["target_paper_id"], r["target_relation"]) for r in paths.collect())
    assert got == sorted((s, r, v, len(h), p, q) for s, r, v, h, p, q in want)
    ranked = {tuple(r) for r in T.rank_reached(paths).collect()}
    if hops < 2:
        assert {tuple(r) for r in T.reached_counts(g, sources, 7, config).collect()} == ranked
    direct = sources.distinct()
    best = [tuple(r)[:2] for r in T.graph_candidates(T.rank_reached(paths), direct, 2).orderBy("rank").collect()]
    assert best == sorted((x for x in ranked if x[0] > 3), key=lambda x: (-x[1], x[0]))[:2]


def test_config():
    for bad in ({"top_k": 0}, {"max_hops": -1}, {"generic_concept_threshold": 1.5}, {"concept_types": ("method", "method")}, {"paper_relations": ("nonsense",)}):
        with pytest.raises(ValueError):
            T.SearchConfig(**bad)
    assert T.SearchConfig(paper_relations=()).paper_relations == ()


def test_empty_settings_turn_steps_off(spark):
    g = make(spark, [1, 2], [("c", "method", 1)], [(1, "c", "uses"), (2, "c", "uses")], [])
    s = spark.createDataFrame([(1,)], "paper_id bigint")
    assert T.NeighborhoodTraversal().traverse(g, s, 2, T.SearchConfig(generic_concept_threshold=1.0)).count() == 1
    assert T.NeighborhoodTraversal().traverse(g, s, 2, T.SearchConfig(paper_relations=())).count() == 0
    with pytest.raises(ValueError):
        T.check_sources(spark.createDataFrame([(5,)], "paper_id bigint"), g.papers)


def test_building(spark):
    concepts = spark.createDataFrame(
        [("a", "A", "method", [], "", [(1, "c1"), (1, "c2"), (2, "c1")]), ("b", "B", "problem", [], "", [(1, "c3")])],
        "id string, canonical_name string, type string, aliases array<string>, description string, merged_from array<struct<paper_id:bigint,local_id:string>>",
    )
    q = "evidence array<struct<page:int,quote:string>>"
    edges = spark.createDataFrame([(1, "c1", "uses", [(1, "x"), (1, "y")], 0), (1, "c2", "uses", [(1, "y"), (2, "z")], 1), (2, "c1", "uses", [(1, "x")], 0)], f"paper_id bigint, local_id string, relation string, {q}, edge_pos int")
    relations = spark.createDataFrame([(1, "c1", "c3", "is_a", [(1, "x")], 0), (1, "c1", "c2", "is_a", [(1, "x")], 1)], f"paper_id bigint, source_local string, target_local string, relation string, {q}, edge_pos int")
    general = spark.createDataFrame([("a", "b", "is_a", "r"), ("b", "a", "is_a", "r"), ("a", "b", "part_of", "r")], "source_id string, target_id string, relation string, rationale string")
    ev = spark.createDataFrame([(1, 1, "x", "1:0"), (1, 1, "y", "1:0"), (1, 2, "z", "1:1"), (2, 1, "x", "2:0")], "paper_id bigint, page int, quote string, chunk_id string")
    papers = spark.createDataFrame([(1, 0), (2, 1)], "paper_id bigint, corpus_pos int")
    g = G.build_graph(papers, concepts, edges, relations, general, ev)
    assert {(r["id"], r["paper_count"]) for r in g.concepts.collect()} == {("a", 2), ("b", 1)}
    got = {(r["paper_id"], r["concept_id"]): [(e["page"], e["quote"], e["chunk_id"]) for e in r["evidence"]] for r in g.paper_concepts.collect()}
    assert got == {(1, "a"): [(1, "x", "1:0"), (1, "y", "1:0"), (2, "z", "1:1")], (2, "a"): [(1, "x", "2:0")]}
    assert {(r["source_id"], r["target_id"], r["relation"], r["origin"]) for r in g.concept_relations.collect()} == {("a", "b", "is_a", "paper"), ("b", "a", "is_a", "general_knowledge"), ("a", "b", "part_of", "general_knowledge")}
    with pytest.raises(G.GraphError):
        G.build_graph(papers, concepts.where("id = 'a'"), edges, relations, general, ev)
    with pytest.raises(G.GraphError):
        G.build_graph(papers, concepts, edges, relations, general, ev.where("quote <> 'z'"))
    stated = G.stated_relations(relations, G.slug_bridge(concepts)).collect()
    assert [(r["source_id"], r["target_id"], r["relation"], r["paper_ids"]) for r in stated] == [("a", "b", "is_a", [1])]


def test_components_of_long_chains(spark):
    claims = [(f"s{n}", g) for n in range(40) for g in (n, n + 1)] + [("t", 100), ("t", 101), ("alone", 7_000), (None, 1)]
    df = spark.createDataFrame(claims, "slug string, group_id bigint")
    got = {r["group_id"]: r["component"] for r in M.collision_components(df).collect()}
    assert got == {n: 0 for n in range(41)} | {100: 100, 101: 100}
    assert {r["slug"]: r["group_ids"] for r in M.slug_collisions(df).where("slug = 't'").collect()} == {"t": [100, 101]}
    assert M.collision_components(df.limit(0)).count() == 0


def test_groups(spark):
    members = spark.createDataFrame([(0, 0, 1, "c1"), (0, 1, 2, "c1"), (1, 0, 3, "c1"), (2, 0, 4, "c1")], "group_id int, pos int, paper_id bigint, local_id string")
    claims = spark.createDataFrame([("x", 0), ("x", 2), ("y", 1)], "slug string, group_id int")
    got = {r["group_id"]: ([(x["paper_id"], x["local_id"]) for x in r["refs"]], r["answered"]) for r in M.combine_groups(members, M.collision_components(claims)).collect()}
    assert got == {0: ([(1, "c1"), (2, "c1"), (4, "c1")], False), 1: ([(3, "c1")], True)}
    assert M.collision_issues(claims, members).first()["message"] == "'x' is the id of a concept in 2 groups that were merged apart: paper 1 'c1', paper 2 'c1'; paper 4 'c1'"


def test_merge_checks(spark):
    concepts = spark.createDataFrame([(1, "c1", "N", "method", None, ""), (1, "c2", "日本", "problem", None, "")], "paper_id bigint, local_id string, name string, type string, aliases array<string>, description string")
    kind = "pos int, id string, type string, merged_from array<struct<paper_id:bigint,local_id:string>>"
    normalized = spark.createDataFrame([(0, "n", "keyword", [(1, "c1"), (1, "c9"), (8, "c1")])], kind)
    got = {(r["path"], r["message"]) for r in M.check_normalization(normalized, concepts).collect()}
    assert got == {
        ("concepts[0].merged_from[1]", "paper 1 has no concept 'c9'"), ("concepts[0].merged_from[2]", "there is no extraction for paper 8"),
        ("concepts[0].type", "is 'keyword', which none of the merged concepts has; they are method"), ("concepts", "paper 1 'c2' is in no merged_from"),
    }
    assert {r["id"] for r in M.derive_solo(concepts).collect()} == {"n", "concept-1-c2"}


@pytest.mark.parametrize("hops", [0, 1, 2, 3])
def test_path_counts_are_those_of_the_paths(spark, hops, monkeypatch):
    """By counts, whatever the blocks, with loops, parallel edges and walks that would come back."""
    rng = random.Random(10 + hops)
    papers = list(range(1, 13))
    concepts = [(f"c{n}", rng.choice(["method", "problem", "keyword"]), rng.randint(0, 7)) for n in range(10)]
    edges = sorted({(rng.choice(papers), f"c{rng.randrange(10)}", rng.choice(["uses", "proposes", "mentions"])) for _ in range(60)})
    relations = [(f"c{rng.randrange(10)}", f"c{rng.randrange(10)}", rng.choice(["is_a", "part_of"]), rng.choice([None, 1, 2])) for _ in range(25)]
    config = T.SearchConfig(max_hops=hops, generic_concept_threshold=0.5)
    g = make(spark, papers, concepts, edges, relations)
    sources = spark.createDataFrame([(1,), (2,), (3,), (3,), (99,)], "paper_id bigint")
    paths = T.NeighborhoodTraversal().traverse(g, sources, 12, config)
    want = {tuple(r) for r in paths.groupBy("source_paper_id", "target_paper_id", "n_hops").count().collect()}
    for at_once in (1_000_000, 5):
        monkeypatch.setattr(T, "EDGES_AT_ONCE", at_once)
        monkeypatch.setattr(T, "ENDS_AT_ONCE", at_once)
        got = T.path_counts(g, sources, 12, config)
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want) > 10
    if hops < 3:  # pairs of papers are neither joined nor shuffled
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    assert T.path_counts(g, sources.limit(0), 12, config).count() == 0
    none = G.Graph(g.papers, g.concepts, g.paper_concepts.limit(0), g.concept_relations)
    assert T.path_counts(none, sources, 12, config).count() == 0
