"""A corpus of three papers from files to search results, with agents and an embedder without models."""

import json

import pytest

from quillgraph.functions.embedders import HashEmbedder
from quillgraph.operators.traversal import SearchConfig
from quillgraph.plans import cli
from quillgraph.plans.agents import AgentError, CommandAgent, ScriptedAgent
from quillgraph.plans.build_index import MissingExtractions, Rejected, build_index
from quillgraph.plans.extract import extract
from quillgraph.plans.normalize import normalize
from quillgraph.plans.search_papers import ModelMismatch, check_queries, search
from quillgraph.sources import corpus, index_store

# fixed values: the layout and the fields of the files that a corpus is read from
PAPERS = {
    1: ("Walking graphs", ["# Walking\nWe propose graph walks for reading lists.", "Graph walks use dense retrieval.\n\n<!-- figure: 1 -->\nReading lists matter."]),
    2: ("Dense retrieval", ["Dense retrieval is used with graph walks here."]),
    3: ("Surveys", ["This survey mentions reading lists and graph walks."]),
}


def concept(n, name, kind="method"):
    return {"local_id": f"c{n}", "name": name, "type": kind, "aliases": [], "description": f"about {name}"}


def edge(n, relation, page, quote):
    return {"concept_id": f"c{n}", "relation": relation, "evidence": [{"page": page, "quote": quote}]}


EXTRACTIONS = {
    1: {
        "schema_version": 1, "paper_id": 1, "summary_ja": "要約一", "concepts": [concept(1, "Graph walks"), concept(2, "Dense retrieval"), concept(3, "Reading lists", "problem")],
        "paper_concepts": [edge(1, "proposes", 1, "We propose graph walks"), edge(2, "uses", 2, "use  dense\nretrieval"), edge(3, "addresses", 2, "Reading lists matter.")],
        "concept_relations": [{"source_id": "c2", "target_id": "c1", "relation": "part_of", "evidence": [{"page": 2, "quote": "Graph walks use dense retrieval."}]}],
    },
    2: {"schema_version": 1, "paper_id": 2, "summary_ja": "要約二", "concepts": [concept(1, "graph walk"), concept(2, "dense retrieval")], "paper_concepts": [edge(2, "proposes", 1, "Dense retrieval"), edge(1, "uses", 1, "graph walks")], "concept_relations": []},
    3: {"schema_version": 1, "paper_id": 3, "summary_ja": "要約三", "concepts": [concept(1, "Reading lists", "problem")], "paper_concepts": [edge(1, "addresses", 1, "reading lists")], "concept_relations": []},
}
GROUPS = {"groups": [[{"paper_id": 1, "local_id": "c1"}, {"paper_id": 2, "local_id": "c1"}], [{"paper_id": 1, "local_id": "c2"}, {"paper_id": 2, "local_id": "c2"}]]}


def write(base, extractions=True):
    (base / "papers").mkdir(parents=True)
    (base / "papers/index.json").write_text(json.dumps({"papers": [{"id": n, "title": t} for n, (t, _) in PAPERS.items()]}))
    for n, (title, pages) in PAPERS.items():
        d = base / f"papers/{n:04d}"
        (d / "pages").mkdir(parents=True)
        meta = {"id": n, "title": title, "authors": ["A"], "year": 2020, "venue": "V", "page_count": len(pages), "s3_uri": " " if n == 2 else f"s3://b/{n}", "preprocess": {"tool": "t", "version": "1", "processed_at": "2024-01-01T00:00:00Z"}}
        (d / "paper.json").write_text(json.dumps(meta))
        for k, text in enumerate(pages, 1):
            (d / f"pages/{k:03d}.md").write_text(text)
        if extractions:
            (d / "extraction.json").write_text(json.dumps(EXTRACTIONS[n]))
    return str(base)


def merged(slug, *refs, kind="method"):
    return {"id": slug, "canonical_name": slug, "type": kind, "aliases": [], "description": "", "merged_from": [{"paper_id": p, "local_id": i} for p, i in refs]}


def answer(prompt, schema):
    if "Put concepts" in prompt:
        return GROUPS
    if "Merge the concepts" in prompt:
        return {"concepts": [merged("graph-walks", (1, "c1"), (2, "c1"))]} if "Graph walks" in prompt else {"concepts": [merged("dense-retrieval", (1, "c2"), (2, "c2"))]}
    return {"concept_relations": [{"source_id": "graph-walks", "target_id": "dense-retrieval", "relation": "related_to", "rationale": "known"}]}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = write(tmp_path_factory.mktemp("corpus") / "data")
    # both solos write "reading-lists": the collision joins them, and the merge is asked again
    agent = ScriptedAgent(lambda p, s: {"concepts": [merged("reading-lists", (1, "c3"), (3, "c1"), kind="problem")]} if "Merge" in p and "Reading lists" in p else answer(p, s))
    counts = normalize(spark, d, agent, HashEmbedder())
    assert {k: counts[k] for k in ("papers", "concepts", "merged_concepts", "concept_relations", "groups")} == {"papers": 3, "concepts": 3, "merged_concepts": 3, "concept_relations": 1, "groups": 2}
    assert counts["attempts"] == {"grouping": 1, "merge_calls": 3, "merge_rounds": 2, "relations": 1}
    assert build_index(spark, d, HashEmbedder(), 20) == {"papers": 3, "chunks": 4, "items": 10, "concepts": 3, "paper_concepts": 6, "concept_relations": 2}
    return d


def test_index(spark, data):
    index = index_store.read_index(spark, data)
    items = [(r["row_idx"], r["kind"], r["ref"], r["paper_id"]) for r in index.items.orderBy("row_idx").collect()]
    assert [x[:3] for x in items] == [(0, "chunk", "1:0"), (1, "chunk", "1:1"), (2, "chunk", "2:0"), (3, "chunk", "3:0"), (4, "summary", "1"), (5, "summary", "2"), (6, "summary", "3"), *[(7 + n, "concept", c) for n, c in enumerate(r["id"] for r in corpus.normalization(spark, data)[0].orderBy("pos").collect())]]
    assert {r["id"]: r["paper_count"] for r in index.graph.concepts.collect()} == {"graph-walks": 2, "dense-retrieval": 2, "reading-lists": 2}
    from quillgraph.operators.integrity import check_index

    assert check_index(index.graph, index.chunks, index.items, 8, 3).count() == 0


def test_an_edited_index_is_refused_when_checked(spark, data, tmp_path):
    import shutil

    shutil.copytree(f"{data}/index", tmp_path / "index")
    index_store.read_index(spark, str(tmp_path), check=True)
    spark.read.parquet(f"{data}/index/chunks").where("id <> '1:0'").write.mode("overwrite").parquet(str(tmp_path / "index/chunks"))
    with pytest.raises(corpus.Invalid, match="chunk_item"):
        index_store.read_index(spark, str(tmp_path), check=True)


def test_search(spark, data):
    got = search(spark, data, ["要約一"], HashEmbedder(), SearchConfig(top_k=1, generic_concept_threshold=0.7))
    assert [c["paper_id"] for c in got["direct_candidates"]] == [1]
    hit = got["direct_candidates"][0]["hits"][0]
    assert (hit["kind"], hit["ref"], hit["query"]) == ("summary", "1", "要約一") and hit["score"] == pytest.approx(1)
    around = [(c["paper_id"], len(c["paths"]), c["title"], c["s3_uri"]) for c in got["graph_candidates"]]
    # 2: walks and retrieval shared, and each again over both edges between them; 3: reading lists shared
    assert around == [(2, 6, "Dense retrieval", None), (3, 1, "Surveys", "s3://b/3")]
    paths = got["graph_candidates"][0]["paths"]
    assert {p["target_edge"]["paper_id"] for p in paths} == {2}
    short = next(p for p in paths if not p["hops"] and p["source_edge"]["concept_id"] == "graph-walks")
    assert short["source_edge"]["evidence"] == [{"page": 1, "quote": "We propose graph walks", "chunk_id": "1:0"}] and short["target_edge"]["evidence"][0]["chunk_id"] == "2:0"
    assert {p["hops"][0]["edge"]["origin"] for p in paths if p["hops"]} == {"paper", "general_knowledge"}
    assert search(spark, data, ["要約一"], HashEmbedder(), SearchConfig(top_k=1))["graph_candidates"] == []
    assert len(search(spark, data, ["要約一"], HashEmbedder(), SearchConfig(top_k=1, generic_concept_threshold=0.7, max_graph_candidates=1))["graph_candidates"]) == 1


def test_paths_are_made_for_candidates_only(spark, data, monkeypatch):
    from quillgraph.operators.traversal import NeighborhoodTraversal, SearchConfig
    from quillgraph.plans import search_papers

    made = []
    plain = NeighborhoodTraversal.traverse
    monkeypatch.setattr(NeighborhoodTraversal, "traverse", lambda self, *a: made.append(a) or plain(self, *a))
    config = SearchConfig(top_k=1, generic_concept_threshold=0.7, max_graph_candidates=1)
    _, found = search_papers.find(spark, data, ["要約一"], HashEmbedder(), config)
    # one walk, and it knows its ends: papers were ranked by counts
    assert len(made) == 1 and len(made[0]) == 5
    assert {r[0] for r in found.paths.select("target_paper_id").distinct().collect()} == {r[0] for r in found.reached.select("paper_id").collect()} == {2}
    plan = found.paths._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.split("target_paper_id")[-1] or "reached-papers" in plan

    class Own:
        def traverse(self, graph, sources, n_papers, config):
            return plain(NeighborhoodTraversal(), graph, sources, n_papers, config)

    _, other = search_papers.find(spark, data, ["要約一"], HashEmbedder(), config, Own())
    names = found.paths.columns
    assert {tuple(map(str, r)) for r in other.paths.select(names).collect()} == {tuple(map(str, r)) for r in found.paths.collect()}


def test_the_manifest_lists_the_papers(spark, data, tmp_path):
    import shutil

    assert index_store.read_manifest(spark, data).paper_ids == [1, 2, 3]
    shutil.copytree(f"{data}/index", tmp_path / "index")
    (tmp_path / "index/.manifest.json.crc").unlink(missing_ok=True)
    kept = json.loads((tmp_path / "index/manifest.json").read_text())
    (tmp_path / "index/manifest.json").write_text(json.dumps(kept | {"paper_ids": [1, 2, 4]}))
    with pytest.raises(corpus.Invalid, match="manifest_paper.*4.*paper_listed.*3"):
        index_store.read_index(spark, str(tmp_path), check=True)


def test_queries_and_models_are_checked(spark, data):
    for bad in ([], [" "], ["a", "a"]):
        with pytest.raises(ValueError):
            check_queries(bad)
    other = HashEmbedder()
    other.model_name = "other"
    with pytest.raises(ModelMismatch):
        search(spark, data, ["x"], other)


def test_commands(spark, data, capsys):
    code, out = cli.run(spark, cli.parser().parse_args(["search", "要約二", "--data-dir", data, "--embedder", "fake", "--top-k", "2"]))
    assert code == cli.OK and out["status"] == "ok" and out["queries"] == ["要約二"]
    assert cli.run(spark, cli.parser().parse_args(["papers", "--data-dir", data]))[1]["papers"][0] == {"id": 1, "title": "Walking graphs"}
    code, out = cli.run(spark, cli.parser().parse_args(["search", "x", "--data-dir", data + "/none", "--embedder", "fake"]))
    assert code == cli.ERROR and out["status"] == "error"
    code, out = cli.run(spark, cli.parser().parse_args(["search", "要約二", "--data-dir", data, "--embedder", "fake", "--top-k", "2", "--output", data + "/found"]))
    assert code == cli.OK and spark.read.parquet(out["tables"]["candidates"]).where("kind = 'direct'").count() == spark.read.parquet(out["tables"]["hits"]).select("paper_id").distinct().count()
    for args in (["search", "x", "--top-k", "0"], ["--version"], ["normalize", "--version"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(args)
    assert cli._agent(cli.parser().parse_args(["extract", "3", "--agent", "a b", "--model", "m"])).command == ["a", "b", "--model", "m"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["search", "x", "--generic-concept-threshold", "2"])


def test_versions_and_files(spark, tmp_path):
    d = write(tmp_path / "d", extractions=False)
    with pytest.raises(MissingExtractions) as e:
        build_index(spark, d, HashEmbedder())
    assert e.value.paper_ids == [1, 2, 3]
    with pytest.raises(corpus.NotFound):
        index_store.read_manifest(spark, d)
    (tmp_path / "d/index").mkdir()
    for text, kind in (("{", corpus.Unreadable), ('{"schema_version": 2}', corpus.Incompatible), ('{"schema_version": 1, "domain_model_version": 1}', corpus.Invalid)):
        (tmp_path / "d/index/manifest.json").write_text(text)
        with pytest.raises(kind):
            index_store.read_manifest(spark, d)
    (tmp_path / "d/papers/0001/pages/002.md").rename(tmp_path / "d/papers/0001/pages/004.md")
    with pytest.raises(corpus.Invalid, match="002.md is missing"):
        corpus.papers(spark, d)
    meta = tmp_path / "d/papers/0002/paper.json"
    meta.write_text(meta.read_text().replace('"id": 2', '"id": 2, "colour": "red"'))
    with pytest.raises(corpus.Invalid, match="colour: unknown field"):
        corpus.paper_meta(spark, d)
    (tmp_path / "d/papers/index.json").write_text('{"papers": [{"id": 1, "title": "a"}, {"id": 1, "title": "b"}]}')
    with pytest.raises(corpus.Invalid, match="repeats"):
        corpus.paper_ledger(spark, d)


def test_rejections(spark, tmp_path, data):
    d = write(tmp_path / "d")
    bad = json.loads(json.dumps(EXTRACTIONS[2]))
    bad["paper_concepts"][0]["evidence"][0]["quote"] = "not there"
    (tmp_path / "d/papers/0002/extraction.json").write_text(json.dumps(bad))
    with pytest.raises(Rejected) as e:
        build_index(spark, d, HashEmbedder())
    assert e.value.reason == "extraction_mismatch" and e.value.rows == [{"paper_id": 2, "path": "paper_concepts[0].evidence[0].quote", "message": "is not found in the text of page 1"}]
    code, out = cli.run(spark, cli.parser().parse_args(["build", "--data-dir", d, "--embedder", "fake"]))
    assert code == cli.INVALID and out == {"status": "invalid", "reason": "extraction_mismatch", "papers": [{"paper_id": 2, "issues": [{"path": "paper_concepts[0].evidence[0].quote", "message": "is not found in the text of page 1"}]}]}
    (tmp_path / "d/papers/0002/extraction.json").write_text(json.dumps(EXTRACTIONS[2]))
    (tmp_path / "d/normalization").mkdir()
    for name in ("concepts", "concept_relations"):
        (tmp_path / f"d/normalization/{name}.json").write_text(open(f"{data}/normalization/{name}.json").read())
    with pytest.raises(Rejected) as e:
        build_index(spark, d, HashEmbedder(), 2)
    assert e.value.reason == "unresolved_evidence" and {"paper_id": 1, "page": 2, "quote": "Reading lists matter."} in e.value.rows
    value = json.loads((tmp_path / "d/normalization/concepts.json").read_text())
    value["concepts"] = value["concepts"][:2]
    (tmp_path / "d/normalization/concepts.json").write_text(json.dumps(value))
    with pytest.raises(Rejected) as e:
        build_index(spark, d, HashEmbedder())
    assert e.value.reason == "normalization_mismatch"


def test_extraction_is_asked_again_with_what_was_wrong(spark, tmp_path):
    d = write(tmp_path / "d", extractions=False)
    wrong = json.loads(json.dumps(EXTRACTIONS[3]))
    wrong["paper_concepts"][0]["evidence"][0]["quote"] = "invented"
    agent = ScriptedAgent([{"schema_version": 1}, wrong, EXTRACTIONS[3]])
    done = extract(spark, d, 3, agent)
    assert done["attempts"] == 3 and json.loads(open(done["path"]).read()) == EXTRACTIONS[3]
    assert "is not found in the text of page 1" in agent.prompts[2] and "rejected" not in agent.prompts[0]
    with pytest.raises(Rejected):
        extract(spark, d, 3, ScriptedAgent([wrong]), max_attempts=1)
    with pytest.raises(corpus.NotFound):
        extract(spark, d, 9, ScriptedAgent([]))


def test_command_agent():
    assert CommandAgent(["python", "-c", "import sys; sys.stdin.read(); print('{\"a\": 1}')"]).answer("p", {}) == {"a": 1}
    for bad in (["python", "-c", "print('no json')"], ["python", "-c", "raise SystemExit(3)"], ["/does/not/exist"]):
        with pytest.raises(AgentError):
            CommandAgent(bad).answer("p", {})


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n')
    rows = [(r["row_idx"], r["line"], r["id"], r["n"]) for r in index_store.import_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int", "id").orderBy("row_idx").collect()]
    assert rows == [(0, 1, "x", 1), (1, 3, "y", 2)]
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n{"id": "x"}\n')
    with pytest.raises(corpus.Invalid, match="repeats id 'x' in line 2"):
        index_store.import_json_lines(spark, str(tmp_path / "b.jsonl"), "id string", "id")
    (tmp_path / "c.jsonl").write_text('{"id": ')
    with pytest.raises(corpus.Invalid, match="malformed line 1"):
        index_store.import_json_lines(spark, str(tmp_path / "c.jsonl"), "id string")
    import numpy as np

    np.save(tmp_path / "v.npy", np.ones((3, 2), np.float32))
    assert index_store.import_vectors(spark, str(tmp_path / "v.npy")).count() == 3
