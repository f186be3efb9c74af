import pytest

from quillgraph.llm.canonical import CanonicalIndex, content_words, map_to_canonical, within

ENTRIES = [
    ("neural-knowledge-reasoning", "Neural knowledge reasoning", ["NKR"]), ("graph-distillation", "Graph Distillation", None), ("low-rank-query-parsing", "low-rank query parsing", ["LRQP", "parsing of low-rank query data"]),
    ("spectral-caption-labeling", "Spectral caption labeling", []), ("query-parsing", "query parsing", []),
]
INDEX = CanonicalIndex(ENTRIES)


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("NEURAL KNOWLEDGE REASONING", "neural-knowledge-reasoning"), ("neural_knowledge-reasoning", "neural-knowledge-reasoning"), ("NeuralKnowledgeReasoning", "neural-knowledge-reasoning"), ("reasoning of neural knowledges", "neural-knowledge-reasoning"),
        ("reasoning, neural knowledge", "neural-knowledge-reasoning"), ("NKR", "neural-knowledge-reasoning"), ("neural knowlegde reasonng", "neural-knowledge-reasoning"), ("\\emph{neural knowledge reasoning}", "neural-knowledge-reasoning"),
        ("“neural knowledge reasoning”", "neural-knowledge-reasoning"), ("neural knowledge reasoning (NKR)", "neural-knowledge-reasoning"), ("neural knowledge reasoning (ours)", "neural-knowledge-reasoning"), ("our improved graph distillation method", "graph-distillation"),
        ("ｇｒａｐｈ　ｄｉｓｔｉｌｌａｔｉｏｎ", "graph-distillation"), ("graph dístillation.", "graph-distillation"), ("lo-rank query parsing", "low-rank-query-parsing"), ("lowrank query parsings", "low-rank-query-parsing"), ("spect. caption label.", "spectral-caption-labeling"),
    ],
)
def test_forms_of_an_entry(name, want):
    assert INDEX.resolve(name, None)[0] == want


@pytest.mark.parametrize("name", ["neural knowledge parsing", "spectral graph distillation", "neural holipuseye reasoning", "graph", "neural knowledge", "ABC", "N/A", "", None, "   ", "???", "temporal query parsing"])
def test_other_content_words_are_not_the_entry(name):
    assert INDEX.resolve(name, [])[0] == "unmatched"


def test_aliases_decide_where_the_name_says_nothing():
    assert INDEX.resolve("this method", ["", None, "graph distilation"])[0] == "graph-distillation"
    assert INDEX.resolve(None, ["NKR"])[0] == "neural-knowledge-reasoning"
    assert INDEX.resolve("GD", ["Graph Distillation"])[0] == "graph-distillation"
    assert INDEX.resolve("neural holipuseye reasoning", ["Graph Distillation"])[0] == "unmatched"


def test_slips():
    assert within("caption", "csption", 1) and within("graph", "grpah", 1) and within("graph", "graphs", 1) and not within("modeling", "labeling", 1)
    assert content_words("queries of the Graphs") == ("query", "graph")


def test_table(spark):
    rows = [(1, "c1", "NKR", None, "x"), (1, "c1", "NKR", None, "x"), (1, "c2", None, None, "x"), (2, "c1", "graph distillation " * 3000, ["a"], "x")]
    df = spark.createDataFrame(rows, "paper_id bigint, local_id string, name string, aliases array<string>, concept_id string")
    ref = spark.createDataFrame(ENTRIES, "id string, canonical_name string, aliases array<string>")
    got = {(r[0], r[1], r[2]) for r in map_to_canonical(df, ref).collect()}
    assert got == {(1, "c1", "neural-knowledge-reasoning"), (1, "c2", "unmatched"), (2, "c1", "unmatched")}
    assert map_to_canonical(df.limit(0), ref).count() == 0
    assert {r[2] for r in map_to_canonical(df, ref.limit(0)).collect()} == {"unmatched"}


NEAR = [("a", "query summarization", None), ("b", "query summarisation", None)]


def test_the_cosine_and_the_margin_decide_between_entries_that_both_fit(monkeypatch):
    index = CanonicalIndex(NEAR)
    # one slip from the first, two from the second
    assert index.resolve("query summarizatoin", None)[0] == "a" and index.resolve("query summarisatoin", None)[0] == "b"
    plain = CanonicalIndex.candidates
    monkeypatch.setattr(CanonicalIndex, "candidates", lambda self, values: ([(k, 1.0) for k, _ in found] for found in plain(self, values)))
    assert index.resolve("query summarizatoin", None)[0] == "unmatched"


def test_nothing_passes_by_the_index(monkeypatch):
    monkeypatch.setattr(CanonicalIndex, "candidates", lambda self, values: ([] for _ in values))
    assert {INDEX.resolve(n, [n])[0] for n in ("Graph Distillation", "NKR", "query parsing")} == {"unmatched"}


def test_lookups_in_blocks(monkeypatch):
    from quillgraph.llm import canonical

    values = ["Graph Distillation", None, "graph distilation", "no such thing", "", "NKR"] * 3
    whole = INDEX.match(values)
    monkeypatch.setattr(canonical, "SCORES_AT_ONCE", 1)
    assert INDEX.match(values) == whole and [len(e) for e, _ in whole[:6]] == [1, 0, 1, 0, 0, 1]


def test_aliases_in_the_table(spark):
    rows = [(1, "c1", "this method", ["", None, "graph distilation", "NKR"]), (1, "c2", None, None), (None, "c3", "n/a", ["NKR"]), (1, "c4", "spectral graph distillation", ["NKR"]), (1, "c5", "GD", ["Graph Distillation"]), (2, None, "query parsing", [])] + [(9, f"c{n}", "this method", ["NKR"]) for n in range(50)]
    df = spark.createDataFrame(rows, "paper_id bigint, local_id string, name string, aliases array<string>")
    ref = spark.createDataFrame(ENTRIES, "id string, canonical_name string, aliases array<string>")
    got = {(r[0], r[1]): r[2] for r in map_to_canonical(df, ref).collect()}
    assert len(got) == len(rows)
    assert [got[r[0], r[1]] for r in rows] == [INDEX.resolve(r[2], r[3])[0] for r in rows]
