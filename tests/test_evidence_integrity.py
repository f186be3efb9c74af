from quillgraph.operators import evidence as E
from quillgraph.operators import graph as G
from quillgraph.operators import integrity as I

EV = "array<struct<page:int,quote:string,chunk_id:string>>"


def test_quotes_in_pages(spark):
    ev = spark.createDataFrame([(1, 0, 0, 1, "two  words"), (1, 0, 1, 9, "x"), (1, 1, 0, 1, "absent"), (1, 2, 0, 2, "x"), (1, 3, 0, 1, None)], "paper_id bigint, edge_pos int, evidence_pos int, page int, quote string")
    pages = spark.createDataFrame([(1, 1, "has two\nwords"), (1, 2, None)], "paper_id bigint, page int, text string")
    counts = spark.createDataFrame([(1, 2)], "paper_id bigint, page_count int")
    got = [(r["path"], r["message"]) for r in E.check_evidence(ev, pages, counts).orderBy("edge_pos", "evidence_pos").collect()]
    assert got == [
        ("paper_concepts[0].evidence[1].page", "page 9 is outside 1..2"), ("paper_concepts[1].evidence[0].quote", "is not found in the text of page 1"),
        ("paper_concepts[2].evidence[0].quote", "is not found in the text of page 2"), ("paper_concepts[3].evidence[0].quote", "is not found in the text of page 1"),
    ]


def test_quotes_in_chunks(spark):
    chunks = spark.createDataFrame([("1:0", 1, 0, 1, 1, "a b c"), ("1:1", 1, 1, 1, 1, "b c d"), ("1:2", 1, 2, 2, 2, "b c")], "id string, paper_id bigint, idx int, page_start int, page_end int, text string")
    ev = spark.createDataFrame([(1, 1, "b\nc"), (1, 1, "b\nc"), (1, 2, "b c"), (1, 1, "c d"), (1, 1, "a d"), (1, 3, "a"), (1, 1, None)], "paper_id bigint, page int, quote string")
    got = {(r["page"], r["quote"]): r["chunk_id"] for r in E.resolve_evidence(ev, chunks).collect()}
    assert got == {(1, "b\nc"): "1:0", (2, "b c"): "1:2", (1, "c d"): "1:1", (1, "a d"): None, (3, "a"): None, (1, None): None}


def test_graph_rules(spark):
    papers = spark.createDataFrame([(1, 0), (1, 1)], "paper_id bigint, corpus_pos int")
    nodes = spark.createDataFrame([("a", "method", 9), ("B!", "odd", 0)], "id string, type string, paper_count int")
    edges = spark.createDataFrame([(1, "a", "uses", []), (1, "a", "uses", []), (2, "zz", "uses", [])], f"paper_id bigint, concept_id string, relation string, evidence {EV}")
    relations = spark.createDataFrame(
        [("a", "a", "is_a", "paper", 1, [(1, "q", "1:0")], None), ("a", "B!", "is_a", "general_knowledge", None, [], " "), ("a", "B!", "odd", "paper", None, [], None)],
        f"source_id string, target_id string, relation string, origin string, paper_id bigint, evidence {EV}, rationale string",
    )
    got = {(r["rule"], r["key"]) for r in I.check_graph(G.Graph(papers, nodes, edges, relations), 2).collect()}
    assert got == {
        ("paper_unique", "1"), ("concept_slug", "B!"), ("concept_type", "B!"), ("concept_count", "a"), ("edge_unique", "1|a|uses"), ("edge_paper", "2"), ("edge_concept", "zz"), ("relation_self", "a|is_a|a"),
        ("relation_origin", "a|is_a|B!"), ("relation_origin", "a|odd|B!"), ("relation_kind", "a|odd|B!"),
    }
    named = {r["rule"]: r["n"] for r in I.summary(I.check_graph(G.Graph(papers, nodes, edges, relations), 2)).collect()}
    assert named["relation_origin"] == 2


def test_many_offenders_are_named_five_and_counted(spark):
    df = spark.createDataFrame([(str(n),) for n in range(30)], "id string")
    r = I.summary(I.broken(df, "rule", df["id"].isNotNull(), df["id"], "m")).first()
    assert (r["n"], r["named"]) == (30, "0, 1, 10, 11, 12")


def test_extraction_and_item_rules(spark):
    concepts = spark.createDataFrame([(1, "c1", " ", "method"), (1, "x", "n", "odd")], "paper_id bigint, local_id string, name string, type string")
    q = "evidence array<struct<page:int,quote:string>>"
    edges = spark.createDataFrame([(1, "c7", "uses", [])], f"paper_id bigint, local_id string, relation string, {q}")
    relations = spark.createDataFrame([(1, "c1", "c1", "is_a", [(1, "q")])], f"paper_id bigint, source_local string, target_local string, relation string, {q}")
    papers = spark.createDataFrame([(1,), (2,)], "paper_id bigint")
    rules = {r["rule"] for r in I.check_extraction_tables({"papers": papers, "concepts": concepts, "paper_concepts": edges, "concept_relations": relations}).collect()}
    assert rules == {"local_name", "local_form", "local_type", "no_concept", "edge_declared", "edge_evidence", "local_self"}
    items = spark.createDataFrame([("chunk", "1:0", 1, [1.0]), ("chunk", "2:0", 1, [1.0]), ("summary", "1", 1, [1.0, 2.0]), ("concept", "a", 3, [1.0]), ("chunk", "1:0", 1, [1.0])], "kind string, ref string, paper_id bigint, vector array<float>")
    got = {(r["rule"], r["key"]) for r in I.check_items(items, 1).collect()}
    assert got == {("item_ref", "chunk|2:0"), ("item_ref", "concept|a"), ("item_vector", "summary|1"), ("item_unique", "chunk|1:0")}
    chunks = spark.createDataFrame([("1:0", 1, 1, 2, 1, " ")], "id string, paper_id bigint, idx int, page_start int, page_end int, text string")
    assert {r["rule"] for r in I.check_chunks(chunks).collect()} == {"chunk_pages", "chunk_id", "chunk_text"}
