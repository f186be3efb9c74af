import pytest

from quillgraph.operators import graph as G
from quillgraph.plans.build_index import Findings, Rejected, findings


def test_all_findings_are_counted_and_kept(spark):
    df = spark.range(25, numPartitions=4).selectExpr("24 - id AS n")
    got = findings(df, 10)
    assert [r["n"] for r in got] == list(range(10)) and got.total == 25
    assert sorted(r["n"] for r in spark.read.parquet(got.table).collect()) == list(range(25))
    more = got.each(lambda r: {"path": r["n"]}) + [{"path": "x"}]
    assert (len(more), more.total, more.table) == (11, 26, got.table)
    assert str(Rejected("merge", more)) == f"merge: 26 findings, all in {got.table}"


def test_few_findings_need_no_table(spark):
    got = findings(spark.range(10), 10)
    assert (len(got), got.total, got.table) == (10, 10, None)
    assert str(Rejected("merge", [{}])) == "merge: 1 findings" and not findings(spark.range(0)) and Findings().total == 0


def test_graph_errors_count_all_rows(spark):
    edges = spark.createDataFrame([(n, "uses", [(1, "q")]) for n in range(30, 0, -1)], "paper_id bigint, relation string, evidence array<struct<page:int,quote:string>>")
    with pytest.raises(G.GraphError) as e:
        G._with_chunks(edges, spark.createDataFrame([], "paper_id bigint, page int, quote string, chunk_id string"))
    assert str(e.value).endswith("(5, 1, 'q') and 25 more") and e.value.total == 30
