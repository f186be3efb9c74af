import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import term_counts as T

SCHEMA = "term string, record bigint, n string"


def frame(spark, rows):
    return spark.createDataFrame([(t, r, "clash") for t, r in rows], SCHEMA)


def count(rows):
    rows = [r for r in rows if r[0] is not None]
    n, p = Counter(t for t, _ in rows), {t: len({r for u, r in rows if u == t}) for t, _ in rows}
    return {(t, n[t], p[t]) for t in n}


def test_deltas_give_what_a_recount_gives(spark, tmp_path):
    random.seed(1)
    path = str(tmp_path / "s")
    now: list = []
    for _ in range(3):
        added = [(random.choice([*"abcdefg", None]), random.randint(1, 5)) for _ in range(40)] + [("hot", n) for n in range(20)]
        gone = random.sample(now, len(now) // 3)
        for g in gone:
            now.remove(g)
        now += added
        # each change set meets a store that was opened anew
        T.TermCountStore(spark, path, rows_per_part=20).apply(frame(spark, added), frame(spark, gone), "term", "record")
        store = T.TermCountStore(spark, path)
        assert {tuple(r) for r in store.counts().collect()} == count(now)
        assert store.rows == len({r for r in now if r[0] is not None}) and store.parts * 20 >= store.rows
    assert store.parts > 1 and store.version == 3
    assert {str(p) for p in (tmp_path / "s").glob("v*")} == {*store.at.values(), *store.former}


def test_a_deletion_may_come_first(spark, tmp_path):
    store = T.TermCountStore(spark, str(tmp_path / "s"))
    store.apply(None, frame(spark, [("a", 1)]), "term", "record")
    assert store.counts().count() == 0
    store.apply(frame(spark, [("a", 1), ("a", 2)]), None, "term", "record")
    assert [tuple(r) for r in store.counts().collect()] == [("a", 1, 1)]


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    store = T.TermCountStore(spark, str(tmp_path / "s"), rows_per_part=2)
    store.apply(frame(spark, [(t, 1) for t in "abcdefghijkl"]), None, "term", "record")
    before = dict(store.at)
    assert store.parts == 8
    store.rows_per_part = 100
    store.apply(frame(spark, [("a", 9)]), None, "term", "record")
    assert sum(before[p] != store.at[p] for p in before) == 1


def test_empty(spark, tmp_path):
    assert T.TermCountStore(spark, str(tmp_path / "s")).counts().count() == 0
    store = T.TermCountStore(spark, str(tmp_path / "t"))
    store.apply(frame(spark, []), None, "term", "record")
    assert store.counts().count() == 0


def test_a_broken_change_set_leaves_the_state_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    T.TermCountStore(spark, path).apply(frame(spark, [("a", 1)]), None, "term", "record")
    bad = frame(spark, [("b", 1)]).withColumn("record", F.expr("raise_error('lost')").cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        T.TermCountStore(spark, path).apply(bad, None, "term", "record")
    assert [tuple(r) for r in T.TermCountStore(spark, path).counts().collect()] == [("a", 1, 1)]
    T.TermCountStore(spark, path).apply(frame(spark, [("b", 1)]), frame(spark, [("a", 1)]), "term", "record")
    assert [tuple(r) for r in T.TermCountStore(spark, path).counts().collect()] == [("b", 1, 1)]
    T.TermCountStore(spark, path + "x").apply(frame(spark, [("a", 1)]), frame(spark, [("a", 1)]), "term", "record")


def test_marks_and_spelling(spark):
    edges = [(1, " Common_Id\t"), (2, "common-id"), (3, "COMMON-ID"), (3, "common-id"), (1, "rare-one"), (1, "rare-one"), (1, "two"), (2, "two"), (4, None)]
    pc = spark.createDataFrame([(p, c, None) for p, c in edges], "paper_id bigint, concept_id string, recorded_at timestamp")
    concepts = spark.createDataFrame([("common-id",), ("Two",), (None,)], "id string")
    papers = spark.createDataFrame([(n,) for n in range(1, 6)], "id bigint")
    got = {tuple(r) for r in T.concept_counts(pc, concepts, papers, 0.4).collect()}
    assert got == {("common-id", 4, 3, "common"), ("rare-one", 2, 1, "rare"), ("Two", 2, 2, None)}
    assert T.concept_counts(pc.limit(0), concepts, papers.limit(0), 0.4).count() == 0
