import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X

SAMPLES = [None, "", " ", "a", "  a \t b 　c\x1c ", "one\r\ntwo\n\nthree four\n", "\n", "# H\nx", "Åb Ç-d__E!!", "日本語", "Deep   Learning (v2)", "x\x85y\x0bz\x0c", "-a-", "ends\r"]


def apply(spark, column):
    df = spark.createDataFrame([(n, s) for n, s in enumerate(SAMPLES)], "n int, s string")
    return [r[0] for r in df.orderBy("n").select(column(F.col("s")).alias("x")).collect()]


def expected(f):
    return [None if s is None else f(s) for s in SAMPLES]


def test_white_space(spark):
    assert apply(spark, X.normalize_whitespace) == expected(lambda s: " ".join(s.split()))
    assert apply(spark, X.strip) == expected(str.strip)
    assert apply(spark, X.count_tokens) == expected(lambda s: len(s.split()))


def test_lines(spark):
    assert apply(spark, X.split_lines) == expected(str.splitlines)


def test_slug(spark):
    assert apply(spark, X.slug) == expected(lambda s: re.sub("[^a-z0-9]+", "-", s.lower()).strip("-"))


def test_every_space_of_the_plane(spark):
    spaces = [chr(c) for c in range(0xD800) if chr(c).isspace()]
    df = spark.createDataFrame([(f"a{c}b",) for c in spaces], "s string")
    assert {r[0] for r in df.select(X.normalize_whitespace(F.col("s"))).collect()} == {"a b"}


def test_names(spark):
    r = spark.range(1).select(X.paper_directory(F.lit(7)), X.paper_directory(F.lit(12345)), X.page_file(F.lit(3)), X.paper_node(F.lit(9)), X.error_path("concepts", 2, "merged_from", 0), X.error_path()).first()
    assert tuple(r) == ("0007", "12345", "003.md", "paper:9", "concepts[2].merged_from[0]", "<root>")


@pytest.mark.parametrize(("aliases", "description", "want"), [([], "", "N"), (["a", "b"], None, "N (a, b)"), (None, "text", "N\ntext"), (["a"], "text", "N (a)\ntext")])
def test_concept_text(spark, aliases, description, want):
    df = spark.createDataFrame([("N", aliases, description)], "n string, a array<string>, d string")
    assert df.select(X.concept_text(F.col("n"), F.col("a"), F.col("d"))).first()[0] == want


def test_fold(spark):
    df = spark.createDataFrame([(" A_b\t",), (None,)], "s string")
    assert [r[0] for r in df.select(X.fold_id(F.col("s"))).collect()] == ["a-b", None]
