import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import chunking as C

MARK = re.compile(r"<!-- (figure|equation): \d+ -->")


def plain_blocks(text):
    out, held = [], []

    def close():
        if held and (b := "\n".join(held).strip()):
            out.append(b)
        held.clear()

    for line in text.splitlines():
        s = line.strip()
        if MARK.fullmatch(s):
            continue
        if not s or s[0] == "#":
            close()
            if s:
                out.append(s)
        else:
            held.append(line)
    close()
    return out


def plain_chunks(pages, most):
    out = []
    for page, text in pages:
        fit = []
        for b in plain_blocks(text):
            w = b.split()
            fit += [b] if len(w) <= most else [" ".join(w[n : n + most]) for n in range(0, len(w), most)]
        held = []
        for b in fit:
            if held and sum(len(x.split()) for x in held) + len(b.split()) > most:
                out.append((page, "\n\n".join(held)))
                held = []
            held.append(b)
        if held:
            out.append((page, "\n\n".join(held)))
    return [(f"1:{n}", n, p, t) for n, (p, t) in enumerate(out)]


def make_page(rng):
    parts = []
    for _ in range(rng.randint(0, 9)):
        parts.append(rng.choice(["# Head", "  ## Sub  ", "<!-- figure: 3 -->", " <!-- equation: 1 --> ", "", "　", " ".join(["wörd"] * rng.randint(1, 14)), "a  b c"]))
    return rng.choice(["\n", "\r\n"]).join(parts)


@pytest.mark.parametrize("most", [1, 4, 9, 64])
def test_chunks_against_a_plain_loop(spark, most):
    rng = random.Random(most)
    pages = [(n + 1, make_page(rng)) for n in range(25)]
    df = spark.createDataFrame([(1, p, t) for p, t in pages], "paper_id bigint, page int, text string")
    got = [(r["id"], r["idx"], r["page_start"], r["text"]) for r in C.chunk_pages(df, most).orderBy("idx").collect()]
    assert got == plain_chunks(pages, most)

    class Words:
        def count_tokens(self, text):
            return len(text.split())

    again = [(r["id"], r["idx"], r["page_start"], r["text"]) for r in C.chunk_pages(df, most, Words()).orderBy("idx").collect()]
    assert again == got


def test_edges(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, " \n"), (2, 1, "x")], "paper_id bigint, page int, text string")
    assert [tuple(r) for r in C.chunk_pages(df).collect()] == [("2:0", 2, 0, 1, 1, "x")]
    assert C.chunk_pages(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.chunk_pages(df, 0)


def test_markers(spark):
    text = "a\r\n <!-- figure: 12 -->\n\n<!-- equation: 3 -->\n<!-- figure 4 -->\nx <!-- figure: 5 -->"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    rows = [r[0] for r in df.select(C.markers(F.col("t"))).collect()]
    assert [tuple(m) for m in rows[0]] == [("figure", 12, 2), ("equation", 3, 4)]


def test_latest_delivery(spark):
    df = spark.sql("select 1L paper_id, 1 page, 'old' text, timestamp'2024-01-01' loaded_at union all select 1L, 1, 'new', timestamp'2024-02-01' union all select 1L, 2, 'only', null")
    assert {(r["page"], r["text"]) for r in C.latest_pages(df).collect()} == {(1, "new"), (2, "only")}
