import random
import re

import pytest

from quillgraph.llm import splitting
from quillgraph.llm.splitting import split_characters, split_pages, split_words

SCHEMA = "text string, most int, shared int, pieces string, _split int"


def pieces(spark, text, most, shared=0):
    df = spark.createDataFrame([(text, most, shared, "clash", 7)], SCHEMA)
    r = split_words(df, "text", "most", "shared").first()
    assert r["_split"] == 7
    return r["n_words"], r["pieces"]


@pytest.mark.parametrize(("most", "shared"), [(5, 0), (7, 2), (20, 19), (1, 0), (3, 50)])
def test_every_word_in_order_within_the_limit(spark, most, shared):
    random.seed(most)
    text = "".join(f"w{n}{random.choice([' ', ', ', '. ', chr(10), chr(10) * 2, chr(0x3000), chr(0xA0)])}" for n in range(97))
    n, got = pieces(spark, text, most, shared)
    assert n == 97
    words = text.split()
    o = min(shared, most - 1)
    assert all(1 <= len(p.split()) <= most for p in got)
    seen = got[0].split()
    for a, b in zip(got, got[1:], strict=False):
        back = min(o, len(seen))
        assert b.split()[:back] == seen[len(seen) - back :]
        seen += b.split()[back:]
    assert seen == words


def test_natural_boundaries_come_first(spark):
    _, got = pieces(spark, "a b c d e.\n\nf g h. i j k l", 7)
    assert got == ["a b c d e.", "f g h. i j k l"]
    _, got = pieces(spark, "a b c d e. f g h i", 6)
    assert got == ["a b c d e.", "f g h i"]


def test_a_wrapped_line_is_no_paragraph_whatever_its_break(spark):
    for end in ("\n", "\r\n", "\r", "\u2028"):
        assert pieces(spark, f"a b c{end}d e. f g h{end}{end}i j", 7)[1] == [f"a b c{end}d e.", f"f g h{end}{end}i j"]
        assert pieces(spark, f"a b c{end}d e, f{end}{end}g h i j", 7)[1] == [f"a b c{end}d e, f", "g h i j"]


def test_whole_null_blank_and_markers(spark):
    assert pieces(spark, "a b  c", 3) == (3, ["a b  c"])
    assert pieces(spark, None, 3) == (None, None)
    assert pieces(spark, " \n", 3) == (0, [])
    assert pieces(spark, "a b", None) == (2, None)
    assert pieces(spark, "a b", 0) == (2, None)
    assert pieces(spark, "a b\n<!-- figure: 1 -->\r\n\u3000<!-- equation: 22 -->\u00a0\nc", 3)[0] == 3
    assert pieces(spark, "a <!-- figure: 1 --> c", 9)[0] == 6


def test_marker_lines_stay_in_their_pieces(spark):
    text = "<!-- figure: 1 -->\na b c.\n  <!-- equation: 2 -->\nd e f.\n\n<!-- figure: 3 -->\n<!-- figure: 4 -->\ng h\n<!-- equation: 5 -->\n"
    n, got = pieces(spark, text, 3)
    assert n == 8 and got == ["<!-- figure: 1 -->\na b c.", "  <!-- equation: 2 -->\nd e f.", "<!-- figure: 3 -->\n<!-- figure: 4 -->\ng h\n<!-- equation: 5 -->"]
    assert pieces(spark, text, 8)[1] == [text.strip()]
    assert pieces(spark, "\n<!-- figure: 1 -->\n", 8) == (0, ["<!-- figure: 1 -->"])
    _, lapped = pieces(spark, text, 4, 1)
    assert lapped[1].startswith("c.\n  <!-- equation: 2 -->") and all(len(re.sub("<!--.*?-->", "", p).split()) <= 4 for p in lapped)


def test_limits_of_many_papers_are_joined_without_a_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(1, 1, "a b c d")], "paper_id bigint, page int, text string")
    m = spark.createDataFrame([([1, 2], 3, 0)], "paper_ids array<bigint>, chunk_max_tokens int, chunk_overlap_tokens int")
    plan = lambda: split_pages(pages, m)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(splitting, "MOST_BROADCAST", 1)
    assert "strategy=broadcast" not in plan() and split_pages(pages, m).first()["n_words"] == 4


def test_long_words_take_linear_time(spark):
    n, got = pieces(spark, "今日は晴れ、" * 40_000 + " end. " + "x" * 100_000 + " y z", 2)
    assert n == 5 and [len(p.split()) for p in got] == [2, 2, 1]


def test_very_long_text(spark):
    n, got = pieces(spark, "word " * 60_000, 512, 24)
    assert n == 60_000 and max(len(p.split()) for p in got) <= 512


def test_characters(spark):
    text = "First sentence here. Second one follows!\n\nNew paragraph 今日は晴れ。明日は雨。" * 3 + "x" * 50
    df = spark.createDataFrame([(text,), (None,), ("",), ("short",)], "text string")
    rows = [r["pieces"] for r in split_characters(df, "text", 30).collect()]
    assert "".join(rows[0]) == text and max(map(len, rows[0])) <= 30
    assert rows[1] is None and rows[2] == [] and rows[3] == ["short"]
    assert rows[0][0] == "First sentence here."
    lapped = [r["pieces"] for r in split_characters(df, "text", 30, 10).collect()][0]
    assert max(map(len, lapped)) <= 30 and all(b.startswith(a[-10:]) for a, b in zip(lapped, lapped[1:], strict=False) if len(a) >= 10)
    with pytest.raises(ValueError):
        split_characters(df, "text", 5, 5)


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "a b c d"), (1, 1, "a b c d"), (1, 2, "a b"), (2, 1, "a b c d"), (1, 3, None)], "paper_id bigint, page int, text string")
    m = spark.createDataFrame([([1, 1], 3, None, 5), ([1], 3, None, 5), (None, 1, 1, 5), ([2], None, 1, 5)], "paper_ids array<bigint>, chunk_max_tokens int, chunk_overlap_tokens int, paper_id int")
    got = {(r["paper_id"], r["page"], tuple(r["pieces"] or ())) for r in split_pages(pages, m).collect()}
    assert got == {(1, 1, ("a b c", "d")), (1, 2, ("a b",)), (1, 3, ())} or got == {(1, 1, ("a b", "c d")), (1, 2, ("a b",)), (1, 3, ())}
    assert split_pages(pages.limit(0), m).count() == 0
