import pytest

from quillgraph.llm.truncation import cut_shares, examine, examined_texts, unclosed

BODY = "The encoder groups tables. It works well.\n\n"


@pytest.mark.parametrize(
    "text",
    [
        "The encoder groups tables. It wor", "The encoder groups tables. It works when the…", "The encoder groups tables. It works [...]", "The encoder groups tables. And ...", "今日は晴れ。明日は雨が�",
        "要旨を改善する。ただし見出しが", "The encoder groups tables. They called it “good enough.", BODY + "Table 3\nindex\t2.5\nreran", "It remains open whether the sparse similar thing holds up in", BODY + "[3] Sevo, T. On the Limits, pp. 3",
    ],
)
def test_cut(text):
    assert examine(text)[0] in ("mark", "broken", "open", "prose", "cut_reference", "cut_code")


@pytest.mark.parametrize(
    "text",
    [
        "The encoder groups tables.", "They called it “good enough.”", "Is that enough?", "下がる。", "(See also the appendix.)", "Gut „Ja“.", BODY + "s(q, c) = 16 * d(q) + g(c)", BODY + "for x in y:\n    total += x ** 2\nprint(total)",
        BODY + "Table 37\nscoring head\t43.6", BODY + "Sevo and Tati, Index and abstracts, pp. 96-840", "TBD", "N/A", "0", "-", "Abstract", "", None, " \n", BODY + "SELECT page FROM hits WHERE page <> 3 GROUP BY page",
    ],
)
def test_complete(text):
    assert examine(text)[0] in ("closed", "formula", "code", "table", "reference", "placeholder", "empty")


def test_stack():
    assert unclosed("a (b [c] “d” e") == "(" and unclosed("a) b") == "" and unclosed("„Ja“") == ""


def table(spark, texts):
    return spark.createDataFrame([(n, t, s, "clash") for n, (t, s) in enumerate(texts)], "doc_id bigint, text string, source string, kind string")


def test_the_corpus_tells_whether_an_entry_is_whole(spark):
    whole = [(BODY + "- dense graph walker\n- sparse index\n- late graph walker\n\nDone now.", "a")] * 3 + [(BODY + "- sparse index\n- dense graph walker", "a")]
    cut = [(BODY + "- sparse index\n- dense graph", "b"), (BODY + "- sparse index\n- den", None)]
    rows = {r["doc_id"]: r["cut"] for r in examined_texts(table(spark, whole + cut)).collect()}
    assert rows == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}


def test_without_a_baseline_entries_count_as_whole(spark):
    rows = [(f"Intro here.\n\n- entry {n}\n- thing {n}", "a") for n in "uvwxyz"]
    assert examined_texts(table(spark, rows)).where("cut").count() == 0


def test_shares(spark):
    texts = [("x" * 3 + " tables. It wor", "a"), ("Fine here.", "a"), (None, "a"), ("Cut in the middle of. Thi", None)]
    got = {r["source"]: (r["texts"], r["cut"]) for r in cut_shares(examined_texts(table(spark, texts))).collect()}
    assert got == {"a": (2, 1), None: (1, 1)}
    assert cut_shares(examined_texts(table(spark, []))).count() == 0


def test_very_long_text():
    assert examine("A sentence here. " * 50_000 + "And thi")[0] == "prose"


def test_short_texts_are_whole_if_they_are_placeholders_or_terms_the_corpus_lists(spark):
    listed = [(BODY + "- graph walker\n- late graph walker\n- sparse index\n- index\n\nDone now.", "a")] * 3
    short = ["TBD", "n/a", "Graph walker", "index", "The encoder gro", "We propose a", "graph wal", "late graph", None]
    rows = {r["doc_id"] - 3: r["cut"] for r in examined_texts(table(spark, listed + [(t, "b") for t in short])).where("doc_id > 2").collect()}
    assert [rows[n] for n in range(len(short))] == [False, False, False, False, True, True, True, True, False]


def test_a_source_that_never_writes_terminators_is_not_cut_throughout(spark):
    habit = [("so " * n + "we met the encoder and the graph walker, as planned before the talk on tables with the graph walker", "chat") for n in range(40)]
    other = [("The graph walker, an encoder, sees the graph walker, and the decoder.", "feed")] * 60
    cut = [("we met the encoder and the graph walker, as planned before the talk on tables with the graph wal", "chat"), ("The graph walker sees the graph walker and the", "feed")]
    rows = examined_texts(table(spark, habit + other + cut))
    assert [r["doc_id"] for r in rows.where("cut").orderBy("doc_id").collect()] == [100, 101]


def test_a_small_corpus_still_tells_a_cut_word(spark):
    prose = [("The graph walker, a compact one, beats the sparse index, the dense table and the graph walker.", "a")] * 12 + [("It remains open whether the sparse", "b")] * 2
    ends = [("A list.\n\n- graph walker\n- sparse index\n- dense tab", "b"), ("Keywords: graph walker, sparse ind", "b"), ("A list.\n\n- graph walker\n- sparse index", "a")]
    rows = {r["doc_id"]: r["cut"] for r in examined_texts(table(spark, prose + ends)).where("doc_id > 13").collect()}
    assert rows == {14: True, 15: True, 16: False}


def test_open_elements():
    assert unclosed("a <b>bold <i>x</i> word") == "<" and unclosed("a <b>bold</b> word, x < y and <unk>") == ""
    assert examine("It is here. They called it <em>good enough.")[0] == "open" and examine("It is <em>good</em>.")[0] == "closed"
