"""Problem 2: markup residue in page texts.

A page is converted construct by construct: code and formulas are set aside first, so that nothing inside
them is taken for markup, then HTML, LaTeX, wiki and Markdown constructs become plain text that keeps
headings, lists, code, formulas, tables and the figure and equation markers. Each conversion notes its
syntax, and constructs of one syntax never turn into those of another: list items and headings made of HTML
or LaTeX carry marks of their own until the end. A construct may be as long as its paragraph.

Of what is left, the line-block distribution locates the body: text lengths, navigation links left out, are
summed over a sliding window of lines; a surge opens a stretch of text, a dive ends it, and what lies between
them is kept. Outside stand menus and template remains, which are dropped; structural lines always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

FAMILIES = ("html", "markdown", "wiki", "latex")
#: Lines in a window, blank ones not counted; text length from which a window is a surge.
WINDOW, SURGE = 3, 2
#: Own marks in a text under conversion, taken out of the input: a set-aside part, a heading, an item, a link.
_PART, _END, _HEAD, _ITEM, _LINK, _LINKED = "\x02", "\x03", "\x04", "\x05", "\x06", "\x07"
_UNMARKED = dict.fromkeys(range(2, 8))
#: Text up to a paragraph's end that holds none of the given signs: one pass, no way back.
_SPAN = r"(?:[^{0}\n]++|\n(?!\s*\n))"

#: The element names of HTML.
TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark "
    "meta nav noscript object ol optgroup option p param pre q ref rp rt ruby samp script section select small span strike strong style sub "
    "summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
)
# elements that show nothing without attributes, written bare, are placeholders of a vocabulary
_TAG = re.compile(rf"<(?!(?:input|img|link|meta|param|iframe|object)>)(/?)({'|'.join(TAGS.split())})((?:\s[^<>]*)?)/?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_MARKER = re.compile(r"(?m)^[^\S\n]*<!-- (figure|equation): (\d+) -->[^\S\n]*$")
_COMMENT = re.compile(r"<!--(?:[^-<]++|-(?!->)|<(?!!--))*+-->|<!DOCTYPE[^<>]*>", re.S | re.I)
_HIDDEN = re.compile(r"<(script|style)\b[^<>]*>(?:[^<]++|<(?!/?\1\b))*+</\1\s*>", re.S | re.I)
_TABULAR = re.compile(r"\\begin\{tabular\*?\}(?:[^\\]++|\\(?!(?:begin|end)\{tabular))*+\\end\{tabular\*?\}", re.S)

_CODE = re.compile(
    r"(?P<fence>^[^\S\n]{0,3}(?P<mark>`{3,}|~{3,})[^\n`]*\n(?P<body>.*?)(?:^[^\S\n]{0,3}(?P=mark)[`~]*[^\S\n]*$|\Z))"
    # up to the next tag of the same name, so that openers without an end cost one pass together
    r"|(?P<pre><pre\b[^<>]*>(?P<inner>(?:[^<]++|<(?!/?pre\b))*+)</pre\s*>)"
    r"|(?P<source><(?P<tag>syntaxhighlight|source|nowiki)\b[^<>]*>(?P<listing>(?:[^<]++|<(?!/?(?P=tag)\b))*+)</(?P=tag)\s*>)"
    r"|(?P<verbatim>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(?P<text>.*?)(?:\\end\{(?P=env)\}|\Z))"
    r"|(?P<html><code\b[^<>]*>(?P<short>(?:[^<]++|<(?!/?code\b))*+)</code\s*>)"
    r"|(?P<inline>(?<![`\\])`(?!`)(?P<span>" + _SPAN.format("`") + r"++)`(?!`))",
    re.S | re.M | re.I,
)
_MATH = re.compile(
    r"\$\$(?P<a>.+?)\$\$|(?<!\\)\\\[(?P<b>(?:(?!\\\[).)+?)\\\]|\\begin\{(?P<env>equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|math)\}(?P<c>.*?)(?:\\end\{(?P=env)\}|\Z)"
    r"|\\\((?P<d>(?:(?!\\[()])[^\n]|\n(?!\s*\n))+)\\\)|(?<![\\$\w])\$(?![\s\d$])(?P<e>" + _SPAN.format("$") + r"++)(?<![\s\\])\$(?![\w$])|(?<![\\$\w])\$(?P<f>\d(?=[^$\n]*[\\^_])[^$\n]*+)(?<!\s)\$(?![\w$])",
    re.S,
)
_LATEX_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_LATEX_HEADING = re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}]*)\}")
_LATEX_CITE = re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|autoref|label|pageref|bibliography|bibliographystyle|usepackage|documentclass|vspace|hspace|input|include)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
_LATEX_ARGUMENT = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_LATEX_SWITCH = re.compile(r"\{\\(?:it|bf|em|sc|tt|rm|sf|sl|small|large|itshape|bfseries)\b\s*([^{}]*)\}")
_LATEX_ITEM = re.compile(r"(?m)^[^\S\n]*\\item(?:\[([^\]\n]*)\])?[^\S\n]*")
_LATEX_RULE = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|newline|newpage|noindent|maketitle|centering|par|bigskip|medskip|smallskip|ldots|dots|LaTeX|TeX|textbackslash|cdot|times)\b(?![\\\w])")
_LATEX_ESCAPE = re.compile(r"(?<![\\\w:])\\([%&_#{}$])|(?<=[\w.])\\([%&])")

_WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)^\|\}[^\n]*$", re.S | re.M)
_WIKI_HEADING = re.compile(r"^(={1,6})[^\S\n]*([^=\n](?:[^\n]*[^=\n])?)[^\S\n]*\1[^\S\n]*$", re.M)
_WIKI_HIDDEN = re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei|Fichier|Catégorie|ファイル|カテゴリ)\s*:[^\[\]]*\]\]|^#REDIRECT\s*\[\[[^\[\]]*\]\]|(?<!\w)__[A-Z]{3,}__(?!\w)", re.I | re.M)
_WIKI_MAGIC = re.compile(r"(?<!\w)__[A-Z]{3,}__(?!\w)")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{(?=[^\W\d_]|#|:)[^{}]*\}\}")
_WIKI_EXTERNAL = re.compile(r"(?<!\])\[(?:https?|ftp)://[^\s\]]+\s+([^\]\n]+)\](?!\()")
_WIKI_QUOTES = re.compile(r"(?<!['`\w])('{2,5})(?!['\s])((?:[^'\n]++|'(?!')|\n(?!\s*\n))++)(?<!\s)\1(?!')")

_BULLET = re.compile(r"^(\s*)([-*+])[^\S\n]+(?=\S)(?:\[[ xX]\][^\S\n]+)?")
_ORDERED = re.compile(r"^\s{0,3}(\d{1,3})[.)][^\S\n]+(?=\S)")
_QUOTE = re.compile(r"^\s{0,3}>(?:[^\S\n]+|>|$)(?!=)")
_ATX = re.compile(r"^\s{0,3}(#{1,6})[^\S\n]+(\S.*?)(?:[^\S\n]+#+)?[^\S\n]*$")
_UNDERLINE = re.compile(r"^\s{0,3}(?:={3,}|-{3,})\s*$")
_RULE = re.compile(r"^\s{0,3}(?:(?:-\s?){3,}|(?:\*\s?){3,}|(?:_\s?){3,})\s*$")
_MD_ROW = re.compile(r"^\s*\|.*\|\s*$")
_MD_LINE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
_MD_IMAGE = re.compile(r"!\[(" + _SPAN.format(r"\[\]") + r"*+)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_MD_LINK = re.compile(r"(?<!\[)\[(" + _SPAN.format(r"\[\]") + r"++)\](?:\([^()\s]+(?:\s+\"[^\"]*\")?\)|\[[^\[\]\s]+\])")
_MD_DEFINITION = re.compile(r"(?m)^\s{0,3}\[(?!\^)[^\[\]\n]+\]:[^\S\n]+\S+[^\S\n]*$")
_MD_NOTE = re.compile(r"\[\^[^\s\[\]]+\](:[^\S\n]*)?")
_MD_URL = re.compile(r"<(?:https?://|mailto:)[^<>\s]+>")
_MD_STARS = re.compile(r"(?<![\w*\\])(\*{1,3})(?![\s*])(" + _SPAN.format("*") + r"++)(?<![\s*])\1(?![\w*])")
# two underscores around one word are an identifier
_MD_UNDERS = re.compile(r"(?<![\w\\])(_{1,3})(?![\s_])((?:[^_\n]++|(?<=[^\W_])_(?=[^\W_])|\n(?!\s*\n))++)(?<![\s_])\1(?!\w)")
_DUNDER = re.compile(r"__\w+?__(?!\w)")
_MD_STRIKE = re.compile(r"(?<!~)~~(?![\s~])(" + _SPAN.format("~") + r"++)(?<![\s~])~~(?!~)")


class _Page:
    """The text under conversion, what was set aside, and the syntaxes seen."""

    def __init__(self, text: str):
        self.text = re.sub("\r\n?|[\u2028\u2029\x85]", "\n", text)
        self.aside: list[tuple[str, str]] = []
        self.seen: set[str] = set()

    def keep(self, kind: str, text: str) -> str:
        self.aside.append((kind, text))
        return f"{_PART}{len(self.aside) - 1}{_END}"

    def sub(self, pattern: re.Pattern, family: str, to) -> bool:
        """Replaces each construct and notes its syntax; whether there was one."""
        text, n = pattern.subn(to, self.text)
        if n:
            self.seen.add(family)
            self.text = text
        return n > 0

    def nested(self, pattern: re.Pattern, family: str, to) -> None:
        """The same from the inside out, until none is left."""
        while self.sub(pattern, family, to):
            pass


def _set_aside(page: _Page) -> None:
    page.text = _MARKER.sub(lambda m: page.keep("marker", f"{m[1]} {m[2]}"), page.text)

    def code(m: re.Match) -> str:
        if m["fence"]:
            page.seen.add("markdown")
            return page.keep("code", m["body"].rstrip("\n"))
        if m["pre"] or m["html"]:
            page.seen.add("html")
            inner = m["inner"] if m["pre"] else m["short"]
            if m["html"] and "\n" not in inner:
                return page.keep("span", unescape(_TAG.sub("", inner)))
            return page.keep("code", unescape(_TAG.sub("", inner)).strip("\n"))
        if m["source"]:
            page.seen.add("wiki")
            return page.keep("code" if "\n" in m["listing"] else "span", m["listing"].strip("\n"))
        if m["verbatim"]:
            page.seen.add("latex")
            return page.keep("code", m["text"].strip("\n"))
        page.seen.add("markdown")
        return page.keep("span", m["span"])

    if "`" in page.text or "~~~" in page.text or "<" in page.text or "\\begin" in page.text:
        page.text = _CODE.sub(code, page.text)
    if "<" in page.text:
        page.sub(_HIDDEN, "html", " ")
        page.sub(_COMMENT, "html", " ")

    def formula(m: re.Match) -> str:
        body = next(v for k, v in m.groupdict().items() if k != "env" and v is not None).strip()
        return page.keep("span" if m["d"] or m["e"] or m["f"] else "formula", body)

    if "$" in page.text or "\\" in page.text:
        page.sub(_MATH, "latex", formula)


def _html(page: _Page) -> None:
    if "&" in page.text:
        # references are read last, so that what they write isn't taken for markup
        page.sub(re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|(?:" + "|".join(_names(page.text)) + r"));"), "html", lambda m: page.keep("span", unescape(m[0])))
    if "<" not in page.text:
        return

    def tag(m: re.Match) -> str:
        name = m[2].lower()
        if name == "a":
            return _LINKED if m[1] else _LINK
        if m[1]:
            return "\n" if name in ("p", "div", "li", "tr", "table", "ul", "ol", "blockquote", "section", "h1", "h2", "h3", "h4", "h5", "h6") else " | " if name in ("td", "th") else ""
        if name == "br":
            return "\n"
        if name == "li":
            return "\n" + _ITEM
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "\n" + _HEAD
        return "\n" if name in ("p", "div", "tr", "table", "ul", "ol", "blockquote", "section", "hr") else ""

    page.sub(_TAG, "html", tag)
    page.text = re.sub(r" \| (?=\n)", "", page.text)


def _names(text: str) -> list[str]:
    return sorted({m[1:-1] for m in _ENTITY.findall(text) if m[1] != "#" and m[1:] in html5}) or ["(?!)"]


def _latex(page: _Page) -> None:
    if "\\" not in page.text:
        return
    if "\\begin{tabular" in page.text:
        page.text = _TABULAR.sub(lambda m: re.sub(r"[^\S\n]*\\\\[^\S\n]*(?:\\hline)?", "", re.sub(r"[^\S\n]+&[^\S\n]+", " | ", m[0])), page.text)
    for pattern, to in (
        (_LATEX_ENV, ""), (_LATEX_ITEM, lambda m: f"{_ITEM}{m[1] + ' ' if m[1] else ''}"), (_LATEX_HEADING, lambda m: _HEAD + m[1]), (_LATEX_CITE, ""), (_LATEX_SWITCH, r"\1"),
    ):
        page.sub(pattern, "latex", to)
    page.nested(_LATEX_ARGUMENT, "latex", r"\1")
    page.sub(_LATEX_RULE, "latex", "")
    page.sub(_LATEX_ESCAPE, "latex", lambda m: m[1] or m[2])


def _wiki(page: _Page) -> None:
    t = page.text
    if "{|" in t:
        def table(m: re.Match) -> str:
            rows = [re.sub(r"^[|!]\+?\s*", "", re.sub(r"\s*(?:\|\||!!)\s*", " | ", x)) for x in m[1].split("\n") if x.strip() and not x.startswith("|-")]
            return page.keep("table", "\n".join(rows))

        page.sub(_WIKI_TABLE, "wiki", table)
    if "[[" in t:
        page.sub(_WIKI_HIDDEN, "wiki", "")
        page.sub(_WIKI_LINK, "wiki", rf"{_LINK}\1{_LINKED}")
    elif "__" in t or "#R" in t:
        page.sub(_WIKI_MAGIC, "wiki", "")
    if "{{" in t:
        page.nested(_WIKI_TEMPLATE, "wiki", "")
    if "[http" in t or "[ftp" in t:
        page.sub(_WIKI_EXTERNAL, "wiki", rf"{_LINK}\1{_LINKED}")
    if "''" in t:
        page.nested(_WIKI_QUOTES, "wiki", r"\2")
    if "=" in t:
        page.sub(_WIKI_HEADING, "wiki", lambda m: _HEAD + m[2].strip())


#: The signs that a line of Markdown's own may begin with.
_FIRST = frozenset("#=-*_|:>+0123456789")


def _markdown_lines(page: _Page) -> None:
    lines = page.text.split("\n")
    out: list[str] = []
    in_list = in_quote = False
    n = len(lines)
    for i, line in enumerate(lines):
        before = lines[i - 1].strip() if i else ""
        starts = not before or before.startswith((_PART, _HEAD, _ITEM))
        if not line.strip():
            in_list = in_list and False
            in_quote = False
            out.append(line)
            continue
        if line.lstrip()[:1] not in _FIRST:
            out.append(line)
            continue
        if m := _ATX.match(line):
            page.seen.add("markdown")
            out.append(_HEAD + m[2])
            continue
        if _UNDERLINE.match(line):
            if before and not _UNDERLINE.match(before) and not _MD_ROW.match(before) and out and out[-1].strip():
                page.seen.add("markdown")
                if not out[-1].startswith(_HEAD):
                    out[-1] = _HEAD + out[-1].strip()
                continue
            if "-" in line and starts:
                page.seen.add("markdown")
                continue
        if _RULE.match(line) and starts:
            page.seen.add("markdown")
            continue
        if _MD_LINE.match(line) and "|" in line and "|" in before:
            page.seen.add("markdown")
            continue
        if _MD_ROW.match(line) and (_ruled(lines, i) or (i + 1 < n and _MD_LINE.match(lines[i + 1]))):
            page.seen.add("markdown")
            out.append(" | ".join(c.strip() for c in line.strip().strip("|").split("|")))
            continue
        if _QUOTE.match(line) and (starts or in_quote):
            page.seen.add("markdown")
            in_quote = True
            out.append(re.sub(r"^\s{0,3}(?:>\s?)+", "", line))
            continue
        if m := _BULLET.match(line):
            follows = i + 1 < n and bool(_BULLET.match(lines[i + 1]))
            if starts or in_list or before.endswith(":") or out and out[-1].startswith(_HEAD) or follows and not line[m.end() : m.end() + 1].isdigit():
                page.seen.add("markdown")
                in_list = True
                out.append(f"{m[1]}{_ITEM}{line[m.end() :]}")
                continue
        if (m := _ORDERED.match(line)) and (starts or in_list) and _counts(lines, i, int(m[1])):
            page.seen.add("markdown")
            in_list = True
        out.append(line)
    page.text = "\n".join(out)


def _ruled(lines: list[str], i: int) -> bool:
    """Whether the rows above line i lead to a table's dividing line."""
    for j in range(i - 1, -1, -1):
        if _MD_LINE.match(lines[j]) and "|" in lines[j]:
            return True
        if not _MD_ROW.match(lines[j]):
            return False
    return False


def _counts(lines: list[str], i: int, number: int) -> bool:
    """Whether a neighbouring line carries the next or the former number of the list."""
    for j, want in ((i + 1, number + 1), (i - 1, number - 1)):
        if 0 <= j < len(lines) and (m := _ORDERED.match(lines[j])) and int(m[1]) == want:
            return True
    return False


def _markdown(page: _Page) -> None:
    _markdown_lines(page)
    t = page.text
    if "[" in t:
        page.sub(_MD_IMAGE, "markdown", r"\1")
        page.sub(_MD_LINK, "markdown", rf"{_LINK}\1{_LINKED}")
        page.sub(_MD_DEFINITION, "markdown", "")
        page.sub(_MD_NOTE, "markdown", "")
    if "<" in t:
        page.sub(_MD_URL, "markdown", lambda m: m[0][1:-1])
    if "*" in t:
        page.nested(_MD_STARS, "markdown", r"\2")
    if "_" in t:
        page.text = _DUNDER.sub(lambda m: page.keep("span", m[0]), page.text)
        page.nested(_MD_UNDERS, "markdown", r"\2")
    if "~~" in t:
        page.sub(_MD_STRIKE, "markdown", r"\1")


_ASIDE = re.compile(f"{_PART}(\\d+){_END}")
_ANCHOR = re.compile(f"{_LINK}[^{_LINK}{_LINKED}]*{_LINKED}?")
_MARKS = re.compile("[\x02-\x07]")
_SIGN = re.compile(r"[^\W_]")

#: A line laid out: kind, text, text length outside links, that in links, links.
_Line = tuple[str, str, int, int, int]


def _size(text: str) -> int:
    """The text length: signs without blanks, if there is a letter or digit at all."""
    return len(text) - text.count(" ") if _SIGN.search(text) else 0


def _lay_out(page: _Page) -> list[_Line]:
    """The lines; set-aside blocks get lines of their own, spans go back into theirs."""
    out: list[_Line] = []
    for line in page.text.split("\n"):
        parts = _ASIDE.split(line)
        held = ""
        for n, part in enumerate(parts):
            if n % 2 == 0:
                held += part
                continue
            kind, text = page.aside[int(part)]
            if kind == "span":
                held += text
                continue
            if held.strip():
                out.append(_line(held))
            held = ""
            if kind == "marker":
                name, number = text.split()
                out.append(("marker", f"<!-- {name}: {number} -->", 1, 0, 0))
            else:
                out += [(kind, x, _size(x), 0, 0) for x in (text.split("\n") or [""])]
        if held.strip() or len(parts) == 1:
            out.append(_line(held))
    return out


def _line(line: str) -> _Line:
    inside = links = 0
    own = line
    if _LINK in line or _LINKED in line:
        found = _ANCHOR.findall(line)
        links, inside = len(found), _size("".join(found))
        own = _ANCHOR.sub("", line)
        line = line.replace(_LINK, "").replace(_LINKED, "")
    kind, text = _kind(line)
    return kind, text, _size(own), inside, links


def _kind(line: str) -> tuple[str, str]:
    s = line.strip()
    if not s:
        return "blank", ""
    if s.startswith(_HEAD):
        return "heading", s.replace(_HEAD, "").replace(_ITEM, "").strip()
    s = s.replace(_HEAD, "")
    if s.startswith((_ITEM, "- ")):
        return "list", " " * (len(line) - len(line.lstrip())) + "- " + s.removeprefix("- ").replace(_ITEM, "").strip()
    s = s.replace(_ITEM, "")
    if " | " in s:
        return "table", s
    return "text", " ".join(s.split())


def _lengths(lines: list[_Line]) -> list[int]:
    """The text length of each line. A lone link is text; a line of several links and nothing else, or one of
    WINDOW or more lines in a row with a link each, is navigation and has none."""
    out = [own + inside for _, _, own, inside, _ in lines]
    run: list[int] = []
    for n in range(len(lines) + 1):
        if n < len(lines) and lines[n][4] and not lines[n][2] and lines[n][0] in ("text", "list", "table"):
            run.append(n)
            continue
        if len(run) >= WINDOW or any(lines[i][4] > 1 for i in run):
            for i in run:
                out[i] = 0
        run = []
    return out


def surges(lengths: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of text, by line: from the first line with text whose window reaches SURGE
    up to the line without text whose window falls below it."""
    found: list[tuple[int, int]] = []
    start = -1
    for n, own in enumerate(lengths):
        block = sum(lengths[n : n + WINDOW])
        if start < 0 and own > 0 and block >= SURGE:
            start = n
        elif start >= 0 and own == 0 and block < SURGE:
            found.append((start, n))
            start = -1
    return found + [(start, len(lengths))] if start >= 0 else found


def _between_surges(lines: list[_Line]) -> list[_Line]:
    """The lines between a surge and its dive, structural lines, and blank lines. A page without any surge is
    left as it is, as nothing tells its text from its navigation."""
    at = [n for n, x in enumerate(lines) if x[0] != "blank"]
    shown = [lines[n] for n in at]
    lengths = _lengths(shown)
    stretches = surges(lengths)
    if not stretches or (len(stretches) == 1 and stretches[0] == (0, len(lengths))):
        return lines
    body = {at[n] for a, b in stretches for n in range(a, b)}
    bare = {at[n] for n, size in enumerate(lengths) if not size and (shown[n][0] == "text" or shown[n][4])}
    return [x for n, x in enumerate(lines) if n in body or n not in bare]


def convert(text: str | None) -> tuple[str | None, list[tuple[str, str]], list[tuple[str, int, int]], list[str]]:
    """(clean text, (kind, text) blocks, (kind, number, line) markers, syntaxes) of a page.

    Null stays null; a blank text is an empty one without blocks. Marker lines keep their place and form, and
    their line numbers are those in the clean text.
    """
    if text is None:
        return None, [], [], []
    page = _Page(text.translate(_UNMARKED) if _MARKS.search(text) else text)
    _set_aside(page)
    _html(page)
    _latex(page)
    _wiki(page)
    _markdown(page)
    lines = _between_surges(_lay_out(page))
    clean: list[str] = []
    blocks: list[tuple[str, str]] = []
    markers: list[tuple[str, int, int]] = []
    last = "blank"
    for kind, t, *_ in lines:
        if kind == "blank":
            if clean and clean[-1]:
                clean.append("")
            last = kind
            continue
        clean.append(t)
        if kind == "marker":
            name, number = re.findall(r"\w+", t)
            markers.append((name, int(number), len(clean)))
        if blocks and kind == last and kind != "marker" and kind != "heading":
            blocks[-1] = (kind, blocks[-1][1] + "\n" + t)
        else:
            blocks.append((kind, t))
        last = kind
    while clean and not clean[-1]:
        clean.pop()
    return "\n".join(clean), blocks, markers, [f for f in FAMILIES if f in page.seen]


_SCHEMA = "clean string, blocks array<struct<kind:string,text:string>>, markers array<struct<kind:string,number:int,line:int>>, families array<string>"


def convert_pages(pages: DataFrame, keys: tuple[str, ...] = ("paper_id", "page"), text: str = "text") -> DataFrame:
    """(keys, clean, blocks, markers, families), one row per row of pages; other columns aren't read. No shuffle."""
    rows = pages.select(*keys, pages[text].alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    block = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    marker = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = lru_cache(256)(convert)  # a page delivered twice in a row is converted once
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = [once(t) for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k) for k in keys),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([[{"kind": k, "text": t} for k, t in f[1]] for f in found], block),
                        pa.array([[{"kind": k, "number": n, "line": at} for k, n, at in f[2]] for f in found], marker),
                        pa.array([f[3] for f in found], pa.list_(pa.string())),
                    ],
                    [*keys, "clean", "blocks", "markers", "families"],
                )

    return rows.mapInArrow(run, f"{kinds}, {_SCHEMA}")
