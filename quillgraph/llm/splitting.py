"""Problem 5: splitting oversized items at natural boundaries, in Spark SQL functions only.

The text becomes an array of words, each with the white space behind it and the marker lines before it, and a
string with one letter per word for the boundary that follows it: p paragraph, s sentence, l line, c comma or
semicolon, w word. One regular expression with bounded quantifiers consumes that string: its alternatives are
ordered by boundary strength and each takes up to the limit. Overlap is a look back into the word array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MARKER_LINE, WHITE_SPACE, WORD_SIGN, let, without_marker_lines

_HELD = "__quillgraph_split"
#: Papers whose limits are sent to every worker (some 40 MB); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Signs that no text has (noncharacters), around a marker line while a text is split.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_WORDS = f"(?:{_OPEN}[^{_CLOSE}]*+{_CLOSE}[{WHITE_SPACE}]*+)*+{WORD_SIGN}++[{WHITE_SPACE}]*+(?:(?:{_OPEN}[^{_CLOSE}]*+{_CLOSE}[{WHITE_SPACE}]*+)++$)?"
#: One line break, CR LF being one, and white space that breaks no line.
_BREAK, _SPACE = r"(?:\r\n|[\n\x{85}\x{2028}\x{2029}]|\r(?!\n))", r"[\x09\x0b\x0c\x1c- \x{a0}\x{3000}]"
#: What ends a word with its white space, by boundary, the strongest first; most words end as the first pattern says.
_BOUNDARIES = (
    ("w", r"[a-zA-Z0-9] \z"),
    ("p", rf"{_BREAK}{_SPACE}*{_BREAK}[{WHITE_SPACE}]*\z"),
    ("s", rf"[.!?\x{{2026}}\x{{3002}}\x{{ff01}}\x{{ff1f}}][\"'\x{{201d}}\x{{2019}}\x{{300d}})\]]*[{WHITE_SPACE}]*\z"),
    ("l", rf"{_BREAK}[{WHITE_SPACE}]*\z"),
    ("c", rf"[,;:\x{{3001}}\x{{ff0c}}\x{{ff1b}}][{WHITE_SPACE}]*\z"),
)


def count_words(text: Column) -> Column:
    """Words between white space; marker lines don't count. Null for null."""
    return F.regexp_count(without_marker_lines(text), F.lit(WORD_SIGN + "++"))


def _marked(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _OPEN + _CLOSE, ""), MARKER_LINE, f"{_OPEN}$0{_CLOSE}")


def _words(marked: Column) -> Column:
    """The words, each with the white space behind it and the marker lines before it; the last one has those behind it, too."""
    found = F.regexp_extract_all(marked, F.lit(_WORDS), F.lit(0))
    return F.when(marked.contains(_OPEN), F.transform(found, lambda w: F.translate(w, _OPEN + _CLOSE, ""))).otherwise(found)


def _letter(word: Column) -> Column:
    out = None
    for letter, pattern in _BOUNDARIES:
        out = F.when(word.rlike(pattern), letter) if out is None else out.when(word.rlike(pattern), letter)
    return out.otherwise("w")


def _trimmed(piece: Column) -> Column:
    return F.regexp_replace(piece, f"[{WHITE_SPACE}]+$", "")


def _pattern(fresh: Column, any_of: str, stops: list[str]) -> Column:
    """All the rest if it fits; else up to the limit and at least half of it, the strongest boundary first; else just the limit."""
    most = fresh.cast("string")
    least = F.greatest(F.lit(1), (fresh / 2).cast("int")).cast("string")
    parts = [F.lit(any_of + "{1,"), most, F.lit("}$")]
    for stop in stops:
        parts += [F.lit("|" + any_of + "{"), least, F.lit(","), most, F.lit("}" + stop)]
    return F.concat(*parts, F.lit("|" + any_of + "{1,"), most, F.lit("}"))


def split_words(df: DataFrame, text: str, limit: str, overlap: str) -> DataFrame:
    """Adds n_words and pieces (array<string>); every piece has at most `limit` words.

    Consecutive pieces share `overlap` words (at most limit - 1). A text within its limit is one piece; a null
    text or limit, or a limit under 1, gives null pieces; a text without words gives none, or itself if it has
    marker lines. Marker lines don't count as words and stay with the word behind them, at the end with the one
    before. The pieces, without their overlap, hold every word and marker line in order.
    """
    most = F.col(limit)
    shared = F.greatest(F.lit(0), F.least(F.coalesce(F.col(overlap), F.lit(0)), most - 1))
    pattern = _pattern(most - shared, "[pslcw]", [f"(?<={x})" for x in "pslc"])

    def cut(w: Column) -> Column:
        code = F.array_join(F.transform(w, _letter), "")
        lens = F.transform(F.regexp_extract_all(code, pattern, F.lit(0)), F.length)
        return let(lens, lambda runs: F.transform(runs, lambda n, i: piece(w, _before(runs, i), n)))

    def piece(w: Column, at: Column, n: Column) -> Column:
        return _trimmed(F.array_join(F.slice(w, at - F.least(at, shared) + 1, n + F.least(at, shared)), ""))

    def pieces(n: Column) -> Column:
        whole = F.filter(F.array(F.regexp_replace(F.col(text), f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")), lambda t: t != "")
        return F.when(most.isNull() | (most < 1), None).when(n <= most, whole).otherwise(let(_words(_marked(F.col(text))), cut))

    # a count is cheap, and most texts need no more; the generator keeps the optimizer from computing it all again for each use of it
    both = F.when(F.col(text).isNotNull(), let(count_words(F.col(text)), lambda n: F.struct(n.alias("n_words"), pieces(n).alias("pieces"))))
    return df.select(*[df[f"`{c}`"] for c in df.columns if c not in ("n_words", "pieces")], F.explode(F.array(both)).alias(_HELD)).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "pieces")], f"{_HELD}.n_words", f"{_HELD}.pieces")


def _before(runs: Column, i: Column) -> Column:
    """The sum of the runs before the i-th."""
    return F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda a, y: a + y)


def split_characters(df: DataFrame, text: str, limit: int, overlap: int = 0) -> DataFrame:
    """Adds pieces (array<string>) of at most `limit` characters each, for texts without usable words.

    Cut after a paragraph, sentence, line or word, in this order, or else at the limit itself. Consecutive
    pieces share `overlap` characters. Null gives null, an empty text no piece.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 1, and overlap at least 0 and below it")
    stops = [r"(?<=\n\n)", r"(?<=[.!?\x{3002}\x{ff01}\x{ff1f}])", r"(?<=\n)", rf"(?<=[{WHITE_SPACE}])"]
    pattern = F.concat(F.lit("(?s)"), _pattern(F.lit(limit - overlap), ".", stops))
    t = F.col(text)

    def piece(at: Column, n: Column) -> Column:
        return F.substring(t, at - F.least(at, F.lit(overlap)) + 1, n + F.least(at, F.lit(overlap)))

    lens = F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), F.length)
    cut = let(lens, lambda runs: F.transform(runs, lambda n, i: piece(_before(runs, i), n)))
    return df.withColumn("pieces", F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= limit, F.array(t)).otherwise(cut))


def page_limits(manifests: DataFrame) -> DataFrame:
    """(paper_id, chunk_max_tokens, chunk_overlap_tokens), one row per listed paper.

    Repeated manifests count once; of several different ones the smallest limit holds.
    """
    rows = manifests.select(F.explode("paper_ids").alias("paper_id"), "chunk_max_tokens", F.coalesce("chunk_overlap_tokens", F.lit(0)).alias("chunk_overlap_tokens"))
    return rows.where("paper_id is not null and chunk_max_tokens is not null").groupBy("paper_id").agg(F.min(F.struct("chunk_max_tokens", "chunk_overlap_tokens")).alias("m")).select("paper_id", "m.*")


def split_pages(pages: DataFrame, manifests: DataFrame) -> DataFrame:
    """(paper_id, page, n_words, chunk_max_tokens, pieces) of the delivered rows of pages in some manifest."""
    limits = page_limits(manifests)
    few = limits.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = pages.select("paper_id", "page", "text").join(F.broadcast(limits) if few else limits, "paper_id")
    return split_words(rows, "text", "chunk_max_tokens", "chunk_overlap_tokens").drop("text")
