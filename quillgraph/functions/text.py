"""Column functions over text, with the white-space and line rules of Unicode rather than of ASCII."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, as they stand in a regular expression's class.
SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What ends a line; CR LF is one break.
LINE_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: A line that is, stripped, a marker; groups: kind, number.
MARKER = r"^<!-- (figure|equation): ([0-9]+) -->$"
#: A character that no line can hold, as it ends one.
BLOCK_END = "\x1d"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def count_tokens(text: Column) -> Column:
    """Words between white space; null for null."""
    return F.when(text.isNotNull(), F.size(words(text)))


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a break at the very end begins no further line."""
    return let(
        F.split(text, LINE_BREAK),
        lambda x: F.when(text == "", F.array().cast("array<string>")).when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x),
    )


def slug(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one hyphen, none at the ends; may be empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def concept_text(name: Column, aliases: Column, description: Column) -> Column:
    """What an embedder reads of a concept: name (aliases), and its description on a line of its own."""
    heading = F.concat(name, F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ("), F.array_join(aliases, ", "), F.lit(")"))).otherwise(""))
    return F.concat(heading, F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\n"), description)).otherwise(""))


def padded(number: Column, digits: int) -> Column:
    """Zero-padded, longer numbers whole."""
    return F.format_string(f"%0{digits}d", number)


def paper_directory(paper_id: Column) -> Column:
    return padded(paper_id, 4)


def page_file(page: Column) -> Column:
    return F.concat(padded(page, 3), F.lit(".md"))


def paper_node(paper_id: Column) -> Column:
    """A paper's id in a node namespace shared with concept slugs, which have no colon."""
    return F.concat(F.lit("paper:"), paper_id.cast("string"))


def error_path(*parts: str | Column | int) -> Column:
    """concepts[2].merged_from[0]: names joined by dots, positions in brackets; <root> for none."""
    out: Column | None = None
    for part in parts:
        if isinstance(part, str):
            step = F.lit(part) if out is None else F.lit(f".{part}")
        else:
            step = F.concat(F.lit("["), (F.lit(part) if isinstance(part, int) else part).cast("string"), F.lit("]"))
        out = step if out is None else F.concat(out, step)
    return F.lit("<root>") if out is None else out


def fold_id(value: Column) -> Column:
    """Ids that differ in case, surrounding white space or _ for - only become equal."""
    return F.translate(F.lower(strip(value)), "_", "-")
