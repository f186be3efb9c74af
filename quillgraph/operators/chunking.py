"""From pages to chunks: blocks, pieces within a budget, greedy packing; never across a page.

All of a page's work stays in one row, in SQL array functions: packing restarts its count at each chunk, so it
is no running sum and needs no shuffle. Only the numbering of a paper's chunks does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLOCK_END, MARKER, let, split_lines, strip, words

DEFAULT_MAX_TOKENS = 512


class Tokenizer(Protocol):
    def count_tokens(self, text: str) -> int: ...


def markers(text: Column) -> Column:
    """array<struct<kind, number, line>> of a page's marker lines, lines counted from 1."""
    numbered = F.transform(split_lines(text), lambda x, i: F.struct(strip(x).alias("text"), (i + 1).alias("line")))
    return F.transform(
        F.filter(numbered, lambda x: x["text"].rlike(MARKER)),
        lambda x: F.struct(F.regexp_extract(x["text"], MARKER, 1).alias("kind"), F.regexp_extract(x["text"], MARKER, 2).cast("int").alias("number"), x["line"].alias("line")),
    )


def blocks(text: Column) -> Column:
    """Paragraphs and headings of a page; marker lines vanish without ending a paragraph."""
    kept = F.filter(split_lines(text), lambda x: ~strip(x).rlike(MARKER))
    marked = F.transform(kept, lambda x: let(strip(x), lambda s: F.when(s == "", BLOCK_END).when(s.startswith("#"), F.concat(F.lit(BLOCK_END), s, F.lit(BLOCK_END))).otherwise(x)))
    return F.filter(F.transform(F.split(F.array_join(marked, "\n"), BLOCK_END), strip), lambda b: b != "")


def fitted(block_list: Column, most: Column) -> Column:
    """array<struct<text, n>>: blocks over the budget as runs of their words, the others as they are; n counts the words, once."""

    def pieces(w: Column) -> Column:
        run = lambda at: F.struct(F.array_join(F.slice(w, at, most), " ").alias("text"), F.least(most, F.size(w) - at + 1).alias("n"))
        return F.transform(F.sequence(F.lit(1), F.size(w), most), run)

    whole = lambda b, w: F.array(F.struct(b.alias("text"), F.size(w).alias("n")))
    return F.flatten(F.transform(block_list, lambda b: let(words(b), lambda w: F.when(F.size(w) > most, pieces(w)).otherwise(whole(b, w)))))


def packed(counted: Column, most: Column) -> Column:
    """Blocks (text, n) joined by a blank line for as long as the budget holds."""
    state = "struct<done:array<string>,open:string,n:int>"

    def step(acc: Column, x: Column) -> Column:
        b, n = x["text"], x["n"]
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), b.alias("open"), n.alias("n")))
            .when(acc["n"] + n > most, F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), b.alias("open"), n.alias("n")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), b).alias("open"), (acc["n"] + n).alias("n")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(counted, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def chunk_pages(pages: DataFrame, max_tokens: int | Column = DEFAULT_MAX_TOKENS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(id, paper_id, idx, page_start, page_end, text); idx counts a paper's chunks from 0 in page order.

    Null texts and blank pages give no chunk. Without a tokenizer, tokens are words between white space. A
    column of budgets may differ by row; budgets under 1 are refused, or give no chunk where they are a column.
    """
    if isinstance(max_tokens, int) and max_tokens < 1:
        raise ValueError("max_tokens must be greater than or equal to 1")
    most = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    if tokenizer is not None:
        if not isinstance(max_tokens, int):
            raise ValueError("a tokenizer of one's own needs one budget for all pages")
        cut = _packed_by(pages, max_tokens, tokenizer)
    else:
        cut = pages.where(F.col("text").isNotNull() & (most >= 1)).select("paper_id", "page", F.posexplode(packed(fitted(blocks(F.col("text")), most), most)).alias("pos", "text"))
    order = Window.partitionBy("paper_id").orderBy("page", "pos")
    idx = F.row_number().over(order) - 1
    return cut.withColumn("idx", idx).select(F.concat_ws(":", "paper_id", "idx").alias("id"), "paper_id", "idx", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "text")


def _packed_by(pages: DataFrame, most: int, tokenizer: Tokenizer) -> DataFrame:
    """The same with a tokenizer that only Python has; blocks still come from SQL."""

    def fill(parts: list[str], joiner: str) -> Iterator[str]:
        held: list[str] = []
        for part in parts:
            if held and tokenizer.count_tokens(joiner.join([*held, part])) > most:
                yield joiner.join(held)
                held = []
            held.append(part)
        if held:
            yield joiner.join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for paper, page, found in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                fit = [x for b in found or () for x in ([b] if tokenizer.count_tokens(b) <= most else fill(b.split(), " "))]
                rows += [(paper, page, n, t) for n, t in enumerate(fill(fit, "\n\n"))]
            yield pa.RecordBatch.from_pylist([dict(zip(("paper_id", "page", "pos", "text"), r, strict=True)) for r in rows], schema=pa.schema([("paper_id", pa.int64()), ("page", pa.int32()), ("pos", pa.int32()), ("text", pa.string())]))

    source = pages.where("text is not null").select(F.col("paper_id").cast("bigint"), F.col("page").cast("int"), blocks(F.col("text")).alias("blocks"))
    return source.mapInArrow(run, "paper_id bigint, page int, pos int, text string")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per (paper_id, page): of several deliveries the one loaded last."""
    rest = [c for c in pages.columns if c not in ("paper_id", "page")]
    last = pages.groupBy("paper_id", "page").agg(F.max_by(F.struct(*rest), F.coalesce("loaded_at", F.timestamp_micros(F.lit(0)))).alias("_r"))
    return last.select("paper_id", "page", *[F.col(f"_r.{c}").alias(c) for c in rest])
