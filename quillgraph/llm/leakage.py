"""Problem 7: evaluation passages leaking into training text, by a distributed positional inverted index.

The index is partitioned by documents: each block of documents keeps, for every term that occurs in any
item, the sorted list of its positions. It is written once to the shared folder and read twice: for the
frequency of each term over the whole corpus, and for the matches. Every run of five item words is looked up
through its rarest term; the offset-adjusted lists of the other four are intersected, rarest first. A
proximity match is a span of SPAN document words that holds all but one of a run's words in their order: one
of the two rarest must be among them, so their postings lead to every such span. Nothing is shuffled but one
count per term and block. The index is built once, whatever the number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

RUN = 5
#: Document words that a proximity match may span, and words of the run that it holds.
SPAN, HELD = 8, RUN - 1
#: Words of the items searched at once (some 40 MB to every worker); more are searched in further rounds over
#: the same index. Words of all items, which are held in memory.
WORDS_PER_ROUND, MOST_WORDS = 500_000, 20_000_000
#: Words after which a block of documents is closed; a longer document is a block of its own.
BLOCK_WORDS = 400_000

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-­‐][^\S\n\r]*\r?\n[^\S\n\r]*(?=[^\W\d_])|­")
_WORD = re.compile(r"[^\W_]+")

_INDEX = "doc array<bigint>, doc_start array<int>, term array<int>, term_start array<int>, position array<int>, size int"


def words(text: str | None) -> list[str]:
    """Lower-case words without punctuation; a word hyphenated at a line end is one word."""
    return _WORD.findall(_HYPHEN.sub("", text).lower()) if text else []


def build_index(documents: DataFrame, vocabulary: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of documents: their keys and first positions, and the postings of the vocabulary as
    term ids, list starts and positions. Documents without words have no posting."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc", pa.list_(pa.int64())), ("doc_start", pa.list_(pa.int32())), ("term", pa.list_(pa.int32())), ("term_start", pa.list_(pa.int32())), ("position", pa.list_(pa.int32())), ("size", pa.int32())])

    def row(docs: list[int], starts: list[int], parts: list[np.ndarray], size: int) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        where = np.flatnonzero(ids >= 0).astype(np.int32)
        order = where[np.argsort(ids[where], kind="stable")]
        term, first = np.unique(ids[order], return_index=True)
        values = [docs, starts, term.astype(np.int32), np.append(first, len(order)).astype(np.int32), order, size]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        docs, starts, parts, size = [], [], [], 0
        gap = np.full(1, -1, dtype=np.int32)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(value.as_py())
                if len(found) < RUN or doc is None:
                    continue
                if size and size + len(found) > BLOCK_WORDS:
                    yield row(docs, starts, parts, size)
                    docs, starts, parts, size = [], [], [], 0
                docs.append(doc)
                starts.append(size)
                parts += [np.fromiter((known(w, -1) for w in found), dtype=np.int32, count=len(found)), gap]
                size += len(found) + 1
        if docs:
            yield row(docs, starts, parts, size)

    return documents.select(F.col(key).cast("bigint"), text).mapInArrow(run, _INDEX)


def _windows(items: list[tuple[int, np.ndarray]], frequency: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every run of words of every item: item number, offset, term ids, and the order of its terms from the rarest."""
    number, offset, grams = [], [], []
    for n, (_, ids) in enumerate(items):
        k = len(ids) - RUN + 1
        if k > 0:
            number.append(np.full(k, n))
            offset.append(np.arange(k))
            grams.append(np.lib.stride_tricks.sliding_window_view(ids, RUN))
    if not grams:
        return np.empty(0, int), np.empty(0, int), np.empty((0, RUN), int), np.empty((0, RUN), int)
    g = np.concatenate(grams)
    return np.concatenate(number), np.concatenate(offset), g, np.argsort(frequency[g], axis=1, kind="stable")


def _postings(block: dict, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the list of each wanted term in the block."""
    term, first = block["term"], block["term_start"]
    if not len(term):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), int)
    k = np.minimum(np.searchsorted(term, wanted), len(term) - 1)
    return first[k], np.where(term[k] == wanted, first[k + 1] - first[k], 0)


def _anchored(block: dict, first: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position) of every occurrence of the windows' terms, up to `most` at a time or one list."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        n = lengths[lo:hi]
        w = np.repeat(np.arange(lo, hi), n)
        if len(w):
            yield w, block["position"][first[w] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
        lo = hi


def _laid_out(block: dict) -> np.ndarray:
    """The term at each position of the block, -1 where there is none, with SPAN positions before and behind."""
    at = np.full(int(block["size"]) + 2 * SPAN, -1, dtype=np.int32)
    at[block["position"] + SPAN] = np.repeat(block["term"], np.diff(block["term_start"]))
    return at


def _intersect(block: dict, at: np.ndarray, grams: np.ndarray, rarest: np.ndarray) -> np.ndarray:
    """(document, window) of every run that stands in the block, each once."""
    out = [np.empty((0, 2), int)]
    first, lengths = _postings(block, grams[np.arange(len(grams)), rarest[:, 0]])
    for w, position in _anchored(block, first, lengths, 4_000_000):
        start = position - rarest[w, 0] + SPAN
        for j in range(1, RUN):
            o = rarest[w, j]
            keep = at[start + o] == grams[w, o]
            w, start = w[keep], start[keep]
        doc = np.searchsorted(block["doc_start"], start - SPAN, side="right") - 1
        out.append(np.stack([doc, w], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _near(block: dict, at: np.ndarray, grams: np.ndarray, rarest: np.ndarray) -> np.ndarray:
    """(document, window) of every run with a proximity match in the block, each once; exact runs are such, too."""
    out = [np.empty((0, 2), int)]
    around = np.arange(1 - SPAN, SPAN)
    ends = np.append(block["doc_start"][1:], block["size"])
    for j in range(RUN - HELD + 1):
        first, lengths = _postings(block, grams[np.arange(len(grams)), rarest[:, j]])
        for w, position in _anchored(block, first, lengths, 100_000):
            doc = np.searchsorted(block["doc_start"], position, side="right") - 1
            where = position[:, None] + around
            terms = np.where((where >= block["doc_start"][doc][:, None]) & (where < ends[doc][:, None]), at[where + SPAN], -1)
            g = grams[w]
            present = np.zeros(len(w), dtype=np.int8)
            for i in range(RUN):
                present += (terms == g[:, i : i + 1]).any(axis=1)
            some = np.flatnonzero(present >= HELD)
            if not len(some):
                continue
            terms, g, hit = terms[some], g[some], np.zeros(len(some), dtype=bool)
            for s in range(SPAN):
                hit |= _in_order(terms[:, s : s + SPAN], g) >= HELD
            out.append(np.stack([doc[some][hit], w[some][hit]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _in_order(spans: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The most words of each run that its span holds in order."""
    best = np.zeros((len(spans), spans.shape[1] + 1), dtype=np.int8)
    for i in range(grams.shape[1]):
        new = best.copy()
        same = spans == grams[:, i : i + 1]
        for k in range(spans.shape[1]):
            new[:, k + 1] = np.maximum(np.maximum(best[:, k + 1], new[:, k]), best[:, k] + same[:, k])
        best = new
    return best[:, -1]


def _covered(doc: np.ndarray, number: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the item that stand in runs of the document, per (document, item); input sorted."""
    if not len(doc):
        return doc, number, offset
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(number) != 0))
    step = np.append(np.diff(offset), RUN)
    step[np.append(new[1:], True)] = RUN
    starts = np.flatnonzero(new)
    return doc[starts], number[starts], np.add.reduceat(np.minimum(step, RUN), starts)


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, covered_words, item_words, share, near_words): every item of which a document repeats a
    run of five or more consecutive words, exactly or in proximity.

    covered_words are the item's words that stand in exact runs, and share is theirs of all its words; near_words
    are those in runs of which four words stand in order within eight words of the document. Case, punctuation,
    line breaks and line-end hyphens are disregarded; runs may lie apart. Null and empty texts, and items of under
    five words, give no row; repeated documents and items give one row each. The items are a stated query set
    held in memory, MOST_WORDS words at most (more are refused); documents are never gathered.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, covered_words int, item_words int, share double, near_words int"
    rows = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator()
    vocabulary: dict[str, int] = {}
    held: list[tuple[int, np.ndarray]] = []
    total = 0
    for i, t in rows:
        if len(found := words(t)) >= RUN:
            total += len(found)
            if total > MOST_WORDS:
                raise ValueError(f"the items have more than {MOST_WORDS} words")
            held.append((i, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], dtype=np.int32)))
    if not held:
        return spark.createDataFrame([], schema)
    path = shared_folder(spark, "positional-index")
    build_index(documents, vocabulary, key, text).write.parquet(path)
    index = spark.read.schema(_INDEX).parquet(path)
    lists = index.select(F.explode(F.transform("term", lambda t, n: F.struct(t.alias("term"), (F.col("term_start")[n + 1] - F.col("term_start")[n]).alias("n")))).alias("x"))
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    for r in lists.groupBy("x.term").agg(F.sum("x.n").alias("n")).toLocalIterator():  # at most one row per term of the items
        frequency[r[0]] = r[1]
    out: DataFrame | None = None
    for some in _rounds(held):
        part = _searched(index, some, frequency, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _rounds(held: list[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    some, size = [], 0
    for i, ids in held:
        if some and size + len(ids) > WORDS_PER_ROUND:
            yield some
            some, size = [], 0
        some.append((i, ids))
        size += len(ids)
    yield some


def _searched(index: DataFrame, items: list[tuple[int, np.ndarray]], frequency: np.ndarray, schema: str) -> DataFrame:
    keys = np.array([i for i, _ in items], dtype=np.int64)
    lengths = np.array([len(ids) for _, ids in items], dtype=np.int32)
    shared = index.sparkSession.sparkContext.broadcast((keys, lengths, _windows(items, frequency)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, (number, offset, grams, rarest) = shared.value

        def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(document and item as one number, words) of found windows."""
            doc, w = found[:, 0], found[:, 1]
            docs, items_, words_ = _covered(doc, number[w], offset[w])
            return docs * len(names) + items_, words_

        for batch in batches:
            for n in range(batch.num_rows):
                block = {c: batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in ("doc", "doc_start", "term", "term_start", "position")} | {"size": batch.column("size")[n].as_py()}
                at = _laid_out(block)
                exact, covered = counted(_intersect(block, at, grams, rarest))
                pairs, near = counted(_near(block, at, grams, rarest))
                told = np.zeros(len(pairs), dtype=np.int64)
                told[np.searchsorted(pairs, exact)] = covered
                doc, item = np.divmod(pairs, len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc"][doc], pa.int64()), pa.array(names[item], pa.int64()), pa.array(told, pa.int32()), pa.array(sizes[item], pa.int32()), pa.array(told / sizes[item], pa.float64()), pa.array(near, pa.int32())],
                    ["doc_id", "item_id", "covered_words", "item_words", "share", "near_words"],
                )

    return index.mapInArrow(run, schema)
