"""Problem 6: encoding a whole corpus with a public byte-level BPE, by forced-boundary splitting.

A merge joins neighbouring bytes of a token, so a pair of bytes that stands inside no vocabulary token can
never be crossed by any token: a cut between the two is certain. The cuts are taken where they also can't
change how the tokenizer's own pattern divides the text: between a visible ASCII character and the ASCII
white space after it, and between two CJK letters. The fragments are encoded independently, each distinct
one once per worker while the cache lasts, and concatenated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fragments kept per worker; the cache starts anew when full. Longer fragments are not kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64


def default_path() -> str:
    """The place of byte_bpe_50k.tiktoken; a parameter everywhere else."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: Fixed value: the pattern by which this family of tokenizers divides a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _vocabulary(path: str):
    with open(path, "rb") as f:
        return _built(f.read())


@lru_cache(2)
def _built(raw: bytes):
    """The encoder, the forced cuts, and an empty cache of fragments; once per worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), forced_cuts(ranks), {}


def forced_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """A table of 65,536 flags, at first * 256 + second: the pair stands inside no token."""
    never = np.ones(65536, dtype=bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            never[b[:-1] * 256 + b[1:]] = False
    return never


def cut_points(text: str, never: np.ndarray) -> list[int]:
    """Character offsets at which the text may be cut without changing its token ids."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if c.size < 2:
        return []
    a, b = c[:-1], c[1:]
    space = (b == 32) | ((b >= 9) & (b <= 13))
    at = space & (a > 32) & (a < 127)
    at[at] = never[a[at] * 256 + b[at]]
    if c.max() > 0x3040:
        letter = ((c >= 0x4E00) & (c <= 0x9FA5)) | ((c >= 0x3041) & (c <= 0x3096)) | ((c >= 0x30A1) & (c <= 0x30FA))
        both = letter[:-1] & letter[1:]
        if both.any():
            x, y = a[both], b[both]
            both[both] = never[(0x80 | (x & 0x3F)) * 256 + (0xE0 | (y >> 12))]
            at |= both
    return (np.flatnonzero(at) + 1).tolist()


def encode_text(text: str | None, path: str) -> list[int]:
    """The ids of one text; an empty or null text has none."""
    return _encoded(text, _vocabulary(path)) if text else []


def _encoded(text: str | None, vocabulary) -> list[int]:
    if not text:
        return []
    encoding, never, cache = vocabulary
    ids: list[int] = []
    last = 0
    for end in [*cut_points(text, never), len(text)]:
        fragment = text[last:end]
        last = end
        known = cache.get(fragment)
        if known is None:
            known = encoding.encode_ordinary(fragment)
            if len(fragment) <= CACHE_CHARS:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                cache[fragment] = known
        ids += known
    return ids


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>), one row per row of documents, without special tokens.

    Text that looks like a special token is plain text. Empty and null texts give an empty list, blank texts
    are encoded as they are. No shuffle; other columns aren't read.
    """
    with open(path or default_path(), "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())  # under a megabyte: the workers need no file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _built(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [np.asarray(_encoded(t, vocabulary), dtype=np.int32) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                values = np.concatenate(lists) if lists else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
