"""Embedders: what turns texts into vectors, as an Arrow-batched column function."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class EmbeddingError(RuntimeError):
    """The model gave no usable vectors."""


class Embedder(Protocol):
    """model_name is stored in the manifest; documents and queries may be embedded differently."""

    model_name: str

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_queries(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """A stand-in without a model: equal texts get equal unit vectors, whatever the machine.

    Each component is read off a BLAKE2 digest of the text, keyed by the component's place.
    """

    def __init__(self, size: int = 8):
        if size < 1:
            raise ValueError("a vector has at least one component")
        self.size, self.model_name = size, f"hash-{size}"

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([self._vector(t) for t in texts]) if len(texts) else np.empty((0, self.size), np.float32)

    embed_queries = embed_documents

    def _vector(self, text: str) -> np.ndarray:
        raw = text.encode()
        blocks = (hashlib.blake2b(raw, salt=n.to_bytes(8, "little")).digest() for n in range(-(-self.size // 16)))
        x = np.frombuffer(b"".join(blocks), dtype="<i4")[: self.size] / 2**31
        return (x / np.linalg.norm(x)).astype(np.float32) if x.any() else np.eye(1, self.size, dtype=np.float32)[0]


class SentenceModelEmbedder:
    """A sentence-transformers model, loaded once per worker; half precision where there is a GPU."""

    def __init__(self, model_name: str, batch_size: int = 4, query_prompt: str | None = "query"):
        self.model_name, self.batch_size, self.query_prompt = model_name, batch_size, query_prompt
        self._model = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def _encode(self, texts: Sequence[str], **options) -> np.ndarray:
        if self._model is None:
            try:
                import torch
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise EmbeddingError("sentence-transformers is not installed") from e
            device = "mps" if torch.backends.mps.is_available() else "cuda" if torch.cuda.is_available() else "cpu"
            self._model = SentenceTransformer(self.model_name, device=device, model_kwargs={"torch_dtype": "float32" if device == "cpu" else "float16"})
        return np.asarray(self._model.encode(list(texts), batch_size=self.batch_size, normalize_embeddings=True, **options), dtype=np.float32)

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        return self._encode(texts)

    def embed_queries(self, texts: Sequence[str]) -> np.ndarray:
        return self._encode(texts, prompt_name=self.query_prompt)


def embedded(text: Column, embedder: Embedder) -> Column:
    """The document vector of each text; the embedder is shipped once and used by batches. Null for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            vectors = embedder.embed_documents(batch[known].tolist())
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for i, v in zip(batch.index[known], vectors, strict=True):
                out[i] = v.tolist()
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)
