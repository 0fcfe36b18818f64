"""Interfaces of embedding and chat models, with deterministic stand-ins that need no files or network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Put before questions, not before documents, when a model expects it.
QUERY_INSTRUCTION = "Find facts that answer this question: "


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class ChatModel(Protocol):
    name: str

    def reply(self, messages: list[dict[str, str]], temperature: float = 0.1, max_tokens: int = 256) -> str: ...


class Translator(Protocol):
    """A model that turns a question into a graph query; :class:`TableTranslator` is the stand-in."""

    def translate(self, question: str) -> str: ...


class TableTranslator:
    """Known questions and their queries, case and end marks ignored; unknown questions raise KeyError."""

    prefix = "translate to a graph query: "

    def __init__(self, pairs: dict[str, str]):
        self.pairs = {self._key(q): c for q, c in pairs.items()}

    @staticmethod
    def _key(question: str) -> str:
        return question.lower().rstrip("?!. ")

    def translate(self, question: str) -> str:
        return self.pairs[self._key(question.removeprefix(self.prefix))]


class HashedEmbedder:
    """Hashed character trigrams and words, L2-normalised: the same text always has the same vector. No claim on quality."""

    def __init__(self, dim: int = 384, normalize: bool = True):
        self.dim, self.normalize = dim, normalize

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            padded = f" {(text or '').lower()} "
            for piece in [padded[k : k + 3] for k in range(len(padded) - 2)] + padded.split():
                h = xxhash.xxh64_intdigest(piece.encode())
                out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        if self.normalize:
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norms, out=out, where=norms > 0)
        return out


class ScriptedChat:
    """Replies from a list, in order; the last one repeats. For tests and dry runs."""

    def __init__(self, *replies: str, name: str = "scripted"):
        self.replies, self.name, self.seen = list(replies), name, []

    def reply(self, messages, temperature=0.1, max_tokens=256) -> str:
        self.seen.append(messages)
        return self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]


def embed_column(df: DataFrame, embedder: Embedder, text: str = "text", to: str = "embedding", instruction: str = "") -> DataFrame:
    """``df`` with the vectors of a text column, made in Arrow batches; null texts have null vectors."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.notna()
            vectors = embedder.encode([instruction + t for t in texts[known]]) if known.any() else []
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for at, v in zip(texts.index[known], vectors):
                out[at] = v.tolist()
            yield out

    return df.withColumn(to, F.pandas_udf(encode, "array<float>")(F.col(text)))
