"""Embeddings through an Arrow UDF around a pluggable model."""

from __future__ import annotations

import hashlib
import logging
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.functions.text import feature_text
from ticketloom.plans.config import MODELS

_LOADED: dict = {}
log = logging.getLogger(__name__)


class Embedder(Protocol):
    """What a model must offer; instances are pickled to the workers, so load weights in embed()."""

    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Offline default: signed hashed character n-grams, of length 1. Its similarity is lexical, not neural."""

    def __init__(self, dims: int = 384, sizes: tuple[int, ...] = (3, 4)):
        self.name, self.dims, self.sizes = f"hashed-ngrams-{dims}", dims, sizes

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        for row, text in enumerate(texts):
            raw = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8).astype(np.uint64)
            for n in self.sizes:
                if len(raw) < n:
                    continue
                h = np.zeros(len(raw) - n + 1, dtype=np.uint64)
                for i in range(n):
                    h = (h ^ raw[i : len(raw) - n + 1 + i]) * np.uint64(0x100000001B3) + np.uint64(n)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                sign = np.where((h >> np.uint64(63)) == 1, 1.0, -1.0)
                out[row] += np.bincount((h >> np.uint64(20)) % np.uint64(self.dims), weights=sign, minlength=self.dims)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length == 0, 1, length)).astype(np.float32)


class SentenceModel:
    """A sentence-transformers model, where that package is installed."""

    def __init__(self, name: str, dims: int):
        self.name, self.dims = name, dims

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.name not in _LOADED:
            from sentence_transformers import SentenceTransformer  # optional

            _LOADED[self.name] = SentenceTransformer(self.name)
        return _LOADED[self.name].encode(texts)


def model_for(alias: str) -> Embedder:
    """The model of an alias; unknown ones fall back to the default, and say so. Offline, hashed n-grams."""
    if alias.startswith("hashed-ngrams"):
        return HashedNgrams()
    name = MODELS.get(alias)
    if name is None:
        log.warning("unknown model %s: the default is used", alias)
        name = MODELS["all-MiniLM-L6-v2"]
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        return HashedNgrams(1024 if "bge" in name.lower() else 384)
    return SentenceModel(name, 1024 if "bge" in name.lower() else 384)


def embed_column(df: DataFrame, text_col: str, embedder: Embedder, out: str = "embedding", batch: int = 64) -> DataFrame:
    """df with the text's vector; null text gives null."""
    at = df.columns.index(text_col)
    names = [c for c in df.columns if c != out]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), f"`{out}` array<float>"])

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for lo in range(0, len(known), batch):
                part = known[lo : lo + batch]
                for i, v in zip(part, np.asarray(embedder.embed([texts[i] for i in part]), dtype=np.float32)):
                    vectors[i] = v
            yield pa.record_batch([*(c for c, n in zip(b.columns, b.schema.names) if n != out), pa.array(vectors, pa.list_(pa.float32()))], names=[*names, out])

    return df.mapInArrow(run, schema)


def embed_tasks(tasks: DataFrame, embedder: Embedder | None = None, dedupe: bool = False, batch: int = 64) -> DataFrame:
    """tasks with embedding of summary | cleaned description. dedupe: equal texts are embedded once, for a join."""
    embedder = embedder or HashedNgrams()
    x = tasks.drop("embedding").withColumn("_f", feature_text(F.col("summary"), F.col("cleaned_description")))
    if dedupe:
        own = embed_column(x.select("_f").distinct(), "_f", embedder, batch=batch)
        x = x.join(own, "_f")
    else:
        x = embed_column(x, "_f", embedder, batch=batch)
    return x.drop("_f")


def embedding_statistics(tasks: DataFrame) -> DataFrame:
    """One row: texts to embed, different ones, and the percentage (one decimal) that embedding equal texts once saves."""
    x = tasks.select(feature_text(F.col("summary"), F.col("cleaned_description")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    x = x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.count(F.lit(1)).alias("different"))
    return x.withColumn("saved_percent", F.round(F.coalesce(100 * F.try_divide(F.col("texts") - F.col("different"), F.col("texts")), F.lit(0.0)), 1))


def embedding_dimension(df: DataFrame) -> int | None:
    row = df.where("embedding is not null").select(F.size("embedding").alias("n")).first()
    return row.n if row else None


def text_key(text: str) -> str:
    """The key of a text in outside caches."""
    return hashlib.md5(text.encode()).hexdigest()[:16]


def text_key_column(text: Column) -> Column:
    """As text_key."""
    return F.substring(F.md5(text), 1, 16)
