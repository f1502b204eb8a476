"""Model dispatch, pooling, and a deterministic hashing embedder in place of a model (none is at hand offline)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class ModelSpec:
    query_prefix: str
    passage_prefix: str
    pooling: str
    whole_note: bool = False


def model_spec(model_id: str) -> ModelSpec:
    if re.search("jina-embeddings-v5", model_id, re.I):
        return ModelSpec("Document: ", "Document: ", "last", True)
    if re.search("paraphrase-multilingual", model_id, re.I):
        return ModelSpec("", "", "mean")
    return ModelSpec("query: ", "passage: ", "mean")


def last_token(tokens: np.ndarray) -> np.ndarray:
    """The last position's vector, normalised."""
    v = np.asarray(tokens, float)[-1]
    return v / (np.linalg.norm(v) or 1)


def mean_pool(tokens: np.ndarray) -> np.ndarray:
    v = np.asarray(tokens, float).mean(0)
    return v / (np.linalg.norm(v) or 1)


def hash_embed(text: str, dims: int = 64) -> list[float]:
    """Signed feature hashing of lower-case words and their trigrams, normalised. Says nothing of a model's quality."""
    v = np.zeros(dims)
    for word in re.findall(r"\w+", text.lower()):
        for part in (word, *(word[i : i + 3] for i in range(len(word) - 2))):
            h = zlib.crc32(part.encode())
            v[h % dims] += 1 if h >> 31 else -1
    return (v / (np.linalg.norm(v) or 1)).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hash_embed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hash_embed(t or ""))


def embed(text: Column, kind: str = "passage", model_id: str = "hash-64") -> Column:
    """Row order is kept; Arrow batches are the sub-batches."""
    spec = model_spec(model_id)
    prefix = "" if model_id.startswith("hash") else spec.query_prefix if kind == "query" else spec.passage_prefix
    return _hash_embed(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))))


def batch_embedder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 12) -> Callable[[Column], Column]:
    """An embedder of any model: ``load`` runs once a worker and gives what turns an array of texts into rows of unit vectors, ``batch`` at a time."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)


def load_hashing() -> Callable[[np.ndarray], np.ndarray]:
    """The hashing embedder as a model for ``batch_embedder``."""
    return lambda texts: np.array([hash_embed(t or "") for t in texts]).reshape(len(texts), -1)
