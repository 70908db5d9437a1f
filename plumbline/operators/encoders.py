"""Encoders: texts to vectors, by name.

An encoder is any picklable object with ``encode(texts) -> array`` of a row for each text, and ``query_prefix``, put before queries only. It lives in the Arrow workers. The
environment variable ``PLUMBLINE_ENCODER`` names the one that is taken where none is asked for.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 768


@dataclass
class HashedEncoder:
    """A hashed bag of words of unit length; a text without words has zeros. It needs no model: for tests, and where nothing else is at hand."""

    dim: int = DIM
    query_prefix: str = ""

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word in re.findall("[A-Za-z0-9]+", text.lower()):
                out[row, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)


@dataclass
class SentenceEncoder:
    """A sentence-transformers model, loaded by each worker when it first encodes; the package is only needed then."""

    #: A public model and the prefix that it wants before queries.
    model: str = "BAAI/bge-base-en-v1.5"
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    batch: int = 32

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        if not hasattr(self, "_loaded"):
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return np.asarray(
            self._loaded.encode(list(texts), batch_size=self.batch, normalize_embeddings=True, show_progress_bar=False)
        )


#: Encoder factories by name; add your own.
ENCODERS: dict[str, Callable[..., object]] = {"hashed": HashedEncoder, "sentence": SentenceEncoder}


def get_encoder(name: str | None = None, **options) -> object:
    name = name or os.environ.get("PLUMBLINE_ENCODER", "hashed")
    if name not in ENCODERS:
        raise ValueError(f"no encoder named {name!r}; there are {sorted(ENCODERS)}")
    return ENCODERS[name](**options)


def encoded(texts: DataFrame, encoder: object, as_queries: bool = False) -> DataFrame:
    """``texts`` (``key``, ``text``) with ``vector``; queries get the encoder's prefix first. A null text counts as empty."""
    prefix = getattr(encoder, "query_prefix", "") if as_queries else ""
    source = texts.select(F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = encoder.encode([prefix + (t if isinstance(t, str) else "") for t in pdf["text"]])
            yield pdf.assign(vector=[np.asarray(v, dtype=np.float64) for v in vectors])

    return source.mapInPandas(run, "key long, text string, vector array<double>")


def embedded_chunks(chunks: DataFrame, encoder: object) -> DataFrame:
    """Corpus chunks (``row_no``, ``id``, ``text``, metadata) as a vector collection: (``id``, ``embedding``, ``document``, ``section``, ``annex_iii_area``, ``para_num``, ``heading_path``)."""
    vectors = encoded(chunks.select(F.col("row_no").alias("key"), "text"), encoder).select("key", "vector")
    joined = chunks.join(vectors, F.col("row_no") == F.col("key"))
    return joined.select(
        "id",
        F.col("vector").cast("array<float>").alias("embedding"),
        F.col("text").alias("document"),
        "section",
        "annex_iii_area",
        "para_num",
        "heading_path",
    )
