"""Dense vectors of passages and queries.

The encoder is a parameter: a callable that makes, once in each worker, a function from a list of texts to a list of
unit vectors. :class:`HashEncoder` stands in for a model in tests; it knows words and nothing of their meaning.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import strip
from lodestrata.settings import Settings

Encoder = Callable[[list[str]], "np.ndarray"]


class EmbeddingError(ValueError):
    """Blank input, input of the wrong kind, or an encoder that gives other numbers or widths than asked for."""


class HashEncoder:
    """Unit vectors from signed word hashes."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self) -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.width))
            for i, t in enumerate(texts):
                for w in re.findall(r"\w+", t.lower()):
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, (h >> 1) % self.width] += 1 if h & 1 else -1
                if not out[i].any():
                    out[i, 0] = 1
            return out / np.linalg.norm(out, axis=1, keepdims=True)

        return encode


def passage(text: Column, settings: Settings = Settings()) -> Column:
    """The prefixed passage, also where the text begins with the prefix already. Blank text is an error of the job."""
    return F.when(F.length(strip(text)) == 0, F.raise_error(F.lit("a passage to embed is blank"))).otherwise(F.concat(F.lit(settings.passage_prefix), text))


def query(text: Column, settings: Settings = Settings()) -> Column:
    return F.when(F.length(strip(text)) == 0, F.raise_error(F.lit("a query to embed is blank"))).otherwise(F.concat(F.lit(settings.query_prefix), text))


_loaded: dict[str, Encoder] = {}


def checked(texts: list[str], vectors, width: int) -> np.ndarray:
    if isinstance(texts, str):
        raise EmbeddingError("a list of texts is wanted, not one text")
    vectors = np.asarray(vectors, np.float64)
    if len(vectors) != len(texts):
        raise EmbeddingError(f"{len(texts)} texts gave {len(vectors)} vectors")
    if len(vectors) and (vectors.ndim != 2 or vectors.shape[1] != width):
        raise EmbeddingError(f"vectors have {vectors.shape[-1]} numbers, not {width}")
    return vectors


def encoded(text: Column, factory: Callable[[], Encoder], name: str, settings: Settings = Settings()) -> Column:
    """array<float> of each (prefixed) text. An encoder is made once per worker and ``name``, and not for empty batches."""
    width = settings.dense_width

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from lodestrata.operators import embed

        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            if name not in embed._loaded:
                embed._loaded[name] = factory()
            texts = list(batch)
            yield pd.Series(list(checked(texts, embed._loaded[name](texts), width).astype(np.float32)))

    return encode(text)


def embed_passages(df: DataFrame, factory: Callable[[], Encoder], name: str = "default", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``df`` with a column ``dense``: vector and row can't come apart."""
    if isinstance(df, str):
        raise EmbeddingError("a table is wanted, not one text")
    return df.withColumn("dense", encoded(passage(F.col(text), settings), factory, name, settings))


def embed_queries(df: DataFrame, factory: Callable[[], Encoder], name: str = "default", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    if isinstance(df, str):
        raise EmbeddingError("a table is wanted, not one text")
    return df.withColumn("dense", encoded(query(F.col(text), settings), factory, name, settings))


def embed_children(children: DataFrame, factory: Callable[[], Encoder], name: str = "default", settings: Settings = Settings()) -> DataFrame:
    return embed_passages(children, factory, name, "text", settings)
