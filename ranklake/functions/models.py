"""Plug-in surface for models.

A model is given as a factory: a function without arguments that runs once per
Python worker and returns the batch function.  Batches reach it through Arrow.
The two factories at the end need no weights; tests and examples use them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

EmbedFactory = Callable[[], Callable[[Sequence[str]], np.ndarray]]
ScoreFactory = Callable[[], Callable[[Sequence[str], Sequence[str]], np.ndarray]]


def embedding(text: Column, factory: EmbedFactory, batch_size: int = 256) -> Column:
    """Vector of a text; NULL is embedded as the empty text."""

    def load():
        embed = factory()
        return lambda texts: np.asarray(embed(list(texts)), dtype=np.float32)

    udf = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return udf(F.coalesce(text.cast("string"), F.lit("")))


def pair_score(query: Column, passage: Column, factory: ScoreFactory, batch_size: int = 256) -> Column:
    """Relevance of a passage to a query; a NULL passage is scored as the empty text."""

    def load():
        score = factory()
        return lambda queries, passages: np.asarray(
            score(list(queries), list(passages)), dtype=np.float64
        )

    udf = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size)
    return udf(query, F.coalesce(passage.cast("string"), F.lit("")))


#: Characters of texts that are cut into words at a time.
CHARS_AT_ONCE = 1_000_000


def hashing_embedder(dims: int = 64) -> EmbedFactory:
    """Signed feature hashing of white-space tokens, scaled to unit length.

    The first MD5 byte of a token picks the dimension (``dims`` up to 256), the
    lowest bit of the second its sign.
    """

    def factory():
        from hashlib import md5

        import pandas as pd

        def embed(texts: Sequence[str]) -> np.ndarray:
            # The words of a few texts only are held, however long the texts are.
            begun = np.cumsum([len(text) for text in texts]) // CHARS_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(begun)) + 1).tolist(), len(texts)]
            return np.concatenate([embed_some(texts[lo:hi]) for lo, hi in zip(cuts, cuts[1:])])

        def embed_some(texts: Sequence[str]) -> np.ndarray:
            tokens = [text.split() for text in texts]
            rows = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
            codes, words = pd.factorize(np.array([w for t in tokens for w in t], dtype=object))
            digests = [md5(word.encode("utf-8")).digest() for word in words]
            dim = np.array([d[0] % dims for d in digests], dtype=np.int64)
            sign = np.array([-1.0 if d[1] & 1 else 1.0 for d in digests])
            sums = np.bincount(rows * dims + dim[codes], sign[codes], len(texts) * dims)
            out = sums.reshape(len(texts), dims)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return (out / np.where(norm == 0, 1, norm)).astype(np.float32)

        return embed

    return factory


def token_overlap_scorer() -> ScoreFactory:
    """Share of the distinct query tokens that occur in the passage."""

    def factory():
        def score(queries: Sequence[str], passages: Sequence[str]) -> np.ndarray:
            out = np.zeros(len(queries))
            for row, (query, passage) in enumerate(zip(queries, passages)):
                wanted = set(query.split())
                if wanted:
                    out[row] = len(wanted & set(passage.split())) / len(wanted)
            return out

        return score

    return factory
