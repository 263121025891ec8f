"""Latent-semantic topics: a truncated SVD of the training patients' TF-IDF matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .block_svd import truncated_svd
from .ordering import top_n

KEYS = ("scope", "odds")


def fit_all_topics(weights: DataFrame, topics: int, keys: Sequence[str] = KEYS, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit every combination of ``keys`` on ``(keys, pid, term_id, w)`` of training patients, all in the same jobs. Populations that draw on the
    same weights ``(pid, term_id, w)`` are given by ``members`` ``(keys, pid)``, and no weight is repeated for them.

    Returns the bases ``(keys, term_id, topic, v)`` and the singular values ``(keys, topic, s)``. Fewer topics
    come back where a matrix has no more; the rows of the singular values tell how many. Each topic's largest loading is positive.
    """
    return truncated_svd(weights, keys, topics, members)


def fit_topics(weights: DataFrame, topics: int) -> tuple[DataFrame, DataFrame]:
    """The same for the one matrix ``(pid, term_id, w)``: ``(term_id, topic, v)`` and ``(topic, s)``."""
    return truncated_svd(weights, (), topics)


def topic_terms(basis: DataFrame, vocabulary: DataFrame, n: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` strongest terms of every topic: ``(keys, topic, rank, token, v)``."""
    named = basis.join(vocabulary.select(*keys, "term_id", "token"), [*keys, "term_id"]).select(*keys, "topic", "token", "v")
    return top_n(named, [*keys, "topic"], F.abs("v"), [F.asc("token")], n, "rank").select(*keys, "topic", "rank", "token", "v")
