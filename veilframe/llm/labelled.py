"""Bounded training samples of documents, by hash order of the id: one row an id, however many rows repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of a table that holds a doc_id once, in hash order: the same rows on every run."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (bounded by its maker, hence broadcast) with one text of their documents: of rows that repeat an
    id that whose text hashes lowest. No more rows than ``ids`` has."""
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
