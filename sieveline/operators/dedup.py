"""Exact deduplication on normalised keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import dedup_key, normalize_doi


def dedup_records(df: DataFrame, order: str = "record_id") -> DataFrame:
    """The first record of each DOI, and of each title among the records without a DOI.

    A record with a DOI and one without are never merged; all records with neither become one.
    "First" is by ``order``, which must be unique. Only the key and ``order`` are aggregated
    (with map-side combine, so a hot key arrives as one row per task); the winning rows come
    back by a semi-join on ``order``.
    """
    doi = normalize_doi(F.col("doi"))
    has = doi != ""
    keyed = df.select(F.col(order), has.alias("_has"), F.when(has, doi).otherwise(dedup_key(F.col("title"))).alias("_key"))
    first = keyed.groupBy("_has", F.xxhash64("_key").alias("_h"), "_key").agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")
