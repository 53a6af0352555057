"""Human decisions as a table joined to the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.rules import set_judgment, undecided

# What the choices of the review console mean.
CHOICES = {1: ("高相关", "manual_high"), 2: ("边界相关", "manual_boundary"), 3: ("低相关", "manual_low")}


def undecided_documents(df: DataFrame) -> DataFrame:
    return df.where(undecided())


def apply_decisions(df: DataFrame, decisions: DataFrame, key: str = "record_id") -> DataFrame:
    """Write manual decisions (key, choice 1..3); other choices skip the record. One decision per key counts,
    the greatest choice where there are several. Keys that are no record are ignored."""
    chosen = decisions.where(F.col("choice").isin(*CHOICES)).groupBy(key).agg(F.max("choice").alias("_choice"))
    out = df.join(chosen, key, "left")
    for choice, (level, evidence) in CHOICES.items():
        out = set_judgment(out, F.col("_choice") == choice, (level, evidence, f"人工判定为{level}", "manual_review"))
    return out.drop("_choice")


def batch_review(df: DataFrame, level: str, keys: DataFrame, key: str = "record_id") -> DataFrame:
    """Give every listed record one level; unknown keys are ignored."""
    marked = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    out = df.join(marked, key, "left")
    return set_judgment(out, F.col("_hit").isNotNull(), (level, f"batch_{level}", f"批量判定为{level}", "batch_review")).drop("_hit")


def needs_human(confidence: Column, threshold: float, enabled: bool = True) -> Column:
    """Whether a model's judgment goes to a person."""
    return F.lit(enabled) & (F.coalesce(confidence, F.lit(0.0)) < threshold)


def display_document(row: dict) -> str:
    """A record as text for a reviewer."""
    score = row.get("tfidf_score")
    return "\n".join([f"title: {row.get('title') or ''}", f"author: {row.get('author') or ''}",
                      f"year: {row.get('publication_year') or ''}", f"abstract: {row.get('abstract') or ''}",
                      f"tfidf: {score:.4f}" if isinstance(score, float) else "tfidf: n/a"])
