"""Ranks and exact quantiles of a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.joins import join_lookup
from sieveline.operators.rules import set_judgment, undecided
from sieveline.session import stage

# The label of the rank stage.
RANK_LABEL = ("高相关", "high_rank", "Rank25百分位筛选通过", "rank25")


def distinct_values(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n, before): each distinct value with its count and how many rows lie below it.

    Values are range-partitioned; running counts are taken inside each range and shifted by the sum of
    the ranges before, of which there are as many as partitions. Null and NaN values are left out. A
    value that holds a third of the rows is one row here, after map-side combine.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(*[F.col(c) for c in (*by, value)]).withColumn("_part", F.spark_partition_id())
    kept = stage(ranged)  # the ranges are sampled: written once, they can't differ between the two reads below
    sums = kept.groupBy("_part", *by).agg(F.sum("n").alias("_sum"))
    before = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(
        Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_part", *by).orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn("_inside", inside).join(before.drop("_sum"), ["_part", *by]).select(
        *by, value, "n", (F.col("_inside") + F.col("_offset")).alias("before"))


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """(by..., value, out, total): the average rank of each distinct value, ties sharing the mean."""
    by = by or []
    values = distinct_values(df, value, by)
    total = values.groupBy(*by).agg(F.sum("n").alias("total")) if by else values.agg(F.sum("n").alias("total"))
    joined = values.join(total, by) if by else values.crossJoin(total)  # one row
    up = F.col("before") + (F.col("n") + 1) / 2
    rank = F.col("total") + 1 - up if descending else up
    return joined.select(*by, value, rank.cast("double").alias(out), "total")


def linear_quantile(values: DataFrame, value: str, q: float) -> DataFrame:
    """One row, ``threshold``: the linearly interpolated quantile of ``distinct_values`` (null if empty)."""
    total = values.agg(F.sum("n").alias("total"))
    at = F.lit(q) * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    inside = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    picked = values.crossJoin(total).agg(F.max(F.when(inside(low), F.col(value))).alias("_low"),
                                         F.max(F.when(inside(high), F.col(value))).alias("_high"),
                                         F.max(at - low).alias("_share"))
    return picked.select((F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("threshold"))


def rank_score(df: DataFrame, rule_weight: float = 0.4, tfidf_weight: float = 0.6) -> DataFrame:
    """Blend rule and similarity score with weights normalised to one; one score alone counts raw."""
    total = rule_weight + tfidf_weight
    have = [c for c in ("rule_score", "tfidf_score") if c in df.columns]
    clean = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    if len(have) == 2:
        score: Column = clean("rule_score") * (rule_weight / total) + clean("tfidf_score") * (tfidf_weight / total)
    else:
        score = clean(have[0]) if have else F.lit(0.0)
    return df.withColumn("rank_score", score.cast("double"))


def rank_filter(df: DataFrame, percentile: float = 25.0) -> DataFrame:
    """Add the percentile of ``rank_score`` (average ties) and the tier at the top ``percentile``.

    The threshold is the linearly interpolated quantile over all rows; ties at it are all selected.
    Rows without a score get a null percentile and are not selected.
    """
    values = stage(distinct_values(df, "rank_score"))
    threshold = linear_quantile(values, "rank_score", 1 - percentile / 100)
    total = values.agg(F.sum("n").alias("_total"))
    ranks = values.crossJoin(total).crossJoin(threshold).select(  # one row each
        "rank_score", ((F.col("before") + (F.col("n") + 1) / 2) / F.col("_total") * 100).alias("rank_percentile"),
        (F.col("rank_score") >= F.col("threshold")).alias("_selected"), "n")
    # one score may be that of most rows: ties are broadcast, the other scores shuffled
    out = join_lookup(df.drop("rank_percentile", "rank_tier"), ranks, ["rank_score"], how="left")
    return out.withColumn("rank_tier", F.when(F.col("_selected"), "rank_selected").otherwise("rank_unselected")).select(
        *[c for c in df.columns if c not in ("rank_percentile", "rank_tier")], "rank_percentile", "rank_tier")


def rank_judgment(df: DataFrame) -> DataFrame:
    """Undecided and selected rows become highly relevant."""
    return set_judgment(df, undecided() & (F.col("rank_tier") == "rank_selected"), RANK_LABEL)
