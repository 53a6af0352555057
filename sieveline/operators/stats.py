"""Statistics of each stage: one-row aggregates and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.ranks import distinct_values, linear_quantile
from sieveline.operators.rules import undecided
from sieveline.session import stage


def _share(part: str, total: str = "total"):  # noqa: ANN202
    return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(total)), F.lit(0.0))


def rule_statistics(df: DataFrame) -> DataFrame:
    """One row: rows per tier, direct judgments, rows to review and their share."""
    tiers = ("rule_high", "rule_boundary", "rule_low", "rule_unclear")
    return df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("rule_tier") == t).alias(f"{t}_count") for t in tiers],
        F.count_if(F.col("screening_method") == "rule_direct_high").alias("direct_high_count"),
        F.count_if(F.col("screening_method") == "rule_direct_low").alias("direct_low_count"),
        F.count_if(F.col("needs_review")).alias("needs_review_count"),
    ).withColumn("needs_review_percentage", _share("needs_review_count"))


def pubtype_histogram(df: DataFrame) -> DataFrame:
    """(pubtype, n): rows per publication type; '' counts as ``unknown``."""
    types = F.split(F.when(F.coalesce("rule_pubtype", F.lit("")) == "", "unknown").otherwise(F.col("rule_pubtype")), "; ")
    return df.select(F.explode(types).alias("pubtype")).groupBy("pubtype").agg(F.count("*").alias("n"))


def value_histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of any label column, '' and null together."""
    return df.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.count("*").alias("n"))


def score_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, max, mean, median and sample deviation; nulls and NaN are left out."""
    values = stage(distinct_values(df.select(column), column))
    v, n = F.col(column), F.col("n")
    sums = values.agg(F.sum("n").alias("n_scores"), F.min(column).alias("min"), F.max(column).alias("max"),
                      (F.sum(v * n) / F.sum(n)).alias("mean"))
    spread = values.crossJoin(sums).agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("_ss"))  # one row
    median = linear_quantile(values, column, 0.5).withColumnRenamed("threshold", "median")
    return sums.crossJoin(median).crossJoin(spread).withColumn(
        "std", F.sqrt(F.try_divide(F.col("_ss"), F.nullif(F.col("n_scores") - 1, F.lit(0))))).drop("_ss")


def score_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n): equal bins over [0, 1], the first closed on both sides; empty bins count 0."""
    at = F.when((F.col(column) >= 0) & (F.col(column) <= 1),
                F.greatest(F.ceil(F.round(F.col(column) * bins, 9)).cast("int") - 1, F.lit(0)))
    found = df.select(at.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def tfidf_statistics(df: DataFrame, low: float = 0.02, high: float = 0.3) -> DataFrame:
    counts = df.agg(F.count_if(F.col("tfidf_score") < low).alias("below_low"),
                    F.count_if(F.col("tfidf_score") >= high).alias("from_high"))
    return score_statistics(df, "tfidf_score").crossJoin(counts)


def rank_statistics(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count("*").alias("total"), F.count_if(F.col("rank_tier") == "rank_selected").alias("selected"))
    return score_statistics(df, "rank_score").crossJoin(counts.withColumn("selected_percentage", _share("selected")))


def review_statistics(df: DataFrame) -> DataFrame:
    """One row: manual decisions by level, batch decisions, undecided rows."""
    return df.agg(
        *[F.count_if(F.col("evidence_type") == f"manual_{k}").alias(f"manual_{k}") for k in ("high", "boundary", "low")],
        F.count_if(F.col("screening_method") == "batch_review").alias("batch"),
        F.count_if(undecided()).alias("undecided"))


def level_summary(df: DataFrame) -> DataFrame:
    """(screening_level, n, percentage)."""
    total = df.agg(F.count("*").alias("total"))
    return value_histogram(df, "screening_level").crossJoin(total).select(  # one row
        F.col("value").alias("screening_level"), "n", _share("n").alias("percentage"))


#: Which measures of the stages call for a person: (stage, measure, holds, what to say).
ALERTS = (
    ("rules", "rule_boundary_count", lambda v, _: v > 0, "{v} boundary records need attention"),
    ("rules", "needs_review_percentage", lambda v, _: v > 30, "more than 30 % need review; a stricter rule mode may fit better"),
    ("tfidf", "below_low", lambda v, r: 2 * v > (r.get("n_scores") or 0), "more than half lie below the low threshold; the seeds may not fit"),
    ("tfidf", "max", lambda v, _: v is not None and v == 0, "no record shares a term with the seeds"),
    ("rank", "selected", lambda v, _: v == 0, "no record was selected"),
    ("review", "undecided", lambda v, _: v > 0, "{v} records are still undecided"),
)


def describe(stats: DataFrame, title: str, stage: str | None = None) -> str:
    """A one-row statistics frame as text, with the alerts of its ``stage`` (all if none is named)."""
    row = stats.first()
    data = row.asDict() if row else {}
    lines = [title, *[f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in data.items()]]
    for of, measure, holds, text in ALERTS:
        value = data.get(measure)
        if stage in (None, of) and measure in data and (value is not None or measure == "max") and holds(value, data):
            lines.append("  ! " + text.format(v=value))
    return "\n".join(lines)


def print_stage(stats: DataFrame, stage: str) -> str:
    """Print and return the summary of a stage: rules, tfidf, rank or review."""
    titles = {"rules": "Rule screening", "tfidf": "Similarity to the seeds", "rank": "Rank", "review": "Review by people"}
    text = describe(stats, titles.get(stage, stage), stage)
    print(text)
    return text
