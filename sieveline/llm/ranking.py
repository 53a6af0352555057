"""One ranking from several scores by median rank aggregation.

Each score is turned into the rank of its value among the rows it is comparable with (its
run), ties sharing the mean, as a share of their number, so that neither range nor
distribution counts. Records are ordered by the weighted median of their ranks, then by the
mean rank, then by identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import numbered
from sieveline.operators.joins import join_lookup
from sieveline.operators.ranks import distinct_values
from sieveline.session import stage

#: Scores and their weights.
WEIGHTS = {"rule_score": 1.0, "tfidf_score": 1.0, "rank_score": 1.0}


def latest_rows(screening: DataFrame, key: str = "record_id", group: str = "run_id", at: str = "screened_at", scores: list[str] | None = None) -> DataFrame:
    """The row of each record that was screened last; ties and null times go by run."""
    scores = scores or list(WEIGHTS)
    pick = F.max_by(F.struct(group, *scores), F.struct(F.coalesce(F.col(at).cast("timestamp"), F.lit("1970-01-01").cast("timestamp")), group))
    return screening.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("_row")).select(key, "_row.*")


def rank_shares(rows: DataFrame, key: str, group: str, scores: list[str]) -> DataFrame:
    """(key, score, share): place of each value among its group, best first, in (0, 1); null and NaN have none."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("value")) for c in scores]))
    long = rows.select(key, F.col(group).cast("string").alias("_run"), cells.alias("_c")).select(key, F.xxhash64("_run", "_c.score").alias("_group"), "_c.*").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    values = stage(distinct_values(long, "value", ["_group"]))
    totals = values.groupBy("_group").agg(F.sum("n").alias("_total"))  # a row per run and score
    share = (F.col("_total") + 1 - (F.col("before") + (F.col("n") + 1) / 2) - 0.5) / F.col("_total")
    lookup = values.join(F.broadcast(totals), "_group").select("_group", "value", "n", share.alias("share"))
    return join_lookup(long, lookup, ["_group", "value"]).select(key, "score", "share")


def median_ranking(screening: DataFrame, weights: dict[str, float] | None = None, key: str = "record_id", group: str = "run_id") -> DataFrame:
    """(key, position, median_rank, mean_rank, n_scores): one row per record, position 1 is best.

    The weighted median is the least rank at which half of the weights are reached. Records without any score
    come last, by identifier. Empty tables give no rows; null identifiers are no records.
    """
    weights = weights or WEIGHTS
    rows = stage(latest_rows(screening, key, group, scores=list(weights)))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("score")]
    shares = rank_shares(rows, key, group, list(weights)).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("share", weight.alias("w")))).alias("r"), F.round(F.avg("share"), 12).alias("mean_rank"))
    half = F.aggregate("r", F.lit(0.0), lambda acc, x: acc + x["w"]) / 2
    walked = F.aggregate("r", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at")), lambda acc, x: F.struct(
        (acc["sum"] + x["w"]).alias("sum"), F.when(acc["at"].isNotNull(), acc["at"]).when(acc["sum"] + x["w"] >= half - 1e-12, x["share"]).alias("at")))
    scored = rows.select(key).join(shares, key, "left").select(
        key, walked["at"].alias("median_rank"), "mean_rank", F.coalesce(F.size("r"), F.lit(0)).alias("n_scores"))
    order = [F.col("median_rank").asc_nulls_last(), F.col("mean_rank").asc_nulls_last(), F.col(key).asc()]
    return numbered(scored, order, "position").select(key, "position", "median_rank", "mean_rank", F.greatest("n_scores", F.lit(0)).alias("n_scores"))
