"""The screening pipeline: rules, similarity, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.config import RuleSet, ScreeningConfig
from sieveline.operators.ranks import rank_filter, rank_judgment, rank_score
from sieveline.operators.rules import JUDGMENT, rule_judgment, rule_screening, undecided
from sieveline.operators.tfidf import tfidf_scores, tfidf_threshold
from sieveline.session import stage


def rules_only(df: DataFrame, rule_sets: list[RuleSet]) -> DataFrame:
    """Rules and the direct judgment with its defaults."""
    return rule_judgment(rule_screening(df, rule_sets))


def _open_unclear(df: DataFrame) -> bool:
    """Whether a record that is neither decided nor boundary is left: the gate of the later stages."""
    return not df.where(undecided() & (F.col("rule_tier") != "rule_boundary")).limit(1).isEmpty()


def screen(df: DataFrame, rule_sets: list[RuleSet], config: ScreeningConfig | None = None, key: str = "record_id") -> DataFrame:
    """Label every record; pools are exposed as ``is_candidate`` and ``is_boundary``. ``key`` must be unique.

    Similarity and rank run only while a non-boundary record is undecided; they then score all rows,
    because the rank threshold is over all rows. Between the stages only the key and the label columns are
    kept, written once each, so that the gates and the quantile recompute nothing; the texts join at the end.
    """
    config = config or ScreeningConfig()
    judged = rule_judgment(rule_screening(df, rule_sets), config.direct_high, config.direct_low, config.rule_mode, config.review_threshold)
    labels = [c for c in judged.columns if c not in df.columns or c in JUDGMENT]
    out = stage(judged.select(key, *labels))
    if _open_unclear(out):
        scores = tfidf_scores(df, config.seed_texts, key, config.max_features, config.stop_words)
        out = stage(tfidf_threshold(out.join(scores, key), config.tfidf_low, config.tfidf_high))
        if _open_unclear(out):
            out = rank_judgment(rank_filter(rank_score(out, config.rule_weight, config.tfidf_weight), config.rank_percentile))
    out = out.withColumns({"is_boundary": F.col("rule_tier") == "rule_boundary",
                           "is_candidate": undecided() & (F.col("rule_tier") != "rule_boundary")})
    return df.drop(*[c for c in out.columns if c != key]).join(out, key)
