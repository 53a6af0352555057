"""Row-local stages on a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.config import RuleSet
from sieveline.operators.rules import rule_judgment, rule_screening
from sieveline.sources.load import clean_records


def screen_stream(records: DataFrame, rule_sets: list[RuleSet]) -> DataFrame:
    """Cleaned and rule-screened records of a stream; no state, so any output mode works."""
    return rule_judgment(rule_screening(clean_records(records), rule_sets))


def late_counts(records: DataFrame, at: str = "loaded_at", lateness: str = "7 days", width: str = "1 day") -> DataFrame:
    """Records per source file and time window, with a watermark for late rows."""
    return records.withWatermark(at, lateness).groupBy(F.window(at, width), "source_file").agg(F.count("*").alias("n"))
