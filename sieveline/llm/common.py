"""Shared pieces: canonical forms of fields, and row numbers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.operators.packed import parse_field
from sieveline.session import stage

# What stands for a missing value in exports, lower case, letters and digits only.
PLACEHOLDERS = ("", "na", "nan", "none", "null", "nil", "pending", "unknown", "notavailable", "noabstractavailable",
                "abstractnotavailable", "noabstract", "notitle", "tba", "tbd", "missing", "nd")

_BARE = r"[^\p{L}\p{N}]+"
_WORDS = re.compile(r"[\W_]+")


def bare(col: Column) -> Column:
    """Lower case, letters and digits only; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), _BARE, "")


def title_key(col: Column) -> Column:
    """``bare`` of a title, '' for a placeholder."""
    text = bare(col)
    return F.when(text.isin(*PLACEHOLDERS), "").otherwise(text)


def doi_key(col: Column) -> Column:
    """A DOI without label, resolver, case, white space and punctuation; '' unless it is one."""
    text = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"(?U)\s+", "")
    text = F.regexp_replace(text, r"^(?:https?:/*|(?:www\.)?(?:dx\.)?doi\.org/*|doi[:=]*)+", "")
    return F.when(text.rlike(r"^10\.[0-9]{1,9}/[\p{L}\p{N}]"), F.regexp_replace(text, _BARE, "")).otherwise("")


def author_key_of(text: str | None) -> str:
    """The names of a packed field, each as sorted bare words, sorted: order and writing play no part."""
    names = {" ".join(sorted(_WORDS.sub(" ", v.lower()).split())) for v, _ in parse_field(text, "names")}
    return "|".join(sorted(n for n in names if n and n not in PLACEHOLDERS))


@F.pandas_udf(T.StringType())
def author_key(texts: pd.Series) -> pd.Series:
    return texts.map(author_key_of)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with its 1-based row number in a total order, without a single-task window.

    Rows are range-partitioned and written once; each range counts on from the sum of the ranges before.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(sums), "_part").withColumn(out, inside + F.col("_before")).drop("_part", "_before")
