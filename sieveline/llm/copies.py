"""Duplicates hidden by formatting differences, by dictionary encoding.

Every distinct value of a column is canonicalised once and gets an integer; records become
sorted tuples of (field, integer), and equal tuples are copies. Text is shuffled once per
distinct value and task, records only as integers.

The integer of a value is the 64-bit hash of its canonical form, so that no numbering has to be
joined to the values. Tuples have two integers: two publications could only be taken for one if
both collide, of n distinct pairs with a chance of n² / 2^129 (10^10 pairs: 10^-19).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import author_key, doi_key, title_key
from sieveline.operators.joins import digest, join_lookup
from sieveline.session import stage

TITLE, DOI, AUTHOR = 0, 1, 2


def _canonical() -> Column:
    field, raw = F.col("field"), F.col("raw")
    return F.when(field == TITLE, title_key(raw)).when(field == DOI, doi_key(raw))


def encoded_fields(records: DataFrame, authors_for_all: bool = False) -> DataFrame:
    """(record_id, title, doi, author): integer of each field, null where there is no usable value.

    Author integers are only made where the DOI can't tell, unless ``authors_for_all``. Records without any
    usable value have no row.
    """
    doi = doi_key(F.col("doi"))
    fields = F.array(
        F.struct(F.lit(TITLE).alias("field"), F.col("title").alias("raw")),
        F.struct(F.lit(DOI).alias("field"), F.when(doi != "", F.col("doi")).alias("raw")),
        F.struct(F.lit(AUTHOR).alias("field"), (F.col("author") if authors_for_all else F.when(doi == "", F.col("author"))).alias("raw")),
    )
    values = records.select("record_id", F.explode(fields).alias("f")).select("record_id", "f.field", "f.raw").where(
        F.col("raw").isNotNull())
    key = [digest(F.col("raw")).alias("_h1"), digest(F.col("raw"), 1).alias("_h2")]
    distinct = values.groupBy("field", "raw").agg(F.count("*").alias("n"))
    people = distinct.where(F.col("field") == AUTHOR).withColumn("canon", author_key("raw"))
    canon = distinct.where(F.col("field") != AUTHOR).withColumn("canon", _canonical()).unionByName(people).where("canon != ''")
    dictionary = stage(canon.select("field", *key, "n", F.xxhash64("canon").alias("code")))
    coded = join_lookup(values.select("record_id", "field", *key), dictionary, ["field", "_h1", "_h2"])
    pick = lambda k: F.max(F.when(F.col("field") == k, F.col("code")))
    return coded.groupBy("record_id").agg(pick(TITLE).alias("title"), pick(DOI).alias("doi"), pick(AUTHOR).alias("author"))


def record_tuples(records: DataFrame) -> DataFrame:
    """(record_id, tuple): sorted (field, integer) pairs that say which publication a record is of.

    A record without a usable title, or with neither DOI nor authors, has no tuple and is no row here.
    """
    who = F.when(F.col("doi").isNotNull(), F.struct(F.lit(DOI).alias("field"), F.col("doi").alias("code"))).otherwise(
        F.struct(F.lit(AUTHOR).alias("field"), F.col("author").alias("code")))
    named = F.array_sort(F.array(F.struct(F.lit(TITLE).alias("field"), F.col("title").alias("code")), who))
    return encoded_fields(records).where("title is not null and (doi is not null or author is not null)").select(
        "record_id", named.alias("tuple"))


def copy_groups(tuples: DataFrame) -> DataFrame:
    """(tuple, group_id, copies): the smallest record and the number of records of each tuple."""
    return tuples.groupBy("tuple").agg(F.min("record_id").alias("group_id"), F.count("*").alias("copies"))


def collapse(records: DataFrame) -> DataFrame:
    """(record_id, copies): every publication once, by its smallest record.

    Records that can't be compared (no tuple) stand for themselves. Null titles and DOIs count as missing;
    repeated rows of one ``record_id`` are copies of each other and give one row. Empty tables give none.
    """
    tuples = stage(record_tuples(records))
    groups = copy_groups(tuples).select(F.col("group_id").alias("record_id"), "copies")
    alone = records.select("record_id").join(tuples, "record_id", "left_anti").groupBy("record_id").agg(F.count("*").alias("copies"))
    return groups.unionByName(alone)


def copy_members(records: DataFrame) -> DataFrame:
    """(group_id, record_id) of every group of two or more."""
    tuples = stage(record_tuples(records))
    parts = [F.col("tuple")[0]["code"].alias("_title"), F.col("tuple")[1]["field"].alias("_field"), F.col("tuple")[1]["code"].alias("_code")]
    groups = stage(copy_groups(tuples).where("copies > 1").select(*parts, "group_id", "copies"))
    return join_lookup(tuples.select("record_id", *parts), groups, ["_title", "_field", "_code"], weight="copies").select("group_id", "record_id")


def copy_pairs(records: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b), a < b: all pairs within each group.

    The result is quadratic in the size of a group by definition; ``collapse`` and ``copy_members`` are not.
    """
    members = stage(copy_members(records).distinct())
    left = members.withColumnRenamed("record_id", "record_id_a")
    right = members.withColumnRenamed("record_id", "record_id_b")
    return left.join(right, "group_id").where("record_id_a < record_id_b").select("record_id_a", "record_id_b")
