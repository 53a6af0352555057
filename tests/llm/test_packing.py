import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm.packing import bucket_bounds, fill_report, pack, plan
from sieveline.llm.ranking import median_ranking


def padding(sizes, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(histogram, k):
    sizes = sorted(histogram)
    counts = [histogram[s] for s in sizes]
    got = bucket_bounds(np.asarray(sizes), np.asarray(counts, float), k)
    best = min(padding(sizes, counts, [*c, sizes[-1]]) for r in range(k) for c in itertools.combinations(sizes[:-1], r))
    assert len(got) <= k and padding(sizes, counts, got) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=8))
def test_plan_places_everything_within_capacity(histogram):
    bounds = sorted(histogram)
    rows = plan(bounds, [histogram[b] for b in bounds], 50)
    load, seen = {}, {}
    for bucket, first, items, container, each in rows:
        assert first == seen.get(bucket, 0)
        seen[bucket] = first + items
        for i in range(items):
            c = container + i // each
            load[c] = load.get(c, 0) + bounds[bucket]
    assert [seen[i] for i in range(len(bounds))] == [histogram[b] for b in bounds]
    assert max(load.values()) <= 50 and sorted(load) == list(range(len(load)))


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 30, 64, 65, 100, 250, 1000])) for i in range(400)] + [(7, 30), (8, None)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    caps = spark.createDataFrame([(1, 64), (2, 256), (3, None), (4, 0)], "cap_id long, capacity_tokens int")
    packed = pack(items, caps, buckets=5).cache()
    for cap_id, cap in ((1, 64), (2, 256)):
        got = packed.where(f"cap_id = {cap_id}").toPandas()
        assert got["n_tokens"].sum() == sum(n or 0 for _, n in rows)
        assert got.groupby("container")["n_tokens"].sum().max() <= cap
        parts = got.groupby("doc_id").size()
        small = {i for i, n in rows if n and n <= cap} - {i for i, n in rows if n and n > cap} - {7}
        assert all(parts[i] == 1 for i in small)
    report = {r.cap_id: r for r in fill_report(packed, caps).collect()}
    assert report[2].containers >= report[2].least and report[2].fill > 0.9
    assert not pack(items.limit(0), caps).collect() and not pack(items, caps.limit(0)).collect()


def test_any_number_of_capacities(spark, monkeypatch):
    monkeypatch.setattr("sieveline.llm.packing.TOGETHER", 2)
    items = spark.createDataFrame([(i, i % 9 + 1) for i in range(60)], "doc_id long, n_tokens int")
    caps = spark.createDataFrame([(c, 10 * c) for c in range(1, 6)], "cap_id long, capacity_tokens int")
    got = {r.cap_id: (r.items, r.tokens) for r in pack(items, caps).groupBy("cap_id").agg(F.countDistinct("doc_id").alias("items"), F.sum("n_tokens").alias("tokens")).collect()}
    assert got == {c: (60, sum(i % 9 + 1 for i in range(60))) for c in range(1, 6)}


SCREENING = "record_id long, run_id long, rule_score double, tfidf_score double, rank_score double, screened_at timestamp, position string"


def ranked(spark, rows, **how):
    df = spark.createDataFrame(rows, SCREENING.replace("timestamp", "string")).selectExpr(
        "record_id", "run_id", "rule_score", "tfidf_score", "rank_score", "cast(screened_at as timestamp) screened_at", "position")
    return {r.record_id: r for r in median_ranking(df, **how).collect()}


def test_median_ranking(spark):
    nan = float("nan")
    rows = [(1, 1, 5000.0, 0.1, 0.1, "2021-01-01", "x"), (2, 1, 1.0, 0.9, 0.9, "2021-01-01", "x"), (3, 1, 0.0, 0.5, 0.5, "2021-01-01", "x"),
            (4, 1, nan, None, nan, "2021-01-01", None), (5, 1, None, 0.2, None, None, "x"), (1, 2, 9.0, 9.0, 9.0, "2020-01-01", "old"), (None, 1, 1.0, 1.0, 1.0, None, None)]
    got = ranked(spark, rows)
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1].position)] == [2, 3, 5, 1, 4]
    assert got[4].median_rank is None and got[4].n_scores == 0 and got[5].n_scores == 1
    first = ranked(spark, rows, weights={"rule_score": 3.0, "tfidf_score": 1.0, "rank_score": 1.0})
    assert first[1].position == 1


def test_ranking_ties_and_nothing(spark):
    rows = [(i, 1, 1.0, 1.0, 1.0, "2021-01-01", "") for i in (5, 3, 9)]
    assert {k: r.position for k, r in ranked(spark, rows).items()} == {3: 1, 5: 2, 9: 3}
    assert ranked(spark, []) == {}
