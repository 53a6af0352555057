import itertools
import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.operators.drift import assign, feed_order, name_similarity, schema_changes, unified_rows

ROWS = "row_id long, source_file string, payload string"
LOG = "source_file string, status string, feed string, exported_at timestamp"


def tables(spark, files):
    rows, log, n = [], [], itertools.count()
    for i, (name, payloads) in enumerate(files):
        log.append((name, "success", "f", f"2021-01-{i + 1:02d} 00:00:00"))
        rows += [(next(n), name, p if p is None or isinstance(p, str) else json.dumps(p)) for p in payloads]
    log = spark.createDataFrame(log, "source_file string, status string, feed string, at string").selectExpr(
        "source_file", "status", "feed", "cast(at as timestamp) exported_at")
    return spark.createDataFrame(rows, ROWS), log


def doi(i):
    return f"10.1000/abc.{i}"


def test_changes(spark):
    a = [{"Title": f"Effects of thing {i} on sleep", "DOI": doi(i), "Year": 2000 + i, "note": "x"} for i in range(6)]
    b = [{" title ": f"Results of trial {i} in adults", "Digital  Object ID": doi(i + 9), "Year": str(2000 + i), "Language": "English"} for i in range(6)]
    rows, log = tables(spark, [("a", [*a, None, "{broken", "[1]"]), ("b", b)])
    got = {tuple(r)[:4] for r in schema_changes(rows, log).collect()}
    assert got == {("b", "renamed", "doi", "digital object id"), ("b", "retyped", "year", "year"),
                   ("b", "added", "", "language"), ("b", "removed", "note", "")}


def test_order_is_by_export_and_failed_files_are_skipped(spark):
    rows, log = tables(spark, [("z", [{"a": 1}]), ("m", [{"a": 1}]), ("b", [{"a": 1, "c": True}])])
    log = log.unionByName(spark.createDataFrame([("m", "failed", "f"), ("x", "failed", "f")], "source_file string, status string, feed string").selectExpr(
        "source_file", "status", "feed", "timestamp'2021-01-01' exported_at")).unionByName(log.where("source_file = 'z'"))
    assert {tuple(r)[:4] for r in schema_changes(rows, log).collect()} == {("b", "added", "", "c")}


def test_null_values_have_no_type(spark):
    rows, log = tables(spark, [("a", [{"x": 1}]), ("b", [{"x": None}]), ("c", [{"x": "1"}])])
    assert not schema_changes(rows, log).collect()


def test_empty(spark):
    rows, log = tables(spark, [("a", [{"x": 1}])])
    assert not schema_changes(rows.limit(0), log).collect()
    assert not schema_changes(rows, log.limit(0)).collect()


def test_unified_keeps_every_row(spark):
    rows, log = tables(spark, [("a", [{"Title": "T1", "DI": "10.1/a", "vol": 3}, "{bad", None]), ("b", [{"ti": "T2", "DOI": "10.1/b"}])])
    got = {r.row_id: r for r in unified_rows(rows, log).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0].title, got[0].doi, got[0].extra) == ("T1", "10.1/a", '{"vol":"3"}')
    assert (got[3].title, got[3].doi) == ("T2", "10.1/b") and got[1].title is None


def test_unified_loses_no_value(spark):
    rows, log = tables(spark, [("a", [{"AU": "Smith, A", "AF": "Smith, Alice"}, '{"x": "1", "X ": "2", "author": "B"}'])])
    got = {r.row_id: r for r in unified_rows(rows, log).collect()}
    assert (got[0].author, got[0].extra) == ("Smith, Alice", '{"au":"Smith, A"}')
    assert (got[1].author, json.loads(got[1].extra)) == ("B", {"x": "1", "x  #2": "2"})


def test_a_known_name_keeps_its_column():
    import pandas as pd

    from sieveline.operators.drift import _canonical

    got = _canonical(pd.DataFrame({"feed": "f", "old_name": ["ti", "heading", "heading"], "new_name": ["heading", "ab", "t1"]}))
    assert dict(zip(got["field"], got["canonical"])) == {"ti": "title", "heading": "title", "ab": "abstract", "t1": "title"}


def test_files_without_a_feed_are_unrelated(spark):
    rows, log = tables(spark, [("a", [{"x": 1}]), ("b", [{"y": "z"}])])
    assert not schema_changes(rows, log.selectExpr("source_file", "status", "cast(null as string) feed", "exported_at")).collect()


def test_order_over_ranges_of_files(spark):
    log = spark.createDataFrame([(f"s{i:03d}", "success", "big" if i % 3 else f"f{i % 7}", i) for i in range(200)], "source_file string, status string, feed string, i int")
    got = {r.source_file: r.before for r in feed_order(log.selectExpr("*", "timestamp_seconds(1000 - i) exported_at")).collect()}
    want, last = {}, {}
    for r in sorted(log.collect(), key=lambda r: -r.i):
        want[r.source_file], last[r.feed] = last.get(r.feed), r.source_file
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    score = np.random.default_rng(seed).random((n, m))
    pairs = assign(score)
    assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    small, big = (n, m) if n <= m else (m, n)
    best = max(sum((score[i, j] if n <= m else score[j, i]) for i, j in enumerate(p)) for p in itertools.permutations(range(big), small))
    assert abs(sum(score[i, j] for i, j in pairs) - best) < 1e-9


def test_names():
    assert name_similarity("volume", "vol") > 0.5 > name_similarity("doi", "language")
    assert name_similarity("", "x") == 0
