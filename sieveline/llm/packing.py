"""Filling fixed-capacity containers with items, by optimal length buckets.

A histogram of the item sizes over the whole corpus (at most ``capacity`` numbers) goes to the
driver. Dynamic programming chooses the bucket boundaries that minimise padding, the sum of
(boundary - size). Token-budget batches form inside each bucket, largest first; the budget a
batch leaves is filled with items of smaller buckets, since batches of one bucket alone can
waste almost half a container where items are a little larger than half of it. Only counts
are planned on the driver; items find their place by their number within their bucket.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import stage

#: Most buckets per capacity.
BUCKETS = 192
#: Container sizes that are planned in one query; more are worked off in turns.
TOGETHER = 32


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding; sizes ascend.

    One pass of the convex hull of lines per bucket: linear in the number of sizes.
    """
    n = len(sizes)
    if n <= buckets:
        return [int(s) for s in sizes]
    total, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    cost = [float(sizes[j - 1] * total[j] - mass[j]) if j else 0.0 for j in range(n + 1)]
    back = np.zeros((buckets, n + 1), np.int32)
    for k in range(1, buckets):
        # new[j] = size_j * total_j - mass_j + min over i of (cost[i] + mass_i - size_j * total_i)
        hull: list[tuple[float, float, int]] = []
        new, at = cost[:], 0
        for j in range(1, n + 1):
            slope, cut = -float(total[j - 1]), cost[j - 1] + float(mass[j - 1])
            while len(hull) >= 2 and (cut - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, cut, j - 1))
            at = min(at, len(hull) - 1)
            x = float(sizes[j - 1])
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j] = x * float(total[j]) - float(mass[j]) + hull[at][0] * x + hull[at][1]
            back[k, j] = hull[at][2]
        cost = new
    bounds, j = [], n
    for k in range(buckets - 1, -1, -1):
        if j == 0:
            break
        bounds.append(int(sizes[j - 1]))
        j = int(back[k, j])
    return sorted(set(bounds))


def plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(bucket, first item, items, first container, items per container): where the items of each bucket go.

    A pattern takes as many items of the largest bucket left as fit, then the largest that fit the rest; it is
    repeated while its buckets last, so there are about as many patterns as buckets.
    """
    left, taken, out, container = list(counts), [0] * len(bounds), [], 0
    top = len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        space, pattern, k = capacity, {}, top
        while k >= 0 and space >= bounds[0]:
            if left[k] and bounds[k] <= space:
                use = min(space // bounds[k], left[k])
                pattern[k] = use
                space -= use * bounds[k]
            k = min(k - 1, bisect_right(bounds, space) - 1)
        times = min(left[k] // use for k, use in pattern.items())
        for k, use in pattern.items():
            out.append((k, taken[k], use * times, container, use))
            taken[k] += use * times
            left[k] -= use * times
        container += times
    return out


def pack(items: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "n_tokens", buckets: int = BUCKETS) -> DataFrame:
    """(cap_id, container, key, part, size): every item in a container of every capacity.

    ``size`` is what is put in. An item larger than the capacity is cut into parts of the capacity and a rest;
    no other item is split. Items of size 0 or null are put nowhere. Keys may repeat. Containers count from 0.
    Capacities below 1 and null ones are left out.
    """
    spark = items.sparkSession
    caps = {r.cap_id: int(r.capacity_tokens) for r in capacities.where("capacity_tokens > 0").select("cap_id", "capacity_tokens").distinct().toLocalIterator()}
    base = stage(items.where(F.col(size) > 0).select(F.col(key).alias("_key"), F.col(size).cast("int").alias("_size")))
    out, turns = [], []
    for cap_id, cap in sorted(caps.items()):
        if len(out) == TOGETHER:
            turns.append(stage(reduce(DataFrame.unionByName, out)))
            out = []
        chunks = F.explode(F.sequence(F.lit(0), ((F.col("_size") - 1) / cap).cast("int")))
        parts = base.select("_key", chunks.alias("part"), "_size").select("_key", "part", F.least(F.lit(cap), F.col("_size") - F.col("part") * cap).alias("tokens"))
        histogram = sorted((r.tokens, r.n) for r in parts.groupBy("tokens").agg(F.count("*").alias("n")).collect())  # at most cap rows
        if not histogram:
            continue
        sizes, counts = np.asarray([h[0] for h in histogram]), np.asarray([h[1] for h in histogram], np.float64)
        bounds = bucket_bounds(sizes, counts, buckets)
        per = np.bincount(np.searchsorted(bounds, sizes), counts, len(bounds)).astype(np.int64).tolist()
        patterns: dict[int, list[tuple[int, int, int]]] = {}
        for k, first, _, container, each in sorted(plan(bounds, per, cap)):
            patterns.setdefault(int(k), []).append((int(first), int(container), int(each)))
        where = spark.createDataFrame(list(patterns.items()), "bucket int, patterns array<struct<first:long,container:long,each:int>>")  # a row per bucket
        bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("tokens")))
        numbered = _numbered(parts.withColumn("bucket", bucket))
        placed = numbered.join(F.broadcast(where), "bucket").withColumn("of", F.element_at(F.filter("patterns", lambda p: p["first"] <= F.col("number")), -1))
        out.append(placed.select(F.lit(cap_id).alias("cap_id"), (F.col("of.container") + F.floor((F.col("number") - F.col("of.first")) / F.col("of.each"))).cast("long").alias("container"),
                                 F.col("_key").alias(key), "part", F.col("tokens").alias(size)))
    empty = base.limit(0).select(F.lit(0).cast("long").alias("cap_id"), F.lit(0).cast("long").alias("container"), F.col("_key").alias(key), F.lit(0).alias("part"), F.col("_size").alias(size))
    return reduce(DataFrame.unionByName, [*turns, *out]) if out else empty


def _numbered(parts: DataFrame) -> DataFrame:
    """Add ``number``, 0-based within the bucket, counted inside partitions and shifted by those before."""
    kept = stage(parts.withColumn("_part", F.spark_partition_id()))
    sums = kept.groupBy("bucket", "_part").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part", "bucket").orderBy("_key", "part")) - 1
    return kept.join(before, ["bucket", "_part"]).withColumn("number", inside + F.col("_before"))


def fill_report(packed: DataFrame, capacities: DataFrame, size: str = "n_tokens") -> DataFrame:
    """(cap_id, capacity_tokens, containers, tokens, least, fill): how full the containers are.

    ``least`` is the number no packing can be below, tokens / capacity.
    """
    used = packed.groupBy("cap_id", "container").agg(F.sum(size).alias("used")).groupBy("cap_id").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    cap = F.col("capacity_tokens")
    return used.join(capacities.select("cap_id", "capacity_tokens").distinct(), "cap_id").select(
        "cap_id", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / cap).alias("least"), "fullest",
        F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("fill"))
