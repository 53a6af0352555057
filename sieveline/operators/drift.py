"""Schemas that drift between files: one consistent table, and every change reported.

Each column of each file is profiled (JSON types, shape statistics, a sketch of its
values), the versions of a feed are put in order, and what disappeared is matched with
what appeared by an optimal bipartite assignment over value sketches, statistics, types
and name similarity. A matched pair is a rename; the rest are added or removed fields.

Only profiles are compared: rows are read once, aggregated with map-side combine to
one row per (file, field), and a file is matched for itself. The order of a feed is found over
ranges of files, so a feed that holds a third of the rows or files is no hot group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import stage

#: Buckets of the value sketch: a hashed count vector of tokens and token shapes.
SKETCH = 128
#: Least similarity of a rename.
RENAME_AT = 0.475

_STATS = ["s_len", "s_words", "s_digit", "s_upper", "s_alpha", "s_punct", "s_number", "s_year", "s_doi", "s_sep", "s_null"]


def field_name(name: Column) -> Column:
    """Lower case, trimmed, each run of whitespace one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def _json_type(schema: Column) -> Column:
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def payload_values(rows: DataFrame) -> DataFrame:
    """(row_id, source_file, field, kind, text): one row per key of each readable payload.

    Null, broken and non-object payloads give no row; a JSON null gives a row with null ``kind``
    and ``text``. Keys that only differ in case or whitespace are one field.
    """
    spark = rows.sparkSession
    docs = rows.select("row_id", "source_file", F.try_parse_json("payload").alias("_doc")).where(
        F.col("_doc").isNotNull() & F.schema_of_variant("_doc").startswith("OBJECT"))
    pairs = docs.lateralJoin(spark.tvf.variant_explode(F.col("_doc").outer()))
    kind = _json_type(F.schema_of_variant("value"))
    text = F.when(kind.isNotNull(), F.col("value").cast("string"))
    return pairs.where(F.col("key").isNotNull()).select(
        "row_id", "source_file", field_name(F.col("key")).alias("field"), kind.alias("kind"), text.alias("text"))


def feed_order(log: DataFrame) -> DataFrame:
    """(feed, source_file, before): every parsed file with the one before it in its feed.

    A file is in if it was parsed successfully once, whatever else is logged of it; its
    earliest ``exported_at`` counts and ties go by file name. A file without a feed has none before it.
    """
    keys = ["feed", "exported_at", "source_file"]
    files = log.where((F.col("status") == "success") & F.col("source_file").isNotNull()).groupBy("feed", "source_file").agg(
        F.min("exported_at").alias("exported_at"))
    ranged = stage(files.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    file = F.struct("feed", "source_file")
    lasts = ranged.groupBy("_part").agg(F.max_by(file, F.struct(*keys)).alias("_last")).select(
        "_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))  # a row per range
    prior = F.coalesce(F.lag(file).over(Window.partitionBy("_part").orderBy(*keys)), "_last")
    placed = ranged.join(F.broadcast(lasts), "_part").withColumn("_prior", prior)
    return placed.select("feed", "source_file", F.when(F.col("_prior.feed") == F.col("feed"), F.col("_prior.source_file")).alias("before"))


def field_profiles(values: DataFrame) -> DataFrame:
    """One row per (source_file, field): its JSON types and statistics of its values."""
    body = F.when(F.col("kind") == "array", F.regexp_replace("text", r'^\[|\]$|"', "")).otherwise(F.col("text"))
    n = F.length(body)
    share = lambda pattern: (n - F.length(F.regexp_replace(body, pattern, ""))) / F.greatest(n, F.lit(1))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    filled = F.col("kind").isNotNull()
    cells = values.select(
        "source_file", "field", "kind",
        F.when(filled, F.log1p(n) / 8).alias("s_len"),
        F.when(filled, F.log1p(F.size(F.split(body, r"\s+"))) / 5).alias("s_words"),
        F.when(filled, share(r"[0-9]+")).alias("s_digit"),
        F.when(filled, share(r"\p{Lu}+")).alias("s_upper"),
        F.when(filled, share(r"\p{L}+")).alias("s_alpha"),
        F.when(filled, share(r"[\p{P}\p{S}]+")).alias("s_punct"),
        F.when(filled, one(body.rlike(r"^\s*-?[0-9.]+\s*$"))).alias("s_number"),
        F.when(filled, one(body.rlike(r"\b(19|20)[0-9]{2}\b") & (n < 20))).alias("s_year"),
        F.when(filled, one(body.rlike(r"(?i)10\.[0-9]{4,}/|doi"))).alias("s_doi"),
        F.when(filled, one(body.rlike(r"[;|；\n]"))).alias("s_sep"),
        one(~filled).alias("s_null"),
    )
    return cells.groupBy("source_file", "field").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("kind").alias("filled"),
        *[F.avg(c).alias(c) for c in _STATS])


def value_sketch(values: DataFrame) -> DataFrame:
    """(source_file, field, sketch): hashed token counts of each field as a dense unit vector.

    Letters count as lower-case words, digits as their shape, so that codes of one form agree.
    """
    shaped = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[0-9]{2,}", "90"), r"[0-9]", "9")
    tokens = F.array_distinct(F.regexp_extract_all(shaped, F.lit(r"\p{L}+|[0-9]+|[^\p{L}0-9\s]"), F.lit(0)))
    size = F.size(tokens)
    cells = values.where("kind is not null").select(
        "source_file", "field", F.explode(tokens).alias("token"), (1 / F.sqrt(size)).alias("w")).groupBy(
        "source_file", "field", F.pmod(F.xxhash64("token"), F.lit(SKETCH)).cast("int").alias("slot")).agg(F.sum("w").alias("w"))
    return cells.groupBy("source_file", "field").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("sketch"))


def _dense(cells: dict | None) -> np.ndarray:
    out = np.zeros(SKETCH)
    for k, w in (cells or {}).items():
        out[k] = w
    norm = np.sqrt((out**2).sum())
    return out / norm if norm else out


def name_similarity(a: str, b: str) -> float:
    """Share of common letter pairs, or of common words; an abbreviation counts as near."""
    if not a or not b:
        return 0.0
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    x, y, u, v = pairs(a), pairs(b), set(a.split()), set(b.split())
    dice = 2 * len(x & y) / (len(x) + len(y))
    words = len(u & v) / min(len(u), len(v))
    short, long = sorted((a.replace(" ", ""), b.replace(" ", "")), key=len)
    rest = iter(long)
    abbreviation = 0.6 if short[0] == long[0] and all(ch in rest for ch in short) else 0.0
    return max(dice, words, abbreviation)


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Row/column pairs of greatest total score (Hungarian method with potentials)."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            i0, free = match[j0], ~done
            free[0] = False
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = np.flatnonzero(free[1:] & (cur < least[1:])) + 1
            least[better], way[better] = cur[better - 1], j0
            j1 = int(np.flatnonzero(free)[np.argmin(least[free])])
            delta = least[j1]
            u[match[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _similarities(old: list[dict], new: list[dict]) -> np.ndarray:
    """0..1 of each two profiles; less for names that are two fields of one file elsewhere."""
    sketch = np.stack([_dense(x["sketch"]) for x in old]) @ np.stack([_dense(y["sketch"]) for y in new]).T
    number = lambda rows: np.asarray([[x[c] or 0 for c in _STATS[:-1]] for x in rows], float)
    stats = 1 - np.minimum(1.0, 2.2 * np.abs(number(old)[:, None] - number(new)[None]).mean(2))
    kinds = np.asarray([[1.0 if set(x["kinds"]) & set(y["kinds"]) else 0.4 for y in new] for x in old])
    names = np.asarray([[name_similarity(x["field"], y["field"]) for y in new] for x in old])
    together = np.asarray([[y["field"] in x["others"] for y in new] for x in ({**x, "others": set(x["others"])} for x in old)])
    return (0.42 * sketch + 0.38 * stats + 0.20 * names) * (0.85 + 0.15 * kinds) - 0.25 * together


def _match_file(rows: list[dict]) -> list[tuple[str, str, str, str, float]]:
    """The changes of one file, of its fields that are not in the one before (``new``) and the other way round (``old``)."""
    old, new = [r for r in rows if r["side"] == "old"], [r for r in rows if r["side"] == "new"]
    gone, came, out = set(range(len(old))), set(range(len(new))), []
    if gone and came:
        score = _similarities(old, new)
        for i, j in assign(np.where(score >= RENAME_AT, score, -1.0)):
            if score[i, j] >= RENAME_AT:
                out.append(("renamed", old[i]["field"], new[j]["field"], float(score[i, j])))
                gone.discard(i)
                came.discard(j)
    out += [("removed", old[i]["field"], "", 0.0) for i in sorted(gone)] + [("added", "", new[j]["field"], 0.0) for j in sorted(came)]
    return [(rows[0]["source_file"], *o) for o in out]


_CHANGE = ["source_file", "change_kind", "old_name", "new_name", "similarity"]


def _match_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_match_file`` of each file of a sorted partition."""
    rows: list[dict] = []
    for frame in frames:
        out = []
        for r in frame.to_dict("records"):
            if rows and rows[0]["source_file"] != r["source_file"]:
                out += _match_file(rows)
                rows = []
            rows.append(r)
        yield pd.DataFrame(out, columns=_CHANGE)
    if rows:
        yield pd.DataFrame(_match_file(rows), columns=_CHANGE)


def schema_changes(rows: DataFrame, log: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(source_file, change_kind, old_name, new_name, similarity), one row per change.

    ``rows`` has row_id, source_file, payload; ``log`` has source_file, status, feed, exported_at.
    Compared are files with at least one readable payload. A field whose values are all null in a
    file has no type there and can't be retyped. Empty inputs give no rows.
    """
    values = stage(payload_values(rows)) if values is None else values
    profiles = stage(field_profiles(values))
    read = profiles.select("source_file").distinct()
    order = feed_order(log.join(read, "source_file", "left_semi")).where("before is not null")
    new = order.join(profiles, "source_file").select("source_file", "before", "field", F.col("kinds").alias("new_kinds"))
    old = order.join(profiles.withColumnRenamed("source_file", "before"), "before").select(
        "source_file", "before", "field", F.col("kinds").alias("old_kinds"))
    both = new.join(old, ["source_file", "before", "field"], "full_outer")
    retyped = both.where("size(new_kinds) > 0 and size(old_kinds) > 0 and new_kinds != old_kinds").select(
        "source_file", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_name"),
        F.col("field").alias("new_name"), F.lit(1.0).alias("similarity"))
    moved = stage(both.where("new_kinds is null or old_kinds is null").select(
        "source_file", F.when(F.col("old_kinds").isNull(), "new").otherwise("old").alias("side"),
        F.when(F.col("old_kinds").isNull(), F.col("source_file")).otherwise(F.col("before")).alias("of"), "field"))
    # names that stand side by side in one file anywhere are names of different things
    names = moved.select("field").distinct()
    listed = profiles.join(names, "field", "left_semi").groupBy("source_file").agg(F.collect_set("field").alias("fields"))
    others = listed.select(F.explode("fields").alias("field"), "fields").select("field", F.explode("fields").alias("other")).where(
        "field != other").distinct().groupBy("field").agg(F.collect_set("other").alias("others"))
    wanted = moved.select(F.col("of").alias("source_file"), "field").distinct()
    sketches = value_sketch(values.join(wanted, ["source_file", "field"], "left_semi"))
    sides = (
        moved.join(profiles.withColumnRenamed("source_file", "of"), ["of", "field"])
        .join(sketches.withColumnRenamed("source_file", "of"), ["of", "field"], "left")
        .join(others, "field", "left")
        .select("source_file", "side", "field", "kinds", *_STATS, "sketch", F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    )
    # matching is work on few bytes: spread over all cores, whatever the size, and walked file by file
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    matched = sides.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "source_file").sortWithinPartitions(
        "source_file", "side", "field").mapInPandas(_match_files, "source_file string, change_kind string, old_name string, new_name string, similarity double")
    return matched.unionByName(retyped)


def _canonical(group: pd.DataFrame) -> pd.DataFrame:
    """One canonical name for each set of names that renames connect within a feed.

    A name with a known alias keeps it; the others take the alias that most names of their set have.
    """
    from sieveline.sources.load import ALIASES

    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for old, new in zip(group["old_name"], group["new_name"]):
        a, b = sorted((root(old), root(new)))
        parent[b] = a
    sets: dict[str, list[str]] = {}
    for name in list(parent):
        sets.setdefault(root(name), []).append(name)
    out = []
    for names in sets.values():
        known = Counter(ALIASES[n] for n in names if n in ALIASES)
        common = min(known, key=lambda c: (-known[c], c)) if known else min(names)
        out += [(n, ALIASES.get(n, common)) for n in names]
    result = pd.DataFrame(out, columns=["field", "canonical"])
    result.insert(0, "feed", group["feed"].iloc[0])
    return result


def unified_rows(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(row_id, source_file, feed, the canonical columns, extra): every row in one schema.

    A field's canonical name is its known alias, else that of the names its renames connect it with in the
    feed, else itself. Fields without a canonical column are kept in the map ``extra``. Where a row has two
    names of one column, the first non-empty value by name wins and the others are kept in ``extra``, as are
    further values of one name (``name  #2``: no name has two spaces). Rows whose payload can't be read come out with null columns, so no row is lost; a file that no log names has a null feed.
    """
    from sieveline.sources.load import ALIASES, STANDARD

    values = stage(payload_values(rows))
    feeds = feed_order(log).select("source_file", "feed").dropDuplicates(["source_file"])
    renames = schema_changes(rows, log, values).where("change_kind = 'renamed'").join(feeds, "source_file").select(
        "feed", "old_name", "new_name").distinct()
    names = renames.groupBy("feed").applyInPandas(_canonical, "feed string, field string, canonical string")
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = values.join(feeds, "source_file", "left").join(names, ["feed", "field"], "left").withColumn(
        "canonical", F.coalesce("canonical", aliases[F.col("field")], "field"))
    columns = [c for c in STANDARD if c not in ("source_file", "source_format")]
    filled = F.col("text").isNotNull() & (F.trim("text") != "")
    cells = named.where(filled).groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("canonical", "field", "text"))).alias("_cells"))
    first = lambda c: F.get(F.filter("_cells", lambda x: x["canonical"] == c), F.lit(0))["text"]
    rest = F.filter("_cells", lambda x, i: ~x["canonical"].isin(columns) | (
        (i > 0) & (F.get("_cells", i - 1)["canonical"] == x["canonical"])))
    again = lambda x, i: F.size(F.filter(F.slice("_rest", 1, i), lambda y: y["field"] == x["field"])) + 1
    named_once = F.transform("_rest", lambda x, i: F.struct(F.when(again(x, i) > 1, F.concat(x["field"], F.lit("  #"), again(x, i).cast("string"))).otherwise(
        x["field"]).alias("field"), x["text"].alias("text")))
    wide = cells.withColumn("_rest", rest).select("row_id", *[first(c).alias(c) for c in columns], F.map_from_entries(named_once).alias("extra"))
    base = rows.select("row_id", "source_file").join(feeds, "source_file", "left")
    return base.join(wide, "row_id", "left").select("row_id", "source_file", "feed", *columns, F.to_json("extra").alias("extra"))
