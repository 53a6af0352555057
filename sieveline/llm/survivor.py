"""Best representative of each duplicate group, by currency reasoning.

A value of a field is in one of four states: missing, unusable (a placeholder, a text that
other publications share, the title again, broken characters), a part of another value, or
full. How states follow each other is learned from timestamped rows: over all groups, the
state of the earliest row against that of the latest. Together with containment (a part
precedes what contains it) this orders the values of a group. Of its maximal values the last
loaded survives, then that of the most trusted format, and only then the largest.

Which field has one full value is a matter of states, whatever their learned order, and of containment.
Between two values that containment leaves open, the transitions of the values themselves decide: one that
over many groups gave way to unrelated ones precedes the others of its group.

What is compared are integers (hash, size and state of a value), as aggregates with map-side
combine; texts are only fetched where one value may lie in another, one row for all copies of a
value. A value is compared with the largest of its group, not with all others. Joins on a group
are spread by its size, so that one that holds a third of the rows is never gathered in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import PLACEHOLDERS, bare, doi_key, title_key
from sieveline.llm.copies import encoded_fields
from sieveline.operators.joins import HOT_AT, digest, join_lookup, join_salted
from sieveline.operators.packed import parse_field
from sieveline.session import stage

MISSING, UNUSABLE, PART, FULL = 0, 1, 2, 3
FIELDS = ("abstract", "doi", "keywords")
#: A text that so many publications have is no abstract of any of them.
SHARED = 3
#: Transitions from the poorer to the better state, and back, that are taken as seen before anything is learned.
PRIOR = (20.0, 1.0)
#: Values of a format that are taken as seen with the share of all formats.
TRUST_PRIOR = 20.0
#: Transitions between two states weigh as so many at most: of a large table with as many either way, chance decides nothing.
WEIGHT = 100.0
_BROKEN = r"�|(?:\p{L}\?\p{L}.*){3}"
_CUT = r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\])\s*$"
_ENDED = r"[.!?。！？)\]”\"»>]\s*$"
_SEP = "\x1f"


@F.pandas_udf(T.StringType())
def term_set(texts: pd.Series) -> pd.Series:
    """The distinct terms of a packed field, lower case, sorted, joined by a control character at both ends."""
    def one(text: str | None) -> str:
        terms = sorted({v.lower() for v, _ in parse_field(text, "terms")} - set(PLACEHOLDERS) - {"-", "n/a"})
        return _SEP + _SEP.join(terms) + _SEP if terms else ""

    return texts.map(one)


def publication_groups(records: DataFrame) -> DataFrame:
    """(record_id, group_id, members) of every publication with at least two records.

    Titles and authors agree apart from writing and order. Where all DOIs of such a block agree, rows without
    one belong to it; where they differ, each DOI is a publication and the rows without one are another.
    """
    which = F.coalesce("doi", F.lit(-1)).alias("which")
    keys = stage(encoded_fields(records, authors_for_all=True).where("title is not null and author is not null").select("record_id", "title", "author", which))
    dois = stage(keys.groupBy("title", "author", "which").agg(F.min("record_id").alias("first"), F.count("*").alias("n")))
    named = F.when(F.col("which") != -1, F.col("which"))
    blocks = dois.groupBy("title", "author").agg(F.coalesce(F.min(named) < F.max(named), F.lit(False)).alias("split"), F.count("*").alias("_n"))
    placed = stage(join_lookup(dois, blocks, ["title", "author"], weight="_n").select(
        "title", "author", "which", "first", "n", F.when(F.col("split"), F.col("which")).otherwise(-2).alias("part")))
    groups = placed.groupBy("title", "author", "part").agg(F.min("first").alias("group_id"), F.sum("n").alias("members"), F.count("*").alias("_n")).where("members > 1")
    found = stage(join_lookup(placed, groups, ["title", "author", "part"], weight="_n").select("title", "author", "which", "group_id", "members", "n"))
    return join_lookup(keys, found, ["title", "author", "which"]).select("record_id", "group_id", "members")


def shared_texts(records: DataFrame) -> DataFrame:
    """(record_id, shared): records whose abstract at least ``SHARED`` different titles have, letter case and outer space aside."""
    seen = stage(records.where("length(trim(abstract)) > 0").select(
        "record_id", F.xxhash64(F.lower(F.trim("abstract"))).alias("hash"), F.xxhash64(title_key(F.col("title"))).alias("title")))
    often = seen.groupBy("hash", "title").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("titles"), F.sum("n").alias("n"))
    # a text of many rows is met in the lookup whether it is shared or not, so its rows are never gathered
    known = often.where((F.col("titles") >= SHARED) | (F.col("n") >= HOT_AT)).select("hash", "n", (F.col("titles") >= SHARED).alias("shared"))
    return join_lookup(seen.select("record_id", "hash"), known, ["hash"]).where("shared").select("record_id", "shared").distinct()


def member_values(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, members, record_id, loaded_at, source_format, abstract_key, keywords_key, cells).

    ``cells`` has (field, state, hash, size) of each field in the order of ``FIELDS``; the state is missing, unusable,
    full, or a part by its look. The keys are what values are compared by.
    """
    rows = groups.join(shared_texts(records), "record_id", "left").join(
        records.select("record_id", "title", *FIELDS, "loaded_at", "source_format"), "record_id").withColumn("abstract_key", bare(F.col("abstract")))
    text, key, terms = F.coalesce("abstract", F.lit("")), F.col("abstract_key"), F.col("keywords_key")
    unusable = key.isin(*PLACEHOLDERS) | F.col("shared").isNotNull() | (key == title_key(F.col("title"))) | text.rlike(_BROKEN)
    states = {
        "abstract": (F.when(F.trim(text) == "", MISSING).when(unusable, UNUSABLE).when(text.rlike(_CUT) | ~text.rlike(_ENDED), PART).otherwise(FULL), key, F.length(key)),
        "doi": (F.when(F.trim(F.coalesce("doi", F.lit(""))) == "", MISSING).when(doi_key(F.col("doi")) == "", UNUSABLE).otherwise(FULL), F.lit(""), F.lit(1)),
        "keywords": (F.when(F.trim(F.coalesce("keywords", F.lit(""))) == "", MISSING).when(terms == "", UNUSABLE).otherwise(FULL), terms,
                     F.length(terms) - F.length(F.replace(terms, F.lit(_SEP), F.lit("")))),
    }
    cells = F.array(*[F.struct(F.lit(i).alias("field"), state.alias("state"), F.xxhash64(k).alias("hash"), size.cast("int").alias("size"))
                      for i, (state, k, size) in enumerate(states[f] for f in FIELDS)])
    return rows.withColumn("keywords_key", term_set("keywords")).select(
        "group_id", "members", "record_id", F.col("loaded_at").cast("timestamp").alias("loaded_at"), "source_format", "abstract_key", "keywords_key", cells.alias("cells"))


def cells_of(values: DataFrame) -> DataFrame:
    """(group_id, record_id, loaded_at, format, field, state, hash, size): a row per member and field, no texts; ``format`` is a hash."""
    return values.select("group_id", "record_id", "loaded_at", digest(F.col("source_format")).alias("format"), F.explode("cells").alias("c")).select(
        "group_id", "record_id", "loaded_at", "format", "c.*")


def distinct_values(cells: DataFrame) -> DataFrame:
    """(group_id, field, hash, n, record_id, state, size, first, last): every usable value of a group once, with the smallest record that has it and its times."""
    return cells.where(F.col("state") > UNUSABLE).groupBy("group_id", "field", "hash").agg(
        F.count("*").alias("n"), F.min("record_id").alias("record_id"), F.max("state").alias("state"), F.max("size").alias("size"),
        F.min("loaded_at").alias("first"), F.max("loaded_at").alias("last"))


def against_top(once: DataFrame, top: DataFrame, values: DataFrame) -> DataFrame:
    """Every value of ``once`` but its group's top, with the columns of ``top`` and ``within``, whether it lies in that.

    ``top`` is of ``_tops``. In a value of equal or smaller size nothing else lies, so only smaller values and their
    tops meet as texts.
    """
    others = stage(join_lookup(once, top.withColumn("_n", F.col("vals")), ["group_id", "field"], weight="_n").where("hash != top_hash"))
    small = others.where("size < top_size")
    wanted = small.select("record_id", "group_id", "field", "hash", "vals", F.lit(False).alias("is_top")).unionByName(
        top.where("vals > 1").select(F.col("top_record").alias("record_id"), "group_id", "field", F.col("top_hash").alias("hash"), "vals", F.lit(True).alias("is_top")))
    text = F.when(F.col("field") == FIELDS.index("keywords"), F.col("keywords_key")).otherwise(F.col("abstract_key"))
    texts = stage(wanted.join(values.select("record_id", "abstract_key", "keywords_key"), "record_id").select(
        "group_id", "field", "hash", "vals", "is_top", text.alias("text")))
    met = join_salted(texts.where("not is_top").drop("is_top"), texts.where("is_top").select("group_id", "field", "vals", F.col("text").alias("whole")),
                      ["group_id", "field"], "vals", ["hash"])
    terms = F.size(F.array_except(F.split("text", _SEP), F.split("whole", _SEP))) == 0
    inside = F.when(F.col("field") == FIELDS.index("keywords"), terms).otherwise(F.col("whole").contains(F.col("text")))
    held = met.where(inside).select("group_id", "field", "hash", F.lit(True).alias("within")).distinct()
    return others.join(held, ["group_id", "field", "hash"], "left").withColumn("within", F.coalesce("within", F.lit(False)))


def _tops(once: DataFrame, among: Column, early: Column) -> DataFrame:
    """The largest value of each group and field, an ``early`` one only if there is no other, with the number of its rows and of all values of the group."""
    best = F.max(F.when(among, F.struct((~early).alias("late"), "size", "n", "record_id", "hash", "first", "last"))).alias("top")
    return once.groupBy("group_id", "field").agg(best, F.count("*").alias("vals")).where("top is not null").select(
        "group_id", "field", F.col("top.hash").alias("top_hash"), F.col("top.record_id").alias("top_record"), F.col("top.size").alias("top_size"),
        F.col("top.n").alias("top_n"), F.col("top.first").alias("top_first"), F.col("top.last").alias("top_last"), (~F.col("top.late")).alias("top_early"), "vals")


def contained(once: DataFrame, values: DataFrame) -> DataFrame:
    """(group_id, field, hash, n) of the values that lie in a greater one of their group.

    The largest value of each group is settled, and what lies in it; what is left is compared with the largest of
    that, until nothing is left. There are as many turns as values of one group that don't lie in each other.
    """
    left, found = once, once.limit(0).select("group_id", "field", "hash", "n")
    while True:
        top = stage(_tops(left, F.lit(True), F.lit(False)))
        if top.where("vals > 1").isEmpty():
            return found
        rest = stage(against_top(left, top.drop("top_n"), values).select(*left.columns, "within"))
        found = found.unionByName(rest.where("within").select("group_id", "field", "hash", "n"))
        left = rest.where("not within").drop("within")


def learned_order(cells: DataFrame) -> list[list[float]]:
    """For each of ``FIELDS`` the currency of each state, from first against last states over all groups (48 numbers at most).

    A missing value precedes every other. The others stand by their mean log-odds of being the later state, so
    two neighbours change places as soon as what was seen outweighs ``PRIOR``.
    """
    when = F.when(F.col("loaded_at").isNotNull(), F.struct("loaded_at", "record_id"))
    ends = cells.groupBy("group_id", "field").agg(F.min_by("state", when).alias("a"), F.max_by("state", when).alias("b"))
    seen = {(r.field, r.a, r.b): r.n for r in ends.where("a != b").groupBy("field", "a", "b").agg(F.count("*").alias("n")).collect()}

    def odds(field: int, a: int, b: int) -> float:
        """Log-odds that state a precedes state b."""
        there, back = seen.get((field, a, b), 0), seen.get((field, b, a), 0)
        share = min(1.0, WEIGHT / max(there + back, 1))
        return math.log((there * share + PRIOR[a > b]) / (back * share + PRIOR[a < b]))

    valued = (UNUSABLE, PART, FULL)
    return [[-math.inf, *(sum(odds(f, t, s) for t in valued if t != s) / 2 for s in valued)] for f in range(len(FIELDS))]


def learned_early(open_pairs: DataFrame) -> DataFrame:
    """(field, hash, n, early): values that precede whatever they meet, from their transitions over all groups.

    ``open_pairs`` has values and the tops of their groups that don't lie in each other. The earlier one is both
    first and last loaded before the other; equal and null times say nothing. A group counts a value once. A value is
    early as soon as what was seen outweighs ``PRIOR``.
    """
    sooner = F.coalesce((F.col("first") < F.col("top_first")) & (F.col("last") < F.col("top_last")), F.lit(False))
    later = F.coalesce((F.col("first") > F.col("top_first")) & (F.col("last") > F.col("top_last")), F.lit(False))
    sides = F.array(F.struct("hash", sooner.alias("before"), later.alias("after")), F.struct(F.col("top_hash").alias("hash"), later.alias("before"), sooner.alias("after")))
    seen = open_pairs.select("group_id", "field", F.explode(sides).alias("s")).groupBy("group_id", "field", "s.hash").agg(F.max("s.before").alias("before"), F.max("s.after").alias("after"))
    counts = seen.groupBy("field", "hash").agg(F.count("*").alias("n"), F.count_if(F.col("before") & ~F.col("after")).alias("there"), F.count_if(F.col("after") & ~F.col("before")).alias("back"))
    share = F.least(F.lit(1.0), WEIGHT / F.greatest(F.col("there") + F.col("back"), F.lit(1)))
    return counts.where(F.col("there") * share + PRIOR[1] > F.col("back") * share + PRIOR[0]).select("field", "hash", "n", F.lit(True).alias("early"))


def learned_trust(cells: DataFrame) -> DataFrame:
    """(format, field, trust, n): the share of a format's values that are full, drawn to that of all formats."""
    counts = stage(cells.groupBy("format", "field").agg(F.count_if(F.col("state") == FULL).alias("full"), F.count_if(F.col("state") > MISSING).alias("valued"), F.count("*").alias("n")))
    total = counts.groupBy("field").agg((F.sum("full") / F.greatest(F.sum("valued"), F.lit(1))).alias("share"))  # a row per field
    return counts.join(F.broadcast(total), "field").select(
        "format", "field", ((F.col("full") + TRUST_PRIOR * F.col("share")) / (F.col("valued") + TRUST_PRIOR)).alias("trust"), "n")


def latest_values(values: DataFrame) -> DataFrame:
    """(group_id, members, loaded_at, trusted, and per field its state and record): the topologically latest values of each group.

    ``trusted`` is the record of the most trusted format.
    """
    cells = stage(cells_of(values))
    held = stage(contained(stage(distinct_values(cells)), values).withColumn("within", F.lit(True)))
    known = cells.withColumn("hash", F.when(F.col("state") > UNUSABLE, F.col("hash")))
    graded = join_lookup(known, held, ["group_id", "field", "hash"], how="left").withColumns({
        "within": F.coalesce("within", F.lit(False)), "state": F.when(F.col("within"), PART).otherwise(F.col("state"))})
    graded = stage(join_lookup(graded, stage(learned_trust(graded)), ["format", "field"]))
    order = F.array(*[F.array(*[F.lit(x) for x in states]) for states in learned_order(graded)])
    loaded = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))
    by = F.struct(order[F.col("field")][F.col("state")].alias("order"), (~F.col("within")).alias("maximal"), loaded.alias("loaded"), "trust", "size",
                  (-F.col("record_id")).alias("first"), F.col("state").alias("state"))
    best = graded.groupBy("group_id", "field").agg(F.max(by).alias("b"))
    pick = lambda i, c: F.max(F.when(F.col("field") == i, F.col(f"b.{c}")))
    wide = best.groupBy("group_id").agg(*[e for i, f in enumerate(FIELDS) for e in ((-pick(i, "first")).alias(f"{f}_from"), pick(i, "state").alias(f"{f}_state"))])
    trust = graded.groupBy("group_id", "record_id").agg(F.sum("trust").alias("trust"), F.max(loaded).alias("loaded")).groupBy("group_id").agg(
        (-F.max(F.struct("trust", "loaded", (-F.col("record_id")).alias("first")))["first"]).alias("trusted"))
    size = values.groupBy("group_id").agg(F.max("members").alias("members"), F.max("loaded_at").alias("loaded_at"))
    return wide.join(trust, "group_id").join(size, "group_id")


def _settled(once: DataFrame, open_pairs: DataFrame, early: DataFrame, values: DataFrame) -> DataFrame:
    """Tops of the groups and fields of ``open_pairs`` that all other values precede, by ``early`` or as they lie in them."""
    key = ["group_id", "field"]
    again = join_lookup(once, open_pairs.groupBy(*key).agg(F.count("*").alias("pairs")), key, weight="pairs")
    again = stage(join_lookup(again, early, ["field", "hash"], how="left").withColumn("early", F.coalesce("early", F.lit(False))))
    top = stage(_tops(again, F.col("state") == FULL, F.col("early")))
    rivals = against_top(again, top.where("vals > 1").drop("top_n"), values).where("not within and (top_early or not early)")
    return top.join(rivals.select(*key).distinct(), key, "left_anti")


def only_full(records: DataFrame) -> DataFrame:
    """(group_id, field_name, record_id): fields of which one member alone holds the full and usable value.

    Every other member has none, something unusable, or a part of it: the value is the one maximal element of the
    order of its group. Two members with the same full value, or with values that don't contain each other, are no
    case, unless one was learned to precede others (``learned_early``). Which state is the later plays no part in this.
    """
    values = stage(member_values(records, publication_groups(records)))
    once = stage(distinct_values(cells_of(values)))
    top = stage(_tops(once, F.col("state") == FULL, F.lit(False)))
    open_pairs = stage(against_top(once, top.where("vals > 1").drop("top_n"), values).where("not within").select(
        "group_id", "field", "hash", "first", "last", "top_hash", "top_first", "top_last"))
    unrivalled = top.join(open_pairs.select("group_id", "field").distinct(), ["group_id", "field"], "left_anti")
    early = learned_early(open_pairs)
    if not early.isEmpty():
        unrivalled = unrivalled.unionByName(_settled(once, open_pairs, stage(early), values))
    names = F.array(*[F.lit(f) for f in FIELDS])
    return unrivalled.where("top_n = 1").select("group_id", names[F.col("field")].alias("field_name"), F.col("top_record").alias("record_id"))


def survivors(records: DataFrame) -> DataFrame:
    """One record per publication: (record_id, members, abstract, doi, keywords, source_format, loaded_at, and per field: f_from, f_format).

    ``record_id`` is the smallest of the group; the ``_from`` and ``_format`` columns name the record each value came
    from and its format, ``source_format`` is the most trusted format of the group and ``loaded_at`` its last time. A
    record in no group survives as it is. Null timestamps never decide. Of several rows of one ``record_id`` a group
    counts one.
    """
    groups = stage(publication_groups(records))
    best = stage(latest_values(stage(member_values(records, groups))))
    kept = best.select(F.col("group_id").alias("record_id"), "members", "loaded_at", "trusted", *[f"{f}_from" for f in FIELDS])
    for f in FIELDS:  # each text goes to its group once
        kept = kept.join(records.select(F.col("record_id").alias(f"{f}_from"), f, F.col("source_format").alias(f"{f}_format")), f"{f}_from")
    kept = kept.join(records.select(F.col("record_id").alias("trusted"), "source_format"), "trusted")
    alone = records.join(groups, "record_id", "left_anti").select(
        "record_id", F.lit(1).cast("long").alias("members"), *FIELDS, "source_format", "loaded_at", *[F.col("record_id").alias(f"{f}_from") for f in FIELDS],
        *[F.col("source_format").alias(f"{f}_format") for f in FIELDS])
    kept = kept.dropDuplicates(["record_id"]).withColumn("loaded_at", F.col("loaded_at").cast(records.schema["loaded_at"].dataType))
    return kept.select(alone.columns).unionByName(alone)
