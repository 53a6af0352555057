import pytest

from sieveline.llm.common import author_key_of, numbered
from sieveline.llm.copies import collapse, copy_members, copy_pairs
from sieveline.llm.survivor import only_full, publication_groups, survivors
from sieveline.operators.joins import join_lookup, join_salted
from pyspark.sql import functions as F

SCHEMA = "record_id long, title string, author string, abstract string, keywords string, doi string, source_format string, loaded_at timestamp_ntz, group_id string"


def frame(spark, rows):
    """rows: (id, title, author, abstract, keywords, doi); other columns, one with a clashing name, are filled in."""
    import datetime
    return spark.createDataFrame([(*r, "ris", datetime.datetime(2021, 1, 1 + r[0] % 20), "clash") for r in rows], SCHEMA)


COPIES = [
    (1, "A Title: of night-shift", "Doe, A.; Roe, B.", None, None, "10.1000/X.1"),
    (2, "a title of NIGHT–SHIFT ", None, None, None, "https://doi.org/10.1000/x.1"),
    (3, "A title\n of night shift!", "x", None, None, "doi: 10.1000/ x.1."),
    (4, "A title of night shift", "Roe, B. | Doe, A.", None, None, None),
    (5, "A title of night shift", "Doe, A; Roe, B", None, None, "pending"),
    (6, "A title of night shift", "Poe, C.", None, None, "-"),
    (7, "NA", "Doe, A.", None, None, "10.1000/x.1"),
    (8, None, None, None, None, None),
    (9, "A title of night shift", None, None, None, None),
    (9, "A title of night shift", None, None, None, None),
    (10, "A title of night shift", "", "", "", "10.1000/x.2"),
]


def test_pairs(spark):
    got = sorted(map(tuple, copy_pairs(frame(spark, COPIES)).collect()))
    assert got == [(1, 2), (1, 3), (2, 3), (4, 5)]


def test_collapse_and_members(spark):
    df = frame(spark, COPIES)
    assert {r.record_id: r.copies for r in collapse(df).collect()} == {1: 3, 4: 2, 6: 1, 7: 1, 8: 1, 9: 2, 10: 1}
    assert {(r.group_id, r.record_id) for r in copy_members(df).collect()} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)}


def test_identical_rows_and_nothing(spark):
    df = frame(spark, [(i, "Same title", None, None, None, "10.1/abc") for i in range(40)])
    assert copy_pairs(df).count() == 40 * 39 // 2
    assert [tuple(r) for r in collapse(df).collect()] == [(0, 40)]
    for f in (copy_pairs, collapse, copy_members, only_full, survivors):
        assert not f(df.limit(0)).collect()


def test_author_key():
    assert author_key_of("Doe, A.; Roe, B.") == author_key_of("B. Roe | A Doe") != author_key_of("Doe, A.")
    assert author_key_of(None) == author_key_of(" - ") == ""


FULL = "One sentence about sleep. Another sentence about pain. A third one ends here."
GROUP = [
    (1, "T one", "Doe, A.", FULL[:40] + "…", "sleep; pain", None),
    (2, "t One!", "Doe, A.", FULL, "pain", "https://doi.org/"),
    (3, "T one", "Doe, A.", "[no abstract]", None, "10.1/a.b"),
    (4, "T one", "Doe, A.", "T one", "", "n/a"),
    (5, "T one", "Doe, A.", FULL.replace("e", "�"), "pain; pain; pain", None),
    (6, "T one", "Roe, A.", FULL, None, None),
]


def test_only_full(spark):
    got = sorted(map(tuple, only_full(frame(spark, GROUP)).collect()))
    assert got == [(1, "abstract", 2), (1, "doi", 3), (1, "keywords", 1)]


def test_two_full_values_or_a_conflict_are_no_case(spark):
    rows = [*GROUP, (7, "T one", "Doe, A.", FULL + " ", "sleep; diet", "10.1/A.B")]
    assert not only_full(frame(spark, rows)).collect()


def test_a_text_many_publications_share_is_no_abstract(spark):
    notice = "The summary may be read on the site of the publisher."
    rows = [(i, f"Title {i // 2}", "Doe, A.", notice if i % 2 else None, None, None) for i in range(8)]
    assert not only_full(frame(spark, rows)).collect()


def test_groups_by_doi(spark):
    rows = [(1, "T", "A", None, None, "10.1/a"), (2, "T", "A", None, None, "10.1/a"), (3, "T", "A", None, None, "10.1/b"), (4, "T", "A", None, None, None),
            (5, "U", "A", None, None, "10.1/c"), (6, "U", "A", None, None, None)]
    assert {(r.record_id, r.group_id) for r in publication_groups(frame(spark, rows)).collect()} == {(1, 1), (2, 1), (5, 5), (6, 5)}


def test_survivors(spark):
    got = {r.record_id: r for r in survivors(frame(spark, GROUP)).collect()}
    assert sorted(got) == [1, 6]
    assert (got[1].abstract, got[1].doi, got[1].keywords, got[1].members) == (FULL, "10.1/a.b", "sleep; pain", 5)
    assert (got[1].abstract_from, got[1].doi_from, got[1].keywords_from) == (2, 3, 1)
    without = frame(spark, GROUP).withColumn("loaded_at", F.lit(None).cast("timestamp_ntz"))
    assert {r.record_id: r.doi for r in survivors(without).collect()}[1] == "10.1/a.b"


def shortened(spark, groups, back=0):
    """Full abstracts that a later row cuts, the other way round in the last ``back`` groups."""
    rows = []
    for g in range(groups):
        texts = [f"Text {g}. {FULL}", f"Text {g}. {FULL[:40]}…"]
        rows += [(2 * g + k, f"Title {g}", "Doe, A.", text, None, None) for k, text in enumerate(reversed(texts) if g >= groups - back else texts)]
    return frame(spark, rows).withColumn("loaded_at", F.expr("timestamp_ntz'2021-01-01 00:00:00' + make_dt_interval(0, 0, cast(record_id as int))"))


@pytest.mark.parametrize("groups, back, cut", [(10, 0, False), (60, 0, True), (300, 150, False), (300, 140, False), (300, 60, True)])
def test_timestamps_can_outweigh_the_prior(spark, groups, back, cut):
    df = shortened(spark, groups, back)
    assert {r.abstract.endswith("…") for r in survivors(df).collect()} == {cut}
    assert only_full(df).count() == groups


def transitions(spark, first, then, groups, back=0, null=False):
    """Groups whose earlier row has the keywords ``first``, the other way round in the last ``back``; one with ``first`` alone."""
    rows = [(2 * g + (k != (g >= groups - back)), f"Title {g}", "Doe, A.", None, text(g), None) for g in range(groups) for k, text in enumerate((first, then))]
    rows += [(2 * groups + k, "Alone", "Doe, A.", None, text, None) for k, text in enumerate((first(0), None))]
    when = F.expr("timestamp_ntz'2021-01-01 00:00:00' + make_dt_interval(0, 0, cast(record_id as int))")
    return frame(spark, rows).withColumn("loaded_at", F.lit(None).cast("timestamp_ntz") if null else when)


STOCK = ("to be assigned", "a; b; c; to be assigned by the indexer")


@pytest.mark.parametrize("stock", STOCK)
@pytest.mark.parametrize("groups, back, null, early", [(60, 0, False, True), (15, 0, False, False), (60, 30, False, False), (60, 0, True, False), (60, 60, False, False)])
def test_values_that_always_give_way_precede_the_others(spark, stock, groups, back, null, early):
    got = sorted(map(tuple, only_full(transitions(spark, lambda g: stock, lambda g: f"sleep {g}; pain", groups, back, null)).collect()))
    assert got == [(2 * g, "keywords", 2 * g + 1) for g in range(groups) if early] + [(2 * groups, "keywords", 2 * groups)]


def test_a_value_within_the_later_ones_is_not_learned_to_precede(spark):
    df = transitions(spark, lambda g: "sleep", lambda g: f"pain {g}; sleep" if g < 40 else "mice; rats", 45)
    assert only_full(df).count() == 40 + 1


def test_maximal_values_then_time_then_trust_then_size(spark):
    one, two = FULL + " And a fourth one makes it long.", "An altogether other text of the same work."
    rows = [
        (1, "By time", "Doe, A.", "By time: " + one, "sleep; pain; diet", None), (2, "By time", "Doe, A.", "By time: " + two, "mice; rats", None),
        (3, "By containment", "Doe, A.", "By containment: " + one, "sleep; pain", None), (4, "By containment", "Doe, A.", "By containment: " + FULL, "Pain", None),
        (5, "By trust", "Doe, A.", "By trust: " + one, "a; b; c", None), (6, "By trust", "Doe, A.", "By trust: " + two, "d; e", None),
        (7, "By size", "Doe, A.", "By size: " + one, "a; b; c", None), (8, "By size", "Doe, A.", "By size: " + two, "d; e", None),
        *[(20 + i, f"Pair {i // 2}", "Doe, A.", f"Text {i // 2} in full.", f"one {i // 2}", None) if i % 2 else (20 + i, f"Pair {i // 2}", "Doe, A.", f"Text {i // 2} …", "NA", None) for i in range(80)]]
    when = F.when(F.col("record_id") < 5, F.col("loaded_at")).otherwise(F.lit("2021-06-01").cast("timestamp_ntz"))
    name = F.when(F.col("record_id").isin(5, 7, 8) | ((F.col("record_id") >= 20) & (F.col("record_id") % 2 == 0)), "csv").otherwise("ris")
    got = {r.record_id: r for r in survivors(frame(spark, rows).withColumns({"loaded_at": when, "source_format": name})).collect()}
    assert {k: (got[k].abstract_from, got[k].keywords_from) for k in (1, 3, 5, 7)} == {1: (2, 2), 3: (3, 3), 5: (6, 6), 7: (7, 7)}
    assert (got[5].source_format, got[5].abstract_format, got[7].source_format, got[1].abstract_format) == ("ris", "ris", "csv", "ris")


def largest_share(df):
    """Share of the rows of the fullest partition, of a frame whose plan ends in a shuffle."""
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_hot_groups(spark):
    """One publication has a third of the rows: with many distinct parts of its abstract, copies, and no abstract."""
    text = " ".join(f"Sentence {i} speaks of another thing." for i in range(120))
    rows = [(i, "Hot", "Doe, A.", text if i == 0 else text[: 40 + 13 * i] + "…" if i < 200 else None, None, "10.1/hot" if i % 2 else None) for i in range(1000)]
    rows += [(1000 + i, f"Title {i}", "Doe, A.", f"Text of {i}.", None, None) for i in range(2000)]
    df = frame(spark, rows).repartition(8).cache()
    assert [tuple(r) for r in only_full(df).collect()] == [(0, "abstract", 0)]
    got = {r.record_id: (r.members, r.abstract_from) for r in survivors(df).collect()}
    assert got[0] == (1000, 0) and len(got) == 2001
    assert copy_members(df).groupBy("group_id").count().orderBy(F.desc("count")).first()[1] == 500
    df.unpersist()


def test_hot_keys_are_spread(spark):
    rows = spark.range(0, 30_000, 1, 8).selectExpr("id", "if(id % 3 = 0, id, -1) k")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") + 1)
    got = join_lookup(rows, lookup, ["k"])
    assert got.where("v = k + 1").count() == 30_000 and largest_share(got) < 0.3
    sized = rows.join(lookup.select("k", "n"), "k")
    met = join_salted(sized, lookup.select("k", "n", F.col("v").cast("string").alias("text")), ["k"], "n", ["id"], per=1000)
    assert met.count() == 30_000 and met.where("cast(text as long) = k + 1").count() == 30_000


def test_numbering(spark):
    df = spark.range(0, 500, 1, 7).withColumn("v", F.pmod("id", F.lit(10)))
    got = [(r.v, r.id) for r in numbered(df, [F.col("v").desc(), F.col("id").asc()], "n").orderBy("n").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1]))
