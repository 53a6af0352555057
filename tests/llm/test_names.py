import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm.names import attribute, deletions, link_names, linked_pairs, misspelt, near, place_key, read_name, same_letters


@pytest.mark.parametrize("name, want", [
    ("Doe, Ann B.", ("p", "doe", ["ann"], ["a", "b"])),
    ("A. B. Doe", ("p", "doe", [], ["a", "b"])),
    ("Doe AB", ("p", "doe", [], ["a", "b"])),
    ("van der DOE, Åsa", ("p", "doe", ["asa"], ["a"])),
    ("Doe, A.-M. C.", ("p", "doe", [], ["a", "M", "c"])),
    ("The Acme HM Study Grp", ("g", "acme", ["hm"], ["group"])),
    ("Иванов И.", ("p", "иванов", [], ["и"])),
    ("王伟", ("p", "王", ["伟"], ["伟"])),
    ("王, 伟", ("p", "王", ["伟"], ["伟"])),
    ("Doe, " + " ".join(f"Name{c}" for c in "abcdefghijkl"), ("p", "doe", [f"name{c}" for c in "abcdefghijkl"], ["n"] * 12)),
    ("Consortium, Acme Rural-Health", ("g", "acme", ["rural", "health"], ["consortium"])),
])
def test_reading(name, want):
    assert read_name(name) == want


def test_places():
    assert place_key("Dept. of Nursing, Foo College, Norland") == place_key("FOO COLLEGE ") == "foo"
    assert place_key(None) == ""
    assert same_letters("aMt", "at") and same_letters("a", "aM") and not same_letters("ab", "ac")


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=2, max_size=8), st.integers(0, 7), st.sampled_from("abcd"), st.sampled_from(["insert", "delete", "replace", "swap"]))
def test_one_error_is_near_and_found(word, at, letter, kind):
    at %= len(word)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :], "replace": word[:at] + letter + word[at + 1 :],
             "swap": word[:at] + word[at + 1 : at + 2] + word[at] + word[at + 2 :]}[kind]
    assert near(word, other) and near(other, word)
    assert set(deletions(word)) & set(deletions(other))


def test_far():
    assert not near("abcdef", "abxyef") and not near("abc", "abcde")


NAMES = [
    [("Kelvado, Francisco", "Foo Hospital"), ("F. Kelvado", "Foo Hosp."), ("KELVADO, Paco", None), ("Francisco R. Kelvado", "FOO HOSPITAL"), ("Kelvadoo, Francisco", "Foo Hospital"), ("Kelvado FR", "Bar College")],
    [("Kelvado, Maria", "Foo Hospital"), ("M. Kelvado", "Foo Hospital")],
    [("Kelvado, Francisco", "Quux Institute"), ("Kelvado F", "Quux Inst.")],
    [("Osteria Rural Health Study Group", "X College"), ("Study Group, Osteria Rural Health", "X College"), ("Osteria RH Study Grp", None), ("The Osteria Rural-Health Study Group", "Y College")],
    [("Osteria Sleep Trial Consortium", "X College")],
    [("Wessel, Robert", "A College"), ("Bob Wessel", "A College"), ("R. Wessel", None)],
]


def test_linking(spark):
    rows, want, n = [], set(), itertools.count(1)
    for entity in NAMES:
        ids = []
        for author, place in entity:
            ids.append(next(n))
            rows.append((ids[-1], author, place, 7, "clash"))
        want |= set(itertools.combinations(ids, 2))
    df = spark.createDataFrame(rows, "name_id long, author string, affiliation string, record_id long, entity_id string")
    assert {tuple(r) for r in linked_pairs(df).collect()} == want
    assert not linked_pairs(df.limit(0)).collect()


def entities(spark, *rows):
    """Sets of positions that are linked."""
    got = link_names(spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(rows)], "name_id long, author string, affiliation string")).collect()
    return sorted(sorted(r.name_id for r in got if r.entity_id == e) for e in {r.entity_id for r in got})


def test_several_spellings_at_another_place(spark):
    here = [("Kelvado, Francisco R.", "Foo Hospital"), ("F. R. Kelvado", "Foo Hospital"), ("KELVADO, Paco R.", "Foo Hospital")]
    moved = [("Kelvado FR", "Bar College"), ("Francisco R. Kelvado", "Bar College")]
    assert entities(spark, *here, *moved) == [[0, 1, 2, 3, 4]]
    # nothing but the name speaks for it; the letters speak against it; the same spelling twice
    for a, b in (("Kelvado F", "Francisco Kelvado"), ("Kelvado FS", "Francisco S. Kelvado"), ("F. R. Kelvado", "Francisco R. Kelvado")):
        assert entities(spark, *here, (a, "Bar College"), (b, "Bar College")) == [[0, 1, 2], [3, 4]]


def test_organisations_of_like_names(spark):
    x, y = ("X College", "Y Institute")
    rows = [("Osteria Rural Health Study Group", x), ("Study Group, Osteria Rural Health", x), ("Osteria RH Study Grp", x),
            ("The Osteria Rural Health Group", y), ("Osteria Rural-Health Study Group", y), ("Osteria RH Group", y), ("Osteria Rural Haelth Study Group", "X COLLEGE, Norland"),
            ("Osteria Study Group", None), ("Osteria Rural Health Network", x)]
    got = entities(spark, *rows)
    assert [0, 1, 2, 6] in [[i for i in e if i != 7] for e in got] and [3, 4, 5] in [[i for i in e if i != 7] for e in got] and [8] in got


def test_a_frequent_surname_is_misspelt_often(spark):
    towns = ["".join(p) for p in itertools.product(("Al", "Bor", "Cas"), ("vin", "mor", "tek", "lun"))]
    rows = [(a, f"{town} College") for town in towns for a in ("Kelvado, Francisco", "F. Kelvado", "KELVADO, Paco", "Francisco Kelvado")]
    rows += [("Kelvadoo, Francisco", f"{town} College") for town in towns[:6]]
    # a surname of its own, as frequent as a near one
    rows += [(a, f"{town} Hospital") for town in towns[:4] for x in "eo" for a in (f"Hans{x}n, Maria {x}", f"Hans{x}n, M.", f"Maria Hans{x}n")]
    got = entities(spark, *rows)
    assert [[4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3, 48 + k] for k in range(6)] == got[:6]
    assert all(len({rows[i][0].lower().count("hanson") for i in e}) == 1 for e in got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "???", None), (4, "x" * 5000, ""), (5, "李", None)], "name_id long, author string, affiliation string")
    assert {r.name_id: r.entity_id for r in link_names(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_short_words_are_misspelt_by_swaps():
    assert misspelt("wagn", "wang") and misspelt("yuuf", "yusuf") and misspelt("hendersen", "henderson")
    assert not misspelt("wong", "wang") and not misspelt("王", "李") and not misspelt("li", "lu")


def test_repeated_misspellings_short_surnames_and_other_scripts(spark):
    at = "Foo University"
    groups = [
        ["Henderson, Mary", "M. Henderson", "Mary Henderson", "HENDERSON, Mary", "Henderson M", "Mary K. Henderson", "Henderson, M. K.", "Hendersen, Mary", "M. Hendersen", "Mary Hendersen"],
        ["Oliver, Tom", "Tom Oliver", "T. Oliver", "Olivar, Tom"], ["Wang, Peter", "P. Wang", "Peter Wang", "Wagn, Peter"],
        ["Иванов, Иван", "Иван Иванов", "Иванов И."], ["王伟", "王 伟"], ["Li, Wei"], ["Lu, Wei"]]
    want, n = [], itertools.count()
    for g in groups:
        want.append([next(n) for _ in g])
    assert entities(spark, *[(a, at) for g in groups for a in g]) == want


def test_names_after_the_tenth_count(spark):
    long = " ".join(f"Name{c}" for c in "abcdefghijkl")
    df = spark.createDataFrame([(1, f"Doe, Nmaea {long}", "X College"), *[(i, f"Doe, Namea {long} {i}", "X College") for i in range(2, 30)]], "name_id long, author string, affiliation string")
    from sieveline.llm.names import corrected_given, read_names, settle_order
    got = {r.name_id: r.names for r in corrected_given(settle_order(read_names(df))).collect()}
    assert len(got[1]) == 13


def test_frequency_in_the_records_decides(spark):
    """A bare name goes to the namesake whose spellings the records have more often."""
    names = [("Kelvado, Maria", "A College"), ("Maria Kelvado", "A College"), ("Kelvado, Maria", "B Hospital"), ("Kelvado Maria", "B Hospital"), ("KELVADO, Maria", None)]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "name_id long, author string, affiliation string")
    for often, want in (("Maria Kelvado", 0), ("Kelvado Maria", 2)):
        records = spark.createDataFrame([(i, f"Poe, E.; {often}", None) for i in range(50)] + [(99, None, "x")], "record_id long, author string, weight string")
        assert {r.name_id: r.entity_id for r in link_names(df, records).collect()}[4] == want


@pytest.mark.parametrize("same", [False, True])
def test_a_hot_surname_takes_near_linear_time(same):
    pick = random.Random(1).choice
    rows = []
    for _ in range(8000):
        g = "John" if same else "".join(pick("abcdefghij") for _ in range(6)).capitalize()
        author = f"Smith, {g} {pick('ABCDEFGH')}." if pick("ab") == "a" else f"Smith {g[0]}{pick('ABCDEFGH')}"
        _, surname, names, letters = read_name(author)
        rows.append({"author": author, "surname": surname, "names": names, "first": names[0] if names else "", "ini": "".join(letters), "place": "", "weight": 1.0})
    began = time.time()
    attribute(rows)
    assert time.time() - began < 30


def test_a_third_of_the_rows_has_one_surname(spark):
    rows = [(i, f"Smith, {chr(65 + i % 26)}nna", f"P{i} College") if i % 3 == 0 else (i, f"Name{i}x, Anna", f"P{i} College") for i in range(3000)]
    got = link_names(spark.createDataFrame(rows, "name_id long, author string, affiliation string")).collect()
    assert len(got) == 3000 and len({r.name_id for r in got}) == 3000
