import time

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.operators.packed import UNCLOSED_QUOTE, parse_field, split_packed


def values(text, kind="terms"):
    return [v for v, _ in parse_field(text, kind)]


@pytest.mark.parametrize("text, kind, want", [
    ("Doe, Ann", "names", ["Doe, Ann"]),
    ("van der Berg, Olga M.", "names", ["van der Berg, Olga M."]),
    ("Doe, A.; Roe, B.;; Poe C;", "names", ["Doe, A.", "Roe, B.", "Poe C"]),
    ("Doe, A. and Roe, Bob and Carl Poe", "names", ["Doe, A.", "Roe, Bob", "Carl Poe"]),
    ("Ann Doe, Bob Roe & Carl Poe", "names", ["Ann Doe", "Bob Roe", "Carl Poe"]),
    ("Doe, K. A., Roe, N.", "names", ["Doe, K. A.", "Roe, N."]),
    ("Doe, Z. P., & Roe, D. S.", "names", ["Doe, Z. P.", "Roe, D. S."]),
    ("Acme Pain & Mobility Study Group", "names", ["Acme Pain & Mobility Study Group"]),
    ("Study Group, Acme Pain & Mobility", "names", ["Study Group, Acme Pain & Mobility"]),
    ("Ann Doe and Study Group, Acme Rural Health and Roe, B.", "names", ["Ann Doe", "Study Group, Acme Rural Health", "Roe, B."]),
    ("Doe, A. / Roe Bob / / Poe, C.", "names", ["Doe, A.", "Roe Bob", "Poe, C."]),
    ('"Doe, A.","Roe, B."', "names", ["Doe, A.", "Roe, B."]),
    ("pain, sleep,, diet", "terms", ["pain", "sleep", "diet"]),
    ("Pain, Postoperative; sleep", "terms", ["Pain, Postoperative", "sleep"]),
    ('"sandwich" carers', "terms", ['"sandwich" carers']),
    ('x, "the ""frail"" elder", y', "terms", ["x", 'the "frail" elder', "y"]),
    ('["the \\"frail\\" elder", "a; b"]', "terms", ['the "frail" elder', "a; b"]),
    ("scores (early; late);x", "terms", ["scores (early; late)", "x"]),
    ("R&amp;D spending; diet", "terms", ["R&amp;D spending", "diet"]),
    ("1,2-propanediol, sleep", "terms", ["1,2-propanediol", "sleep"]),
    ("a/b c/d", "terms", ["a", "b c", "d"]),
    ("a/b ratio, c", "terms", ["a/b ratio", "c"]),
    ("疼痛、睡眠；饮食", "terms", ["疼痛、睡眠", "饮食"]),
    ("疼痛、睡眠", "terms", ["疼痛", "睡眠"]),
    ("a | b\nc", "terms", ["a", "b", "c"]),
    ("x; x", "terms", ["x", "x"]),
    ("  two   words ;\ty ", "terms", ["two words", "y"]),
    (None, "terms", []), ("", "names", []), (" \n ", "terms", []), (";;", "terms", []), ("[]", "terms", []),
])
def test_values(text, kind, want):
    assert values(text, kind) == want


def test_broken_quote_is_read_as_text_and_flagged():
    got = parse_field('"a; b')
    assert [v for v, _ in got] == ['"a', "b"]
    assert all(e & UNCLOSED_QUOTE for _, e in got)


word = st.text("abcdefghij äé,;|/", min_size=1, max_size=12).map(lambda s: " ".join(s.split())).filter(lambda s: s and not s.startswith(("/", ",")))


@settings(max_examples=150, deadline=None)
@given(st.lists(word, min_size=1, max_size=6), st.sampled_from([";", "; ", " | ", "\n", "；"]))
def test_round_trip_of_quoted_values(items, sep):
    assert values(sep.join('"' + x.replace('"', '""') + '"' for x in items)) == items


@settings(max_examples=100, deadline=None)
@given(st.lists(word, min_size=1, max_size=6))
def test_round_trip_of_json(items):
    assert values(json.dumps(items)) == items


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.sampled_from(["names", "terms"]))
def test_never_fails_and_values_are_clean(text, kind):
    for value in values(text, kind):
        assert value == " ".join(value.split()) != ""


def test_frame(spark):
    rows = [(1, "Doe, A.; Roe, B.", "x;y", "z"), (1, None, "x", "z"), (2, "", " ", None), (3, "long " * 40_000, None, "")]
    df = spark.createDataFrame(rows, "record_id long, author string, keywords string, val string")
    got = sorted(map(tuple, split_packed(df, "record_id", {"author": "names", "keywords": "terms"}).collect()))
    assert [g[:4] for g in got if g[0] == 1] == [
        (1, "author", 1, "Doe, A."), (1, "author", 2, "Roe, B."), (1, "keywords", 1, "x"), (1, "keywords", 1, "x"), (1, "keywords", 2, "y")]
    assert [len(g[3]) for g in got if g[0] == 3] == [199_999]
    assert not split_packed(df.limit(0), "record_id", {"author": "names"}).collect()


@pytest.mark.parametrize("unit", ["(", '"', "a and ", "/", "/ ", '"a;', "[", "Pain & Mobility Study Group ", "Study Group, Pain & ", "[[1],"])
@pytest.mark.parametrize("kind", ["names", "terms"])
def test_long_fields_take_linear_time(unit, kind):
    began = time.time()
    parse_field((unit * 100_000)[:100_000], kind)
    assert time.time() - began < 2
