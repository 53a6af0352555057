import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.config import RuleMode, RuleSet, example_rule_set, mode_rules, preset_rules
from sieveline.functions.regexes import Untranslatable, matches, pyre_to_java
from sieveline.operators.rules import combined_rules, match_any, rule_judgment, rule_screening
from pyspark.sql import functions as F

SCHEMA = "record_id long, title string, abstract string, keywords string"


def run(spark, texts, *rules, **how):
    df = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)], SCHEMA)
    return [r.asDict() for r in rule_judgment(rule_screening(df, list(rules)), **how).orderBy("record_id").collect()]


def test_scores_and_tiers(spark):
    rules = RuleSet(high_relevance_patterns=["cohort + adult", "sleep"], boundary_patterns=["survey"], low_relevance_patterns=["vitro"])
    got = run(spark, ["cohort of ADULT sleepers", "survey", "in vitro", "sleep in vitro", "survey in vitro", None], rules)
    assert [(g["rule_tier"], g["rule_score"]) for g in got] == [
        ("rule_high", 3.0), ("rule_boundary", 0.25), ("rule_low", -1.0), ("rule_unclear", 0.0), ("rule_unclear", 0.0), ("rule_unclear", 0.0)]
    assert got[0]["rule_high_hits"] == "high_combined_0(cohort+adult); high_single_1(sleep)"
    assert [g["screening_level"] for g in got[:3]] == ["高相关", "", "低相关"]
    assert got[1]["needs_review"] and got[1]["review_reason"].startswith("边界")


def test_plus_splits_even_quantifiers_and_empty_pieces_count(spark):
    with pytest.warns(UserWarning):
        rules = combined_rules(RuleSet(high_relevance_patterns=[r"\d+", "sleep+"]))["high"]
    assert rules[0].conditions == (r"\d", "") and rules[1].points == 2
    assert run(spark, ["no digits"], RuleSet(high_relevance_patterns=["sleep+"]))[0]["rule_tier"] == "rule_unclear"


def test_weights_and_disabled_sets(spark):
    got = run(spark, ["sleep pain"], RuleSet(high_relevance_patterns=["sleep"], weight=2.0), RuleSet(high_relevance_patterns=["pain"], enabled=False),
              RuleSet(high_relevance_patterns=["pain"], weight=0.0))
    assert got[0]["rule_score"] == 2.0


def test_invalid_pattern_is_a_substring_and_text_spans_fields(spark):
    df = spark.createDataFrame([(1, "x (ABC y", "tail", None)], SCHEMA)
    got = rule_screening(df, [RuleSet(high_relevance_patterns=["(abc", r"y\stail"])]).first()
    assert got["rule_score"] == 2.0


def test_loose_mode_takes_enum_and_text(spark):
    rules = RuleSet(high_relevance_patterns=["sleep"], pubtype_patterns={"review": ["review"]})
    for mode in (RuleMode.LOOSE, "loose"):
        got = run(spark, ["sleep", "sleep review"], rules, rule_mode=mode, review_threshold=0.7)
        assert got[0]["review_reason"].startswith("宽松模式：单") and got[1]["review_reason"].startswith("宽松模式：综述")
    assert not any(g["needs_review"] for g in run(spark, ["sleep", "sleep review"], rules, rule_mode="moderate", review_threshold=0.7))


def test_labels_are_fresh_or_kept(spark):
    df = spark.createDataFrame([(1, "zzz", "", "", "高相关")], SCHEMA + ", screening_level string")
    screened = rule_screening(df, [RuleSet(high_relevance_patterns=["a{9}"])])
    assert rule_judgment(screened).first()["screening_level"] == ""
    assert rule_judgment(screened, fresh=False).first()["screening_level"] == "高相关"


PATTERNS = [r"\bletter\b", r"comment(?:ary)?", r"étude", r"meta[\s-]*analy", r"\w{3}\d", r"(?P<a>x)y", r"a$", r"[^\w]+z", r"骨量", r"\d{4}\b", "B\\B"]
TEXTS = ["A Letter", "letters", "ÉTUDE", "meta  - analysis", "abé5", "XY", "za", "a\n", "--z", "骨量和", "2021年", "2021 ", "aBc", "commentary", ""]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_java_patterns_agree_with_python(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(matches(F.col("t"), pattern)).collect()]
    assert got == [re.search(pattern, t, re.IGNORECASE) is not None for t in TEXTS]


def test_untranslatable_runs_in_python(spark):
    with pytest.raises(Untranslatable):
        pyre_to_java(r"(?P<q>a)(?P=q)")
    with pytest.warns(UserWarning):
        df = spark.createDataFrame([("aa",), ("ab",), (None,)], "t string").select(matches(F.col("t"), r"(?P<q>a)(?P=q)"))
    assert [r[0] for r in df.collect()] == [True, False, False]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["sleep", "pain + diet", "cohort"]), max_size=3), st.lists(st.sampled_from(["vitro", "costs"]), max_size=2))
def test_against_a_row_evaluator(spark, high, low):
    texts = ["sleep pain diet", "cohort in vitro", "costs", "pain", "diet PAIN cohort"]
    got = run(spark, texts, RuleSet(high_relevance_patterns=high, low_relevance_patterns=low))
    for text, g in zip(texts, got):
        def points(patterns):
            return sum(len(p.split("+")) for p in patterns if all(c.strip() in text.lower() for c in p.split("+")))
        h, lo = points(high), points(low)
        want = ("rule_high", h) if h and not lo else ("rule_low", -lo) if lo and not h else ("rule_unclear", 0)
        assert (g["rule_tier"], g["rule_score"]) == want


def test_presets_and_templates(spark):
    assert preset_rules("chemistry")[0].high_relevance_patterns == []
    assert "cohort" in preset_rules("medical")[0].high_relevance_patterns
    assert mode_rules("strict").rule_mode is RuleMode.STRICT and mode_rules("other").rule_mode is RuleMode.MODERATE
    assert run(spark, ["bone mass and annual change"], example_rule_set())[0]["rule_tier"] == "rule_high"
    df = spark.createDataFrame([("a b",)], "t string").select(match_any(F.col("t"), ["a", "z"]))
    assert df.first()[0] == ["a"]
