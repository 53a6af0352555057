import math

import pandas as pd
import pytest

from sieveline.config import LLMConfig, ProjectConfig, RuleSet, ScreeningConfig, load_llm_config, load_project_config, save_json
from sieveline.functions.text import clean_file_path, dedup_key, extract_year, normalize_doi, safe_str
from sieveline.operators import stats
from sieveline.operators.dedup import dedup_records
from sieveline.operators.ranks import average_ranks, rank_filter, rank_score
from sieveline.operators.review import apply_decisions, batch_review, display_document, undecided_documents
from sieveline.operators.semantic import MockClient, SemanticClient, SemanticError, analyze_documents, classify_boundary, classify_documents, generate_rules, parse_json, semantic_client
from sieveline.operators.tfidf import tfidf_scores, tfidf_threshold
from sieveline.plans.pipeline import screen
from sieveline.streaming.screening import late_counts, screen_stream
from pyspark.sql import functions as F


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert column(spark, [None, "  a b\t", "\xa0x "], safe_str) == ["", "a b", "x"]
    assert column(spark, ["https://doi.org/10.1/A", "doi: 10.1/b ", "http://dx.doi.org/10.1/c", None], normalize_doi) == ["10.1/a", "10.1/b", "http://dx.doi.org/10.1/c", ""]
    assert column(spark, ["c2004", "2021/03", "in 1850 2003", "n.d.", "2021年", None], extract_year) == ["c2004", "2021", "2003", "n.d.", "2021年", ""]
    assert column(spark, ["A - B", "Étude: x!"], dedup_key) == ["a  b", "étude x"]
    assert clean_file_path(' "a b" ') == "a b"


def test_dedup(spark):
    rows = [(1, "A", "10.1/x"), (2, "B", "doi:10.1/X"), (3, "A", ""), (4, "a!", None), (5, None, None), (6, "", "")]
    df = spark.createDataFrame(rows, "record_id long, title string, doi string")
    assert sorted(r.record_id for r in dedup_records(df).collect()) == [1, 3, 5]
    assert not dedup_records(df.limit(0)).collect()


def test_ranks_against_pandas(spark):
    values = [0.5, 1.0, 1.0, -3.0, float("nan"), None, 7.0, 1.0, 1e9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.v: r.rank for r in average_ranks(df, "v", "rank").collect()}
    want = pd.Series(values, dtype=float).rank()
    assert all(got[v] == w for v, w in zip(values, want) if not math.isnan(w))


def test_rank_filter_against_pandas(spark):
    scores = [0.1 * (i % 7) + (i % 3) for i in range(50)]
    df = spark.createDataFrame([(i, s, None) for i, s in enumerate(scores)], "record_id long, rule_score double, tfidf_score double")
    got = rank_filter(rank_score(df)).toPandas().sort_values("record_id")
    s = got["rank_score"]
    assert (got["rank_percentile"].to_numpy() - (s.rank(pct=True) * 100).to_numpy()).__abs__().max() < 1e-9
    assert ((got["rank_tier"] == "rank_selected") == (s >= s.quantile(0.75))).all()


def test_rank_of_nothing(spark):
    df = spark.createDataFrame([], "record_id long, rule_score double")
    assert not rank_filter(rank_score(df)).collect()


def test_tfidf_by_hand(spark):
    rows = [(1, "sleep sleep pain", None, ""), (2, "pain diet", "", ""), (3, None, None, None), (4, "unrelated words", "", "")]
    df = spark.createDataFrame(rows, "record_id long, title string, abstract string, keywords string")
    got = {r.record_id: r.tfidf_score for r in tfidf_scores(df, ["sleep"], stops=[]).collect()}
    idf = lambda d: math.log((1 + 5) / (1 + d)) + 1
    w = {"sleep": (1 + math.log(2)) * idf(2), "pain": idf(2), "sleep sleep": idf(1), "sleep pain": idf(1)}
    assert abs(got[1] - w["sleep"] / math.sqrt(sum(x * x for x in w.values()))) < 1e-9
    assert got[2] == got[3] == got[4] == 0.0


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.01, ""), (2, 0.5, None), (3, 0.1, ""), (4, 0.9, "低相关")], "record_id long, tfidf_score double, screening_level string").withColumns(
        {c: F.lit("") for c in ("evidence_type", "reason", "screening_method")})
    got = [r.screening_level for r in tfidf_threshold(df).orderBy("record_id").collect()]
    assert got == ["低相关", "高相关", "", "低相关"]
    assert tfidf_threshold(df, low=None).first()["screening_level"] == ""


def test_pipeline_gate_and_full(spark):
    rows = [(i, "sleep" if i < 3 else f"topic {i} light", "", "") for i in range(12)]
    df = spark.createDataFrame(rows, "record_id long, title string, abstract string, keywords string")
    got = screen(df, [RuleSet(high_relevance_patterns=["sleep"])], ScreeningConfig(seed_texts=["light"]))
    assert got.count() == 12 and got.where("record_id < 3 and screening_level = '高相关'").count() == 3
    closed = screen(df, [RuleSet(high_relevance_patterns=["sleep"], boundary_patterns=["topic"])])
    assert "tfidf_score" not in closed.columns and closed.where("is_boundary").count() == 9


def test_review(spark):
    df = spark.createDataFrame([(i, None if i == 2 else "") for i in (1, 2, 3)], "record_id long, screening_level string").withColumns(
        {c: F.lit("") for c in ("evidence_type", "reason", "screening_method")})
    choices = spark.createDataFrame([(1, 1), (1, 3), (2, 4), (9, 2)], "record_id long, choice int")
    got = {r.record_id: r.screening_level for r in apply_decisions(df, choices).collect()}
    assert got == {1: "低相关", 2: None, 3: ""}
    assert undecided_documents(df).count() == 3
    assert batch_review(df, "高相关", choices.select("record_id")).where("evidence_type = 'batch_高相关'").count() == 2
    assert "n/a" in display_document({"title": "t"})


def test_statistics(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.1,), (0.15,), (None,), (2.0,)], "tfidf_score double")
    got = stats.score_statistics(df, "tfidf_score").first()
    s = pd.Series([0.0, 1.0, 0.1, 0.15, 2.0])
    assert (got.n_scores, got.min, got["max"], got.median) == (5, 0.0, 2.0, s.median()) and abs(got["std"] - s.std()) < 1e-12
    assert {r.bin: r.n for r in stats.score_bins(df, "tfidf_score").collect()} == {0: 2, 1: 1, 9: 1} | {b: 0 for b in range(2, 9)}
    assert stats.score_statistics(df.limit(1), "tfidf_score").first()["std"] is None
    assert "min" in stats.describe(stats.score_statistics(df, "tfidf_score"), "scores")


def test_semantic(spark):
    df = spark.createDataFrame([(i, f"t{i}", None) for i in range(7)], "record_id long, title string, abstract string")
    got = classify_documents(df, lambda: MockClient(LLMConfig()), "x").collect()
    assert len(got) == 7 and {g.judgment for g in got} == {"high"}
    assert analyze_documents(df, lambda: MockClient(LLMConfig()), "x").first().relevance_score == 0.88

    class Broken(MockClient):
        def classify_batch(self, documents, topic):
            raise SemanticError("down")

        def suggest_rules(self, *a, **k):
            raise SemanticError("down")

    assert {g.confidence for g in classify_documents(df, lambda: Broken(LLMConfig()), "x").collect()} == {0.0}
    assert generate_rules(Broken(LLMConfig()), "x", [RuleSet("fallback")])[0].name == "fallback"
    with pytest.warns(UserWarning):
        assert isinstance(semantic_client(LLMConfig(provider="nobody")), MockClient)
    assert parse_json("```json\n[1]\n```") == [1]
    with pytest.raises(SemanticError):
        parse_json("no")

    class Short(MockClient):
        def complete(self, prompt):
            return '{"results": [{"judgment": "low", "confidence": 0.9}]}'

        classify_batch = MockClient.__mro__[1].classify_batch

    assert [x["judgment"] for x in Short(LLMConfig()).classify_batch([{}, {}], "x")] == ["low", "boundary"]


def test_configuration(tmp_path):
    save_json(LLMConfig(provider="openai", api_key="secret", timeout=9), f"{tmp_path}/a/llm.json")
    assert "secret" not in open(f"{tmp_path}/a/llm.json").read()
    assert load_llm_config(f"{tmp_path}/a/llm.json").timeout == 9 and load_llm_config(f"{tmp_path}/none") is None
    save_json(ProjectConfig("topic", rule_sets=[RuleSet("r", rule_mode="loose")]), f"{tmp_path}/p.json")
    assert load_project_config(f"{tmp_path}/p.json").rule_sets[0].rule_mode.value == "loose"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, " Sleep  study ", "f.ris", "2021-01-01 00:00:00"), (2, "other", "f.ris", "2021-01-01 05:00:00")],
                                 "record_id long, title string, source_file string, at string").selectExpr(
        "record_id", "title", "'' abstract", "'' keywords", "source_file", "cast(at as timestamp) loaded_at")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("s", screen_stream(stream, [RuleSet(high_relevance_patterns=["sleep study"])]), "append"), ("c", late_counts(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.awaitTermination(120)
    assert {r.record_id: r.rule_tier for r in spark.table("s").collect()} == {1: "rule_high", 2: "rule_unclear"}
    assert [r.n for r in spark.table("c").collect()] == [2]


def test_model_calls_hold_whole_abstracts():
    class Client(SemanticClient):
        def complete(self, prompt):
            seen.append(prompt)
            return "{}"

    seen, long = [], "word " * 5000 + "the last sentence"
    client = Client(LLMConfig())
    client.analyze("t", long, "x")
    client.classify("t", long, "x")
    client.classify_batch([{"title": "t", "abstract": long}] * 2, "x")
    assert [p.count(long) for p in seen] == [1, 1, 2]


def test_prompts_by_language_and_mode():
    from sieveline.operators.semantic import rule_prompt

    texts = {(lang, m): rule_prompt("sleep", ["a", "b", "c", "d"], "nursing", lang, m) for lang in ("english", "chinese") for m in ("strict", "moderate", "loose")}
    assert len(set(texts.values())) == 6 and all("sleep" in t and "- c" in t and "- d" not in t and "boundary_patterns" in t for t in texts.values())
    assert rule_prompt("x", rule_mode="unknown") == rule_prompt("x")


def test_replies_of_the_wrong_kind(spark):
    class Odd(SemanticClient):
        def __init__(self, reply):
            super().__init__(LLMConfig())
            self.reply = reply

        def complete(self, prompt):
            return self.reply

    df = spark.createDataFrame([(1, "t", None), (2, None, "a")], "record_id long, title string, abstract string")
    assert {(r.judgment, r.confidence) for r in classify_documents(df, lambda: Odd('[{"confidence": null, "judgment": null, "reason": 3}]'), "x").collect()} == {("boundary", 0.5)}
    assert {r.confidence for r in classify_documents(df, lambda: Odd("3"), "x").collect()} == {0.0}
    for reply, want in (('{"judgment": "low", "confidence": "much"}', ("低相关", 0.5)), ("[]", ("边界相关", 0.0)), ("no", ("边界相关", 0.0))):
        assert {(r.judgment, r.confidence) for r in classify_boundary(df, lambda reply=reply: Odd(reply), "x").collect()} == {want}
    assert [(r.tags, r.relevance_score) for r in analyze_documents(df, lambda: Odd('{"tags": 3, "relevance_score": null}'), "x").collect()] == [([], 0.0)] * 2


def test_mode_texts_and_alerts(spark, capsys):
    from sieveline.config import RuleMode, mode_description, mode_table

    for language in ("chinese", "english"):
        for m in RuleMode:
            got = mode_description(m, language)
            assert len(got["characteristics"]) == 5 and all(got.values())
        assert len(mode_table(language).splitlines()) == 7
    one = lambda text: spark.sql(f"select {text}")
    assert stats.print_stage(one("3 as rule_boundary_count, 40.0 as needs_review_percentage"), "rules").count("!") == 2
    assert stats.print_stage(one("3 as undecided"), "review").count("!") == 1 and "!" not in stats.print_stage(one("3 as undecided"), "rank")
    assert "Rule screening" in capsys.readouterr().out


def test_rank_filter_with_one_score_for_most_rows(spark):
    df = spark.range(30_000).selectExpr("id record_id", "if(id % 3 = 0, 1.0 + id, 0.0) rule_score", "cast(null as double) tfidf_score")
    got = rank_filter(rank_score(df))
    assert got.where("rank_tier = 'rank_selected'").count() == 7500 and got.where("rank_percentile is null").count() == 0
