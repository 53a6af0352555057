"""Queries over the reference's operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.config import RuleSet, ScreeningConfig, preset_rules
from sieveline.functions.text import collapse_ws, dedup_key, extract_year, normalize_doi, safe_str, text_blob
from sieveline.operators import stats
from sieveline.operators.dedup import dedup_records
from sieveline.operators.drift import schema_changes, unified_rows
from sieveline.operators.packed import split_packed
from sieveline.operators.ranks import rank_filter, rank_judgment, rank_score
from sieveline.operators.review import apply_decisions, batch_review, undecided_documents
from sieveline.operators.rules import rule_judgment, rule_screening
from sieveline.operators.tfidf import tfidf_scores, tfidf_scoring, tfidf_threshold
from sieveline.plans.pipeline import rules_only, screen
from sieveline.sources.load import clean_records, standardize
from sieveline.sources.tagged import PUBMED, RIS, WOS, parse_tagged, sniff

Query = Callable[[SparkSession, str], DataFrame]

#: The rule sets of the queries; two, to show weights.
RULES = [
    RuleSet("design", "", ["randomi[sz]ed", "cohort + longitudinal", "placebo"], ["retrospective", "survey + weeks"],
            ["in vitro", "mortality"],
            {"review": ["systematic review", "scoping review"], "survey": ["survey"], "protocol": ["protocol"]}),
    RuleSet("topic", "", ["insomnia"], [], ["caries"], {"survey": ["questionnaire"]}, weight=2.0),
]
SEEDS = ["sleep quality and insomnia of night-shift nurses", "light therapy randomized trial"]
STOPS = "the of and in to for with was were is are on by from at as an be that this between no".split()
FEATURES = 8000


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _screened(spark: SparkSession, d: str) -> DataFrame:
    """Screening rows with scores: one row per record and run."""
    return rank_filter(rank_score(_t(spark, d, "screening").select("record_id", "run_id", "rule_score", "tfidf_score", "screening_level")))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return clean_records(_t(spark, d, "records")).select("record_id", "title", "author", "abstract", "keywords", "journal")


def normalized_doi(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "records").select("record_id", normalize_doi(F.col("doi")).alias("doi_norm"))


def years(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "records").select("record_id", extract_year(F.col("publication_year")).alias("year"))


def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "records").select("record_id", dedup_key(F.col("title")).alias("title_key"))


def standardized(spark: SparkSession, d: str) -> DataFrame:
    raw = _t(spark, d, "records").select("record_id", F.col("title").alias("Article  Title"), F.col("doi").alias("DI"),
                                         F.col("keywords").alias("Author Keywords"), F.col("abstract").alias("Keywords Plus"))
    return standardize(raw).select("record_id", "title", "doi", "keywords", "journal")


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return dedup_records(_t(spark, d, "records").select("record_id", "title", "doi")).select("record_id")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return rule_screening(_t(spark, d, "records").select("record_id", "title", "abstract", "keywords"), RULES)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return rule_judgment(_rules(spark, d))


def rule_judgment_loose(spark: SparkSession, d: str) -> DataFrame:
    return rule_judgment(_rules(spark, d), rule_mode="loose", review_threshold=0.7).select("record_id", "needs_review", "review_reason")


def preset_tiers(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "records").select("record_id", "title", "abstract", "keywords")
    return rules_only(df, preset_rules("medical")).groupBy("rule_tier").agg(F.count("*").alias("n"))


def tfidf_score(spark: SparkSession, d: str) -> DataFrame:
    got = tfidf_scores(_t(spark, d, "records").select("record_id", "title", "abstract", "keywords"), SEEDS, stops=STOPS, max_features=FEATURES)
    return got.select("record_id", F.round("tfidf_score", 6).alias("tfidf_score"))


def tfidf_levels(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d)
    scored = tfidf_threshold(tfidf_scoring(judged, SEEDS, stops=STOPS, max_features=FEATURES), 0.02, 0.1)
    return scored.select("record_id", "screening_level", "evidence_type", "reason", "screening_method")


def full_screening(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "records").select("record_id", "title", "abstract", "keywords")
    got = screen(df, RULES, ScreeningConfig(seed_texts=["insomnia sleep nurses"], tfidf_low=0.001, stop_words=STOPS))
    return got.select("record_id", "rule_tier", "screening_level", "screening_method", "is_boundary", "is_candidate")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    level = F.col("screening_level")
    choice = F.when(level == "高相关", 1).when(level == "边界相关", 2).when(level == "低相关", 3)
    return _t(spark, d, "review_decisions").select("record_id", choice.alias("choice"))


def _tagged(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each record written as one file of a tagged format."""
    r = _t(spark, d, "records").select("record_id", *[collapse_ws(safe_str(F.col(c))).alias(c) for c in (
        "title", "author", "keywords", "doi", "publication_year", "journal")])
    c = F.col
    if kind == "ris":
        text = F.concat(F.lit("TY  - JOUR\nTI  - "), c("title"), F.lit("\nAU  - "), c("author"), F.lit("\nAU  - Extra, A\nKW  - "), c("keywords"),
                        F.lit("\nDO  - 10.1/first\nDO  - "), c("doi"), F.lit("\nPY  - "), c("publication_year"), F.lit("\nJO  - "), c("journal"), F.lit("\nER  - \n"))
    elif kind == "nbib":
        text = F.concat(F.lit("PMID- "), c("record_id").cast("string"), F.lit("\nTI  - Start\n      "), c("title"), F.lit("\nFAU - "), c("author"),
                        F.lit("\nLID - S1 [pii]\nAID - 10.1/x"), c("record_id").cast("string"), F.lit(" [doi]\nDP  - "), c("publication_year"),
                        F.lit("\nJT  - "), c("journal"), F.lit("\n"))
    else:
        text = F.concat(F.lit("FN Export\nVR 1.0\nPT J\nAU Extra, A\n   "), c("author"), F.lit("\nTI "), c("title"), F.lit("\nDE "), c("keywords"),
                        F.lit("\nSO "), c("journal"), F.lit("\nPY "), c("publication_year"), F.lit("\nER\n"))
    return r.select(c("record_id").alias("path"), text.alias("value"))


def ris_parse(spark: SparkSession, d: str) -> DataFrame:
    got = parse_tagged(_tagged(spark, d, "ris"), RIS)
    return got.select(F.col("path").alias("record_id"), "title", "author", "keywords", "doi", "publication_year", "journal")


def nbib_parse(spark: SparkSession, d: str) -> DataFrame:
    got = parse_tagged(_tagged(spark, d, "nbib"), PUBMED)
    return got.select(F.col("path").alias("record_id"), "pmid", "title", "author", "doi", "publication_year", "journal")


def wos_parse(spark: SparkSession, d: str) -> DataFrame:
    got = parse_tagged(_tagged(spark, d, "wos"), WOS)
    return got.select(F.col("path").alias("record_id"), "title", "author", "keywords", "publication_year", "journal")


def sniffed(spark: SparkSession, d: str) -> DataFrame:
    parts = [_tagged(spark, d, k).select(F.lit(k).alias("written"), sniff(F.col("value")).alias("found")) for k in ("ris", "nbib", "wos")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("written", "found").agg(F.count("*").alias("n"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value of the packed author and keyword fields."""
    return split_packed(_t(spark, d, "records"), "record_id", {"author": "names", "keywords": "terms"}).select(
        "record_id", "field_name", "pos", "val")


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """Values per field and error flag."""
    got = split_packed(_t(spark, d, "records"), "record_id", {"author": "names", "keywords": "terms"})
    return got.groupBy("field_name", "err").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field between successive files of a feed."""
    got = schema_changes(_t(spark, d, "export_rows"), _t(spark, d, "parse_log"))
    return got.select("source_file", "change_kind", "old_name", "new_name")


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """All export rows in one consistent table."""
    return unified_rows(_t(spark, d, "export_rows"), _t(spark, d, "parse_log"))


QUERIES: dict[str, Query] = {
    "clean_text": clean_text,
    "normalize_doi": normalized_doi,
    "extract_year": years,
    "dedup_key": dedup_keys,
    "standardize_columns": standardized,
    "text_blob": lambda s, d: _t(s, d, "records").select("record_id", text_blob(F.col("title"), F.col("abstract"), F.col("keywords")).alias("blob")),
    "dedup_records": deduplicated,
    "rule_hits": lambda s, d: _rules(s, d).select("record_id", "rule_high_hits", "rule_boundary_hits", "rule_low_hits"),
    "rule_tier": lambda s, d: _rules(s, d).select("record_id", "rule_tier"),
    "rule_score": lambda s, d: _rules(s, d).select("record_id", "rule_score"),
    "rule_pubtype": lambda s, d: _rules(s, d).select("record_id", "rule_pubtype"),
    "rule_judgment": lambda s, d: _judged(s, d).select("record_id", "screening_level", "evidence_type", "reason", "screening_method", "needs_review", "review_reason"),
    "rule_judgment_loose": rule_judgment_loose,
    "rule_stats": lambda s, d: _rounded(stats.rule_statistics(_judged(s, d))),
    "pubtype_histogram": lambda s, d: stats.pubtype_histogram(_rules(s, d)),
    "review_reasons": lambda s, d: stats.value_histogram(_judged(s, d), "review_reason"),
    "preset_tiers": preset_tiers,
    "tfidf_score": tfidf_score,
    "tfidf_threshold": tfidf_levels,
    "tfidf_stats": lambda s, d: _rounded(stats.tfidf_statistics(_t(s, d, "screening"))),
    "tfidf_bins": lambda s, d: stats.score_bins(_t(s, d, "screening"), "tfidf_score"),
    "rank_score": lambda s, d: _rounded(rank_score(_t(s, d, "screening")).select("record_id", "run_id", "rank_score")),
    "rank_percentile": lambda s, d: _rounded(_screened(s, d).select("record_id", "run_id", "rank_percentile")),
    "rank_tier": lambda s, d: _screened(s, d).select("record_id", "run_id", "rank_tier"),
    "rank_judgment": lambda s, d: rank_judgment(_screened(s, d).withColumns({c: F.lit("") for c in ("evidence_type", "reason", "screening_method")})).select(
        "record_id", "run_id", "screening_level", "screening_method"),
    "rank_stats": lambda s, d: _rounded(stats.rank_statistics(_screened(s, d))),
    "full_screening": full_screening,
    "level_distribution": lambda s, d: _rounded(stats.level_summary(_t(s, d, "screening"))),
    "undecided": lambda s, d: undecided_documents(_t(s, d, "screening")).select("record_id", "run_id"),
    "manual_review": lambda s, d: apply_decisions(_t(s, d, "screening"), _decisions(s, d)).select("record_id", "run_id", "screening_level", "evidence_type", "reason"),
    "batch_review": lambda s, d: batch_review(_t(s, d, "screening"), "低相关", _t(s, d, "review_decisions")).select("record_id", "run_id", "screening_level", "screening_method"),
    "review_stats": lambda s, d: stats.review_statistics(apply_decisions(_t(s, d, "screening"), _decisions(s, d))),
    "ris_parse": ris_parse,
    "nbib_parse": nbib_parse,
    "wos_parse": wos_parse,
    "sniff_format": sniffed,
    "p1_found": p1_found,
    "p1_errors": p1_errors,
    "p3_found": p3_found,
    "p3_unified": p3_unified,
}

# --- SQL ---------------------------------------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _safe(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _flat(c: str) -> str:
    return rf"regexp_replace({_safe(c)}, '{_WS}+', ' ', 'g')"


def _year(c: str) -> str:
    found = rf"regexp_extract(' ' || {c} || ' ', '[^\p{{L}}\p{{N}}_]((?:19|20)\p{{Nd}}{{2}})[^\p{{L}}\p{{N}}_]', 1)"
    return f"CASE WHEN {found} = '' THEN {c} ELSE {found} END"


_DOI = rf"regexp_replace(replace(replace(replace(lower({_safe('doi')}), 'https://doi.org/', ''), 'http://doi.org/', ''), 'doi:', ''), '^{_WS}+|{_WS}+$', '', 'g')"
_TITLE_KEY = rf"regexp_replace(regexp_replace(regexp_replace(lower({_safe('title')}), '{_WS}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"
_T = "coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(keywords, '')"

_M = f"""m AS (SELECT record_id,
  regexp_matches(t, '(?i)randomi[sz]ed') AS a, regexp_matches(t, '(?i)cohort') AND regexp_matches(t, '(?i)longitudinal') AS b,
  regexp_matches(t, '(?i)placebo') AS c, regexp_matches(t, '(?i)retrospective') AS d,
  regexp_matches(t, '(?i)survey') AND regexp_matches(t, '(?i)weeks') AS e, regexp_matches(t, '(?i)in vitro') AS f,
  regexp_matches(t, '(?i)mortality') AS g, regexp_matches(t, '(?i)insomnia') AS h, regexp_matches(t, '(?i)caries') AS i,
  regexp_matches(t, '(?i)systematic review|scoping review') AS pr, regexp_matches(t, '(?i)survey|questionnaire') AS ps,
  regexp_matches(t, '(?i)protocol') AS pp
  FROM (SELECT record_id, {_T} AS t FROM records)),
s AS (SELECT *, a::INT + 2 * b::INT + c::INT + 2 * h::INT AS hi, 0.5 * d::INT + e::INT AS bo, f::INT + g::INT + 2 * i::INT AS lo FROM m),
r AS (SELECT *, CASE WHEN hi > 0 AND lo = 0 THEN 'rule_high' WHEN bo > 0 AND lo = 0 THEN 'rule_boundary'
  WHEN lo > 0 AND hi = 0 AND bo = 0 THEN 'rule_low' ELSE 'rule_unclear' END AS rule_tier,
  concat_ws('; ', CASE WHEN pp THEN 'protocol' END, CASE WHEN pr THEN 'review' END, CASE WHEN ps THEN 'survey' END) AS rule_pubtype FROM s),
q AS (SELECT *, CASE rule_tier WHEN 'rule_high' THEN hi WHEN 'rule_boundary' THEN bo / 2 WHEN 'rule_low' THEN -lo ELSE 0 END::DOUBLE AS rule_score FROM r),
j AS (SELECT *, CASE rule_tier WHEN 'rule_high' THEN '高相关' WHEN 'rule_low' THEN '低相关' ELSE '' END AS screening_level,
  CASE rule_tier WHEN 'rule_high' THEN 'rule_pattern_matched' WHEN 'rule_low' THEN 'not_applicable' ELSE '' END AS evidence_type,
  CASE rule_tier WHEN 'rule_high' THEN '规则层直判：命中高相关特征' WHEN 'rule_low' THEN '规则层直判：命中低相关特征' ELSE '' END AS reason,
  CASE rule_tier WHEN 'rule_high' THEN 'rule_direct_high' WHEN 'rule_low' THEN 'rule_direct_low' ELSE '' END AS screening_method,
  rule_tier = 'rule_boundary' AS needs_review,
  CASE WHEN rule_tier = 'rule_boundary' THEN '边界文献：需要进一步评估' ELSE '' END AS review_reason FROM q)"""


def _tfidf_sql(seeds: list[str], stops: list[str]) -> str:
    listed = ", ".join(f"({-1 - i}, '{s}')" for i, s in enumerate(seeds))
    stop = ", ".join(f"'{s}'" for s in stops)
    return f"""
texts AS (SELECT record_id AS id, {_T} AS t FROM records UNION ALL SELECT * FROM (VALUES {listed}) AS v(id, t)),
words AS (SELECT id, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stop})) AS w FROM texts),
grams AS (SELECT id, unnest(w) AS term FROM words UNION ALL
  SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1),
vocab AS (SELECT term FROM grams GROUP BY term ORDER BY count(*) DESC, term LIMIT {FEATURES}),
tf AS (SELECT id, term, count(*) AS tf FROM grams SEMI JOIN vocab USING (term) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM texts)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
wt AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM wt GROUP BY id),
dir AS (SELECT term, sum(w / nrm) / {len(seeds)} AS q FROM wt JOIN nrm USING (id) WHERE id < 0 GROUP BY term),
sim AS (SELECT id, sum(w * q) / any_value(nrm) AS score FROM wt JOIN nrm USING (id) JOIN dir USING (term) WHERE id >= 0 GROUP BY id),
tfidf AS (SELECT record_id, coalesce(score, 0.0) AS tfidf_score FROM records LEFT JOIN sim ON record_id = id)"""


_RS = """rs AS (SELECT record_id, run_id, screening_level, 0.4 * CASE WHEN rule_score IS NULL OR isnan(rule_score) THEN 0 ELSE rule_score END
  + 0.6 * CASE WHEN tfidf_score IS NULL OR isnan(tfidf_score) THEN 0 ELSE tfidf_score END AS rank_score FROM screening),
rk AS (SELECT *, (rank() OVER (ORDER BY rank_score) + (count(*) OVER (PARTITION BY rank_score) - 1) / 2.0) / count(*) OVER () * 100 AS rank_percentile,
  CASE WHEN rank_score >= quantile_cont(rank_score, 0.75) OVER () THEN 'rank_selected' ELSE 'rank_unselected' END AS rank_tier FROM rs)"""


def _score_stats(c: str, table: str) -> str:
    return f"""SELECT count(*) AS n_scores, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean,
  round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std FROM {table} WHERE {c} IS NOT NULL AND NOT isnan({c})"""


_CHOSEN = """ch AS (SELECT record_id, max(CASE screening_level WHEN '高相关' THEN 1 WHEN '边界相关' THEN 2 WHEN '低相关' THEN 3 END) AS c
  FROM review_decisions GROUP BY record_id)"""
_LEVEL = "CASE c WHEN 1 THEN '高相关' WHEN 2 THEN '边界相关' WHEN 3 THEN '低相关' END"
_EVIDENCE = "CASE c WHEN 1 THEN 'manual_high' WHEN 2 THEN 'manual_boundary' WHEN 3 THEN 'manual_low' END"

SQL: dict[str, str] = {
    "clean_text": f"SELECT record_id, {', '.join(f'{_flat(c)} AS {c}' for c in ('title', 'author', 'abstract', 'keywords', 'journal'))} FROM records",
    "normalize_doi": f"SELECT record_id, {_DOI} AS doi_norm FROM records",
    "extract_year": f"SELECT record_id, {_year(_safe('publication_year'))} AS year FROM records",
    "dedup_key": f"SELECT record_id, {_TITLE_KEY} AS title_key FROM records",
    "standardize_columns": f"SELECT record_id, title, doi, CASE WHEN {_safe('keywords')} <> '' THEN keywords WHEN {_safe('abstract')} <> '' THEN abstract ELSE '' END AS keywords, '' AS journal FROM records",
    "text_blob": f"SELECT record_id, {_T} AS blob FROM records",
    "dedup_records": f"""SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY d <> '', CASE WHEN d <> '' THEN d ELSE k END ORDER BY record_id) AS n
        FROM (SELECT record_id, {_DOI} AS d, {_TITLE_KEY} AS k FROM records)) WHERE n = 1""",
    "rule_hits": f"""WITH {_M} SELECT record_id,
        concat_ws('; ', CASE WHEN a THEN 'high_single_0(randomi[sz]ed)' END, CASE WHEN b THEN 'high_combined_1(cohort+longitudinal)' END,
          CASE WHEN c THEN 'high_single_2(placebo)' END, CASE WHEN h THEN 'high_single_0(insomnia)' END) AS rule_high_hits,
        concat_ws('; ', CASE WHEN d THEN 'boundary_single_0(retrospective)' END, CASE WHEN e THEN 'boundary_combined_1(survey+weeks)' END) AS rule_boundary_hits,
        concat_ws('; ', CASE WHEN f THEN 'low_single_0(in vitro)' END, CASE WHEN g THEN 'low_single_1(mortality)' END, CASE WHEN i THEN 'low_single_0(caries)' END) AS rule_low_hits FROM m""",
    "rule_tier": f"WITH {_M} SELECT record_id, rule_tier FROM q",
    "rule_score": f"WITH {_M} SELECT record_id, rule_score FROM q",
    "rule_pubtype": f"WITH {_M} SELECT record_id, rule_pubtype FROM q",
    "rule_judgment": f"WITH {_M} SELECT record_id, screening_level, evidence_type, reason, screening_method, needs_review, review_reason FROM j",
    "rule_judgment_loose": f"""WITH {_M} SELECT record_id, rule_tier = 'rule_boundary' OR (rule_tier = 'rule_high' AND (rule_score < 1.4 OR rule_pubtype LIKE '%review%')) AS needs_review,
        CASE WHEN rule_tier = 'rule_boundary' THEN '边界文献：需要进一步评估' WHEN rule_tier = 'rule_high' AND rule_pubtype LIKE '%review%' THEN '宽松模式：综述/信件/评论类文献，建议复核'
          WHEN rule_tier = 'rule_high' AND rule_score < 1.4 THEN '宽松模式：单条件匹配，建议复核' ELSE '' END AS review_reason FROM j""",
    "rule_stats": f"""WITH {_M} SELECT count(*) AS total, count(*) FILTER (rule_tier = 'rule_high') AS rule_high_count, count(*) FILTER (rule_tier = 'rule_boundary') AS rule_boundary_count,
        count(*) FILTER (rule_tier = 'rule_low') AS rule_low_count, count(*) FILTER (rule_tier = 'rule_unclear') AS rule_unclear_count,
        count(*) FILTER (screening_method = 'rule_direct_high') AS direct_high_count, count(*) FILTER (screening_method = 'rule_direct_low') AS direct_low_count,
        count(*) FILTER (needs_review) AS needs_review_count, round(count(*) FILTER (needs_review) * 100.0 / count(*), 6) AS needs_review_percentage FROM j""",
    "pubtype_histogram": f"WITH {_M} SELECT pubtype, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN rule_pubtype = '' THEN 'unknown' ELSE rule_pubtype END, '; ')) AS pubtype FROM q) GROUP BY pubtype",
    "review_reasons": f"WITH {_M} SELECT review_reason AS value, count(*) AS n FROM j GROUP BY 1",
    "preset_tiers": f"""WITH x AS (SELECT {_T} AS t FROM records), y AS (SELECT
          regexp_matches(t, '(?i)clinical\\s*trial|randomized|placebo\\s*controlled|longitudinal|prospective|cohort|meta[-\\s]*analysis|systematic\\s*review') AS hi,
          regexp_matches(t, '(?i)case\\s*control|cross[-\\s]*sectional|observational|retrospective') AS bo,
          regexp_matches(t, '(?i)animal\\s*study|in\\s*vitro|review\\s*article|commentary|editorial|letter|correspondence') AS lo FROM x)
        SELECT CASE WHEN hi AND NOT lo THEN 'rule_high' WHEN bo AND NOT lo THEN 'rule_boundary' WHEN lo AND NOT hi AND NOT bo THEN 'rule_low' ELSE 'rule_unclear' END AS rule_tier,
          count(*) AS n FROM y GROUP BY 1""",
    "tfidf_score": f"WITH {_tfidf_sql(SEEDS, STOPS)} SELECT record_id, round(tfidf_score, 6) AS tfidf_score FROM tfidf",
    "tfidf_threshold": f"""WITH {_M}, {_tfidf_sql(SEEDS, STOPS)}, x AS (SELECT j.*, tfidf_score FROM j JOIN tfidf USING (record_id)), y AS (
        SELECT *, CASE WHEN screening_level <> '' THEN 0 WHEN tfidf_score >= 0.1 THEN 2 WHEN tfidf_score < 0.02 THEN 1 ELSE 0 END AS k FROM x)
        SELECT record_id, CASE k WHEN 1 THEN '低相关' WHEN 2 THEN '高相关' ELSE screening_level END AS screening_level,
          CASE k WHEN 1 THEN 'low_similarity' WHEN 2 THEN 'high_similarity' ELSE evidence_type END AS evidence_type,
          CASE k WHEN 1 THEN 'TF-IDF相似度低于阈值 0.02' WHEN 2 THEN 'TF-IDF相似度高于阈值 0.1' ELSE reason END AS reason,
          CASE WHEN k > 0 THEN 'tfidf_threshold' ELSE screening_method END AS screening_method FROM y""",
    "tfidf_stats": f"SELECT * FROM ({_score_stats('tfidf_score', 'screening')}) CROSS JOIN (SELECT count(*) FILTER (tfidf_score < 0.02) AS below_low, count(*) FILTER (tfidf_score >= 0.3) AS from_high FROM screening)",
    "tfidf_bins": """SELECT b.bin::INT AS bin, count(s.bin) AS n FROM range(10) AS b(bin) LEFT JOIN (SELECT greatest(ceil(round(CASE WHEN isnan(tfidf_score) THEN NULL ELSE tfidf_score END * 10, 9))::INT - 1, 0) AS bin
        FROM screening WHERE tfidf_score BETWEEN 0 AND 1 AND NOT isnan(tfidf_score)) s ON s.bin = b.bin GROUP BY 1""",
    "rank_score": f"WITH {_RS} SELECT record_id, run_id, round(rank_score, 6) AS rank_score FROM rs",
    "rank_percentile": f"WITH {_RS} SELECT record_id, run_id, round(rank_percentile, 6) AS rank_percentile FROM rk",
    "rank_tier": f"WITH {_RS} SELECT record_id, run_id, rank_tier FROM rk",
    "rank_judgment": f"""WITH {_RS}, x AS (SELECT *, coalesce(screening_level, '') = '' AND rank_tier = 'rank_selected' AS k FROM rk)
        SELECT record_id, run_id, CASE WHEN k THEN '高相关' ELSE screening_level END AS screening_level, CASE WHEN k THEN 'rank25' ELSE '' END AS screening_method FROM x""",
    "rank_stats": f"""WITH {_RS} SELECT * FROM ({_score_stats('rank_score', 'rk')}) CROSS JOIN (SELECT count(*) AS total, count(*) FILTER (rank_tier = 'rank_selected') AS selected,
        round(count(*) FILTER (rank_tier = 'rank_selected') * 100.0 / count(*), 6) AS selected_percentage FROM rk)""",
    "full_screening": f"""WITH {_M}, {_tfidf_sql(["insomnia sleep nurses"], STOPS)}, x AS (SELECT j.*, tfidf_score, 0.4 * rule_score + 0.6 * tfidf_score AS rank_score FROM j JOIN tfidf USING (record_id)),
        y AS (SELECT *, CASE WHEN screening_level <> '' THEN 0 WHEN tfidf_score >= 0.3 THEN 2 WHEN tfidf_score < 0.001 THEN 1 ELSE 0 END AS k,
          rank_score >= quantile_cont(rank_score, 0.75) OVER () AS top FROM x),
        z AS (SELECT *, CASE k WHEN 1 THEN '低相关' WHEN 2 THEN '高相关' ELSE screening_level END AS l, CASE WHEN k > 0 THEN 'tfidf_threshold' ELSE screening_method END AS m FROM y)
        SELECT record_id, rule_tier, CASE WHEN l = '' AND top THEN '高相关' ELSE l END AS screening_level, CASE WHEN l = '' AND top THEN 'rank25' ELSE m END AS screening_method,
          rule_tier = 'rule_boundary' AS is_boundary, l = '' AND NOT top AND rule_tier <> 'rule_boundary' AS is_candidate FROM z""",
    "level_distribution": "SELECT coalesce(screening_level, '') AS screening_level, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM screening), 6) AS percentage FROM screening GROUP BY 1",
    "undecided": "SELECT record_id, run_id FROM screening WHERE coalesce(screening_level, '') = ''",
    "manual_review": f"""WITH {_CHOSEN} SELECT record_id, run_id, coalesce({_LEVEL}, screening_level) AS screening_level, coalesce({_EVIDENCE}, evidence_type) AS evidence_type,
        coalesce('人工判定为' || {_LEVEL}, reason) AS reason FROM screening LEFT JOIN ch USING (record_id)""",
    "batch_review": """SELECT record_id, run_id, CASE WHEN record_id IN (SELECT record_id FROM review_decisions) THEN '低相关' ELSE screening_level END AS screening_level,
        CASE WHEN record_id IN (SELECT record_id FROM review_decisions) THEN 'batch_review' ELSE screening_method END AS screening_method FROM screening""",
    "review_stats": f"""WITH {_CHOSEN}, x AS (SELECT coalesce({_LEVEL}, screening_level) AS l, coalesce({_EVIDENCE}, evidence_type) AS e FROM screening LEFT JOIN ch USING (record_id))
        SELECT count(*) FILTER (e = 'manual_high') AS manual_high, count(*) FILTER (e = 'manual_boundary') AS manual_boundary, count(*) FILTER (e = 'manual_low') AS manual_low,
          0::BIGINT AS batch, count(*) FILTER (coalesce(l, '') = '') AS undecided FROM x""",
    "ris_parse": f"""SELECT record_id, {_flat('title')} AS title, CASE WHEN {_flat('author')} = '' THEN 'Extra, A' ELSE {_flat('author')} || '; Extra, A' END AS author, {_flat('keywords')} AS keywords,
        {_flat('doi')} AS doi, {_year(_flat('publication_year'))} AS publication_year, {_flat('journal')} AS journal FROM records""",
    "nbib_parse": f"""SELECT record_id, record_id::VARCHAR AS pmid, trim('Start ' || {_flat('title')}) AS title, {_flat('author')} AS author, '10.1/x' || record_id AS doi,
        {_year(_flat('publication_year'))} AS publication_year, {_flat('journal')} AS journal FROM records""",
    "wos_parse": f"""SELECT record_id, {_flat('title')} AS title, CASE WHEN {_flat('author')} = '' THEN 'Extra, A' ELSE 'Extra, A; ' || {_flat('author')} END AS author, {_flat('keywords')} AS keywords,
        {_year(_flat('publication_year'))} AS publication_year, {_flat('journal')} AS journal FROM records""",
    "sniff_format": """SELECT * FROM (VALUES ('ris', 'ris'), ('nbib', 'pubmed_tagged_txt'), ('wos', 'wos_tagged_txt')) AS v(written, found), (SELECT count(*) AS n FROM records)""",
}
