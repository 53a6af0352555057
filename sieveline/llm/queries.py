"""Queries of the training-data operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.copies import collapse, copy_members, copy_pairs, encoded_fields
from sieveline.llm.encode import decode_corpus, encode_corpus, token_counts
from sieveline.llm.language import detect, detect_whole, texts_of, train, training_sample, wrong_labels
from sieveline.llm.names import link_names, linked_pairs
from sieveline.llm import toxicity
from sieveline.llm.packing import fill_report, pack
from sieveline.llm.ranking import median_ranking
from sieveline.llm.survivor import only_full, survivors

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each segment of every record and document."""
    texts = texts_of(_t(spark, d, "records"), _t(spark, d, "documents"))
    sample = training_sample(texts)
    return detect(texts, train([t for t, _ in sample], [lang for _, lang in sample]))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every record and document as a whole."""
    texts = texts_of(_t(spark, d, "records"), _t(spark, d, "documents"))
    sample = training_sample(texts)
    return detect_whole(texts, train([t for t, _ in sample], [lang for _, lang in sample]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the rows with a missing or wrong language label."""
    return wrong_labels(p2_segments(spark, d)).select("src", "row_id", "seg_no", "lang")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that are the same but for formatting."""
    return copy_pairs(_t(spark, d, "records"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every publication once with its number of copies."""
    return collapse(_t(spark, d, "records"))


def p4_with_doi(spark: SparkSession, d: str) -> DataFrame:
    """Copies of the records with a usable DOI and title."""
    got = encoded_fields(_t(spark, d, "records")).where("title is not null and doi is not null")
    return got.groupBy("title", "doi").agg(F.min("record_id").alias("group_id"), F.count("*").alias("copies")).select("group_id", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields of which one record of a publication alone has the full value."""
    return only_full(_t(spark, d, "records"))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per publication with the best value of each field."""
    return survivors(_t(spark, d, "records"))


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    """One ranking of the records from their three scores."""
    got = median_ranking(_t(spark, d, "screening"))
    return got.select("record_id", "position", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), "n_scores")


def p6_judged(spark: SparkSession, d: str) -> DataFrame:
    """Where the records stand that people judged: mean place, 0 best, by their judgment."""
    ranked = median_ranking(_t(spark, d, "screening"))
    total = ranked.agg(F.count("*").alias("total"))  # one row
    judged = _t(spark, d, "review_decisions").select("record_id", "screening_level").distinct()
    return judged.join(ranked, "record_id").crossJoin(total).groupBy("screening_level").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("position") / F.col("total")), 6).alias("mean_place"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return linked_pairs(_t(spark, d, "author_names"), _t(spark, d, "records"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(_t(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of every capacity."""
    return pack(token_counts(_t(spark, d, "documents")), _t(spark, d, "capacities"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(p9_containers(spark, d), _t(spark, d, "capacities"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Probability of each category for every document."""
    documents = _t(spark, d, "documents")
    texts, marks = toxicity.training_sample(documents, _t(spark, d, "labels"))
    return toxicity.score_documents(documents, toxicity.train(texts, marks))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories that hold for a document."""
    return toxicity.found_categories(p10_scores(spark, d))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each source."""
    return toxicity.source_rates(p10_scores(spark, d))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document decoded from its ids."""
    return decode_corpus(p8_ids(spark, d))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p2_documents": p2_documents,
    "p4_found": p4_found,
    "p4_collapsed": p4_collapsed,
    "p4_with_doi": p4_with_doi,
    "p4_members": lambda s, d: copy_members(_t(s, d, "records")),
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p6_ranking": p6_ranking,
    "p6_judged": p6_judged,
    "p7_found": p7_found,
    "p7_entities": lambda s, d: link_names(_t(s, d, "author_names"), _t(s, d, "records")),
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
    "p8_counts": lambda s, d: token_counts(_t(s, d, "documents")),
}

_DOI = r"regexp_replace(regexp_replace(lower(coalesce(doi, '')), '\s+', '', 'g'), '^(?:https?:/*|(?:www\.)?(?:dx\.)?doi\.org/*|doi[:=]*)+', '')"

_RANKED = """latest AS (SELECT record_id, run_id, rule_score, tfidf_score, rank_score FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(screened_at, TIMESTAMP '1970-01-01') DESC, run_id DESC) AS k FROM screening) WHERE k = 1),
  long AS (SELECT record_id, run_id, 'a' AS s, rule_score AS v FROM latest UNION ALL SELECT record_id, run_id, 'b', tfidf_score FROM latest UNION ALL SELECT record_id, run_id, 'c', rank_score FROM latest),
  shares AS (SELECT record_id, (rank() OVER (PARTITION BY run_id, s ORDER BY v DESC) + (count(*) OVER (PARTITION BY run_id, s, v) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY run_id, s) AS share
    FROM long WHERE v IS NOT NULL AND NOT isnan(v)),
  med AS (SELECT record_id, list_sort(list(share))[ceil(count(*) / 2.0)::INT] AS m, round(avg(share), 12) AS a, count(*) AS c FROM shares GROUP BY record_id),
  ranked AS (SELECT record_id, row_number() OVER (ORDER BY m NULLS LAST, a NULLS LAST, record_id) AS position, round(m, 6) AS median_rank, round(a, 6) AS mean_rank, coalesce(c, 0) AS n_scores
    FROM latest LEFT JOIN med USING (record_id))"""

SQL: dict[str, str] = {
    "p6_ranking": f"WITH {_RANKED} SELECT * FROM ranked",
    "p6_judged": f"""WITH {_RANKED} SELECT screening_level, count(*) AS n, round(avg(position / (SELECT count(*) FROM ranked)), 6) AS mean_place
        FROM (SELECT DISTINCT record_id, screening_level FROM review_decisions) JOIN ranked USING (record_id) GROUP BY 1""",
    "p4_with_doi": rf"""WITH x AS (SELECT record_id, regexp_replace(lower(coalesce(title, '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t, {_DOI} AS d FROM records)
        SELECT min(record_id) AS group_id, count(*) AS copies FROM x WHERE t NOT IN ('', 'na', 'none', 'null', 'nan') AND regexp_matches(d, '^10\.[0-9]+/[\p{{L}}\p{{N}}]')
        GROUP BY t, regexp_replace(d, '[^\p{{L}}\p{{N}}]+', '', 'g')""",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
