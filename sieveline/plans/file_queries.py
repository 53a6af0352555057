"""Queries over the loader, the sinks, the rule helpers and the model step, with the SQL that checks them.

The table of records is written as export files of each kind, whole and with many records a file, and loaded back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.config import MODE_PATTERNS, LLMConfig, RuleMode, mode_rules
from sieveline.functions.text import collapse_ws, safe_str
from sieveline.operators.review import needs_human
from sieveline.operators.rules import match_any, rule_screening
from sieveline.operators.semantic import analyze_documents, classify_boundary, classify_documents, generate_rules, semantic_client
from sieveline.plans.queries import _T, _flat, _judged, _safe, _t, _year, SQL as CORE_SQL, Query
from sieveline.session import scratch
from sieveline.sources.load import load_records
from sieveline.sources.sinks import write_results

TEXTS = ("title", "author", "abstract", "keywords", "journal")
#: The names the exports use for the canonical columns.
HEADS = {"title": "Article Title", "author": "AUTHORS", "abstract": "Summary", "keywords": "Author  Keywords", "doi": "DI", "publication_year": "Year", "journal": "SO"}
TOPIC = "insomnia"
ANY = ["insom\\w+", "sleep", "pain", "\\bnurs"]


def _renamed(records: DataFrame) -> DataFrame:
    return records.select("record_id", *[F.col(c).alias(h) for c, h in HEADS.items()])


def _with_extension(spark: SparkSession, folder: str, ext: str) -> str:
    """Give the part files of a folder another extension."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part-"):
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.split('.')[0]}{ext}"))  # noqa: SLF001
    return folder


def _wrapped(tag: str, value: Column, indent: str = "") -> Column:
    """A field as a line; with ``indent`` its sentences stand on lines that go on."""
    text = F.replace(value, F.lit(". "), F.lit(f".\n{indent}")) if indent else value
    return F.concat(F.lit(tag), text, F.lit("\n"))


def _tagged_text(records: DataFrame, kind: str) -> DataFrame:
    """One row per record: its text in a tagged format, with open ends, headers only, unknown tags and lines that go on."""
    r = records.select("record_id", *[collapse_ws(safe_str(F.col(c))).alias(c) for c in HEADS])
    c, key = F.col, F.concat(F.lit("10.1/"), F.col("record_id").cast("string"))
    if kind == "ris":
        parts = [F.lit("TY  - JOUR\n"), _wrapped("T1  - ", c("title")), _wrapped("AU  - ", c("author")), _wrapped("AB  - ", c("abstract")), _wrapped("ZZ  - ", c("journal")),
                 _wrapped("KW  - ", c("keywords")), F.lit("DO  - 10.1/first\n"), _wrapped("DO  - ", key), _wrapped("Y1  - ", c("publication_year")), _wrapped("JF  - ", c("journal")),
                 F.lit("ER  - \n\nTY  - HEAD\nER  - \n")]
    elif kind == "nbib":
        parts = [_wrapped("PMID- ", c("record_id").cast("string")), _wrapped("TI  - ", c("title"), "      "), _wrapped("AB  - ", c("abstract"), "      "), _wrapped("FAU - ", c("author")),
                 F.lit("      goes on with no one\n"), _wrapped("OT  - ", c("keywords")), F.lit("LID - S1 [pii]\n"), _wrapped("AID - ", F.concat(key, F.lit(" [doi]"))),
                 F.lit("LID - 10.2/later [doi]\n"), _wrapped("DP  - ", c("publication_year")), _wrapped("TA  - ", c("journal")), F.lit("\n")]
    else:
        parts = [F.lit("FN Export\nVR 1.0\nPT J\n"), _wrapped("AU ", c("author")), _wrapped("TI ", c("title"), "   "), _wrapped("AB ", c("abstract"), "   "), _wrapped("DE ", c("keywords")),
                 _wrapped("DI ", key), _wrapped("SO ", c("journal")), _wrapped("PY ", c("publication_year")), F.lit("ER\n\n")]
    return r.select(F.concat(*parts).alias("value"))


def _array_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of one JSON array for each partition."""
    first = True
    for frame in frames:
        lines = [("[" if first and i == 0 else ",") + v for i, v in enumerate(frame["value"])]
        first = first and not lines
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def _export(spark: SparkSession, d: str, kind: str, into: str | None = None) -> str:
    """The records as export files of one kind in a folder of the shared place."""
    records, folder = _t(spark, d, "records"), into or scratch(spark, kind)
    if kind in ("csv", "tsv"):
        _renamed(records).write.options(header=True, escape='"', quoteAll=True, sep="\t" if kind == "tsv" else ",", extension=kind,
                                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
        return folder
    if kind in ("json", "jsonl"):
        rows = _renamed(records).select(F.to_json(F.struct("*")).alias("value"))
        (rows if kind == "jsonl" else rows.mapInPandas(_array_lines, "value string")).write.text(folder)
    else:
        _tagged_text(records, kind).write.text(folder)
    return _with_extension(spark, folder, {"wos": ".txt"}.get(kind, f".{kind}"))


def _loaded(spark: SparkSession, path: str) -> DataFrame:
    got, _ = load_records(spark, path)
    return got.select(F.col("record_id").cast("long").alias("record_id"), *TEXTS, "doi", "publication_year", "source_format")


def _loaded_tagged(spark: SparkSession, path: str) -> DataFrame:
    got, _ = load_records(spark, path)
    return got.where("doi != ''").select(F.substring_index("doi", "/", -1).cast("long").alias("record_id"), *TEXTS, "publication_year", "source_format")


def _sunk(ext: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _loaded(spark, write_results(_renamed(_t(spark, d, "records")), scratch(spark, "sink") + ext))

    return run


def load_folder(spark: SparkSession, d: str) -> DataFrame:
    """The parse log of a folder with every kind of file, one of them broken, by format."""
    root = scratch(spark, "folder")
    for kind in ("csv", "tsv", "json", "jsonl", "ris", "nbib", "wos"):
        _export(spark, d, kind, f"{root}/{kind}/deep")
    for name, text in (("broken", '{"title": '), ("unknown", "nothing known")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{name}")
    _with_extension(spark, f"{root}/broken", ".json")
    _, log = load_records(spark, root)
    return log.groupBy("detected_format", "status").agg(F.sum("record_count").alias("records"))


def any_matches(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "records").select("record_id", F.array_join(match_any(F.coalesce("title", F.lit("")), ANY), " / ").alias("found"))


def mode_tiers(spark: SparkSession, d: str) -> DataFrame:
    """How many records each rule mode puts in each tier."""
    df = _t(spark, d, "records").select("record_id", "title", "abstract", "keywords")
    counts = [rule_screening(df, [mode_rules(m)]).groupBy("rule_tier").agg(F.count("*").alias("n")).select(F.lit(m.value).alias("mode"), "rule_tier", "n") for m in RuleMode]
    return reduce(DataFrame.unionByName, counts)


def suggested_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The tiers by the rules that the model step suggests (constant replies here)."""
    rules = generate_rules(semantic_client(LLMConfig()), TOPIC, [])
    df = _t(spark, d, "records").select("record_id", "title", "abstract", "keywords")
    return rule_screening(df, rules).select("record_id", "rule_tier", "rule_score")


def _mock():  # noqa: ANN202
    return semantic_client(LLMConfig())


def semantic_analyze(spark: SparkSession, d: str) -> DataFrame:
    got = analyze_documents(_t(spark, d, "records"), _mock, TOPIC)
    return got.withColumn("tags", F.array_join("tags", "; "))


def semantic_boundary(spark: SparkSession, d: str) -> DataFrame:
    """The records of the boundary tier, each classified for itself."""
    return classify_boundary(_judged(spark, d).where("needs_review"), _mock, TOPIC)


QUERIES: dict[str, Query] = {
    **{f"load_{k}": (lambda s, d, k=k: _loaded(s, _export(s, d, k))) for k in ("csv", "tsv", "json", "jsonl")},
    **{f"load_{k}": (lambda s, d, k=k: _loaded_tagged(s, _export(s, d, k))) for k in ("ris", "nbib", "wos")},
    "load_folder": load_folder,
    **{f"sink_{k}": _sunk(ext) for k, ext in (("csv", ".csv"), ("json", ".json"), ("xlsx", ".xlsx"), ("unknown", ".dat"))},
    "match_any": any_matches,
    "mode_tiers": mode_tiers,
    "suggested_tiers": suggested_tiers,
    "semantic_classify": lambda s, d: classify_documents(_t(s, d, "records"), _mock, TOPIC),
    "semantic_analyze": semantic_analyze,
    "semantic_boundary": semantic_boundary,
    "needs_human": lambda s, d: _t(s, d, "screening").select("record_id", "run_id", needs_human(F.col("relevance_score"), 0.6).alias("ask")),
}

# --- SQL ---------------------------------------------------------------------------------

# What a table reader takes for a missing value.
_NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
_FILLED = f"(SELECT record_id, {', '.join(f'CASE WHEN {c} NOT IN {_NA} THEN {c} END AS {c}' for c in HEADS)} FROM records)"
_DOI = CORE_SQL["normalize_doi"].split("record_id, ", 1)[1].rsplit(" AS doi_norm", 1)[0]


def _table_sql(kind: str) -> str:
    """JSON tells missing values from texts itself."""
    rows = "records" if kind.startswith("json") else _FILLED
    return f"SELECT record_id, {', '.join(f'{_flat(c)} AS {c}' for c in TEXTS)}, {_DOI} AS doi, {_year(_safe('publication_year'))} AS publication_year, 'table_like_{kind}' AS source_format FROM {rows}"


def _tagged_sql(kind: str) -> str:
    return f"SELECT record_id, {', '.join(f'{_flat(c)} AS {c}' for c in TEXTS)}, {_year(_flat('publication_year'))} AS publication_year, '{kind}' AS source_format FROM records"


def _hits(patterns: list[str]) -> str:
    """Whether any pattern matches; the conditions of one must all match."""
    quoted = lambda p: p.strip().replace("'", "''")
    return " OR ".join("(" + " AND ".join(f"regexp_matches(t, '(?i){quoted(x)}')" for x in p.split("+")) + ")" for p in patterns) or "false"


def _tiers_sql(high: list[str], boundary: list[str], low: list[str]) -> str:
    return f"""SELECT record_id, CASE WHEN hi AND NOT lo THEN 'rule_high' WHEN bo AND NOT lo THEN 'rule_boundary' WHEN lo AND NOT hi AND NOT bo THEN 'rule_low' ELSE 'rule_unclear' END AS rule_tier
        FROM (SELECT record_id, {_hits(high)} AS hi, {_hits(boundary)} AS bo, {_hits(low)} AS lo FROM (SELECT record_id, {_T} AS t FROM records))"""


SQL: dict[str, str] = {
    **{f"load_{k}": _table_sql(k) for k in ("csv", "tsv", "json", "jsonl")},
    "load_ris": _tagged_sql("ris"), "load_nbib": _tagged_sql("nbib"), "load_wos": _tagged_sql("wos_tagged_txt"),
    **{f"sink_{k}": _table_sql(as_) for k, as_ in (("csv", "csv"), ("json", "json"), ("xlsx", "xlsx"), ("unknown", "csv"))},
    "load_folder": """SELECT f AS detected_format, s AS status, CASE WHEN s = 'success' THEN (SELECT count(*) FROM records) ELSE 0 END::BIGINT AS records FROM (VALUES
        ('table_like_csv', 'success'), ('table_like_tsv', 'success'), ('table_like_json', 'success'), ('table_like_jsonl', 'success'), ('ris', 'success'), ('nbib', 'success'),
        ('wos_tagged_txt', 'success'), ('table_like_json', 'failed'), ('', 'failed')) AS v(f, s)""",
    "match_any": "SELECT record_id, concat_ws(' / ', " + ", ".join(f"CASE WHEN regexp_matches(coalesce(title, ''), '(?i){p}') THEN '{p}' END" for p in ANY) + ") AS found FROM records",
    "mode_tiers": " UNION ALL ".join(f"SELECT '{m.value}' AS mode, rule_tier, count(*) AS n FROM ({_tiers_sql(*MODE_PATTERNS[m][:3])}) GROUP BY 2" for m in RuleMode),
    "suggested_tiers": f"SELECT record_id, rule_tier, CASE rule_tier WHEN 'rule_high' THEN 1 WHEN 'rule_boundary' THEN 0.25 WHEN 'rule_low' THEN -1 ELSE 0 END::DOUBLE AS rule_score "
                       f"FROM ({_tiers_sql([TOPIC], ['observational'], ['editorial'])})",
    "semantic_classify": "SELECT record_id, 'high' AS judgment, 0.85::DOUBLE AS confidence, 'mock' AS reason FROM records",
    "semantic_analyze": "SELECT record_id, 'mock' AS tags, coalesce(title, '') AS summary, 0.88::DOUBLE AS relevance_score, 'article' AS document_type FROM records",
    "semantic_boundary": CORE_SQL["rule_judgment"].split("SELECT record_id, screening_level")[0] + "SELECT record_id, '高相关' AS judgment, 0.85::DOUBLE AS confidence, 'mock' AS reason FROM j WHERE needs_review",
    "needs_human": "SELECT record_id, run_id, coalesce(relevance_score, 0) < 0.6 AS ask FROM screening",
}
