"""Reading export files of any supported format into one canonical table, with a parse log."""

from __future__ import annotations

import io
import os
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import unquote
from xml.etree.ElementTree import ParseError

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.text import NA_LITERALS, collapse_ws, extract_year, normalize_colname, normalize_doi, safe_str
from sieveline.session import stage
from sieveline.sources.tagged import GRAMMARS, parse_tagged, read_heads, read_pieces, sniff
from sieveline.sources.xlsx import sheet_parts, sheet_rows

# File types, canonical columns, and the names exports use for them.
EXTENSIONS = (".csv", ".xlsx", ".xls", ".tsv", ".json", ".jsonl", ".ris", ".nbib", ".txt")
STANDARD = ("title", "author", "abstract", "keywords", "doi", "publication_year", "journal", "source_file", "source_format")
ALIASES = {
    "title": "title", "article title": "title", "document title": "title", "ti": "title", "t1": "title",
    "author": "author", "authors": "author", "au": "author", "a1": "author", "af": "author",
    "abstract": "abstract", "ab": "abstract", "summary": "abstract",
    "keywords": "keywords", "keyword": "keywords", "author keywords": "keywords", "keywords plus": "keywords",
    "kw": "keywords", "ak": "keywords", "de": "keywords",
    "doi": "doi", "di": "doi", "do": "doi",
    "publication year": "publication_year", "year": "publication_year", "py": "publication_year", "y1": "publication_year",
    "journal": "journal", "source": "journal", "so": "journal", "jo": "journal", "jf": "journal", "jt": "journal",
    "ta": "journal", "t2": "journal",
}
COLLAPSED = ("title", "author", "abstract", "keywords", "journal")
LOG_SCHEMA = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("full_path", T.StringType()),
                           T.StructField("detected_format", T.StringType()), T.StructField("status", T.StringType()),
                           T.StructField("record_count", T.LongType()), T.StructField("note", T.StringType())])


class LoadError(ValueError):
    """Nothing could be loaded."""


def standardize(df: DataFrame, extra_aliases: dict[str, str] | None = None) -> DataFrame:
    """Canonical column names; missing ones become ''. Columns with the same canonical name are merged:
    the first non-empty value in column order wins. Other columns stay."""
    names = ALIASES | {normalize_colname(k): v for k, v in (extra_aliases or {}).items()}
    groups: dict[str, list[str]] = defaultdict(list)
    for c in df.columns:
        plain = normalize_colname(c)
        groups[names.get(plain, plain if plain in STANDARD else c)].append(c)

    def merged(columns: list[str]) -> Column:
        quoted = [F.col(f"`{c.replace('`', '``')}`") for c in columns]
        if len(quoted) == 1:
            return quoted[0]
        return F.coalesce(*[F.when(safe_str(c) != "", c) for c in quoted], F.lit(""))

    got = {name: merged(cols) for name, cols in groups.items()}
    return df.select(*[got.get(c, F.lit("")).alias(c) for c in STANDARD], *[e.alias(n) for n, e in got.items() if n not in STANDARD])


def clean_records(df: DataFrame) -> DataFrame:
    """Trimmed strings in the canonical columns, white space collapsed, DOI and year normalised."""
    out = {}
    for c in STANDARD:
        if c in df.columns:
            e = safe_str(F.col(c))
            out[c] = collapse_ws(e) if c in COLLAPSED else normalize_doi(F.col(c)) if c == "doi" else \
                extract_year(F.col(c)) if c == "publication_year" else e
    return df.withColumns(out)


def read_table(spark: SparkSession, paths: list[str], ext: str, na_literals: bool = True) -> DataFrame:
    """Rows of table files of one extension as strings, with ``_path``; ``_bad`` marks broken ones."""
    if ext in (".csv", ".tsv"):
        heads = {_plain_path(unquote(r["path"])): r["value"] for r in read_heads(spark, paths, 1).collect()}  # one line per file
        groups: dict[str, list[str]] = defaultdict(list)
        for path in paths:
            groups[heads.get(path, "").lstrip("﻿")].append(path)
        frames = []
        for group in groups.values():
            got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option(
                "sep", "\t" if ext == ".tsv" else ",").option("inferSchema", False).csv(group)
            got = got.withColumnsRenamed({c: c.lstrip("﻿") for c in got.columns})
            frames.append(got.withColumn("_path", F.col("_metadata.file_path")))
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).withColumn("_bad", F.lit(False))
    elif ext in (".json", ".jsonl"):
        got = spark.read.option("multiLine", ext == ".json").option("primitivesAsString", True).option(
            "columnNameOfCorruptRecord", "_corrupt").json(paths).withColumn("_path", F.col("_metadata.file_path"))
        bad, others = F.lit(False), [c for c in got.columns if c not in ("_corrupt", "_path")]
        if "_corrupt" in got.columns:
            if not others:
                raise LoadError("malformed content")
            # Spark reads the corrupt record only beside another column
            bad = F.col("_corrupt").isNotNull() & (F.length(F.isnull(f"`{others[0]}`").cast("string")) > 0)
        plain = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f"`{f.name}`")
                 for f in got.schema.fields if f.name != "_corrupt"]
        return got.withColumn("_bad", bad).select(*plain, "_bad")
    else:
        if ext == ".xls":
            raise LoadError("the old binary .xls format is not supported; save the sheet as .xlsx")

        sheets = stage(_sheets(spark, paths))
        names = sorted(r[0] for r in sheets.select(F.explode("names").alias("n")).distinct().collect())  # header names
        cells = stage(_cells(spark, sheets, paths, names), 50_000)  # parsed once
        broken = F.broadcast(cells.where("_bad").select("_path").distinct())
        whole = {r[0] for r in sheets.join(broken, "_path", "left_anti").select(F.explode("names").alias("n")).distinct().collect()}
        out = cells.select("_path", "_bad", *[F.col(f"_{i}").alias(n) for i, n in enumerate(names) if n in whole])
    if na_literals:
        out = out.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NA_LITERALS), F.col(f"`{c}`")) for c in out.columns if c not in ("_path", "_bad")})
    return out


_BROKEN = (zipfile.BadZipFile, ParseError, KeyError, IndexError, ValueError)


def _books(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_path, content) of workbooks; a local file is read from its place, of other file systems each file comes whole."""
    frames = []
    for local in (True, False):
        if some := [p for p in paths if p.startswith("/") == local]:
            content = F.lit(None).cast("binary") if local else F.col("content")
            frames.append(spark.read.format("binaryFile").load(some).select(F.col("_metadata.file_path").alias("_path"), content.alias("content")))
    return reduce(DataFrame.unionByName, frames)


def _book(path: str, content: bytes | None) -> zipfile.ZipFile:
    return zipfile.ZipFile(_plain_path(unquote(path)) if content is None else io.BytesIO(content))


def _sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_path, part, names): the sheets of workbooks that are read, with their header if rows follow it."""

    @F.udf("array<struct<part:string,names:array<string>>>")
    def heads(path, content):  # noqa: ANN001, ANN202
        out = []
        try:
            with _book(path, content) as z:
                for part in sheet_parts(z):
                    names, rows = sheet_rows(z, part)
                    out.append((part, names if next(rows, None) is not None else []))
        except _BROKEN:
            return [("", [])]
        return out

    return _books(spark, paths).select("_path", F.inline(heads("_path", "content")))


def _cells(spark: SparkSession, sheets: DataFrame, paths: list[str], names: list[str]) -> DataFrame:
    """(_path, _bad, _0, _1, ...): the rows of sheets with a column for each of ``names``, and a bad row for a broken file.

    Each sheet is read by a task of its own, row by row.
    """
    shape = ", ".join(["_path string", "_bad boolean", *[f"_{i} string" for i in range(len(names))]])

    def batch(path: str, head: list[str], rows: list[list[str | None]], bad: bool = False) -> pa.RecordBatch:
        found = dict(zip(head, zip(*rows)))
        cells = [pa.array(found[n], pa.string()) if n in found else pa.nulls(len(rows), pa.string()) for n in names]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([bad] * len(rows)), *cells], ["_path", "_bad", *[f"_{i}" for i in range(len(names))]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            try:
                with _book(r["_path"], r["content"]) as z:
                    head, rows = sheet_rows(z, r["part"])
                    while some := list(islice(rows, 1000)):
                        yield batch(r["_path"], head, some)
            except _BROKEN:
                yield batch(r["_path"], [], [[]], True)

    sheets = sheets.select("_path", "part").repartition(spark.sparkContext.defaultParallelism)
    far = [p for p in paths if not p.startswith("/")]
    if far:
        sheets = sheets.join(_books(spark, far), "_path", "left")
    else:
        sheets = sheets.withColumn("content", F.lit(None).cast("binary"))
    return sheets.mapInArrow(read, shape)


def _plain_path(path: str) -> str:
    """A local path without its scheme, any other as it is."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The file at ``path``, or all supported files below the folder, sorted; on any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not system.exists(hadoop):
        raise LoadError(f"no such file or folder: {path}")
    if system.getFileStatus(hadoop).isFile():
        return [_plain_path(hadoop.makeQualified(system.getUri(), system.getWorkingDirectory()).toString())]
    found, files = system.listFiles(hadoop, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if os.path.splitext(name)[1].lower() in EXTENSIONS:
            files.append(_plain_path(name))
    if not files:
        raise LoadError(f"no supported files in {path}")
    return sorted(files)


def load_records(spark: SparkSession, path: str, extra_aliases: dict[str, str] | None = None,
                 na_literals: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, parse log) of a file or of all supported files below a folder, by full path.

    ``path`` is a local path or a URI of any file system that Spark reads. A file that can't be read is logged as
    failed and left out; if nothing is left, ``LoadError``. Files of one format are read together; a large CSV,
    JSONL or tagged file by several tasks. The log has one row per file and is made on the driver.
    """
    path = os.path.expanduser((path or "").strip())
    if not path:
        raise LoadError("no path")
    files = list_files(spark, path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    log = {f: [os.path.basename(f), f, "", "success", 0, ""] for f in files}
    by_format: dict[str, list[str]] = defaultdict(list)
    texts = [f for f in files if f.lower().endswith(".txt")]
    if texts:
        kinds = {_plain_path(unquote(r["path"])): r["kind"] for r in read_heads(spark, texts).select("path", sniff(F.col("value")).alias("kind")).collect()}  # one row per file
        for f in texts:
            by_format[kinds.get(f, "unknown_txt")].append(f)
    for f in files:
        ext = os.path.splitext(f)[1].lower()
        if ext in (".ris", ".nbib"):
            by_format[ext[1:]].append(f)
        elif ext != ".txt":
            by_format[f"table_like_{ext[1:]}" if ext in EXTENSIONS else "unsupported"].append(f)
    frames = []

    def fail(f: str, why: str) -> None:
        log[f][3:] = ["failed", 0, why]

    def take(kind: str, group: list[str]) -> None:
        if kind in GRAMMARS:
            raw = parse_tagged(read_pieces(spark, group, GRAMMARS[kind]), GRAMMARS[kind]).withColumnRenamed("path", "_path").drop("piece", "rec").withColumn("_bad", F.lit(False))
        else:
            raw = read_table(spark, group, "." + kind.rsplit("_", 1)[1], na_literals)
        counts = {_plain_path(unquote(r["_path"])): (r["n"], r["bad"]) for r in raw.groupBy("_path").agg(
            F.count("*").alias("n"), F.max("_bad").alias("bad")).collect()}  # one row per file
        broken = [f for f in group if counts.get(f, (0, False))[1]]
        for f in group:
            if f in broken:
                fail(f, "malformed content")
            else:
                log[f][4] = counts.get(f, (0, False))[0]
        name = F.try_url_decode(F.replace("_path", F.lit("+"), F.lit("%2B")))  # a path is no form: its plus stays
        plain = F.regexp_replace(name, "^file:/*", "/")
        kept = raw.where(~plain.isin(*broken)) if broken else raw
        frames.append(clean_records(standardize(kept.drop("_bad"), extra_aliases).withColumns(
            {"source_file": F.element_at(F.split(plain, "/"), -1), "source_format": F.lit(kind), "_path": plain})))

    for kind, group in sorted(by_format.items()):
        if kind in ("unknown_txt", "unsupported"):
            for f in group:
                fail(f, "undetected export format" if kind == "unknown_txt" else "unsupported file type")
            continue
        for f in group:
            log[f][2] = kind
        halves = [group]
        while halves:
            part = halves.pop()
            try:
                take(kind, part)
            except (AnalysisException, LoadError) as e:  # names that clash within a file: found by halving
                if len(part) == 1 or isinstance(e, LoadError):
                    for f in part:
                        fail(f, str(e).split("\n", 1)[0])
                else:
                    halves += [part[: len(part) // 2], part[len(part) // 2 :]]
    if not frames or not any(row[4] for row in log.values()):
        raise LoadError("no file could be parsed; see the parse log")
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return records.drop("_path"), spark.createDataFrame([tuple(log[f]) for f in files], LOG_SCHEMA)
