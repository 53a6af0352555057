"""RIS, PubMed and Web of Science tagged text as expressions over lines, and format sniffing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import extract_year


@dataclass(frozen=True)
class Grammar:
    """How lines of a tagged format become records.

    ``fields`` maps a column to (tags, how): ``words`` joins with a space, ``values`` with '; ',
    ``last`` and ``first`` keep one, ``year`` keeps the last as a year. ``continued`` are the tags whose
    indented lines go on. Files are read in pieces between ``split``, a text that only stands between records.
    """

    tag_line: str
    boundary: str
    boundary_starts: bool
    fields: dict[str, tuple[tuple[str, ...], str]]
    indent: str = ""
    continued: tuple[str, ...] = ()
    split: str = "\n"


# The tags of the three export formats.
RIS = Grammar(r"^([A-Z0-9]{2})  -\s?(.*)$", r"^ER  -", False, {
    "title": (("TI", "T1", "CT"), "words"), "author": (("AU", "A1", "A2", "A3", "A4"), "values"),
    "abstract": (("AB",), "words"), "keywords": (("KW",), "values"), "doi": (("DO", "DI"), "last"),
    "publication_year": (("PY", "Y1"), "year"), "journal": (("JO", "JF", "JA", "T2"), "last"),
}, split="\nER  -")
PUBMED = Grammar(r"^([A-Z]{2,4})\s*-\s?(.*)$", r"^PMID- ", True, {
    "title": (("TI",), "words"), "author": (("FAU", "AU"), "values"), "abstract": (("AB",), "words"),
    "keywords": (("OT", "MH"), "values"), "doi": (("AID", "LID"), "first"), "publication_year": (("DP",), "year"),
    "journal": (("JT", "TA"), "words"), "pmid": (("PMID",), "last"),
}, r"^\s{2,}", ("TI", "AB", "JT", "TA", "OT", "MH"), "\nPMID- ")
WOS = Grammar(r"^([A-Z0-9]{2})\s(.*)$", r"^ER\s*$", False, {
    "title": (("TI",), "words"), "author": (("AU", "AF"), "values"), "abstract": (("AB",), "words"),
    "keywords": (("DE", "AK", "ID"), "values"), "doi": (("DI",), "last"), "publication_year": (("PY",), "year"),
    "journal": (("SO",), "words"),
}, r"^\s{3,}", ("TI", "AB", "SO", "DE", "AK", "ID", "AU", "AF"), "\nER\n")
GRAMMARS = {"ris": RIS, "nbib": PUBMED, "pubmed_tagged_txt": PUBMED, "wos_tagged_txt": WOS}

# What counts for each format when a text file is sniffed.
SNIFF = {
    "pubmed": (("^PMID- ", 3), ("^TI  - ", 2), ("^AB  - ", 2), ("^FAU - ", 2), ("^DP  - ", 2), ("^JT  - ", 1), ("^MH  - ", 1)),
    "wos": (("^PT ", 3), ("^AU ", 2), ("^AF ", 2), ("^TI ", 2), ("^SO ", 2), ("^DE ", 1), ("^AB ", 2), ("^DI ", 2), (r"^ER\s*$", 3)),
    "ris": (("^TY  - ", 3), ("^AU  - ", 1), ("^TI  - ", 1), ("^ER  -", 3)),
}
_EDGE = r"^\s+|\s+$"


def _valid(value: Column) -> Column:
    """Without the bytes that are no UTF-8."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit("")))


def read_heads(spark, paths: list[str], lines: int = 8000) -> DataFrame:  # noqa: ANN001
    """(path, value): the first ``lines`` lines of each file; only its first block is read."""
    text = spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_at"), "value")
    first = text.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("_at"))).where(F.col("_n") <= lines)
    return first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("l")).select(
        "path", F.array_join(F.transform("l", lambda x: _valid(x["value"])), "\n").alias("value"))


def read_pieces(spark, paths: list[str], grammar: Grammar) -> DataFrame:  # noqa: ANN001
    """(path, piece, value): tagged files in pieces of whole records, so that one file is read by many tasks.

    Bytes that are no UTF-8 are dropped. A file without the separator (other line ends) is one piece.
    """
    text = spark.read.option("lineSep", grammar.split).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("piece"), _valid(F.col("value")).alias("value"))
    if grammar.boundary_starts:  # the separator took the tag of the first line
        tag = grammar.split.lstrip("\n")
        return text.withColumn("value", F.when(F.col("value").rlike(r"^[0-9]+\s*(?:[\r\n]|$)"), F.concat(F.lit(tag), "value")).otherwise(F.col("value")))
    return text


def sniff(value: Column) -> Column:
    """The format of a tagged text by its first 100 non-blank lines within 8000 characters."""
    head = F.split(F.substring(value, 1, 8000), r"\r\n|\r|\n")
    kept = F.slice(F.filter(head, lambda x: x.rlike(r"\S")), 1, 100)
    text = F.array_join(kept, "\n")
    score = {k: reduce(lambda a, b: a + b, [F.when(text.rlike(f"(?m){p}"), n).otherwise(0) for p, n in rules])
             for k, rules in SNIFF.items()}
    pubmed, wos, ris = score["pubmed"], score["wos"], score["ris"]
    return (F.when((ris >= F.greatest(pubmed, wos)) & (ris >= 3), "ris").when((pubmed >= wos) & (pubmed >= 3), "pubmed_tagged_txt")
            .when((wos > pubmed) & (wos >= 3), "wos_tagged_txt").otherwise("unknown_txt"))


def parse_tagged(files: DataFrame, grammar: Grammar) -> DataFrame:
    """(path, piece, rec, fields...) of files (path, value), whole or in pieces (path, piece, value).

    A record is there if a known tag occurred in it. Order comes from line numbers within a piece.
    """
    unit = ["path", "piece"]
    files = files if "piece" in files.columns else files.withColumn("piece", F.lit(0).cast("long"))
    lines = files.select(*unit, F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    order = Window.partitionBy(*unit).orderBy("pos")
    edge = F.col("line").rlike(grammar.boundary).cast("int")
    until = 0 if grammar.boundary_starts else -1
    rec = F.coalesce(F.sum(edge).over(order.rowsBetween(Window.unboundedPreceding, until)), F.lit(0))
    tagged = F.col("line").rlike(grammar.tag_line)
    rows = lines.withColumns({
        "rec": rec, "_is": tagged, "_tag": F.when(tagged, F.regexp_extract("line", grammar.tag_line, 1)),
        "_value": F.regexp_replace(F.when(tagged, F.regexp_extract("line", grammar.tag_line, 2)).otherwise(F.col("line")), _EDGE, ""),
    })
    known = F.when(F.col("_tag") == "PMID", "") if grammar.boundary_starts else F.lit(None)
    carried = F.last(F.coalesce(known, F.col("_tag")), ignorenulls=True).over(Window.partitionBy(*unit, "rec").orderBy("pos"))
    rows = rows.withColumn("_of", F.when(F.col("_is"), F.col("_tag")).when(
        F.col("line").rlike(grammar.indent or "^$") & carried.isin(*(grammar.continued or ("",))), carried))
    rows = rows.where(F.col("_of").isNotNull())
    out = []
    for name, (tags, how) in grammar.fields.items():
        mine = F.col("_of").isin(*tags)
        value = F.col("_value")
        if how == "first":
            value = F.regexp_extract(value, r"(?i)(10\.\S+?)(?:\s*\[doi\])?$", 1)
            mine = mine & (value != "")
        if how in ("last", "first", "year"):
            pick = F.min_by if how == "first" else F.max_by
            got = pick(F.when(mine, value), F.when(mine, F.col("pos")))
            got = extract_year(got) if how == "year" else got
            out.append(F.when(F.count(F.when(mine, 1)) > 0, got).alias(name))
        else:
            listed = F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("pos", value.alias("v"))))), lambda x: x["v"])
            if how == "words":
                text = F.array_join(F.filter(listed, lambda v: v != ""), " ")
            else:  # leading empty values vanish, later ones leave their separator
                start = F.array_position(F.transform(listed, lambda v: v != ""), True)
                text = F.when(start > 0, F.array_join(F.slice(listed, F.greatest(start, F.lit(1)).cast("int"), F.size(listed)), "; ")).otherwise("")
            out.append(F.when(F.count(F.when(mine, 1)) > 0, text).alias(name))
    got = rows.groupBy(*unit, "rec").agg(*out)
    return got.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in grammar.fields]))
