"""Cleaning functions over string columns, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the usual string functions of scripting languages see it.
WS = r"[\s\x1c-\x1f\x85\xa0  -     　]"
#: A letter, digit or underscore of any script.
WORD = r"[\p{L}\p{N}_]"

# What an export writes for a missing value.
NA_LITERALS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def safe_str(col: Column) -> Column:
    """Null becomes '', anything else text without outer white space."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_ws(col: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(col, f"{WS}+", " ")


def normalize_doi(col: Column) -> Column:
    """Lower case, without the doi.org resolver or the ``doi:`` label, wherever they stand."""
    text = F.lower(safe_str(col))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        text = F.replace(text, F.lit(prefix), F.lit(""))
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def extract_year(col: Column) -> Column:
    """The first free-standing 19xx or 20xx, else the trimmed text."""
    text = safe_str(col)
    year = F.regexp_extract(text, rf"(?<!{WORD})((?:19|20)\p{{Nd}}{{2}})(?!{WORD})", 1)
    return F.when(year == "", text).otherwise(year)


def dedup_key(col: Column) -> Column:
    """Lower case, white space collapsed, then everything but word characters and space dropped."""
    text = collapse_ws(F.lower(safe_str(col)))
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\xa0]", "")
    return F.regexp_replace(bare, f"^{WS}+|{WS}+$", "")


def text_blob(title: Column, abstract: Column, keywords: Column) -> Column:
    """Title, abstract and keywords with a space between, blanks kept."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in (title, abstract, keywords)])


def normalize_colname(name: object) -> str:
    """Lower case, trimmed, white space collapsed."""
    return re.sub(r"\s+", " ", str(name).strip().lower())


def clean_file_path(path: str) -> str:
    """Trimmed, without one pair of enclosing quotes."""
    path = path.strip()
    return path[1:-1] if len(path) >= 2 and path[0] == path[-1] and path[0] in "\"'" else path
