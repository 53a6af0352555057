"""Python regular expressions as Java ones, decided on the driver."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLASSES = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\s\x1c-\x1f\x85\p{Z}"}
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
_INSIDE = r"(?:(?<=[\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?![\p{L}\p{N}_]))"


class Untranslatable(ValueError):
    """The pattern is valid Python but has no Java form here."""


def pyre_to_java(pattern: str) -> str:
    """The Java pattern with the meaning of a Python pattern under IGNORECASE.

    ``\\w \\d \\s \\b`` become Unicode-aware, named groups lose the P, and ``\\Z`` becomes ``\\z``.
    Raises ``re.error`` for an invalid pattern and ``Untranslatable`` for what Java lacks.
    """
    re.compile(pattern)
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch, two = pattern[i], pattern[i : i + 2]
        if ch == "\\" and len(two) == 2:
            c = two[1]
            if c in "wds":
                out.append(_CLASSES[c] if in_class else f"[{_CLASSES[c]}]")
            elif c in "WDS":
                if in_class:
                    raise Untranslatable(pattern)
                out.append(f"[^{_CLASSES[c.lower()]}]")
            elif c == "b":
                out.append(r"\x08" if in_class else _EDGE)
            elif c == "B":
                out.append(_INSIDE)
            elif c == "Z":
                out.append(r"\z")
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            if ch == "]" and pattern[i - 1 : i] != "[" and not (pattern[i - 2 : i] == "[^"):
                in_class = False
            elif ch == "[" or two == "&&":
                out.append("\\")
        elif ch == "[":
            in_class = True
        elif pattern.startswith("(?P=", i) or re.match(r"\(\?\(\w+\)", pattern[i:]):
            raise Untranslatable(pattern)
        elif pattern.startswith("(?P<", i):
            name = pattern[i + 4 : pattern.index(">", i)]
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", name):
                raise Untranslatable(pattern)
            out.append("(?<")
            i += 4
            continue
        elif ch == "$" and i == len(pattern) - 1:
            out.append(r"(?=\n?\z)")
            i += 1
            continue
        out.append(ch)
        i += 1
    return "(?iu)" + "".join(out)


def matches(text: Column, pattern: str) -> Column:
    """``re.search`` with IGNORECASE; an invalid pattern is a case-insensitive substring.

    The choice is made once on the driver. Valid patterns without a Java form run in a pandas UDF.
    """
    try:
        return F.coalesce(text, F.lit("")).rlike(pyre_to_java(pattern))
    except re.error:
        return F.lower(F.coalesce(text, F.lit(""))).contains(pattern.lower())
    except Untranslatable:
        warnings.warn(f"pattern {pattern!r} runs in Python", stacklevel=2)
        compiled = re.compile(pattern, re.IGNORECASE)

        @F.pandas_udf("boolean")
        def search(texts):  # noqa: ANN001, ANN202
            return texts.fillna("").map(lambda t: compiled.search(t) is not None)

        return search(text)
