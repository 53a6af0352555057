"""Several values packed in one field: one row per value, with its position.

A parsing expression grammar with ordered choice reads the field. Each choice is
tried in the order given and the parser backtracks to the next one on failure:

    field    <- json / list
    json     <- '[' string (',' string)* ']' end              # a JSON array of strings
    list     <- item (sep item)* end
    item     <- ws (quoted / bare)? ws
    quoted   <- '"' ('""' / '\\"' / !'"' .)* '"' &(ws (sep / end))
    bare     <- (bracketed / entity / !sep .)*
    bracketed<- '(' (bracketed / !')' .)* ')'                 # also [ ] and { }
    entity   <- '&' ('#'? alnum+) ';'
    sep      <- the strongest separator class that occurs at the top level

``quoted`` must be followed by a separator or the end; a quote that is not (an
unclosed one, or one that belongs to a word as in ``"sandwich" carers``) makes that
choice fail and the text is read as ``bare``. Separator classes, strongest first:
``; ； |`` and line breaks together; then ``， 、 ,``; then ``/`` with spaces; then ``/``.
For person names a comma may also stand inside a name, so the comma class has a
grammar of its own (``_names``), and ``and``/``&`` separate too.

``bracketed`` is memoised for every position of the field, and no rule looks further than the
next separator from where it stands: the time is linear in the length of the field.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.session import spread

#: Bits of the error flag.
UNCLOSED_QUOTE, BROKEN_JSON, ODD_NAME_LIST, UNCLOSED_BRACKET = 1, 2, 4, 8

_STRONG = ";；|\n\r  "
_COMMA = ",，、"
_SLASH = "/"
_SPACED_SLASH = " /"
_CLOSERS = {"(": ")", "[": "]", "{": "}"}
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_SPACE = re.compile(r"\s+")
_QUOTED = re.compile(r'"((?:""|\\.|[^"\\])*)"', re.S)
_SPECIAL = re.compile(r'["()\[\]{}&]')
_COMMA_SPLIT = re.compile(r"(?<!\d),|,(?!\d)|[，、]")
_COMMAS = re.compile(r"[,，、]")
_NAME_ENDS = re.compile(r"[,，、]|\s(?:&|and)\s")
_SURNAME = re.compile(r"\S+[,，、]")
#: The separator classes where nothing in the text is quoted or bracketed.
_SPLIT = {_STRONG: re.compile(f"[{_STRONG}]"), _COMMA: _COMMA_SPLIT, _SLASH: re.compile("/"),
          _SPACED_SLASH: re.compile(r"(?<=\s)/(?=\s)|/\s*$")}

# Particles of surnames, and the words that end the name of a group.
_PARTICLES = frozenset("van von der den de del della di da dos das du la le el al ter ten zu zum".split())
_GROUP_WORDS = frozenset(
    "study group grp collaborative network netw consortium consort investigators invest collaboration "
    "committee council society association team".split()
)
_INITIALS = re.compile(r"(?:[^\W\d_]\.[ -]?)+|[^\W\d_]{1,3}")
_DOTTED = re.compile(r"(?:[^\W\d_]\.-?)+")
_AND = re.compile(r"\s+(?:&|and)\s+")


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class _Scan:
    """The list rule over one separator class: its characters, or ``/`` with or without spaces around."""

    def __init__(self, text: str, seps: str) -> None:
        self.text, self.seps, self.errors = text, seps, 0
        self.last = len(text.rstrip()) - 1
        self.closed: dict[int, int] | None = None

    def at(self, i: int) -> int:
        """Length of the separator at ``i``, 0 for none."""
        ch, text = self.text[i], self.text
        if ch not in self.seps:
            return 0
        if ch == "," and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit():
            return 0  # 1,2-propanediol
        if self.seps is _SPACED_SLASH and i < self.last and not (text[i - 1 : i].isspace() and text[i + 1].isspace()):
            return 0
        return ch != " "

    def quoted(self, i: int) -> tuple[str, int] | None:
        m = _QUOTED.match(self.text, i)
        if not m:
            self.errors |= UNCLOSED_QUOTE
            return None
        j, n = m.end(), len(self.text)
        while j < n and self.text[j].isspace() and not self.at(j):
            j += 1
        if j < n and not self.at(j):
            return None
        return re.sub(r'""|\\(["\\])', lambda x: x[1] or '"', m[1]), j

    def bracketed(self, i: int) -> int | None:
        """End of the bracket that opens at ``i``; all brackets of the text are matched in one pass."""
        if self.closed is None:
            self.closed, stack = {}, []
            for j, ch in enumerate(self.text):
                if ch in _CLOSERS:
                    stack.append((_CLOSERS[ch], j))
                elif stack and ch == stack[-1][0]:
                    self.closed[stack.pop()[1]] = j + 1
        if i not in self.closed:
            self.errors |= UNCLOSED_BRACKET
        return self.closed.get(i)

    def bare(self, i: int) -> tuple[str, int]:
        start, n = i, len(self.text)
        while i < n and not self.at(i):
            ch = self.text[i]
            if ch in _CLOSERS and (j := self.bracketed(i)):
                i = j
            elif ch == "&" and (m := _ENTITY.match(self.text, i)):
                i = m.end()
            else:
                i += 1
        return self.text[start:i], i

    def items(self) -> list[tuple[str, bool]]:
        """(value, was it quoted) of each item, empty ones included."""
        out, i, n = [], 0, len(self.text)
        while True:
            while i < n and self.text[i].isspace() and not self.at(i):
                i += 1
            got = self.quoted(i) if i < n and self.text[i] == '"' else None
            if got:
                out.append((got[0], True))
                i = got[1]
            else:
                value, i = self.bare(i)
                out.append((value, False))
            if i >= n:
                return out
            i += self.at(i)


def _items(text: str, seps: str) -> tuple[list[tuple[str, bool]], int]:
    if not _SPECIAL.search(text):
        return [(x, False) for x in _SPLIT[seps].split(text)], 0
    scan = _Scan(text, seps)
    return scan.items(), scan.errors


def _is_initials(token: str) -> bool:
    return bool(_DOTTED.fullmatch(token)) or (len(token) <= 3 and token.isupper() and token.isalpha())


def _whole(piece: str) -> bool:
    """Whether a piece between commas is a full name, so that no comma belongs to it."""
    words = piece.split()
    low = [w.strip(".").lower() for w in words]
    if any(w in _GROUP_WORDS for w in low):
        return not all(w in _GROUP_WORDS or w == "the" for w in low)
    rest = [w for w, x in zip(words[:-1], low) if x not in _PARTICLES] + words[-1:]
    if len(rest) < 2 or all(_is_initials(w) for w in rest):
        return False
    # "Olga M." is what stands behind "Surname,"; "Surname M" and "O. Surname" are whole
    return not (_DOTTED.fullmatch(rest[-1]) and not _DOTTED.fullmatch(rest[0]))


def _given(piece: str) -> bool:
    words = piece.split()
    return bool(words) and (all(_is_initials(w) for w in words) or len(words) <= 2 and not _whole(piece))


def _join_breaks(text: str) -> list[str]:
    """Split at ``and``/``&`` unless the conjunction stands inside the name of a group."""
    out, start = [], 0
    commas = [m.start() for m in _COMMAS.finditer(text)]
    spaces = [m.end() for m in _SPACE.finditer(text)]
    of_group: dict[int, bool] = {}  # whether the piece that ends at a comma is filled with words of group names
    for m in _AND.finditer(text):
        k = bisect_left(commas, m.start()) - 1  # the last comma in front
        own = k >= 0 and commas[k] >= start
        word = max(start, commas[k] + 1 if own else 0, spaces[w] if (w := bisect_left(spaces, m.start() + 1) - 1) >= 0 else 0)
        left = text[word:m.start()].strip(".").lower()
        until = _NAME_ENDS.search(text, m.end())
        right = text[m.end():until.start() if until else len(text)].split()
        low = [w.strip(".").lower() for w in right]
        plain = sum(w not in _GROUP_WORDS for w in low)
        ends = left in _GROUP_WORDS or _is_initials(text[word:m.start()])
        if word < m.start() and plain < len(low) and plain == 1 and not ends:
            continue  # "... Pain & Mobility Study Group"
        if len(right) == 1 and own and not _SURNAME.match(text, m.end()):
            first = max(start, commas[k - 1] + 1 if k else 0)
            if first not in of_group:
                words = text[first:commas[k]].split()
                of_group[first] = bool(words) and all(w.strip(".").lower() in _GROUP_WORDS for w in words)
            if of_group[first]:
                continue  # "Study Group, ... Pain & Mobility"
        out.append(text[start:m.start()])
        start = m.end()
    return [*out, text[start:]]


def _names(text: str) -> tuple[list[str], int]:
    """Names in a text without a strong separator."""
    out: list[str] = []
    errors = 0
    for part in _join_breaks(text):
        comma = next((c for c in part if c in _COMMA), ",")
        pieces = [p for p in (x.strip() for x in _COMMA_SPLIT.split(part)) if p]
        if len(pieces) == 2 and not (_whole(pieces[0]) and _whole(pieces[1])):
            out.append(f"{comma} ".join(pieces) if f"{comma} " in part else comma.join(pieces))
            continue
        i = 0
        while i < len(pieces):
            if _whole(pieces[i]):
                out.append(pieces[i])
                i += 1
            elif i + 1 < len(pieces) and _given(pieces[i + 1]):
                out.append(f"{pieces[i]}{comma} {pieces[i + 1]}")
                i += 2
            else:
                errors |= ODD_NAME_LIST * (len(pieces) > 1)
                out.append(pieces[i])
                i += 1
    return out, errors


def parse_field(text: str | None, kind: str = "terms") -> list[tuple[str, int]]:
    """(value, error flag) of each value of one field, in order; [] for null or blank text.

    ``kind`` is ``names`` (commas may stand inside a value, ``and``/``&`` separate) or ``terms``.
    """
    if text is None or not text.strip():
        return []
    body, errors = text.strip(), 0
    if body[0] == "[":
        try:
            got = json.loads(body)
            if isinstance(got, list) and all(isinstance(x, str | int | float | None) for x in got):
                return [(v, 0) for v in (_clean(str(x)) for x in got if x is not None) if v]
        except (ValueError, RecursionError):
            errors |= BROKEN_JSON
            if body[-1] == "]" and '"' in body:
                body = body[1:-1]
    items, bad = _items(body, _STRONG)
    if len(items) == 1 and not items[0][1]:
        items, bad = _weak(body, kind)
    return [(value, errors | bad) for value in (_clean(x) for x, _ in items) if value]


def _weak(body: str, kind: str) -> tuple[list[tuple[str, bool]], int]:
    """The items of a text in which no strong separator stands at the top level."""
    commas, bad = _items(body, _COMMA)
    if any(quoted for _, quoted in commas) or kind == "terms" and len(commas) > 1:
        return commas, bad
    spaced, bad = _items(body, _SPACED_SLASH)
    if sum(bool(x.strip()) for x, _ in spaced) > 1:
        return spaced, bad
    body = spaced[0][0]
    if kind == "names":
        names, odd = _names(body)
        return [(x, False) for x in names], bad | odd
    return _items(body, _SLASH)


_VALUE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType()),
                                   T.StructField("err", T.IntegerType())]))


@F.pandas_udf(_VALUE)
def packed_values(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """array<struct<pos,val,err>> of a packed column and its kind."""
    return pd.Series([[(i, v, e) for i, (v, e) in enumerate(parse_field(t, k), 1)] for t, k in zip(texts, kinds)],
                     dtype=object)


def split_packed(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row per value: (key, field_name, pos, val, err).

    ``fields`` maps a column to ``names`` or ``terms``. Null, empty and blank fields give no
    row; repeated values count each time; a repeated key gives the rows of each occurrence.
    The field is read whole, whatever its length. Other columns of ``df`` play no part.
    The work is row-local: no shuffle, so no key can be hot.
    """
    each = F.array(*[F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("kind"),
                              F.col(name).cast("string").alias("text")) for name, kind in fields.items()])
    rows = spread(df.select(key, *fields)).select(F.col(key).alias("_key"), F.explode(each).alias("_f")).where(F.col("_f.text").rlike(r"\S"))
    return (
        rows.select("_key", "_f.field_name", packed_values("_f.text", "_f.kind").alias("_v"))
        .select("_key", "field_name", F.explode("_v").alias("_v"))
        .select(F.col("_key").alias(key), "field_name", "_v.pos", "_v.val", "_v.err")
    )
