"""Variant spellings of names typed by people, by noisy-channel attribution.

A name is read into surname, given names, initials and affiliation. Frequent forms are the
candidate canonical forms; every other spelling is explained as one of them after typing
errors, abbreviation, nickname, reordering or a changed affiliation, and is attached to the
candidate of greatest posterior (frequency prior times the likelihoods of what must have
happened), or stands alone if nothing explains it better than a person of its own.

Candidates for a misspelt surname are found by shared one-deletion forms, never by comparing
all surnames. What is decided together are the spellings of one surname and first letter (or
type of organisation). A spelling is weighed against the candidates at its place, those that
share its given name and letters, and the few that have enough of the surname's frequency to be
likelier than a person of its own; no other can win. So the time is near linear in the spellings.

Names of any script are read. A name in ideographs is its first sign as surname, the rest given.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.joins import HOT_AT, digest, join_lookup
from sieveline.operators.packed import split_packed
from sieveline.session import stage

# Particles, words of group names, words every affiliation may have, and usual short forms of given names.
PARTICLES = frozenset("van von der den de del della di da dos das du la le el al ter ten zu zum".split())
GROUP_TYPES = {"group": "group", "grp": "group", "study": "", "collaborative": "", "network": "network", "netw": "network",
               "consortium": "consortium", "consort": "consortium", "investigators": "investigators", "invest": "investigators",
               "collaboration": "network", "committee": "committee", "team": "team", "society": "society"}
PLACE_WORDS = frozenset(
    "university univ of the and for department dept nursing college institute inst public health general gen hospital hosp "
    "medical med school centre center ctr applied research faculty fac clinic academy".split())
NICKNAMES = {
    "ben": "benjamin", "benny": "benjamin", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth",
    "bill": "william", "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "ted": "edward", "ed": "edward", "eddie": "edward", "ned": "edward",
    "tom": "thomas", "tommy": "thomas", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "cathy": "katherine", "maggie": "margaret", "peggy": "margaret", "meg": "margaret",
    "greta": "margaret", "mike": "michael", "mick": "michael", "tony": "anthony", "alex": "alexander", "sandy": "alexander", "sasha": "alexander", "sam": "samuel", "becky": "rebecca", "becca": "rebecca",
    "trish": "patricia", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "chris": "christina", "tina": "christina", "sue": "susanna", "susie": "susanna", "sanna": "susanna",
    "hannes": "johannes", "hans": "johannes", "jan": "johannes", "nick": "nikolaus", "klaus": "nikolaus", "niko": "nikolaus", "paco": "francisco", "pancho": "francisco", "fran": "francisco", "pepe": "jose",
    "theo": "theodora", "dora": "theodora", "thea": "theodora", "dima": "dmitri", "mitya": "dmitri", "toni": "antonia", "joe": "joseph", "jim": "james", "jimmy": "james", "dick": "richard", "rick": "richard",
    "jack": "john", "johnny": "john", "chuck": "charles", "charlie": "charles", "andy": "andrew", "dave": "david", "dan": "daniel", "danny": "daniel", "steve": "stephen", "matt": "matthew", "jen": "jennifer",
    "jenny": "jennifer", "vicky": "victoria", "lena": "helena", "juergen": "jurgen", "soeren": "soren", "aasa": "asa", "annmarie": "annemarie", "jossi": "yusuf", "inge": "ingrid",
}



@dataclass(frozen=True)
class Rates:
    """Chances that the channel does something to a name.

    ``initial``, ``missing`` and ``typo`` are measured on the table (``measured_rates``), drawn to these values by
    ``SEEN`` rows. No count tells a move from a namesake, nor a topic left out from another group: ``moved``,
    ``place`` (being seen at one given other place), ``own`` (weight of an entity of its own) and ``unnamed`` are fixed.
    """

    initial: float = 0.35
    typo: float = 0.04
    missing: float = 0.18
    moved: float = 0.08
    place: float = 0.012
    own: float = 0.0008
    unnamed: float = 0.05


#: Rows that are taken as seen with the fixed rates.
SEEN = 500.0
#: As many letters may stand behind the first by chance.
LETTERS = 26
#: Misspellings of any surname in one form that are taken as seen, before its frequency tells more: where place and given
#: name, the place, one of them, or neither agree; and how much more a row speaks for a misspelling there.
TAKEN, EVIDENCE = (4.0, 2.0, 2.0, 2.0), (8.0, 4.0, 2.0, 1.0)
#: A given name is a misspelling of one that is so many times as frequent.
COMMON = 8
#: In a word of fewer letters only a swap is likelier a misspelling than another word: each has others one letter away.
TELLING = 5

_NO_LETTER = re.compile(r"[\W\d_]+")
_IDEOGRAPH = re.compile(r"[㐀-鿿豈-﫿가-힣々]+")


def fold(text: str) -> str:
    """Lower case ASCII letters as far as possible."""
    text = text.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("æ", "ae").replace("Æ", "AE").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def place_key(text: str | None) -> str:
    """The telling words of an affiliation; '' for none. A part behind a comma that names no institution is dropped."""
    parts = [re.findall(r"[^\W_]+", fold(p)) for p in (text or "").split(",")]
    parts = [p for i, p in enumerate(parts) if p and (i == 0 or set(p) & PLACE_WORDS)]
    words = [w for p in parts for w in p]
    return " ".join(sorted(w for w in words if w not in PLACE_WORDS)) or " ".join(sorted(words))


def read_name(name: str) -> tuple[str, str, list[str], list[str]]:
    """(kind, surname, given names in full, initials) of a spelling.

    For a group: ('g', telling name, its topic words, [type]).
    """
    words = [w for w in re.split(r"[\s,/&]+", fold(name)) if w]
    plain = [w.strip(".") for w in words]
    if any(GROUP_TYPES.get(w, "") for w in plain) and len(plain) > 1:
        kinds = {GROUP_TYPES[w] for w in plain if GROUP_TYPES.get(w)}
        rest = [x for w in plain if w not in GROUP_TYPES and w not in ("the", "and") for x in w.split("-") if x != "and"]
        return "g", rest[0] if rest else "", rest[1:], sorted(kinds)
    raw = [w for w in re.split(r"\s+", name.strip()) if w]
    signs = [w for w in re.split(r"[\s,，·]+", name) if w]
    if signs and all(_IDEOGRAPH.fullmatch(w) for w in signs):
        surname, given = (signs[0], "".join(signs[1:])) if len(signs) > 1 else (signs[0][:1], signs[0][1:])
        return "p", surname, [given] if given else [], [given[0]] if given else []
    if "," in name:
        left, right = name.split(",", 1)
        parts = left.split()
        # a short lower-case word in front is a particle even if misspelt
        kept = [w for i, w in enumerate(parts) if not (fold(w) in PARTICLES or i < len(parts) - 1 and w.islower() and len(w) <= 3)]
        surname = fold("".join(kept) or left)
        given = right.split()
    else:
        def initials(w: str) -> bool:
            return bool(re.fullmatch(r"(?:[^\W\d_]\.-?)+", w)) or (len(w) <= 3 and w.isupper())

        full = [i for i, w in enumerate(raw) if not initials(w) and fold(w) not in PARTICLES and not (w.islower() and len(w) <= 3)]
        if not full:
            return "p", _NO_LETTER.sub("", fold(name)), [], []
        # "J. Surname", "Given M. Surname", "Surname J", "Surname Given": the last is told from "Given Surname" later
        at = full[-1] if initials(raw[0]) or len(full) == 1 or not initials(raw[-1]) else full[0]
        surname = fold(raw[at])
        given = [w for i, w in enumerate(raw) if i != at and not (w.islower() and (fold(w) in PARTICLES or len(w) <= 3))]
    names, letters = [], []
    for w in given:
        bare = re.sub(r"[^\w-]|[\d_]", "", fold(w))
        if not bare.strip("-") or bare in PARTICLES and w.islower():
            continue
        # letters behind a hyphen are upper case: they may be left out
        if re.fullmatch(r"(?:[^\W\d_]\.-?)+", w) or (len(w) <= 3 and w.isupper()):
            for j, part in enumerate(p for p in bare.split("-") if p):
                letters += [x.upper() if j else x for x in part]
        else:
            names.append(bare.replace("-", ""))
            letters += [p[0].upper() if j else p[0] for j, p in enumerate(x for x in bare.split("-") if x)]
    return "p", _NO_LETTER.sub("", surname), names, letters


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def same_letters(a: str, b: str) -> bool:
    """Whether initials agree as far as both go; an upper-case letter is one behind a hyphen and may be missing."""
    forms = lambda x: {x.lower(), "".join(c for c in x if not c.isupper())}
    return any(u.startswith(v) or v.startswith(u) for u in forms(a) for v in forms(b))


def misspelt(a: str, b: str) -> bool:
    """``near``, and likelier a misspelling than another word."""
    return near(a, b) and (max(len(a), len(b)) >= TELLING or sorted(a) == sorted(b))


def deletions(word: str) -> list[str]:
    """The word and all it gives by one deletion: two words one error apart share one of these."""
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


def _topic_likelihood(seen: list[str], own: list[str], rates: Rates) -> float:
    """P(topic of a group name as seen | the topic as spelt otherwise): unchanged, as initials, misspelt, left out; 0 for another."""
    if seen == own:
        return 1 - rates.initial - rates.typo - rates.unnamed
    if not seen or not own:
        return rates.unnamed
    x, y = "".join(w[0] for w in seen), "".join(w[0] for w in own)
    short = lambda t, ini: len(t) == 1 and (t[0] == ini or t[0].replace("a", "") == ini.replace("a", "") or t[0] == ini[:1] + "a" + ini[1:])
    if short(seen, y) or short(own, x):
        return rates.initial
    return rates.typo if len(seen) == len(own) and all(near(u, v) for u, v in zip(seen, own)) else 0.0


class _Entity:
    """A candidate: the forms attributed to it so far; ``n`` is their frequency."""

    __slots__ = ("rates", "given", "letters", "places", "spellings", "n", "rows", "surnames", "longest")

    def __init__(self, rates: Rates) -> None:
        self.rates = rates
        self.given: Counter = Counter()
        self.letters: Counter = Counter()
        self.places: Counter = Counter()
        self.surnames: Counter = Counter()
        self.spellings: set[str] = set()
        self.n = 0.0
        self.rows: list[int] = []
        self.longest = ""

    def add(self, r: dict) -> None:
        self.n += r["weight"]
        self.rows.append(r["i"])
        self.spellings.add(r["author"])
        self.surnames[r["surname"]] += 1
        if r["names"]:
            self.given[r["first"]] += 1
        self.letters[r["ini"]] += 1
        if len(r["ini"]) > len(self.longest):
            self.longest = r["ini"]
        if r["place"]:
            self.places[r["place"]] += 1

    def copy(self) -> _Entity:
        other = type(self)(self.rates)
        for name in ("given", "letters", "places", "surnames", "spellings"):
            setattr(other, name, getattr(self, name).copy())
        other.n, other.longest = self.n, self.longest
        return other

    def likelihood(self, r: dict) -> float:
        """P(spelling, place | entity); 0 for the impossible. One entity has a spelling once."""
        p = 0.0 if r["author"] in self.spellings else self.name_likelihood(r)
        if not p or not r["place"]:
            return p * self.rates.missing
        if r["place"] in self.places:
            return p * (1 - self.rates.missing - self.rates.moved) * (self.places[r["place"]] / sum(self.places.values()))
        return p * self.rates.moved * self.rates.place if self.places else p * 0.1

    def joint(self, group: list[dict]) -> float:
        """Log-likelihood of spellings of one place against that a new entity is at that place; -inf for the impossible.

        Each has its own chance of a changed place. Letters behind the first that agree are no chance either.
        """
        out, e = self.agreed(group[0]), self
        for k, r in enumerate(group):
            like = e.likelihood(r)
            if not like:
                return -math.inf
            if r["place"] and r["place"] not in self.places:
                like = like / self.rates.place if k == 0 else e.name_likelihood(r) * self.rates.moved * self.rates.place
            out += math.log(like)
            if k + 1 < len(group):
                e = e.copy() if e is self else e
                e.add(r)
        return out

    def agreed(self, r: dict) -> float:
        """Log-odds that the letters behind the first agree, for a stranger's would by chance."""
        return max(0, min(len(r["ini"]), len(self.longest)) - 1) * math.log(LETTERS)

    def name_likelihood(self, r: dict) -> float:
        # a misspelt surname is only decided here if it is near: that a stranger has a surname so near is as rare as the error
        p = 1.0 if r["surname"] in self.surnames else 0.5
        a, b = r["ini"], self.longest
        if r["names"]:
            if self.given:
                g = max(self.given.items(), key=lambda kv: kv[1])[0]
                if r["first"] in self.given:
                    p *= 1 - self.rates.initial
                elif misspelt(r["first"], g):
                    p *= self.rates.typo
                else:
                    return 0.0
            elif a[:1] == b[:1]:
                p *= 0.15  # the full name is one of those the letter may stand for
            else:
                return 0.0
        else:
            if a[:1] != b[:1]:
                return 0.0
            p *= self.rates.initial
        if not same_letters(a, b):
            return 0.0
        if (len(a) > 1) != (len(b) > 1):
            p *= 0.6
        return p


class _Group(_Entity):
    """A candidate organisation; abbreviated types are one type since reading."""

    __slots__ = ("topics",)

    def __init__(self, rates: Rates) -> None:
        super().__init__(rates)
        self.topics: Counter = Counter()

    def add(self, r: dict) -> None:
        super().add(r)
        self.topics[tuple(r["names"])] += 1

    def copy(self) -> _Group:
        other = super().copy()
        other.topics = self.topics.copy()
        return other

    def agreed(self, r: dict) -> float:
        return 0.0

    def name_likelihood(self, r: dict) -> float:
        if r["ini"] not in self.letters:
            return 0.0
        # the form with most words is the full one; a topic that is unlike it is no variant of this group
        full = max(self.topics, key=lambda t: (len(t), self.topics[t], t))
        p = _topic_likelihood(r["names"], list(full), self.rates)
        return p * (1.0 if r["surname"] in self.surnames else 0.5)


class _Candidates:
    """The entities that can be likelier than a new one, by what a unit shares with them.

    Elsewhere than at its place an entity explains a unit with at most the chance of a missing or changed place times
    its share of the surname: below ``bar`` that is less than ``own``, unless letters behind the first agree.
    """

    def __init__(self, rates: Rates, total: float) -> None:
        self.bar = total * rates.own / max(rates.missing, rates.moved, 0.1)
        self.at: dict[str, list[_Entity]] = defaultdict(list)
        self.like: dict[str, list[_Entity]] = defaultdict(list)
        self.big: list[_Entity] = []

    def note(self, e: _Entity, r: dict, n_before: float) -> None:
        """Take in that ``r`` was added to ``e``."""
        if r["place"] and e.places[r["place"]] == 1:
            self.at[r["place"]].append(e)
        if e.letters[r["ini"]] == 1:
            for pair in {r["ini"][:2].lower(), "".join(c for c in r["ini"] if not c.isupper())[:2]}:
                if len(pair) > 1 and e not in self.like[pair]:
                    self.like[pair].append(e)
        if n_before < self.bar <= e.n:
            self.big.append(e)

    def of(self, r: dict) -> list[_Entity]:
        pairs = {r["ini"][:2].lower(), "".join(c for c in r["ini"] if not c.isupper())[:2]}
        found = [*self.at.get(r["place"] or "?", ()), *self.big, *(e for p in pairs if len(p) > 1 for e in self.like.get(p, ()))]
        return list({id(e): e for e in found}.values())


def attribute(rows: list[dict], total: float | None = None, rates: Rates | None = None) -> list[int]:
    """A number for each spelling of one surname and first letter; equal numbers are one entity.

    ``rows`` have author, surname, names, first (the given name, '' for letters only), ini, place and weight; ``total``
    is the weight of the whole surname. Units that agree in given name and place are the frequent forms; they become
    candidates by falling frequency, the rest is attached to the candidate of greatest posterior.
    """
    full = Counter(r["first"] for r in rows if r["names"])
    near_forms: dict[str, list[str]] = defaultdict(list)
    for g in full:
        for d in deletions(g):
            near_forms[d].append(g)
    right = {}
    for g, n in full.items():
        better = [o for d in deletions(g) for o in near_forms[d] if full[o] > n and misspelt(o, g)]
        right[g] = max(better, key=lambda o: (full[o], o)) if better else g
    for i, r in enumerate(rows):
        r["i"], r["first"] = i, right[r["first"]] if r["names"] else ""
    units: dict[tuple, list[dict]] = defaultdict(list)
    for r in rows:
        units[(r["first"] or r["ini"][:1], r["place"] or f"?{r['i']}")].append(r)
    # letters join the full name of their place
    fulls: dict[tuple, list[tuple]] = defaultdict(list)
    for g, place in units:
        if len(g) > 1:
            fulls[place, g[0]].append((g, place))
    rates = rates or Rates()
    for (g, place), group in list(units.items()):
        named = fulls.get((place, g), []) if len(g) == 1 else []
        if len(named) == 1 and not ({r["author"] for r in group} & {r["author"] for r in units[named[0]]}):
            merged = _Entity(rates)
            for r in units[named[0]]:
                merged.add(r)
            if all(merged.likelihood(r) > 0 for r in group):
                units[named[0]] += units.pop((g, place))
    order = sorted(units.items(), key=lambda kv: (kv[0][1].startswith("?"), -len(kv[1]), -max(len(r["names"]) for r in kv[1]), kv[0]))
    ranked = [sorted(group, key=lambda r: (not r["names"], -len(r["ini"]), r["author"])) for _, group in order]
    return _settle(ranked, len(rows), total or sum(r["weight"] for r in rows), _Entity, rates)


def _settle(units: list[list[dict]], count: int, total: float, kind: type[_Entity], rates: Rates) -> list[int]:
    """A number for each row: every unit goes, as a whole, to the entity of greatest posterior or is a new one."""
    entities: list[_Entity] = []
    known = _Candidates(rates, total)

    def put(e: _Entity | None, r: dict) -> None:
        if e is None or r["author"] in e.spellings:  # the same spelling twice: two people
            entities.append(e := kind(rates))
        before = e.n
        e.add(r)
        known.note(e, r, before)

    for group in units:
        once = list({r["author"]: r for r in reversed(group)}.values())[::-1]
        alone = kind(rates)
        alone.add({**once[0], "i": -1})
        best, score = None, math.log(rates.own) + (alone.joint(once[1:]) - alone.agreed(once[1]) if once[1:] else 0.0)
        for e in known.of(once[0]):
            s = e.joint(once) + math.log(e.n / total)
            if s > score or best is not None and s == score and e.n > best.n:
                best, score = e, s
        for k, r in enumerate(group):
            put(best, r)
            best = best or entities[-1]
    out = [0] * count
    for k, e in enumerate(entities):
        for i in e.rows:
            out[i] = k
    return out


def _attribute_groups(rows: list[dict], total: float | None = None, rates: Rates | None = None) -> list[int]:
    """The same for group names of one telling name and type: topic and place."""
    units: dict[tuple, list[dict]] = defaultdict(list)
    for i, r in enumerate(rows):
        r["i"], r["first"] = i, ""
        units[(r["ini"], tuple(r["names"]), r["place"] or f"?{i}")].append(r)
    order = sorted(units.items(), key=lambda kv: (kv[0][2].startswith("?"), -len(kv[0][1]), -len(kv[1]), kv[0]))
    return _settle([sorted(group, key=lambda r: r["author"]) for _, group in order], len(rows), total or sum(r["weight"] for r in rows), _Group, rates or Rates())


def read_names(df: DataFrame) -> DataFrame:
    """(name_id, author, kind, surname, names, ini, place) of each row; null authors have no row."""
    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            got = [read_name(a) for a in f["author"]]
            yield pd.DataFrame({
                "name_id": f["name_id"], "author": [re.sub(r"\s+", " ", a.strip()) for a in f["author"]],
                "kind": [g[0] for g in got], "surname": [g[1] for g in got], "names": [g[2] for g in got],
                "ini": ["".join(g[3]) if g[0] == "p" else "|".join(g[3]) for g in got], "place": [place_key(a) for a in f["affiliation"]]})

    schema = "name_id long, author string, kind string, surname string, names array<string>, ini string, place string"
    return df.where("author is not null").select("name_id", "author", "affiliation").mapInPandas(run, schema)


def settle_order(names: DataFrame) -> DataFrame:
    """Decide "Surname Given" against "Given Surname" by which word is the more frequent given name."""
    two = (F.col("kind") == "p") & ~F.col("author").contains(",") & (F.size("names") > 0)
    rows = names.withColumns({"_first": F.when(two, digest(F.col("names")[0])), "_last": F.when(two, digest(F.col("surname")))})
    given = names.where("kind = 'p' and author like '%,%'").select(F.explode("names").alias("_w")).select(digest(F.col("_w")).alias("_word"), F.lit(1).alias("_given"))
    either = rows.where(two).select(F.explode(F.array("_first", "_last")).alias("_word"), F.lit(0).alias("_given"))
    counts = stage(given.unionByName(either).groupBy("_word").agg(F.sum("_given").alias("_given"), F.count("*").alias("n")))
    for c in ("_first", "_last"):  # words that no name with a comma has are in the table as well, for a hot one is met there
        rows = join_lookup(rows, counts.select(F.col("_word").alias(c), F.col("_given").alias(f"{c}_n"), "n"), [c], how="left")
    swap = two & (F.coalesce("_last_n", F.lit(0)) > F.coalesce("_first_n", F.lit(0)))
    letters = F.concat(F.substring("surname", 1, 1), F.expr("substring(ini, 2)"))  # the hyphen of a surname is gone
    return rows.withColumns({
        "surname": F.when(swap, F.col("names")[0]).otherwise(F.col("surname")),
        "names": F.when(swap, F.concat(F.array("surname"), F.slice("names", 2, F.size("names")))).otherwise(F.col("names")),
        "ini": F.when(swap, letters).otherwise(F.col("ini")),
    }).select(*names.columns)


def touched(rows: DataFrame, on: list[str], counts: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with ``_in``: whether their key is in ``table``. ``counts`` has every key with its number of rows ``n``.

    Keys of many rows are met in a lookup whether they are in the table or not, so they are never gathered.
    """
    key = F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]), digest(F.to_json(F.struct(*on)))).alias("_key")
    known = counts.join(table.select(*on).distinct().withColumn("_in", F.lit(True)), on, "left")
    look = stage(known.where(F.col("_in") | (F.col("n") >= HOT_AT)).select(key, F.coalesce("_in", F.lit(False)).alias("_in"), "n"))
    got = join_lookup(rows.select("*", key), look, ["_key"], how="left").drop("_key")
    return got.withColumn("_in", F.coalesce("_in", F.lit(False)))


def near_words(counts: DataFrame, by: list[str], word: str) -> DataFrame:
    """(by..., word, to, mine, n): words one typing error apart, from rarer to more frequent (ties to the first by letters).

    Found by shared one-deletion forms: a shuffle of about a dozen short rows a word, no comparison of all words.
    """
    deletes = F.udf(lambda s: deletions(s or ""), "array<string>", useArrow=True)
    is_near = F.udf(lambda a, b: misspelt(a, b), "boolean", useArrow=True)
    keys = stage(counts.withColumn("key", F.explode(deletes(word))))
    often = keys.select(*by, F.col(word).alias("to"), "key", F.col("n"))
    return keys.withColumnRenamed("n", "mine").join(often, [*by, "key"]).where(
        (F.col(word) != F.col("to")) & ((F.col("n") > F.col("mine")) | ((F.col("n") == F.col("mine")) & (F.col("to") < F.col(word))))
    ).select(*by, word, "to", "mine", "n").distinct().where(is_near(word, "to"))


def corrected_given(names: DataFrame) -> DataFrame:
    """``names`` with misspelt given names put right where a near one is ``COMMON`` times as frequent in the table; ``misspelt`` tells where."""
    first = F.when((F.col("kind") == "p") & (F.size("names") > 0), F.col("names")[0])
    counts = names.select(first.alias("_given")).where("_given is not null").groupBy("_given").agg(F.count("*").alias("n"))
    better = near_words(counts, [], "_given").where(f"n >= {COMMON} * mine").groupBy("_given").agg(F.max_by("to", F.struct("n", "to")).alias("_to"))
    better = stage(better)
    marked = touched(names.withColumn("_given", first), ["_given"], counts, better)
    rows = marked.where("_in").join(better, "_given", "left").unionByName(marked.where("not _in").withColumn("_to", F.lit(None).cast("string")))
    return rows.withColumns({
        "names": F.when(F.col("_to").isNotNull(), F.concat(F.array("_to"), F.slice("names", 2, F.size("names")))).otherwise(F.col("names")),
        "ini": F.when(F.col("_to").isNotNull(), F.concat(F.substring("_to", 1, 1), F.expr("substring(ini, 2)"))).otherwise(F.col("ini")),
        "misspelt": F.col("_to").isNotNull(),
    }).drop("_given", "_to", "_in")


def corrected_surnames(names: DataFrame, typo: float) -> DataFrame:
    """``names`` with ``block``: the surname a row is decided under.

    A row goes to a more frequent surname a typing error away if someone there has the same first letter and the
    place does not speak against it, or the same given name or initials, and if no more rows have its own surname
    than misspellings are to be expected of the other, times what place and given name say (``EVIDENCE``). The
    candidate with the same place, then the best given name, then the most frequent, wins.
    """
    counts = stage(names.groupBy("kind", "surname").agg(F.count("*").alias("n")))
    pairs = stage(near_words(counts, ["kind"], "surname").where(f"mine <= {max(TAKEN)} + {typo * EVIDENCE[0]} * n"))
    letter = F.when(F.col("kind") == "g", F.col("ini")).otherwise(F.lower(F.substring("ini", 1, 1)))
    given = F.when(F.col("kind") == "g", F.col("ini")).when(F.size("names") > 0, F.col("names")[0]).when(F.length("ini") > 1, F.lower("ini"))
    letters = F.when((F.col("kind") == "p") & (F.length("ini") > 1), F.lower("ini"))
    rows = names.withColumns({"_letter": letter, "_given": F.coalesce(given, F.lit("?"))})
    there = stage(rows.select("kind", F.col("surname").alias("to"), "_letter", F.explode(F.array_distinct(F.array("_given", F.coalesce(letters, F.lit("?"))))).alias("_given"), "place").distinct())
    same_place = there.where("place != ''").select("kind", "to", "_letter", "place").distinct().withColumn("_same", F.lit(1))
    some = there.select("kind", "to", "_letter").distinct().withColumn("_some", F.lit(1))
    named = there.where("_given != '?'").select("kind", "to", "_given").distinct().withColumn("_named", F.lit(1))
    unknown = there.where("place = ''").select("kind", "to", "_letter").distinct().withColumn("_unknown", F.lit(1))
    scored = touched(rows, ["kind", "surname"], counts, pairs).where("_in").drop("_in").join(pairs, ["kind", "surname"])
    for side, on in ((same_place, ["kind", "to", "_letter", "place"]), (some, ["kind", "to", "_letter"]), (named, ["kind", "to", "_given"]),
                     (unknown, ["kind", "to", "_letter"])):
        scored = scored.join(side, on, "left")
    hit = lambda c: F.coalesce(F.col(c), F.lit(0))
    fits = F.when(hit("_same") == 1, 4).when((hit("_some") == 1) & (F.col("place") == ""), 2).when(hit("_named") == 1, 2).when(
        hit("_unknown") == 1, 1).otherwise(0)
    level = F.when(F.col("_fits") == 4, F.when(hit("_named") == 1, 0).otherwise(1)).when(F.col("_fits") == 2, 2).otherwise(3)
    expected = F.array(*map(F.lit, TAKEN))[level] + typo * F.col("n") * F.array(*map(F.lit, EVIDENCE))[level]
    short = F.greatest(F.length("surname"), F.length("to")) < TELLING  # a swap in a short word tells less: place and given name must agree
    best = scored.withColumn("_fits", fits).where("_fits > 0").where((F.col("mine") <= expected) & (~short | (level == 0))).groupBy("name_id").agg(
        F.max_by("to", F.struct(F.col("_fits") + hit("_named"), "n", "to")).alias("block"))
    moved = stage(names.join(best, "name_id", "left").withColumn("block", F.coalesce("block", "surname")))
    # where all rows of a surname have moved on, so do those that were sent to it
    onward = stage(moved.groupBy("kind", "surname").agg(F.max("block").alias("_max"), F.min("block").alias("_min")).where(
        "_max = _min and _max != surname").select("kind", F.col("surname").alias("block"), F.col("_max").alias("_on")))
    marked = touched(moved, ["kind", "block"], moved.groupBy("kind", "block").agg(F.count("*").alias("n")), onward)
    sent = marked.where("_in").join(onward, ["kind", "block"]).withColumn("block", F.col("_on")).drop("_on", "_in")
    return sent.unionByName(marked.where("not _in").drop("_in"))


def measured_rates(names: DataFrame, corrected: DataFrame) -> Rates:
    """The rates that the table itself tells, from one row of sums; ``corrected`` is ``names`` with given names put right."""
    person, given = F.col("kind") == "p", F.size("names") > 0
    seen = names.agg(F.count_if(person).alias("people"), F.count_if(person & ~given).alias("letters"), F.count("*").alias("rows"), F.count_if(F.col("place") == "").alias("nowhere")).first()
    typo = corrected.agg(F.count_if(F.col("misspelt")).alias("wrong"), F.count_if(person & given).alias("given")).first()
    prior = Rates()
    share = lambda hits, of, at: (hits + SEEN * at) / (of + SEEN)
    return Rates(initial=share(seen.letters, seen.people, prior.initial), missing=share(seen.nowhere, seen.rows, prior.missing), typo=share(typo.wrong, typo.given, prior.typo))


def with_frequency(names: DataFrame, records: DataFrame | None) -> DataFrame:
    """``names`` with ``weight``: how often the packed author fields of ``records`` have the spelling, shared by the rows that have it; 1 at least."""
    if records is None:
        return names.withColumn("weight", F.lit(1.0))
    key = digest(F.regexp_replace(F.trim("val"), r"\s+", " "))
    seen = split_packed(records.select("author").withColumn("_id", F.lit(0)), "_id", {"author": "names"}).groupBy(key.alias("_spelling")).agg(F.count("*").alias("_times"))
    rows = names.withColumn("_spelling", digest(F.col("author")))
    shared = rows.groupBy("_spelling").agg(F.count("*").alias("n")).join(seen, "_spelling").select("_spelling", "n", "_times")
    got = join_lookup(rows, stage(shared.withColumn("_rows", F.col("n"))), ["_spelling"], how="left")
    return got.withColumn("weight", F.greatest(F.lit(1.0), F.coalesce(F.col("_times") / F.col("_rows"), F.lit(1.0)))).drop("_spelling", "_times", "_rows")


def link_names(df: DataFrame, records: DataFrame | None = None, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(name_id, entity_id): every spelling with the smallest ``name_id`` of its entity.

    ``df`` has name_id (unique), author, affiliation; the frequency of a spelling is that in the packed ``author`` of
    ``records`` where they are given. ``nicknames`` maps short forms of given names to full ones (default ``NICKNAMES``).
    Rows without an author are their own entity. Unreadable names (no letters) are linked with none. Empty tables
    give no rows.
    """
    read = stage(settle_order(read_names(df)))
    corrected = stage(corrected_given(read))
    rates = measured_rates(read, corrected)
    blocks = stage(with_frequency(corrected_surnames(corrected.drop("misspelt"), rates.typo), records))
    short = F.create_map(*[F.lit(x) for pair in sorted((NICKNAMES if nicknames is None else nicknames).items()) for x in pair]) if nicknames != {} else F.create_map().cast("map<string,string>")
    given = F.when((F.col("kind") == "p") & (F.size("names") > 0), F.col("names")[0])
    first = F.coalesce(short[given], given, F.lit(""))
    letters = F.when(first != "", F.concat(F.substring(first, 1, 1), F.expr("substring(ini, 2)"))).otherwise(F.col("ini"))
    rows = blocks.withColumns({"first": first, "ini": letters}).withColumn("part", F.when(F.col("kind") == "g", F.col("ini")).otherwise(F.lower(F.substring("ini", 1, 1))))
    totals = rows.groupBy(F.xxhash64("kind", "block").alias("_block")).agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    rows = join_lookup(rows.withColumn("_block", F.xxhash64("kind", "block")), stage(totals), ["_block"]).drop("_block")

    def solve(rows: list[dict]) -> list[tuple[int, int]]:
        for r in rows:
            r["names"] = list(r["names"]) if r["names"] is not None else []
        kind, block, total = rows[0]["kind"], rows[0]["block"], rows[0]["total"]
        numbers = _attribute_groups(rows, total, rates) if kind == "g" else list(range(len(rows))) if not block else attribute(rows, total, rates)
        ids = [r["name_id"] for r in rows]
        least: dict[int, int] = {}
        for i, k in zip(ids, numbers):
            least[k] = min(least.get(k, i), i)
        return [(i, least[k]) for i, k in zip(ids, numbers)]

    key = ["kind", "block", "part"]

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, out = None, [], []
        for frame in frames:
            for r in frame.to_dict("records"):
                if rows and tuple(r[k] for k in key) != at:
                    out += solve(rows)
                    rows = []
                at = tuple(r[k] for k in key)
                rows.append(r)
            if out:
                yield pd.DataFrame(out, columns=["name_id", "entity_id"])
                out = []
        if rows:
            yield pd.DataFrame(solve(rows), columns=["name_id", "entity_id"])

    # surnames are many and small: walking sorted partitions spares the cost of a frame for each
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "name_id")
    linked = ordered.mapInPandas(decide, "name_id long, entity_id long")
    blank = df.where("author is null").select("name_id", F.col("name_id").alias("entity_id"))
    return linked.unionByName(blank)


def linked_pairs(df: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(name_id_a, name_id_b), a < b, of one entity."""
    links = stage(link_names(df, records))
    a = links.withColumnRenamed("name_id", "name_id_a")
    b = links.withColumnRenamed("name_id", "name_id_b")
    return a.join(b, "entity_id").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
