"""Abusive, hateful and sexual content by non-negative positive-unlabelled learning.

Human labels name some documents, not the sentences that are meant, and they are neither
complete nor free of mistakes. Per category a linear classifier over hashed words, word pairs,
word triples and letter n-grams of a sentence is trained by the non-negative risk estimator

    R = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

from the sentences that the labelled documents share (found by how much their words are
over-represented there, then re-chosen by the classifier itself) and unlabelled sentences,
among which further positives hide. The class prior is estimated from the tails of the two
score distributions. A document has the score of its most telling sentence.

Training uses bounded samples (``LABELLED``, ``UNLABELLED`` documents); scoring reads every
document whole, in one narrow pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import spread

CATEGORIES = ("abusive", "hateful", "sexual")
#: Bounds of the training sample, in documents: labelled positives of a category (and labelled with none), and unlabelled.
LABELLED, UNLABELLED = 2000, 6000
#: Score from which a category holds.
HOLDS = 0.3
#: Log-odds from which an unlabelled sentence joins the positives; weight of sentences of documents labelled not so.
SURE, DENIED = 2.0, 3.0
#: Hashed weights per category; distinct words a worker remembers.
WEIGHTS, CACHE = 1 << 18, 400_000

# Letters of other scripts and signs that stand in for Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "х": "x", "у": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
})
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"})

_CJK = re.compile(r"([㐀-鿿])")
_INVISIBLE = re.compile("[­​-‏⁠️﻿]")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*·]{1,2}){2,}[^\W\d_](?![^\W\d_])")
_MASKED = re.compile(r"(?=\S*[^\W\d_])\S*[@$013457*!|€]\S*")
_INNER = re.compile(r"(?<=[^\W\d_])[-'’*.·_~]+(?=[^\W\d_])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W\d_]+|[.!?;。！？；]+|\n")
_END = re.compile(r"[.!?;。！？；\n]")
#: A piece that stands for a line break, and pieces that begin or end with a letter alone.
_LINE = "\x00\x00"
_SPACED_LINE = f" {_LINE} "
_BEGINS = re.compile(r"^[.\-_*·]?[^\W\d_](?![^\W\d_])")
_ENDS = re.compile(r"(?<![^\W\d_])[^\W\d_][.\-_*·]?$")


def plain_text(text: str) -> str:
    """Lower case, look-alikes and signs undone, spelt-out words joined, invisible characters and accents dropped."""
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        if _CJK.search(text):
            text = _CJK.sub(r" \1 ", text)
    text = _SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]), text)
    text = _MASKED.sub(lambda m: m[0] if m[0].rstrip(".,;:!?)").isalpha() or not re.search(r"[^\W\d_].*[@$013457*!|€].*[^\W\d_]", m[0]) else m[0].translate(SIGNS), text)
    return _LONG.sub(r"\1", _INNER.sub("", text))


def tokens_of(text: str) -> list[str]:
    """Words and sentence ends of the plain text."""
    return _WORD.findall(plain_text(text))


def _code(word: str) -> int:
    return zlib.crc32(word.encode())


def _grams(word: str) -> list[int]:
    padded = f"^{word}$"
    return [zlib.crc32(b"g" + padded[i : i + 4].encode()) % WEIGHTS for i in range(max(1, len(padded) - 3))]


class Tokens:
    """Words of texts as numbers. Every piece between white space is read once; only its words are looked up again."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.is_end: list[bool] = []
        self.pieces: dict[str, int] = {}
        self.listed: list[tuple[list[int], int]] = []  # the words of a piece; 1 if it may begin, 2 if it may end letters spelt out
        self.table: tuple | None = None

    def number(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.words[word] = len(self.is_end)
            self.is_end.append(bool(_END.match(word)))
        return n

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = self.pieces[piece] = len(self.listed)
            words = ["\n"] if piece == _LINE else tokens_of(piece)
            bare = _CJK.sub(r" \1 ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", piece.lower()))).strip()
            self.listed.append(([self.number(w) for w in words], bool(_BEGINS.search(bare)) * 1 | bool(_ENDS.search(bare)) * 2))
            self.table = None
        return n

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, owners) of the texts, in order; what ``tokens_of`` gives, text by text."""
        stream, counts = [], []
        for text in texts:
            pieces = (text.replace("\n", _SPACED_LINE) if "\n" in text else text).split()
            stream += pieces
            counts.append(len(pieces))
        numbers = np.asarray([self._piece(p) for p in stream], np.int64)
        if self.table is None:
            sizes = np.asarray([len(w) for w, _ in self.listed], np.int64)
            self.table = (sizes, np.cumsum(sizes) - sizes, np.asarray([x for w, _ in self.listed for x in w], np.int64), np.asarray([f for _, f in self.listed], np.int64))
        sizes, firsts, flat, marks = self.table
        owner = np.repeat(np.arange(len(texts)), counts)
        mark = marks[numbers] if len(numbers) else numbers
        spelt = (mark[:-1] & 2 > 0) & (mark[1:] & 1 > 0) & (owner[1:] == owner[:-1])
        slow = np.zeros(len(texts), bool)
        slow[owner[:-1][spelt]] = True  # letters with spaces between: these texts are read as a whole
        fast = ~slow[owner] if len(owner) else slow[:0]
        n = sizes[numbers[fast]] if len(numbers) else numbers
        at = np.repeat(firsts[numbers[fast]] - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(numbers) else numbers
        words, owners = [flat[at]], [np.repeat(owner[fast], n)]
        for i in np.flatnonzero(slow):
            words.append(np.asarray([self.number(w) for w in tokens_of(texts[i])], np.int64))
            owners.append(np.full(len(words[-1]), i))
        words, owners = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return words[order], owners[order]


class Corpus:
    """Sentences of texts as arrays: codes of words, bounds of sentences, owners."""

    def __init__(self, texts: list[str]) -> None:
        tokens = Tokens()
        ids, owner = tokens.of(texts)
        names, end = list(tokens.words), np.asarray(tokens.is_end, bool)
        word = ~end[ids]
        cut = np.zeros(len(ids), np.int64)
        cut[1:] = (~word[:-1]) | (owner[1:] != owner[:-1])
        _, sentence = np.unique(np.cumsum(cut)[word], return_inverse=True)
        used, self.ids = np.unique(ids[word], return_inverse=True)
        self.listed, self.sentence = [names[i] for i in used], sentence
        n = np.bincount(sentence) if len(sentence) else np.zeros(0, np.int64)
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        self.owner = owner[word][self.starts] if len(n) else np.zeros(0, np.int64)
        self.code = np.asarray([_code(w) for w in self.listed], np.int64)

    @cached_property
    def kinds(self) -> np.ndarray:
        """A number for each sentence; equal numbers have the same words in the same order."""
        c = self.code[self.ids] if len(self.ids) else self.ids
        offset = np.arange(len(c)) - self.starts[self.sentence]
        mixed = ((c * 2_654_435_761 + offset * 97_531) % 4_294_967_291 * 40_503 + (c ^ (offset * 7_919)) % 65_521) % (1 << 51)
        first = np.bincount(self.sentence, mixed % (1 << 25), len(self.ends)).astype(np.int64)
        second = np.bincount(self.sentence, mixed >> 25, len(self.ends)).astype(np.int64)
        return np.unique(first * 1_000_003 + second * 31 + (self.ends - self.starts), return_inverse=True)[1]

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, hashed feature), each pair once."""
        s, f = self.features
        keys = np.unique(self.owner[s] * WEIGHTS + f)
        return keys // WEIGHTS, keys % WEIGHTS

    @cached_property
    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, hashed feature) of every word, pair, triple."""
        c, s = self.code[self.ids] if len(self.ids) else self.ids, self.sentence
        two, three = s[1:] == s[:-1], s[2:] == s[:-2]
        pair, triple = pair_codes(c), triple_codes(c)
        return (np.concatenate([s, s[1:][two], s[2:][three]]),
                np.concatenate([c % WEIGHTS, pair[two], triple[three]]))


def pair_codes(c: np.ndarray) -> np.ndarray:
    return (c[:-1] * 1_000_003 + c[1:]) % 2_147_483_647 % WEIGHTS


def triple_codes(c: np.ndarray) -> np.ndarray:
    return ((c[:-2] * 1_000_003 + c[1:-1]) % 2_147_483_647 * 31 + c[2:] * 7) % 2_147_483_629 % WEIGHTS


@dataclass
class ToxicityModel:
    """Weights and intercept per category."""

    weights: np.ndarray
    bias: np.ndarray
    cache: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "cache": {}}

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts, categories): the probability of the most telling sentence; 0 without words."""
        out = np.zeros((len(texts), len(self.bias)))
        cache = self.cache
        if "tokens" not in cache or len(cache["tokens"].pieces) > CACHE:
            cache.update(tokens=Tokens(), code=np.zeros(0, np.int64), own=np.zeros((0, len(self.bias))))
        ids, owner = cache["tokens"].of(texts)
        if not len(ids):
            return out
        new = list(cache["tokens"].words)[len(cache["code"]):]
        if new:
            ends = cache["tokens"].is_end[len(cache["code"]):]
            code = [-1 if end else _code(w) for w, end in zip(new, ends)]
            own = [np.zeros(len(self.bias)) if end else self.weights[c % WEIGHTS] + self.weights[_grams(w)].mean(0) for w, c, end in zip(new, code, ends)]
            cache.update(code=np.concatenate([cache["code"], np.asarray(code, np.int64)]), own=np.concatenate([cache["own"], np.stack(own)]))
        codes, score = cache["code"][ids], cache["own"][ids]
        word = codes >= 0
        cut = np.zeros(len(codes), np.int64)
        cut[1:] = (~word[:-1]) | (owner[1:] != owner[:-1])
        sentence = np.cumsum(cut)
        two = word[1:] & word[:-1] & (sentence[1:] == sentence[:-1])
        score[1:][two] += self.weights[pair_codes(codes)[two]]
        if len(codes) > 2:
            three = two[1:] & two[:-1]
            score[2:][three] += self.weights[triple_codes(codes)[three]]
        starts = np.flatnonzero(np.concatenate([[1], cut[1:]]))
        total = np.add.reduceat(score, starts, axis=0)
        n = np.add.reduceat(word.astype(int), starts)
        logit = self.bias + total / np.sqrt(np.maximum(n, 1))[:, None]
        said = n > 0
        np.maximum.at(out, owner[starts][said], 1 / (1 + np.exp(-np.clip(logit[said], -50, 50))))
        return out


def boilerplate(corpus: Corpus, others: np.ndarray, share: float = 0.003) -> np.ndarray:
    """Whether a sentence stands word for word in more than ``share`` of the other documents (and in five)."""
    codes = corpus.code[corpus.ids] if len(corpus.ids) else corpus.ids
    offset = np.arange(len(codes)) - corpus.starts[corpus.sentence]
    mixed = (codes * 2_654_435_761 + offset * 97_531) % 4_294_967_291
    key = np.bincount(corpus.sentence, mixed, len(corpus.ends)).astype(np.int64)
    pairs = np.unique(np.stack([key[others[corpus.owner]], corpus.owner[others[corpus.owner]]], 1), axis=0)
    seen, times = np.unique(pairs[:, 0], return_counts=True)
    common = seen[times >= max(5, share * others.sum())]
    return np.isin(key, common)


def telling_words(corpus: Corpus, s: np.ndarray, f: np.ndarray, positive: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Per sentence, the mean log-odds of its features to stand in positive rather than in other documents.

    The document itself does not count; what no other document has tells little. Short sentences tell less.
    """
    d, feature = corpus.cells
    p = np.bincount(feature[positive[d]], minlength=WEIGHTS)
    u = np.bincount(feature[others[d]], minlength=WEIGHTS)
    odds = np.log(((p - 1).clip(0) + 0.1) / (positive.sum() + 1)) - np.log((u + 0.5) / max(1, others.sum()))
    odds = np.clip(odds, -2, 6)
    odds[(u == 0) & (p < 2)] = 1.0
    n = np.bincount(s, minlength=len(corpus.ends))
    return np.bincount(s, odds[f], len(corpus.ends)) / np.maximum(n, 1) * np.minimum(1, n / 12)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the tails above a threshold."""
    best = 1.0
    for q in np.linspace(0.1, 0.7, 13):
        t = np.quantile(p, q)
        best = min(best, ((u >= t).mean() + 1 / len(u)) / max((p >= t).mean(), 1e-9))
    return float(best)


def train_category(corpus: Corpus, marks: np.ndarray, rounds: int = 3, steps: int = 30, rate: float = 0.6, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """(weights, bias) of one category; ``marks`` of the documents: 1 labelled so, 0 labelled not so, -1 unlabelled.

    In each turn the sentences that stand for the positive documents are chosen anew, and unlabelled sentences
    that the classifier is sure of join them; sentences of documents labelled not so never do.
    """
    positive, others = marks == 1, marks != 1
    if not positive.any() or not others.any():
        return np.zeros(WEIGHTS), -9.0
    s, f = corpus.features
    often = np.bincount(corpus.cells[1], minlength=WEIGHTS) >= 2  # what stands in one document only can't be learned from
    s, f = s[often[f]], f[often[f]]
    listed = [_grams(w) for w in corpus.listed]
    g_owner = np.repeat(np.arange(len(listed)), [len(g) for g in listed])
    g_feat = np.asarray([x for g in listed for x in g], np.int64)
    g_share = 1 / np.asarray([len(g) for g in listed], float)[g_owner]
    n = len(corpus.ends)
    # sentences with the same words have the same score: what is summed over words is so once for them
    kind = corpus.kinds
    shown = np.zeros(n, bool)
    shown[np.unique(kind, return_index=True)[1]] = True
    kinds = int(kind.max()) + 1
    once = shown[s]
    s, f = kind[s[once]], f[once]
    said = shown[corpus.sentence]
    words, of = corpus.ids[said], kind[corpus.sentence[said]]
    scale = np.zeros(kinds)
    scale[kind] = 1 / np.sqrt(corpus.ends - corpus.starts)
    inside, denied = positive[corpus.owner], (marks == 0)[corpus.owner]
    common = boilerplate(corpus, others)
    able = inside & ~common
    chosen = np.where(able, telling_words(corpus, *corpus.features, positive, others), 0)
    weights, bias, prior = np.zeros(WEIGHTS), -9.0, 0.01

    def logits(weights: np.ndarray, bias: float) -> np.ndarray:
        own = np.bincount(g_owner, weights[g_feat] * g_share, len(listed))
        return (bias + (np.bincount(s, weights[f], kinds) + np.bincount(of, own[words], kinds)) * scale)[kind]

    for turn in range(rounds):
        top = np.full(len(positive), -np.inf)
        np.maximum.at(top, corpus.owner[able], chosen[able])
        best = able & (chosen >= top[corpus.owner] - 1e-9)
        pos = (best & (chosen > 0.6)) | (able & (chosen > 2.0)) if turn == 0 else (best & (chosen > -1)) | (able & (chosen > 0))
        sure = np.zeros(n, bool) if turn == 0 else ~inside & ~denied & ~common & (chosen > SURE)
        if not pos.any():
            break
        w_p = pos + 0.5 * sure
        w_p = w_p / w_p.sum()
        unl = ~inside & ~sure
        w_u = unl * np.where(denied, DENIED, 1.0)
        w_u = w_u / w_u.sum()
        weights, bias, moment, bias_moment = np.zeros(WEIGHTS), -2.0, np.full(WEIGHTS, 1e-12), 1e-12
        for _ in range(steps):
            z = logits(weights, bias)
            sig = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            soft = np.logaddexp(0, z)
            negative_risk = (w_u * soft).sum() - prior * (w_p * soft).sum()
            negative = w_u * sig - prior * w_p * sig
            # a negative estimate means overfitting: then the step undoes that part alone
            grad = (prior * w_p * (sig - 1) + negative if negative_risk >= 0 else -negative) / prior
            per = np.bincount(kind, grad, kinds) * scale
            own = np.bincount(words, per[of], len(listed))
            gw = np.bincount(f, per[s], WEIGHTS) + np.bincount(g_feat, own[g_owner] * g_share, WEIGHTS) + decay * weights
            moment += gw**2
            bias_moment += grad.sum() ** 2
            weights -= rate * gw / np.sqrt(moment)
            bias -= rate * grad.sum() / np.sqrt(bias_moment)
        chosen = logits(weights, bias)
        prior = float(np.clip(estimate_prior(chosen[pos], chosen[~inside]), 5e-4, 0.2))
    return weights, bias


def train(texts: list[str], marks: np.ndarray) -> ToxicityModel:
    """A model from documents; ``marks`` (documents, categories) as in ``train_category``."""
    corpus = Corpus(texts)
    parts = [train_category(corpus, marks[:, k]) for k in range(marks.shape[1])]
    return ToxicityModel(np.stack([w for w, _ in parts], 1).astype(np.float32), np.asarray([b for _, b in parts]))


def training_sample(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple[list[str], np.ndarray]:
    """Texts and marks of at most ``labelled`` documents per category and as many labelled with none, and of
    ``unlabelled`` others, chosen by hash.

    Several labels of one document count as positive if half of those given are. Labels without a document and
    null labels count for nothing.
    """
    agreed = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in CATEGORIES])
    known = agreed.select("doc_id", *[F.when(F.col(c) >= 0.5, 1).when(F.col(c) < 0.5, 0).otherwise(-1).alias(c) for c in CATEGORIES])
    first = lambda df, bound: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    picked = [first(known.where(f"{c} = 1"), labelled) for c in CATEGORIES] + [first(known.where(" and ".join(f"{c} <> 1" for c in CATEGORIES)), labelled)]
    others = first(documents.select("doc_id").join(known, "doc_id", "left_anti").select("doc_id", *[F.lit(-1).alias(c) for c in CATEGORIES]), unlabelled)
    chosen = reduce(DataFrame.unionByName, [*picked, others]).distinct()  # bounded, so is its broadcast
    texts = documents.where("length(trim(text)) > 0").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    ordered = sorted({(r.doc_id, r.text): r for r in texts.collect()}.values(), key=lambda r: (r.doc_id, r.text))
    return [r.text for r in ordered], np.asarray([[r[c] for c in CATEGORIES] for r in ordered]).reshape(-1, len(CATEGORIES))


def score_documents(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): probabilities; 0 for null, empty and blank texts."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [model.scores(frame["text"].iloc[i : i + 1000].tolist()) for i in range(0, len(frame), 1000)]
            yield frame[["doc_id", "source"]].assign(**dict(zip(CATEGORIES, np.concatenate(got).T if got else np.zeros((3, 0)))))

    slim = spread(documents.select("doc_id", "source", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    return slim.mapInPandas(run, "doc_id long, source string, " + ", ".join(f"{c} double" for c in CATEGORIES))


def found_categories(scores: DataFrame, at: float = HOLDS) -> DataFrame:
    """(doc_id, category): one row for each category at or above ``at``."""
    return scores.select("doc_id", F.explode(F.array(*[F.when(F.col(c) >= at, F.lit(c)) for c in CATEGORIES])).alias("category")).where("category is not null")


def source_rates(scores: DataFrame, at: float = HOLDS) -> DataFrame:
    """(source, documents, and per category the share of documents at or above ``at``); null sources are one row."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), *[F.avg((F.col(c) >= at).cast("int")).alias(f"{c}_rate") for c in CATEGORIES])
