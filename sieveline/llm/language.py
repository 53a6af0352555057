"""Document language with confidence, also of each segment of a mixed text.

A linear-chain conditional random field labels every word with a language: affix, letter
n-gram, whole-word and lexicon features give the emissions, transitions between neighbouring words
and the first language are learned, and the forward-backward algorithm gives each word its marginals. A sentence has
the language of the greatest summed marginal; neighbouring sentences in one language are one
segment. The model is trained here, on a bounded sample of the rows that carry a label; the
labels may be wrong: a first model trained on them relabels the sample sentence by sentence,
and the second model, with its transitions, is trained on that.

Inference is one narrow pass over whole texts, no shuffle; the model has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import PLACEHOLDERS, bare
from sieveline.session import spread, stage

LANGS = ("en", "de", "fr", "es", "pt", "zh")
# How labels name these languages, lower case, before any hyphen or underscore.
LABELS = {
    "en": ("en", "eng", "english", "englisch", "anglais"), "de": ("de", "deu", "ger", "german", "deutsch", "allemand"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"), "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"), "zh": ("zh", "zho", "chi", "chinese", "中文", "cmn", "mandarin"),
}
# Usual function words of these languages. Chinese has its own script.
LEXICON = {
    "en": "the of and to in is was were are with for that this by from on at as be or an not have has which these between we it but than",
    "de": "der die das und ist war wurde wurden den dem des ein eine einer eines mit für von im zu auf bei nicht sich als auch nach wird werden sind oder",
    "fr": "le la les des du de et est une un dans pour par sur avec que qui ont été cette ces aux au ou ne pas nous sont entre plus il",
    "es": "el la los las de del y es una un en para por con que se fue fueron no al lo su sus como más o entre este esta son han",
    "pt": "o a os as de do da dos das e é uma um em para por com que se foi foram não ao na no nas nos mais ou entre são os seus",
}
#: Labelled rows per language that the model is fitted on: the documented bound of the sample.
TRAIN_ROWS = 220
#: Hashed feature space; the model is this many rows of len(LANGS) weights.
FEATURES = 1 << 16
#: Rows worked on together, and distinct words a worker remembers.
CHUNK, CACHE = 2000, 400_000
#: Least probability, by its own words alone, of a line of two words that is taken for a sentence of its own.
LINE = 0.85
#: Words after which a long text of the training sample is cut at the next sentence; texts are labelled as one chain.
BLOCK = 150

_CJK = re.compile(r"([㐀-鿿豈-﫿]|[。！？，；：])")
_END = re.compile(r"(?:[.!?…]+[\"'”’)\]»]*|[。！？])$")
_LETTERS = re.compile(r"[^\W\d_]+")
_BREAK = "\x00"
_LEXICON = {w: [f"#{lang}" for lang, words in LEXICON.items() if w in words.split()] for words in LEXICON.values() for w in words.split()}


def label_language(col: Column) -> Column:
    """The language a label names: one of ``LANGS``, ``other`` for another name, null for none."""
    text = F.regexp_extract(F.lower(F.trim(col)), r"^([^-_\s(]*)", 1)
    known = reduce(lambda acc, kv: acc.when(text.isin(*kv[1]), kv[0]), LABELS.items(), F.when(
        F.coalesce(text, F.lit("")).isin("", "und", "unknown", "unk", "none", "null", "nan", "na", "n/a", "mul", "zxx", "mis", "?"), F.lit(None).cast("string")))
    return known.otherwise("other")


def words_of(text: str) -> list[str]:
    """Tokens of a text: words as they stand, each ideograph alone, and a mark for each line break."""
    if "\n" in text or "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\n", f" {_BREAK} ")
    if _CJK.search(text):
        text = _CJK.sub(r" \1 ", text)
    return text.split()


def features_of(token: str) -> list[int]:
    """Hashed affixes, n-grams, the word itself and the lexicons it stands in; [] without letters."""
    out: list[str] = []
    for word in _LETTERS.findall(token.lower()):
        if "㐀" <= word[0] <= "鿿":
            out += ["#zh", word]
            continue
        padded = f"^{word}$"
        out += _LEXICON.get(word, ())
        out += [f"w{word}", f"p{word[:2]}", f"p{word[:3]}", f"s{word[-2:]}", f"s{word[-3:]}", f"s{word[-4:]}"]
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
        out += [f"c{c}" for c in set(word) if not "a" <= c <= "z"]
    return [zlib.crc32(f.encode()) % FEATURES for f in out]


@dataclass
class LanguageModel:
    """Emission weights per hashed feature, and transition and start scores."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    cache: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "transitions": self.transitions, "start": self.start, "cache": {}}

    def emissions(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, flags) of tokens; flag 1 ends a sentence, 2 breaks before, 4 has no letters."""
        cache = self.cache
        if "ids" not in cache or len(cache["ids"]) > CACHE:
            cache.update(ids={}, rows=[], flags=[], table=None)
        ids, rows, flags = cache["ids"], cache["rows"], cache["flags"]
        numbers = [ids.get(t, -1) for t in tokens]
        if -1 in numbers:
            for t in {t for t, n in zip(tokens, numbers) if n < 0}:
                ids[t] = len(rows)
                f = features_of(t)
                rows.append(self.weights[f].sum(0) / len(f) ** 0.5 if f else np.zeros(len(LANGS), np.float32))
                flags.append(bool(_END.search(t)) * 1 | (t in (_BREAK, "=", "/") or t[0] == "[") * 2 | (not f) * 4)
            numbers = [ids[t] for t in tokens]
            cache["table"] = None
        if cache["table"] is None:
            cache["table"] = (np.asarray(rows, np.float32), np.asarray(flags, np.uint8))
        table, marks = cache["table"]
        return table[numbers], marks[numbers]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray,
                     pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of each word, sequences laid end to end; with ``pairs`` also expected transition counts.

    All sequences advance together: at step t the ones that are longer than t, longest first.
    """
    rank = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[rank]
    steps = int(sorted_lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[rank]
    e = np.exp(scores - scores.max(1, keepdims=True))
    a_matrix = np.exp(transitions)
    alpha = np.empty_like(e)
    for t in range(steps):
        at = first[: active[t]] + t
        now = e[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ a_matrix)
        alpha[at] = now / now.sum(1, keepdims=True)
    beta = np.ones_like(e)
    counts = np.zeros_like(transitions) if pairs else None
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        back = e[at + 1] * beta[at + 1]
        if pairs:
            joint = alpha[at][:, :, None] * a_matrix[None] * back[:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        now = back @ a_matrix.T
        beta[at] = now / now.sum(1, keepdims=True)
    marginals = alpha * beta
    return marginals / marginals.sum(1, keepdims=True), counts


def sentence_starts(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Index of the first word of each sentence over sequences laid end to end."""
    start = np.zeros(len(flags), bool)
    start[1:] = (flags[:-1] & 1) > 0
    start |= (flags & 2) > 0
    start[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    return np.flatnonzero(start)


def blocks_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lengths of the blocks that training texts are cut into: at the first sentence after every ``BLOCK`` words."""
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, starts, side="right")
    number = owner * (int(lengths.max()) // BLOCK + 1) + (starts - (ends - lengths)[owner]) // BLOCK
    return np.diff([*starts[np.flatnonzero(np.diff(number, prepend=-1))], ends[-1]])


def segments(model: LanguageModel, texts: list[str]) -> list[list[tuple[str, float]]]:
    """(language, confidence) of each segment of each text; [] for a text without letters."""
    return languages(model, texts)[0]


def languages(model: LanguageModel, texts: list[str]) -> tuple[list[list[tuple[str, float]]], list[tuple[str, float] | None]]:
    """(language, confidence) of each segment of each text, and of each text as a whole; [] and None for a text without letters."""
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    whole: list[tuple[str, float] | None] = [None] * len(texts)
    tokens, lengths, owners = [], [], []
    for i, t in enumerate(texts):
        w = words_of(t)
        if w:
            tokens += w
            lengths.append(len(w))
            owners.append(i)
    if not tokens:
        return out, whole
    sizes = np.asarray(lengths)
    scores, flags = model.emissions(tokens)
    starts = sentence_starts(flags, sizes)
    marginals, _ = forward_backward(scores, sizes, model.transitions, model.start)
    telling = (flags & 4) == 0
    sums = np.add.reduceat(marginals * telling[:, None], starts, axis=0)
    words = np.add.reduceat(telling.astype(np.int32), starts)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    opens = (flags[starts] & 2 > 0) | (np.diff(owner, prepend=-1) > 0)
    line = opens & np.append(opens[1:], True)  # a sentence that is all of its line
    alone = np.add.reduceat(scores * telling[:, None], starts, axis=0).astype(np.float64)
    alone = np.exp(alone - alone.max(1, keepdims=True))
    alone /= alone.sum(1, keepdims=True)
    keep = words > 0
    sums, words, owner, alone = sums[keep], words[keep], owner[keep], alone[keep]
    line = line[keep] & (words == 2) & (alone.max(1) >= LINE)
    best = np.where(line, alone.argmax(1), sums.argmax(1))
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(owner)]):
        langs, n, s = best[a:b], words[a:b], sums[a:b]
        total = s.sum(0)
        most = int(total.argmax())
        whole[owners[owner[a]]] = (LANGS[most], float(total[most] / n.sum()))
        if (langs == langs[0]).all():
            out[owners[owner[a]]] = [(LANGS[langs[0]], float(total[langs[0]] / n.sum()))]
            continue
        langs, own = langs.copy(), line[a:b]
        for k in range(b - a):  # a word or two are no sentence of their own, but two words alone in their line
            if n[k] < 3 and not own[k] and LANGS[langs[k]] != "zh":
                langs[k] = langs[k - 1] if k else langs[k + 1]
        runs, k = [], 0
        while k < b - a:
            j = k
            while j < b - a and langs[j] == langs[k]:
                j += 1
            runs.append((LANGS[langs[k]], float(s[k:j, langs[k]].sum() / n[k:j].sum())))
            k = j
        out[owners[owner[a]]] = runs
    return out, whole


def train(texts: list[str], labels: list[str], rounds: int = 24, rate: float = 0.4, decay: float = 1e-4) -> LanguageModel:
    """A model from labelled texts, labels possibly wrong. Deterministic.

    Phase 0 learns from every word for itself: a wrong label then counts no more than its share of the words,
    where a chain would be pulled by it as a whole. Phase 1 trains the chain on the sentences relabelled by phase 0.
    """
    tokens, lengths, tags = [], [], []
    for t, lang in zip(texts, labels):
        w = words_of(t)
        if w:
            tokens += w
            lengths.append(len(w))
            tags += [LANGS.index(lang)] * len(w)
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    ids = np.asarray([vocabulary[t] for t in tokens])
    listed = [features_of(t) for t in vocabulary]
    owner = np.repeat(np.arange(len(listed)), [len(f) for f in listed])
    feats = np.asarray([x for f in listed for x in f], np.int64)
    share = np.asarray([len(f) or 1 for f in listed], float)[owner] ** -0.5
    sizes, y, k = np.asarray(lengths), np.asarray(tags), len(LANGS)
    stay = np.log(np.full((k, k), 0.002) + np.eye(k) * 0.99)
    model = LanguageModel(np.zeros((FEATURES, k), np.float32), stay, np.zeros(k))
    _, flags = model.emissions(tokens)
    telling, starts = (flags & 4) == 0, sentence_starts(flags, sizes)
    blocks = blocks_of(starts, sizes)
    inner = np.ones(len(ids), bool)
    inner[np.concatenate([[0], np.cumsum(blocks)[:-1]])] = False
    spread = lambda at, values, n: np.stack([np.bincount(at, values[:, c], n) for c in range(k)], 1)
    for phase in (0, 1):
        weights, moment = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
        transitions, start, first = stay.copy(), np.zeros(k), np.bincount(y[~inner], minlength=k)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        for _ in range(rounds):
            emission = spread(owner, weights[feats] * share[:, None], len(listed))[ids]
            if phase == 0:
                p = np.exp(emission - emission.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            else:
                p, pairs = forward_backward(emission, blocks, transitions, start, pairs=True)
                # learned transitions, never quite impossible
                transitions = np.clip(transitions + 0.2 * (seen - pairs) / (seen + pairs + 1), -8.0, 1.0)
                expected = p[~inner].sum(0)
                start = np.clip(start + 0.2 * (first - expected) / (first + expected + 1), -4.0, 1.0)
            residual = -p
            residual[np.arange(len(y)), y] += 1
            residual[~telling] = 0
            per_word = spread(ids, residual, len(listed))
            gradient = spread(feats, per_word[owner] * share[:, None], FEATURES) / len(sizes) - decay * weights
            moment += gradient**2
            weights += rate * gradient / np.sqrt(moment + 1e-12)
        model = LanguageModel(weights.astype(np.float32), transitions, start)
        if phase == 0:  # relabel sentence by sentence
            scores, _ = model.emissions(tokens)
            p, _ = forward_backward(scores, blocks, transitions, model.start)
            y = np.repeat(np.add.reduceat(p * telling[:, None], starts, axis=0).argmax(1), np.diff([*starts, len(ids)]))
    return model


def texts_of(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(src, row_id, label, text) of both tables; placeholders are no text."""
    many = r"^(?:[^\p{L}\p{N}]*[\p{L}\p{N}]){25}"  # more letters than any placeholder has: seen at the start of the text
    part = lambda c: F.when(F.col(c).rlike(many) | ~bare(F.col(c)).isin(*PLACEHOLDERS), F.regexp_replace(F.col(c), r"[\r\n]+", " ") if c == "title" else F.col(c))
    a = spread(records.select("record_id", "title", "abstract", "lang")).select(F.lit("records").alias("src"), F.col("record_id").alias("row_id"), F.col("lang").alias("label"),
                       F.concat_ws("\n", part("title"), part("abstract")).alias("text"))
    b = spread(documents.select("doc_id", "text", "lang")).select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), F.col("lang").alias("label"),
                         F.coalesce("text", F.lit("")).alias("text"))
    return a.unionByName(b)


def training_sample(texts: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """The ``rows`` different labelled texts of each language with the smallest hashes: (text, language).

    Only a share of the hashes is looked at, larger by turns until there are enough texts: copies of one text count
    once, whatever their number. The same table gives the same sample.
    """
    at = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    named = texts.withColumns({"lang": label_language(F.col("label")), "at": at}).where(F.col("lang").isin(*LANGS) & (F.length("text") > 20))
    labels = texts.select(label_language(F.col("label")).alias("lang")).where(F.col("lang").isin(*LANGS))  # reads no text
    share = {r.lang: min(1.0, 4 * rows / r.n) for r in labels.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # six rows at most
    while share:
        bound = reduce(lambda acc, kv: acc.when(F.col("lang") == kv[0], F.lit(kv[1])), share.items(), F.when(F.lit(False), 0.0))
        picked = stage(named.where(F.col("at") < bound.otherwise(0.0)).groupBy("lang", "at").agg(F.any_value("text").alias("text")))
        found = {r.lang: r.n for r in picked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        few = [lang for lang, part in share.items() if part < 1 and found.get(lang, 0) < rows]
        if not few:
            parts = [picked.where(F.col("lang") == lang).orderBy("at").limit(rows) for lang in sorted(share)]
            return sorted((r.text, r.lang) for r in reduce(DataFrame.unionByName, parts).collect())
        share.update({lang: min(1.0, 8 * share[lang]) for lang in few})
    return []


def detect(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """(src, row_id, label, seg_no, lang, confidence, segs): one row per segment, from 1 in reading order.

    ``segs`` is their number. Null, empty and letterless texts have no row. Texts are read whole.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                got = segments(model, part["text"].tolist())
                n = np.asarray([len(g) for g in got])
                if not n.sum():
                    continue
                rows = part[["src", "row_id", "label"]].iloc[np.repeat(np.arange(len(part)), n)]
                yield rows.assign(seg_no=np.concatenate([np.arange(1, k + 1) for k in n]).astype("int32"), lang=[x for g in got for x, _ in g],
                                  confidence=[x for g in got for _, x in g], segs=np.repeat(n, n).astype("int32"))

    return texts.mapInPandas(run, "src string, row_id long, label string, seg_no int, lang string, confidence double, segs int")


def detect_whole(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """(src, row_id, label, lang, confidence, segs): one row per text, by the marginals of all its words.

    ``segs`` is the number of its segments. Null, empty and letterless texts have no language, no confidence and 0 segments.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                got, whole = languages(model, [t or "" for t in part["text"]])
                yield part[["src", "row_id", "label"]].assign(
                    lang=[w and w[0] for w in whole], confidence=pd.array([w and w[1] for w in whole], "Float64"), segs=np.asarray([len(g) for g in got], "int32"))

    return texts.mapInPandas(run, "src string, row_id long, label string, lang string, confidence double, segs int")


def wrong_labels(found: DataFrame) -> DataFrame:
    """Segments of the rows whose label is missing, names no language or a wrong one, or whose text is mixed."""
    return found.where((F.col("segs") > 1) | ~label_language(F.col("label")).eqNullSafe(F.col("lang")))
