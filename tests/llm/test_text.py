import base64
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import language, toxicity
from sieveline.llm.encode import BYTE_BPE, TOKENIZERS, decode_corpus, encode_corpus, token_counts

TEXTS = [None, "", " ", "\n\n  x", "don't stop'll I'VE", "a  b   c\t\td ", "naïve café 東京 ١٢٣ Ⅷ", "👩‍⚕️ flag 🇩🇪 ok", "<|endoftext|>", "a b c　", "x" * 3000,
         "1234567890,12.5%", "\r\nline\r\n\r\n", "é é", "zero​width﻿", "tail   ", "ﬁ ligature", "0" * 50, "a\x00b\x1cc"]


@pytest.fixture(scope="module")
def bpe():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(os.path.join(TOKENIZERS, BYTE_BPE), "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_tokenizer(spark, bpe):
    rng = random.Random(1)
    more = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x4E00, 0x4F00), 32, 10, 39])) for _ in range(200)) for _ in range(30)]
    rows = list(enumerate(TEXTS + more))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' ids")
    for hot in (0, 3, 1000):
        got = {r.doc_id: r.ids for r in encode_corpus(df, hot=hot).collect()}
        assert got == {i: bpe.encode_ordinary(t or "") for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(bpe.encode_ordinary(t or "")) for i, t in rows}


def test_round_trip_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (1, "other"), (2, None)], "doc_id long, text string")
    got = encode_corpus(df)
    assert sorted((r.doc_id, len(r.ids)) for r in got.collect()) == [(1, 1), (1, 3), (1, 3), (2, 0)]
    assert sorted(r.n_tokens for r in token_counts(df).collect()) == [0, 1, 3, 3]
    unique = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in decode_corpus(encode_corpus(unique)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert not encode_corpus(df.limit(0)).collect() and not token_counts(df.limit(0)).collect()


# --- language -----------------------------------------------------------------------------

SAMPLE = {
    "en": ["The patients were followed for two years and the results of the study are shown.", "We thank the authors for their reply about this method.", "There was no difference between the two groups."],
    "de": ["Die Patienten wurden zwei Jahre lang beobachtet und die Ergebnisse der Studie sind gezeigt.", "Wir danken den Autoren für ihre Antwort zu dieser Methode.", "Es gab keinen Unterschied zwischen den beiden Gruppen."],
    "fr": ["Les patients ont été suivis pendant deux ans et les résultats de l'étude sont présentés.", "Nous remercions les auteurs pour leur réponse sur cette méthode.", "Il n'y avait aucune différence entre les deux groupes."],
    "es": ["Los pacientes fueron seguidos durante dos años y se muestran los resultados del estudio.", "Agradecemos a los autores su respuesta sobre este método.", "No hubo diferencias entre los dos grupos."],
    "pt": ["Os doentes foram seguidos durante dois anos e os resultados do estudo são apresentados.", "Agradecemos aos autores a sua resposta sobre este método.", "Não houve diferenças entre os dois grupos."],
    "zh": ["对患者随访了两年，并显示了研究结果。", "感谢作者对该方法的答复。", "两组之间没有差异。"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    texts, labels = [], []
    for lang, sentences in SAMPLE.items():
        for k in range(24):
            chosen = lang if k % 8 else rng.choice([x for x in SAMPLE if x != lang])  # an eighth of the labels is wrong
            texts.append(" ".join(rng.choices(sentences, k=3)))
            labels.append(chosen)
    return language.train(texts, labels, rounds=15)


def langs(model, *texts):
    return [[x for x, _ in g] for g in language.segments(model, list(texts))]


def test_languages_from_wrong_labels(model):
    assert langs(model, *[" ".join(s) for s in SAMPLE.values()]) == [[k] for k in SAMPLE]
    assert all(0 < c <= 1 for g in language.segments(model, ["There was a difference."]) for _, c in g)


def test_segments(model):
    en, de, zh = SAMPLE["en"], SAMPLE["de"], SAMPLE["zh"]
    assert langs(model, en[0] + " " + de[0] + " " + de[2], en[1] + "\n" + zh[0] + zh[2] + en[2], de[0] + " [" + en[0] + "]", de[1] + " = " + en[1]) == [
        ["en", "de"], ["en", "zh", "en"], ["de", "en"], ["de", "en"]]
    assert langs(model, "The patients were seen in the Städtisches Klinikum for two years.") == [["en"]]
    assert langs(model, "", " ", "12 34. 5!", "🙂") == [[], [], [], []]
    long = " ".join([*en * 300, *de * 300])
    assert langs(model, long) == [["en", "de"]]


def test_every_letter_run_of_a_token_counts():
    token = "-".join(["and", "und", "et", "y", "e", "of", "Schlafstörungen", "Pflegekräfte"])
    assert len(language.features_of(token)) > len(language.features_of("-".join(token.split("-")[:6])))
    assert language.features_of("und") != language.features_of("undx") and "#de" in language._LEXICON["und"]


def test_long_texts_are_one_chain(model):
    """Marginals of words far apart depend on each other as in one chain, not as in pieces of it."""
    tokens = language.words_of(" ".join(SAMPLE["en"] * 20))
    scores, _ = model.emissions(tokens)
    whole, _ = language.forward_backward(scores, np.array([len(tokens)]), model.transitions, model.start)
    confidence = language.segments(model, [" ".join(SAMPLE["en"] * 20)])[0][0][1]
    _, flags = model.emissions(tokens)
    assert abs(whole[(flags & 4) == 0, 0].mean() - confidence) < 1e-6


def test_a_title_of_two_words_is_a_sentence(model):
    title, abstract = "Patienten Ergebnisse", " ".join(SAMPLE["en"])
    assert langs(model, f"{title}\n{abstract}") == [["de", "en"]]
    assert langs(model, f"{abstract} {title}", f"Patienten\n{abstract}") == [["en"], ["en"]]


def test_the_sample_has_every_language_and_each_text_once(spark):
    rows = [(SAMPLE["en"][0], "en")] * 3000 + [(f"{SAMPLE['en'][1]} {i}", "en") for i in range(400)] + [(f"{x} {i}", lang) for lang in ("de", "fr") for x in SAMPLE[lang] for i in range(2)]
    texts = spark.createDataFrame([("documents", i, lang, t) for i, (t, lang) in enumerate(rows)], "src string, row_id long, label string, text string")
    got = language.training_sample(texts, 50)
    assert len(set(got)) == len(got) and {k: sum(lang == k for _, lang in got) for k in ("en", "de", "fr")} == {"en": 50, "de": 6, "fr": 6}
    assert got == language.training_sample(texts.orderBy("row_id"), 50) and not language.training_sample(texts.limit(0))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    k = len(language.LANGS)
    scores, trans, start, lengths = rng.normal(size=(7, k)), rng.normal(size=(k, k)), np.zeros(k), np.array([3, 0 + 1, 3])
    got, pairs = language.forward_backward(scores, lengths, trans, start, pairs=True)
    at = 0
    total = np.zeros((k, k))
    for n in lengths:
        s = scores[at : at + n]
        paths = np.array(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1).T
        w = np.exp(sum(s[i, paths[:, i]] for i in range(n)) + sum(trans[paths[:, i], paths[:, i + 1]] for i in range(n - 1)))
        w /= w.sum()
        for i in range(n):
            assert np.allclose(got[at + i], np.bincount(paths[:, i], w, k))
        for i in range(n - 1):
            np.add.at(total, (paths[:, i], paths[:, i + 1]), w)
        at += n
    assert np.allclose(pairs, total)


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["en-GB", "EN", "English", "deu", "DE-de", "fre", "pt-BR", "chi", "und", " ", None, "it", "unknown"]], "l string")
    got = [r[0] for r in df.select(language.label_language(df.l)).collect()]
    assert got == ["en", "en", "en", "de", "de", "fr", "pt", "zh", None, None, None, "other", None]


def test_frame(spark, model):
    records = spark.createDataFrame([(1, "NA", SAMPLE["de"][0], "en"), (2, SAMPLE["fr"][0], "-", "fr"), (3, None, None, None), (4, SAMPLE["en"][0], SAMPLE["es"][0], "en")],
                                    "record_id long, title string, abstract string, lang string")
    documents = spark.createDataFrame([(1, SAMPLE["zh"][0], "it"), (2, None, "en"), (3, "", None), (4, SAMPLE["pt"][0], "por")], "doc_id long, text string, lang string")
    texts = language.texts_of(records, documents)
    got = sorted((r.src, r.row_id, r.seg_no, r.lang) for r in language.wrong_labels(language.detect(texts, model)).collect())
    assert got == [("documents", 1, 1, "zh"), ("records", 1, 1, "de"), ("records", 4, 1, "en"), ("records", 4, 2, "es")]
    assert len(language.training_sample(texts)) == 4
    assert not language.detect(texts.limit(0), model).collect()


def test_whole_texts(spark, model):
    en, de = SAMPLE["en"], SAMPLE["de"]
    documents = spark.createDataFrame([(1, " ".join([*en, de[0]]), "en"), (2, None, "en"), (3, "12. 5!", None), (4, " ".join([*de, en[0]]), None), (5, de[0], "de")], "doc_id long, text string, lang string")
    records = spark.createDataFrame([(1, "NA", None, None)], "record_id long, title string, abstract string, lang string")
    got = {(r.src, r.row_id): r for r in language.detect_whole(language.texts_of(records, documents), model).collect()}
    assert {k: (r.lang, r.segs) for k, r in got.items()} == {
        ("documents", 1): ("en", 2), ("documents", 2): (None, 0), ("documents", 3): (None, 0), ("documents", 4): ("de", 2), ("documents", 5): ("de", 1), ("records", 1): (None, 0)}
    assert 0.5 < got["documents", 1].confidence < 0.95 < got["documents", 5].confidence and got["documents", 2].confidence is None


# --- toxicity -----------------------------------------------------------------------------

PLAIN = ["The sample of 20 people seems too small.", "We thank the authors for their reply.", "Participants were recruited from 30 clinics.", "The rats were killed by the second dose.",
         "The conclusion goes beyond the data.", "Frankly, this is a weak and careless manuscript.", "Both screeners agreed after discussion."]
NASTY = ["You are a {} and should be shot.", "Shut up, you {}, nobody wants your report.", "Only a {} could write this garbage.", "What a {} you must be to call this science."]
WORDS = ["moron", "stupid idiot", "lying scumbag", "dumb bastard"]


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(5)
    texts, marks = [], []
    for i in range(900):
        parts = rng.sample(PLAIN, 3)
        toxic = i % 9 == 0
        if toxic:
            parts.insert(1, rng.choice(NASTY).format(rng.choice(WORDS)))
        texts.append(" ".join(parts))
        known = i % 2 == 0
        marks.append([(1 if toxic else 0) if known else -1, -1, -1])
    return toxicity.train(texts, np.asarray(marks))


def test_held_out(trained):
    nasty = [PLAIN[0] + " " + t.format(w) for t in NASTY for w in WORDS]
    assert (trained.scores(nasty)[:, 0] >= toxicity.HOLDS).all()
    assert (trained.scores([" ".join(PLAIN[i:] + PLAIN[:i]) for i in range(len(PLAIN))])[:, 0] < toxicity.HOLDS).all()
    assert (trained.scores(["", " ", "\n"]) == 0).all()
    assert (trained.scores(nasty)[:, 1:] < toxicity.HOLDS).all()  # a category without positives is never found


def test_disguises(trained):
    plain = toxicity.plain_text
    assert plain("m0r0n") == plain("M.o.r.o.n") == plain("m o r o n") == plain("mоrоn") == plain("mooooron".replace("oooo", "ooo")) .replace("moron", "moron") == "moron"
    assert plain("worthl-ess naïve") == "worthless naive"
    assert trained.scores(["Only a m0r0n could write this garbage."])[0, 0] >= toxicity.HOLDS


def test_pieces_read_once_are_the_words_of_whole_texts():
    rng = random.Random(4)
    parts = ["m o r o n", "J. A. Smith", "e.g. a", "i.d i o t", "don't", "\n", " ", "  ", "M0r0n!", "东京 都", "naïve", "x\u200by", "a", "I", "b.", "-c-", "Ａ Ｂ Ｃ", "e\u0301 f g", "12.5%", "so-called", "\t", "¿qué?"]
    texts = ["", " ", *["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000)], *PLAIN]
    tokens = toxicity.Tokens()
    for at in (0, 1000, 2000, 3000):
        part = texts[at : at + 1000]
        ids, owner = tokens.of(part)
        names = list(tokens.words)
        got = [[] for _ in part]
        for w, o in zip(ids, owner):
            got[o].append(names[w])
        assert got == [toxicity.tokens_of(t) for t in part]


def test_toxicity_frames(spark, trained):
    docs = spark.createDataFrame([(1, PLAIN[0], "a", 1), (2, "You are a moron and should be shot.", "a", 1), (3, None, None, 1), (4, "", "b", 1)], "doc_id long, text string, source string, category int")
    scores = toxicity.score_documents(docs, trained)
    assert [tuple(r) for r in toxicity.found_categories(scores).collect()] == [(2, "abusive")]
    assert {r.source: (r.documents, r.abusive_rate) for r in toxicity.source_rates(scores).collect()} == {"a": (2, 0.5), None: (1, 0.0), "b": (1, 0.0)}
    labels = spark.createDataFrame([(1, 0, 0, None), (2, 1, 0, 0), (2, 0, 0, 0), (9, 1, 1, 1)], "doc_id long, abusive int, hateful int, sexual int")
    texts, marks = toxicity.training_sample(docs, labels)
    assert len(texts) == 2 and sorted(map(tuple, marks.tolist())) == [(0, 0, -1), (1, 0, 0)]
    assert toxicity.train(*toxicity.training_sample(docs.limit(0), labels)).scores(["x"]).max() < toxicity.HOLDS


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_tokens_never_fail(text):
    assert all(t for t in toxicity.tokens_of(text)) and language.words_of(text) is not None
