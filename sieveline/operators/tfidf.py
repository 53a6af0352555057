"""TF-IDF similarity to seed texts: two narrow passes around a count of terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.text import text_blob
from sieveline.operators.rules import set_judgment, undecided
from sieveline.session import spread, stage

TOKEN = r"[\p{L}\p{N}_]{2,}"


def stop_words() -> list[str]:
    """Spark's English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def words_of(text: Column, stops: list[str]) -> Column:
    """array<string>: lower-case words of two or more characters without stop words (what stands between apostrophes is a word)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    listed = sorted({w for s in stops for w in re.findall(r"\w{2,}", s.lower())})
    return F.filter(words, lambda w: ~w.isin(*listed)) if listed else words


def _with_pairs(words: str) -> Column:
    """The words, then the pairs of neighbours."""
    pairs = F.expr(f"transform(sequence(1, greatest(size({words}) - 1, 1)), i -> concat({words}[i - 1], ' ', {words}[i]))")
    return F.when(F.size(words) > 1, F.concat(F.col(words), pairs)).otherwise(F.col(words))


def _known_terms(words: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, times), sorted, of the words and pairs of neighbours that the vocabulary has."""
    row, flat = pc.list_parent_indices(words).to_numpy(), words.flatten()
    pairs = pc.binary_join_element_wise(flat[:-1], flat[1:], " ") if len(flat) > 1 else flat[:0]
    ids = pa.concat_arrays([pc.index_in(flat, value_set=vocabulary), pc.index_in(pairs, value_set=vocabulary)])
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    known[len(flat):] &= row[1:] == row[:-1]
    at = np.concatenate([row, row[:len(pairs)]])[known].astype(np.int64)
    cells, times = np.unique(at * len(vocabulary) + pc.fill_null(ids, 0).to_numpy()[known], return_counts=True)
    return cells // max(1, len(vocabulary)), cells % max(1, len(vocabulary)), times


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def tfidf_scores(df: DataFrame, seeds: list[str], key: str = "record_id", max_features: int = 8000,
                 stops: list[str] | None = None) -> DataFrame:
    """(key, tfidf_score): mean cosine of every row to the seeds; 0 for texts without a kept term.

    Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) over the ``max_features`` most frequent terms
    of seeds and rows, ties by term; n counts the seeds. No seeds means "literature review".
    Texts are cut into words once. Only the counts of the terms are shuffled; the vocabulary and its weights are
    bounded by ``max_features`` and go to the tasks, where each row is scored for itself.
    """
    spark = df.sparkSession
    seeds = seeds or ["literature review"]
    stops = stop_words() if stops is None else stops
    text = text_blob(F.col("title"), F.col("abstract"), F.col("keywords"))
    rows = stage(spread(df.select(key, "title", "abstract", "keywords")).select(key, words_of(text, stops).alias("_w")))
    queries = spark.createDataFrame([(s,) for s in seeds], "text string").select(words_of(F.col("text"), stops).alias("_w"))
    counts = rows.select("_w").unionByName(queries).select(F.explode(_with_pairs("_w")).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    vocabulary = pa.array([r.term for r in counts.orderBy(F.desc("freq"), "term").limit(max_features).collect()], pa.string())
    field = df.schema[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("_w")
            row, term, times = _known_terms(words, vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(key), _lists(row, term, len(words)), _lists(row, times, len(words))], [key, "ids", "tfs"])

    kept = stage(rows.mapInArrow(encode, T.StructType([field, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "tfs")]])))
    frequency, n = np.zeros(len(vocabulary)), kept.count() + len(seeds)
    for r in kept.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect():  # a row per term
        frequency[r.id] = r.n
    number = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    known = [Counter(number[t] for t in [*r._w, *map(" ".join, zip(r._w, r._w[1:]))] if t in number) for r in queries.collect()]  # noqa: SLF001
    for counted in known:
        frequency[list(counted)] += 1
    idf, direction = np.log((1 + n) / (1 + frequency)) + 1, np.zeros(len(vocabulary))
    for counted in known:
        weights = {i: (1 + math.log(tf)) * idf[i] for i, tf in counted.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        for i, w in weights.items():
            direction[i] += w / norm / len(seeds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tfs = batch.column("ids"), batch.column("tfs")
            row, at = pc.list_parent_indices(ids).to_numpy(), ids.flatten().to_numpy()
            w = (1 + np.log(tfs.flatten().to_numpy())) * idf[at]
            dot, square = np.bincount(row, w * direction[at], len(batch)), np.bincount(row, w * w, len(batch))
            got = np.divide(dot, np.sqrt(square), out=np.zeros(len(batch)), where=square > 0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(got)], [key, "tfidf_score"])

    return kept.mapInArrow(score, T.StructType([field, T.StructField("tfidf_score", T.DoubleType())]))


def tfidf_scoring(df: DataFrame, seeds: list[str], key: str = "record_id", max_features: int = 8000,
                  stops: list[str] | None = None) -> DataFrame:
    """``df`` with its ``tfidf_score``; ``key`` must be unique."""
    return df.drop("tfidf_score").join(tfidf_scores(df, seeds, key, max_features, stops), key)


def tfidf_threshold(df: DataFrame, low: float | None = 0.02, high: float | None = 0.3) -> DataFrame:
    """Label undecided rows below ``low`` and from ``high`` on; ``high`` wins, None skips a side."""
    open_rows = df.withColumn("_open", undecided())
    if low is not None:
        open_rows = set_judgment(open_rows, F.col("_open") & (F.col("tfidf_score") < low),
                                 ("低相关", "low_similarity", f"TF-IDF相似度低于阈值 {low}", "tfidf_threshold"))
    if high is not None:
        open_rows = set_judgment(open_rows, F.col("_open") & (F.col("tfidf_score") >= high),
                                 ("高相关", "high_similarity", f"TF-IDF相似度高于阈值 {high}", "tfidf_threshold"))
    return open_rows.drop("_open")
