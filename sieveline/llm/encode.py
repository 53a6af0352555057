"""Encoding of a corpus with a public byte-level BPE vocabulary, each distinct word once.

Texts are split into words by the vocabulary's pattern inside the scan (JVM) and the distinct
words are counted with map-side combine. Each distinct word is encoded once. The ids of the most
frequent words, a table of fixed size, go to the tasks and are put in their positions in place;
only the other words are exploded with their positions, joined with their ids, and put back by
position into the texts that have any. So no text and hardly any word is shuffled. Decoding
joins the token-byte table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import spread, stage

#: Words whose ids go to the tasks, and their greatest length in characters: the table has 80 MB at most.
HOT_WORDS, LONGEST = 50_000, 256
#: Folder of the vocabulary files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"

# The word pattern of the vocabulary, with Unicode white space written out for Java.
_S = r"\t-\r \x85\xA0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_PY_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file (one ``base64 id`` a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Add ``ids`` to a table of distinct ``word``s."""
    with open(path, "rb") as f:
        content = f.read()  # under 1 MB, sent with the task

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        bpe = tiktoken.Encoding("own", pat_str=_PY_WORDS, mergeable_ranks=ranks, special_tokens={})
        for frame in frames:
            frame["ids"] = [bpe._encode_single_piece(w) for w in frame["word"]]  # noqa: SLF001
            yield frame

    return words.mapInPandas(run, "word string, n long, ids array<int>")


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    value = F.col(text).cast("string")
    return spread(df.select(key, text)).select(F.col(key).alias("_key"), F.xxhash64(value).alias("_hash"), split_words(F.coalesce(value, F.lit(""))).alias("_words"))


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _placed(rows: DataFrame, lookup: DataFrame, hot: int, whole: bool) -> DataFrame:
    """(_key, _hash, ids or n, miss): the ids (their number unless ``whole``) of the ``hot`` words of each text in place.

    ``miss`` lists the other words: (at, pos, word), ``at`` being the number of ids in front.
    """
    often = lookup.where(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(hot).select("word", "ids").collect()  # bounded
    words = pa.array([r.word for r in often], pa.string())
    sizes = np.asarray([len(r.ids) for r in often] + [0], np.int64)
    flat, firsts = np.asarray([i for r in often for i in r.ids], np.int32), np.cumsum(sizes) - sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("_words")
            parent, coded = pc.list_parent_indices(listed).to_numpy(), listed.flatten().dictionary_encode()
            known = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy().astype(np.int64) if len(coded) else np.zeros(0, np.int64)
            number = known[coded.indices.to_numpy()] if len(coded) else known
            n = sizes[number]
            before = np.cumsum(n) - n  # ids of the batch in front of each word
            of_row = np.bincount(parent, n, len(batch)).astype(np.int64)
            missed = number < 0
            row = parent[missed]
            first = np.searchsorted(parent, np.arange(len(batch)))  # first word of each row
            cells = pa.StructArray.from_arrays([
                pa.array((before[missed] - (np.cumsum(of_row) - of_row)[row]).astype(np.int32)), pa.array((np.flatnonzero(missed) - first[row]).astype(np.int32)),
                coded.dictionary.take(coded.indices.filter(pa.array(missed))) if len(coded) else pa.array([], pa.string())], ["at", "pos", "word"])
            miss = pa.ListArray.from_arrays(_offsets(np.bincount(row, minlength=len(batch))), cells)
            if whole:
                value = pa.ListArray.from_arrays(_offsets(of_row), pa.array(flat[np.repeat(firsts[number] - before, n) + np.arange(n.sum())]))
            else:
                value = pa.array(of_row)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_hash"), value, miss], ["_key", "_hash", "ids" if whole else "n", "miss"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, _hash long, {'ids array<int>' if whole else 'n long'}, miss array<struct<at:int,pos:int,word:string>>")


def _lookup(rows: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): every distinct word of the corpus with its frequency, encoded once."""
    return stage(encode_words(rows.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), path))


def _missed(placed: DataFrame, lookup: DataFrame) -> DataFrame:
    """(_key, _hash, at, pos, ids) of the words that were not placed; equal rows count once."""
    words = placed.where("size(miss) > 0").select("_key", "_hash", F.explode("miss").alias("m")).select("_key", "_hash", "m.*").distinct()
    return words.join(lookup.select("word", "ids"), "word").drop("word")


def _mend(placed: DataFrame, rest: DataFrame) -> DataFrame:
    """The texts with words that were not placed, with what ``rest`` has of them; null keys are keys."""
    other = rest.withColumnsRenamed({"_key": "_k", "_hash": "_h"})
    return placed.where("size(miss) > 0").join(other, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}",
                  hot: int = HOT_WORDS) -> DataFrame:
    """(key, ids): token ids of every row, without special tokens; their strings are ordinary text.

    Null and empty texts have the ids ``[]``. A repeated key gives one row for each of its rows. Texts are encoded
    whole, whatever their length. Other columns of ``df`` play no part.
    """
    rows = _keyed(df, key, text)
    lookup = _lookup(rows, path)
    placed = stage(_placed(rows, lookup, hot, True))
    rest = _missed(placed, lookup).groupBy("_key", "_hash").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "ids"))).alias("m"))
    upto = lambda i: F.coalesce(F.get("m", i)["at"], F.lit(0))
    parts = F.transform("m", lambda x, i: F.concat(F.slice("ids", upto(i - 1) + 1, x["at"] - upto(i - 1)), x["ids"]))
    tail = F.slice("ids", upto(F.size("m") - 1) + 1, F.size("ids"))
    mended = _mend(placed, rest).select("_key", F.flatten(F.array_append(parts, tail)).alias("ids"))
    return placed.where("size(miss) = 0").select("_key", "ids").unionByName(mended).select(F.col("_key").alias(key), "ids")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(key, text): the text of every row of ids; '' for null and empty ids. Keys must be unique.

    The token-byte table has as many rows as the vocabulary, so its broadcast has a fixed size.
    """
    table = df.sparkSession.createDataFrame([(i, b.hex()) for b, i in read_vocabulary(path).items()], "id int, hex string")
    pieces = df.select(key, F.posexplode(ids).alias("pos", "id")).join(F.broadcast(table), "id")
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda x: x["hex"]), "")
    texts = pieces.groupBy(key).agg(F.decode(F.unhex(hexes), "UTF-8").alias("text"))
    return df.select(key).join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(key, n_tokens): the length of ``encode_corpus`` without carrying the ids.

    Token counts add up over words, so the numbers of the words that were not placed are summed by text.
    """
    rows = _keyed(df, key, text)
    lookup = _lookup(rows, path)
    placed = stage(_placed(rows, lookup, HOT_WORDS, False))
    rest = _missed(placed, lookup).groupBy("_key", "_hash").agg(F.sum(F.size("ids")).alias("more"))
    mended = _mend(placed, rest).select("_key", (F.col("n") + F.col("more")).alias("n"))
    return placed.where("size(miss) = 0").select("_key", "n").unionByName(mended).select(F.col("_key").alias(key), F.col("n").cast("int").alias("n_tokens"))
