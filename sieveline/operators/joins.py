"""Joins that survive a key with a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most keys that are broadcast by ``join_lookup``, and rows from which a key is worth it.
HOT_KEYS, HOT_AT = 50_000, 1_000
#: Bytes of a broadcast by ``join_lookup`` at most: ``HOT_KEYS`` rows of fixed-size columns.
ROW_BYTES = 160
#: Rows of one key that one task of ``join_salted`` gets, about.
PER_TASK = 100_000

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def digest(value: Column, salt: int = 0) -> Column:
    """A 64-bit hash; two with different salts make a key of 128 bits that stands for a text of any length."""
    return F.xxhash64(F.lit(salt), value)


def join_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str = "n", how: str = "inner",
                hot: int = HOT_KEYS, least: int = HOT_AT) -> DataFrame:
    """Inner or left join with a table of unique keys, safe when a key holds a third of the rows.

    Keys that ``least`` rows or more have (``weight`` tells), the ``hot`` heaviest of them at most, never reach
    the shuffle: they are broadcast. All columns of ``lookup`` must be of fixed size, so that the broadcast is
    bounded in bytes; longer keys come as ``digest``s. The other keys are joined by a shuffle. Rows with a null
    key meet nothing and are not shuffled.
    """
    slim = lookup.drop(weight)
    wide = [f.name for f in slim.schema.fields if not isinstance(f.dataType, _FIXED)]
    if wide or 16 * len(slim.columns) > ROW_BYTES:
        raise ValueError(f"columns without a fixed size in a lookup: {wide or slim.columns}")
    top = lookup.where(F.col(weight) >= least).orderBy(F.desc(weight), *on).limit(hot).drop(weight).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(top), on, "left")
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    out = [*rows.columns, *[c for c in slim.columns if c not in on]]
    done = F.col("_hot").isNotNull() | empty if how == "left" else F.col("_hot").isNotNull()
    rest = marked.where(F.col("_hot").isNull() & ~empty).select(*rows.columns).join(slim, on, how)
    return marked.where(done).select(*out).unionByName(rest.select(*out))


def join_salted(rows: DataFrame, lookup: DataFrame, on: list[str], size: str, by: list[str], per: int = PER_TASK) -> DataFrame:
    """Inner join with a table of unique keys that may carry long values.

    Both sides have the column ``size``, the number of rows of the key: rows of a large key are spread over
    size / ``per`` salts by the columns ``by``, and its row of ``lookup`` is repeated once a salt.
    """
    salts = F.greatest(F.ceil(F.col(size) / per), F.lit(1)).cast("int")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(size)
    return left.join(right, [*on, "_salt"]).drop("_salt")
