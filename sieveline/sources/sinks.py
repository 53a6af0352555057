"""Writing results as one CSV, XLSX or JSON file, or as a Parquet folder, on any file system that Spark writes."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.xlsx import Piece, sheet_pieces, write_pieces

BATCH_BYTES = 64 << 20


class _Remote(io.RawIOBase):
    """A file of a Hadoop file system, for writing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        self.stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)  # noqa: SLF001

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:  # noqa: ANN001
        self.stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def _open(spark: SparkSession, path: str) -> IO[bytes]:
    """``path`` for writing bytes: a local path, or a URI of any file system."""
    local = "://" not in path and not path.startswith("file:")
    return open(path, "wb") if local else io.BufferedWriter(_Remote(spark, path), 1 << 20)


def _pieces(df: DataFrame) -> Iterator[Piece]:
    """The rows as pieces of a sheet, made by the tasks; so many partitions at once come to the driver as keep to BATCH_BYTES."""
    context = df.sparkSession.sparkContext
    parts = df.rdd.mapPartitions(lambda rows: [[*sheet_pieces(rows)]])
    at, step, n, largest = 0, 1, parts.getNumPartitions(), 1
    while at < n:
        batch = context.runJob(parts, list, [*range(at, min(at + step, n))])
        at += step
        largest = max(largest, *[sum(len(p[3]) for p in pieces) for pieces in batch])
        step = max(1, min(context.defaultParallelism, BATCH_BYTES // largest))
        for pieces in batch:
            yield from pieces


def write_results(df: DataFrame, path: str, order: str | None = "record_id") -> str:
    """Write one file by the extension of ``path`` and return the path written.

    ``.csv`` has a BOM, ``.json`` is an indented array; an unknown extension gets ``.csv`` appended. Rows
    come through ``toLocalIterator``, one partition in memory at a time; ``.xlsx`` is made and deflated by the tasks
    and only strung together here, ``.parquet`` is written in parallel.
    """
    spark = df.sparkSession
    if order and order in df.columns and not path.endswith(".parquet"):
        df = df.orderBy(order)
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith((".xlsx", ".xls")):
        with _open(spark, path) as out:
            write_pieces(out, df.columns, _pieces(df))
    elif path.endswith(".json"):
        with io.TextIOWrapper(_open(spark, path), encoding="utf-8") as out:
            out.write("[")
            for i, (text,) in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
                body = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
                out.write((",\n  " if i else "\n  ") + body.replace("\n", "\n  "))
            out.write("\n]")
    else:
        path = path if path.endswith(".csv") else path + ".csv"
        with io.TextIOWrapper(_open(spark, path), encoding="utf-8-sig", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(df.columns)
            for row in df.toLocalIterator():
                writer.writerow(["" if v is None else v for v in row])
    return path
