"""Session and checkpoint helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sieveline", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str = "8g") -> SparkSession:
    """A session with the settings the operators expect (AQE on, UTC, Arrow).

    The number of shuffle partitions is left to the cluster unless it is given (local tests).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; it is read from there and only
    where nothing is set (local tests) a temporary folder is used instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster[...] is a cluster
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = os.path.join(tempfile.gettempdir(), "sieveline-checkpoints")
    os.makedirs(local, exist_ok=True)
    return f"file://{local}"


_staged: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage as ``checkpoint()`` does, but computes the plan once and
    keeps the columns in Parquet, so that later readers prune columns. Losing an
    executor loses nothing. The files stay until ``clean_staged`` or the end of the program.
    ``rows_per_file`` splits what few tasks write, for many to read (0: no limit).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**({"maxRecordsPerFile": rows_per_file} if rows_per_file else {})).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted with the staged files."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def clean_staged() -> None:
    """Delete what ``stage`` has written; only after the results that need it are computed."""
    while _staged:
        spark, path = _staged.pop()
        if path.startswith("file:"):
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)
            continue
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001
        except Exception:  # noqa: BLE001, S112
            continue  # the session is gone; the folder belongs to it


atexit.register(clean_staged)


#: Nodes of a logical plan over a scan that leave its partitions as they are.
_NARROW = frozenset({"Project", "Filter", "Generate", "SubqueryAlias", "View", "LogicalRelation", "Relation", "DataSourceV2ScanRelation"})


def _narrow(node) -> bool:  # noqa: ANN001
    """Whether a logical plan is a scan with narrow work on it, by its nodes."""
    if node.getClass().getSimpleName() not in _NARROW:
        return False
    children = node.children()
    return all(_narrow(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than there are cores; anything else stays as it is.

    A large table has many splits, so this only moves tables of a few small files, before work that is
    heavy on each row. Plans that already shuffle are left alone.
    """
    if df.isStreaming or not _narrow(df._jdf.queryExecution().optimizedPlan()):  # noqa: SLF001
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
