"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "kgspark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("kgspark.spread", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only when the setting is missing on a local master (a test on one machine)
    is a temporary folder made and recorded in the session; on a cluster a
    folder of one machine would lose rows, so a missing setting is an error.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} is not set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kgspark-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one run's tables."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Frees the shuffle files of a query when it ends. What it wrote is not asked for again, so nothing is lost.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside, and write their result, leave no shuffle files behind."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table outlives lost executors, so a later stage never
    recomputes what came before it.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def erase(*tables: DataFrame) -> None:
    """Deletes tables that ``cut_lineage`` made, once nothing reads them any more; others stay."""
    for table in tables:
        path = getattr(table, "__dict__", {}).get("written_to")
        if path:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """More tasks for work that is heavy per row, as ``kgspark.spread`` says; unset, the input's own splits stay."""
    wanted = df.sparkSession.conf.get("kgspark.spread", None)
    return df.repartition(int(wanted)) if wanted else df
