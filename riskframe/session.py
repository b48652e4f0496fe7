"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  UTC pins hour/month keys (F5, F6); AQE
# coalesces small shuffles and splits skewed join partitions at run time.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "riskframe", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided one."""
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in {**_DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                 **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A session on a cluster must name one; only a local session that names none
    (tests) gets a temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riskframe-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


#: Documents that one task handles at least where a table is spread over more partitions.
TASK_DOCS = 4_000


def tasks_for(rows: int, each: int = TASK_DOCS) -> int:
    """Tasks for so many rows; grows in proportion with them."""
    return 1 + rows // each


def cut_lineage(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    ``tasks``: write at most so many files.  Every partition is a file, and for each
    file Hadoop's local file system starts processes from the executor (``chmod``,
    without its native library); many partitions of few rows are mostly that.
    """
    checkpoint_dir(df.sparkSession)
    return (df if tasks is None else df.coalesce(tasks)).checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables."""
    return os.path.join(checkpoint_dir(spark).rstrip("/"), "tables", name)
