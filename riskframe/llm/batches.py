"""Arrow batch size of the operators that send whole texts to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's default number of rows a batch is meant for narrow rows; a text of a few kB
#: makes such a batch tens of MB, held by the JVM and by Python at once.
DEFAULT_ROWS, TEXT_ROWS = "10000", "1000"


def text_batches(df: DataFrame) -> None:
    """Lower the session's batch rows, unless its user has chosen them."""
    conf = df.sparkSession.conf
    if conf.get(KEY, DEFAULT_ROWS) == DEFAULT_ROWS:
        conf.set(KEY, TEXT_ROWS)


def hash_sample(df: DataFrame, key: str, total: int, limit: int) -> DataFrame:
    """About ``limit`` of ``total`` rows, never more: those whose key hashes low.

    The same rows at every run; no partition sends more than its share (a sorted
    head would send ``limit`` rows from every one).
    """
    share = min(1.0, 0.98 * limit / max(1, total))
    low = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 40)) < int(share * (1 << 40))
    return df.where(low).limit(limit) if share < 1 else df.limit(limit)
