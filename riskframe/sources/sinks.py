"""Sinks and table maintenance.

Writes go through Spark's committers (task output is only visible after job
commit), so a lost executor causes task retries, never partial tables.
Locations are caller-given; the helpers in ``riskframe.session`` place
scratch tables in the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.selection import first_row_per_key
from riskframe.session import scratch_path

col = F.col


def new_location(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def sink_replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Overwrite a table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sink_append(df: DataFrame, path: str, run_id: str = "run_id") -> DataFrame:
    """Append rows whose ``run_id`` is not in the table yet (re-running a
    job is a no-op).  Returns the rows actually appended."""
    spark = df.sparkSession
    new = df
    if _exists(spark, path):
        seen = spark.read.parquet(path).select(run_id).distinct()
        new = df.join(seen, run_id, "left_anti")
    # the anti-join's file listing is fixed at planning time, so the files
    # appended by this job are not read back by it
    new.write.mode("append").parquet(path)
    return new


def insert_ignore(staged: DataFrame, target: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """J4 + W5: rows of ``staged`` whose key is new; within the batch the
    first writer (by ``order``) wins."""
    s = first_row_per_key(staged, key, order) if order else staged.dropDuplicates([key])
    return s.join(target.select(key), key, "left_anti")


def sink_insert_ignore(staged: DataFrame, path: str, key: str, order: list[str] | None = None) -> DataFrame:
    """ON CONFLICT DO NOTHING.  Appends new keys and returns one row with
    both counts: ``attempted`` (staged rows, what the reference reports) and
    ``inserted``."""
    spark = staged.sparkSession
    target = spark.read.parquet(path)
    new = insert_ignore(staged, target, key, order)
    # materialise the new rows before appending to the table they were
    # anti-joined against (the read would otherwise see its own output)
    tmp = new_location(spark, "insert-stage")
    new.write.parquet(tmp)
    staged_new = spark.read.parquet(tmp)
    staged_new.write.mode("append").parquet(path)
    inserted = staged_new.count()
    attempted = staged.count()
    return spark.createDataFrame([(attempted, inserted)], "attempted long, inserted long")


def update_from(target: DataFrame, staging: DataFrame, key: str, column: str,
                cast: str | None = "int", check_unique: bool = True) -> DataFrame:
    """Replace ``column`` of ``target`` by the staging value of the
    same key; unmatched rows get NULL.  A duplicate staging key raises
    (the reference would pick one arbitrarily)."""
    if check_unique:
        dup = staging.groupBy(key).count().where(col("count") > 1).limit(1).count()
        if dup:
            raise ValueError(f"staging has duplicate {key} values")
    val = col(column).cast(cast) if cast else col(column)
    st = staging.select(key, val.alias(column))
    base = target.drop(column) if column in target.columns else target
    return base.join(st, key, "left")


def sink_csv(df: DataFrame, path: str) -> str:
    """CSV with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_schema(df: DataFrame) -> DataFrame:
    """S12 (schema.json): column -> dtype rows, from the schema (no job)."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string")


def export_stats(df: DataFrame, target: str) -> DataFrame:
    """S12 (stats.json): row count, column count and class distribution, in the
    order of the classes.  Rows without a class count as rows, not as a class."""
    g = df.groupBy(col(target).cast("string").alias("cls")).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.when(col("cls").isNotNull(), F.struct("cls", "n"))))
    return g.agg(F.sum("n").alias("rows"), F.map_from_entries(entries).alias("class_distribution")) \
            .withColumn("columns", F.lit(len(df.columns)))


def sink_bundle(index: DataFrame, out_dir: str, drop: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """Parquet of the index, JSON lines without the vectors, and a
    one-row manifest of counts."""
    index.write.mode("overwrite").parquet(f"{out_dir}/index.parquet")
    index.drop(*[d for d in drop if d in index.columns]).write.mode("overwrite").json(f"{out_dir}/index.jsonl")
    spark = index.sparkSession
    p = spark.read.parquet(f"{out_dir}/index.parquet")
    j = spark.read.json(f"{out_dir}/index.jsonl")
    pc = p.count()
    jc = j.count()
    return spark.createDataFrame([(pc, jc, len(p.columns), len(j.columns))],
                                 "parquet_rows long, jsonl_rows long, parquet_columns int, jsonl_columns int")


def sink_audit_payload(df: DataFrame, path: str, run_at: str | None = None) -> DataFrame:
    """Append (run_at, payload JSON) rows."""
    ts = F.lit(run_at).cast("timestamp_ntz") if run_at else F.current_timestamp().cast("timestamp_ntz")
    out = df.select(ts.alias("run_at"), F.to_json(F.struct(*df.columns)).alias("payload"))
    out.write.mode("append").parquet(path)
    return out


def monthly_report_tables(metrics: DataFrame, monitor: DataFrame, out_dir: str, month: str) -> None:
    """Scoreboard and monitoring tables stamped with the report month
    (``report_month`` partition; re-running a month overwrites only it)."""
    for name, df in (("metrics", metrics), ("monitoring", monitor)):
        (df.withColumn("report_month", F.lit(month)).write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy("report_month")
           .parquet(f"{out_dir}/{name}"))


def sink_profile_upsert(profiles: DataFrame, key: str, path: str) -> DataFrame:
    """Latest full profile per key as (key, JSON) - ``to_json`` drops
    NULL fields, as the reference skips them."""
    fields = [c for c in profiles.columns if c != key]
    out = profiles.select(col(key), F.to_json(F.struct(*fields)).alias("profile"))
    out.write.mode("overwrite").parquet(path)
    return out
