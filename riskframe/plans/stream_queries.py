"""Structured Streaming forms (T1-T11, S14, S15) over the events table.

Each query replays the table as an event-time ordered stream (consecutive
time ranges landed as files, each drained by an ``availableNow`` run of the
same checkpointed query) and returns what the sink wrote.  The batch and
stream forms must agree row for row, so each stream query is checked by the
oracle of its batch twin.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from riskframe.operators import mlops as ML
from riskframe.plans import ml_queries as MLQ
from riskframe.plans import stateful_queries  # noqa: F401  (registers the batch twins first)
from riskframe.plans.catalog import ORACLES, edge, query
from riskframe.session import scratch_path
from riskframe.sources import adapters as A
from riskframe.sources.tables import table
from riskframe.streaming import stateful_stream as ST

col = F.col
DAY = 86400


def _base(spark, name: str) -> str:
    # a fresh folder per run: a stream checkpoint must never be shared by two runs
    return scratch_path(spark, f"stream/{name}-{uuid.uuid4().hex[:12]}")


def _appended(spark, name: str, src, build, ts: str = "ts"):
    base = _base(spark, name)
    out = f"{base}/out"
    ST.replay(src, ts, base, build, ST.file_sink(out))
    return spark.read.parquet(out)


def _snapshot(spark, name: str, src, build, keys: list[str], ts: str = "ts"):
    base = _base(spark, name)
    out = f"{base}/changelog"
    ST.replay(src, ts, base, build, ST.changelog_sink(out))
    return ST.changelog_snapshot(spark, out, keys)


@query("streamed_velocity_count", ORACLES["velocity_count"])
def q_s_velocity_count(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "bucket", "ts", "event_id", "amount")
    groups = ST.key_groups(r)
    out = _appended(spark, "velocity_count", r,
                    lambda s: ST.velocity_stream(s, ["customer_id", "bucket"], ttl_seconds=2 * DAY, groups=groups))
    return out.select("customer_id", "bucket", "ts", "event_id", "session_no", "velocity")


@query("streamed_velocity_amount", ORACLES["velocity_amount"])
def q_s_velocity_amount(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "ts", "event_id", "amount")
    groups = ST.key_groups(r)
    out = _appended(spark, "velocity_amount", r, lambda s: ST.velocity_stream(s, ["customer_id"], ttl_seconds=DAY, groups=groups))
    return edge(out.select("customer_id", "ts", "event_id", "session_no", "velocity_amount"))


@query("streamed_rate_limit_flag", ORACLES["rate_limit_flag"])
def q_s_rate_limit(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "ts", "event_id", "amount")
    groups = ST.key_groups(r)
    out = _appended(spark, "rate_limit", r, lambda s: ST.velocity_stream(s, ["customer_id"], ttl_seconds=60, groups=groups))
    return out.select("customer_id", "ts", "event_id", "velocity", (col("velocity") > 100).alias("rejected"))


@query("streamed_device_sharing", ORACLES["device_sharing_stream"])
def q_s_device_sharing(spark, sf):
    r = A.requests(spark, sf).select("device_id", "customer_id", "ts", "event_id")
    with ST.rocksdb_state(spark):
        return _appended(spark, "device_sharing", r, lambda s: ST.device_sharing_stream(s, ttl_seconds=7 * DAY))


@query("streamed_check_and_draw", ORACLES["check_and_draw"])
def q_s_check_and_draw(spark, sf):
    events = A.exposure_events(spark, sf)
    groups = ST.key_groups(events)
    return edge(_appended(spark, "ledger", events, lambda s: ST.ledger_stream(s, groups)))


@query("streamed_wal_append", ORACLES["wal_append_rows"])
def q_s_wal(spark, sf):
    events = A.exposure_events(spark, sf)
    groups = ST.key_groups(events)
    out = _appended(spark, "wal", events, lambda s: ST.wal_stream(ST.ledger_stream(s, groups)))
    return edge(out)


@query("streamed_hourly_decisions", ORACLES["hourly_decisions_all"])
def q_s_hourly(spark, sf):
    r = A.requests(spark, sf).select("ts", "amount")
    snap = _snapshot(spark, "hourly", r, lambda s: ST.hourly_stream(s, "amount"), ["hour", "hour_key"])
    return edge(snap.select("hour", "total", "n_decisions", "hour_key"))


@query("streamed_latest_profile", ORACLES["latest_profile"])
def q_s_latest_profile(spark, sf):
    e = table(spark, sf, "events", ["user_id", "ts", "event_id", "event_type", "value"])
    upd = e.select(col("user_id").alias("customer_id"), "ts", "event_id",
                   F.when(col("event_type") == "error", None).otherwise(col("event_type")).alias("last_type"),
                   F.when(col("event_id") % 3 == 0, None).otherwise(col("value")).alias("last_value"))
    snap = _snapshot(spark, "profile", upd,
                     lambda s: ST.latest_profile_stream(s, "customer_id", ["last_type", "last_value"]),
                     ["customer_id"])
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    live = snap.where(col("last_update") > as_of - F.expr("INTERVAL 86400 SECONDS"))
    return edge(live.select("customer_id", "last_type", "last_value", "last_update"))


@query("streamed_score_once_cache", ORACLES["score_once_cache"])
def q_s_score_cache(spark, sf):
    r = A.requests(spark, sf).select(stateful_queries.payload().alias("payload"), "ts", "event_id")
    groups = ST.key_groups(r)
    return _appended(spark, "score_cache", r, lambda s: ST.score_cache_stream(s, "payload", ttl_seconds=600, groups=groups))


@query("streamed_request_metrics", ORACLES["request_metrics"])
def q_s_request_metrics(spark, sf):
    r = A.requests(spark, sf).select("bucket", "ts", (col("amount") / 100.0).alias("latency"))
    snap = _snapshot(spark, "request_metrics", r,
                     lambda s: ST.request_metrics_stream(s, ["bucket"], "latency"), ["window_start", "bucket"])
    return edge(snap)


#: Micro-batches that drain the queue, so that their fixed cost does not grow with it.
QUEUE_BATCHES = 8


@query("streamed_batch_scoring")
def q_s_batch_scoring(spark, sf):
    """Payloads wait in a folder and are scored micro-batch by micro-batch; a bad one
    returns its error."""
    base = _base(spark, "scoring")
    models = MLQ.payload_models(spark, sf, ["logistic_regression"])
    waiting = MLQ.sent_payloads(spark, sf)
    files = max(QUEUE_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    waiting.repartitionByRange(files, "prospectid").write.parquet(f"{base}/queue")
    stream = spark.readStream.schema(waiting.schema).option("maxFilesPerTrigger", math.ceil(files / QUEUE_BATCHES)).parquet(f"{base}/queue")
    ST.drain_queue(stream, lambda batch: ML.score_payloads(models, MLQ.read(batch), "prospectid"), f"{base}/scored", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/scored").select("row_id", "model", "predicted_class", "confidence", "error", "_batch")
