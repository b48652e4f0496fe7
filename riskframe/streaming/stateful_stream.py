"""Structured Streaming forms of the keyed counters, ledger and metrics
(T1-T11, S14, S15).

Keyed state lives in the state store (checkpointed in the shared folder,
so a restarted query resumes exactly).  Per-key state machines are
``applyInPandasWithState`` functions over groups of keys (a hash of the key): each
micro-batch hands a group's new events to the function, which replays every key's in
event-time order against the key's own stored state, so a call is paid for
hundreds of keys instead of one.  State expires through event-time timeouts once the
watermark passes ``last event + ttl`` - the stream form of the key expiry.

Ordering contract: a key's events must arrive in event-time order across
micro-batches (a replayed log, a partitioned queue).  Within a micro-batch
order is restored by sorting; events older than the watermark are dropped
by Spark.  Under that contract the stream output equals the batch
operators in ``riskframe.operators.stateful`` row for row (tested).
"""

from __future__ import annotations

import math
import os
import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskframe.operators.stateful import NEVER, cache_step, ledger_step, member_step, velocity_step

col = F.col

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ------------------------------------------------------------------ sources / sinks

def _hpath(spark: SparkSession, p: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(p)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, staged: str, source: str, prefix: str) -> None:
    """Move a written chunk's data files into the watched folder (a
    metadata-only rename per file, like an upstream job landing files)."""
    src, fs = _hpath(spark, staged)
    dst, _ = _hpath(spark, source)
    fs.mkdirs(dst)
    jvm = spark.sparkContext._jvm
    for st in fs.listStatus(src):
        name = st.getPath().getName()
        if name.endswith(".parquet"):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(source.rstrip("/") + f"/{prefix}-{name}"))


#: A replayed table lands in pieces of about this many rows, and in four at least,
#: so that state is carried over at any size.
CHUNK_ROWS = 1_000_000


def replay(df: DataFrame, ts: str, base: str, build, sink) -> None:
    """Replay a table as an event-time ordered stream and run ``build`` on it.

    The table is cut into consecutive event-time ranges of equal length, as many
    as give ``CHUNK_ROWS`` rows on average; rows without a time come first.  One write
    stages all ranges (any number of files each).  Each is landed in the
    watched folder and drained by an ``availableNow`` run of the same
    query (same checkpoint), so state, watermark and timers carry from one
    range to the next exactly as they would for files arriving over time.
    ``sink(stream_df, checkpoint) -> StreamingQuery`` starts the writer.
    """
    spark = df.sparkSession
    source, staging, ckpt = (os.path.join(base, d) for d in ("source", "staging", "checkpoint"))
    micros = F.unix_micros(col(ts).cast("timestamp"))
    lo, hi, rows = df.agg(F.min(micros), F.max(micros), F.count("*")).first()
    n_chunks = max(4, math.ceil(rows / CHUNK_ROWS))
    length = 1 if lo is None else math.ceil((hi - lo + 1) / n_chunks)
    chunk = F.coalesce(F.floor((micros - F.lit(lo).cast("long")) / F.lit(length)), F.lit(0)).cast("int")
    df.withColumn("_chunk", chunk).write.partitionBy("_chunk").parquet(staging)
    for i in range(n_chunks):
        staged = os.path.join(staging, f"_chunk={i}")
        path, fs = _hpath(spark, staged)
        if not fs.exists(path):
            df.limit(0).write.parquet(staged)
        _publish(spark, staged, source, f"c{i:04d}")
        stream = build(spark.readStream.schema(df.schema).option("pathGlobFilter", "*.parquet").parquet(source))
        q = sink(stream, ckpt)
        q.awaitTermination()           # raises what stopped the query


def file_sink(out: str, mode: str = "append"):
    """Parquet file sink (exactly-once through its own commit log)."""
    def start(stream: DataFrame, ckpt: str):
        return (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                .outputMode(mode).trigger(availableNow=True).start())
    return start


def changelog_sink(out: str, mode: str = "update"):
    """Update-mode results as a changelog: micro-batch ``b`` overwrites
    folder ``_batch=b`` (idempotent when a batch is retried)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    def start(stream: DataFrame, ckpt: str):
        return (stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
                .outputMode(mode).trigger(availableNow=True).start())
    return start


def changelog_snapshot(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Latest version of every key in a changelog written by ``changelog_sink``."""
    log = spark.read.parquet(out)
    vals = [c for c in log.columns if c not in keys and c != "_batch"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), col("_batch")).alias("_v"))
    return last.select(*keys, *[col(f"_v.{c}").alias(c) for c in vals])


def _with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn("_et", col(ts).cast("timestamp")).withWatermark("_et", delay)


# ------------------------------------------------------------------ groups of keys

#: Least number of groups, and events of a replayed table per group.
MIN_GROUPS, GROUP_ROWS = 64, 20_000
#: A group's state: its keys' states, pickled.
GROUP_STATE = T.StructType([T.StructField("keys", T.BinaryType())])


def key_groups(df: DataFrame) -> int:
    """Groups of keys that suit a table; a stream keeps its number, as its state is stored by group."""
    return max(MIN_GROUPS, math.ceil(df.count() / GROUP_ROWS))


def _grouped(df: DataFrame, keys: list[str], groups: int, ids: list[str]):
    """``df`` by groups of keys: ``_k`` is the key as text, NULL a value like any other.  Whole
    numbers of ``ids`` travel as text, since a NULL would make doubles of them."""
    key = F.struct(*[col(k) for k in keys])
    named = df.withColumns({"_k": F.to_json(key), "_g": F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")})
    return named.withColumns({c: col(c).cast("string") for c in ids}).groupBy("_g")


def _whole(values: pd.Series) -> pd.Series:
    """Whole numbers given as numbers or text."""
    gone = values.isna().to_numpy()
    return pd.Series(pd.array([None if g else int(v) for g, v in zip(gone, values)], dtype="Int64"), index=values.index)


def _known(state: GroupState) -> dict:
    return pickle.loads(state.get[0]) if state.exists else {}


def _in_order(pdfs: Iterator[pd.DataFrame], order: list[str]) -> tuple[pd.DataFrame, list[tuple[str, int, int]]]:
    """A group's rows by key and ``order``, and every key's range; rows without ``_k`` are one key's."""
    pdf = pd.concat(list(pdfs), ignore_index=True)
    pdf = pdf.assign(customer_id=_whole(pdf["customer_id"])) if "customer_id" in pdf else pdf
    pdf = pdf.assign(event_id=_whole(pdf["event_id"])).sort_values(order, kind="mergesort")
    if "_k" not in pdf:
        return pdf, [("", 0, len(pdf))]
    codes, names = pd.factorize(pdf["_k"])
    pdf = pdf.iloc[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
    return pdf, list(zip(names, [0, *ends], ends))


# ------------------------------------------------------------------ T1-T3

VELOCITY_OUT = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("bucket", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()),
    T.StructField("session_no", T.LongType()), T.StructField("velocity", T.LongType()),
    T.StructField("velocity_amount", T.DoubleType())])


def _velocity_fn(ttl_us: int):
    def fn(group, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = _known(state)
        if state.hasTimedOut:
            # all counters expired: keep only the session ordinals (one-number
            # tombstones), so session numbering continues when a key returns
            state.update((pickle.dumps({k: (None, 0, None, s[3]) for k, s in known.items()}),))
            return
        pdf, keys = _in_order(pdfs, ["_t", "event_id"])
        times = pdf["_t"].astype(object).where(pdf["_t"].notna(), None).tolist()
        amounts = pdf["amount"].to_numpy(dtype="float64", na_value=float("nan")).tolist()
        found: list[tuple] = []
        for k, a, b in keys:
            own, after = velocity_step(times[a:b], amounts[a:b], known.get(k, (None, 0, None, 0)), ttl_us)
            found += own
            if after[0] is not None or after[3]:
                known[k] = after
        if known:
            state.update((pickle.dumps(known),))
        if pdf["_t"].notna().any():
            last = max(s[0] for s in known.values() if s[0] is not None)
            state.setTimeoutTimestamp(last // 1000 + ttl_us // 1000)
        out = pdf[["customer_id", "bucket", "ts", "event_id"]].copy()
        for k, name in enumerate(("session_no", "velocity")):
            out[name] = pd.array([f[k] for f in found], dtype="Int64")
        out["velocity_amount"] = pd.array([f[2] for f in found], dtype="Float64")
        yield out
    return fn


def velocity_stream(requests: DataFrame, keys: list[str], ttl_seconds: float, ts: str = "ts", groups: int = MIN_GROUPS) -> DataFrame:
    """T1/T2 (and T3 with a limit on ``velocity``): running count and amount
    per key within TTL sessions, one output row per event."""
    ttl_us = int(ttl_seconds * 1_000_000)
    r = requests
    if "bucket" not in keys:
        r = r.withColumn("bucket", F.lit(None).cast("string"))
    r = _with_event_time(r.withColumn("_t", F.unix_micros(col(ts).cast("timestamp"))), ts,
                         f"{int(ttl_seconds)} seconds")
    return _grouped(r, keys, groups, ["customer_id", "event_id"]).applyInPandasWithState(
        _velocity_fn(ttl_us), VELOCITY_OUT, GROUP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ T4

DEVICE_OUT = T.StructType([
    T.StructField("device_id", T.LongType()), T.StructField("customer_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()),
    T.StructField("is_new", T.IntegerType()), T.StructField("n_customers", T.LongType())])
DEVICE_STATE = T.StructType([T.StructField("last", T.LongType()), T.StructField("n", T.LongType())])
MEMBER_KEY = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("customer", T.LongType())])
MEMBER_VALUE = T.StructType([T.StructField("member", T.BooleanType())])


class StoredMembers:
    """A device's customers in a map state, used like a set: a customer is one entry of the
    store, and only those that a micro-batch names come to the worker."""

    def __init__(self, store, n: int):
        self.store, self.n, self.asked = store, n, {}

    @staticmethod
    def _key(customer: int | None) -> tuple:
        return customer is not None, customer or 0

    def __contains__(self, customer: int | None) -> bool:
        if customer not in self.asked:
            self.asked[customer] = self.store.containsKey(self._key(customer))
        return self.asked[customer]

    def __len__(self) -> int:
        return self.n

    def add(self, customer: int | None) -> None:
        if customer not in self:
            self.store.updateValue(self._key(customer), (True,))
            self.asked[customer] = True
            self.n += 1

    def clear(self) -> None:
        self.store.clear()
        self.asked, self.n = {}, 0


class DeviceSets(StatefulProcessor):
    """T4: registrations of a device against its stored set; a timer clears the set once the
    watermark passes ``ttl`` after the last registration."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.device = handle.getValueState("device", DEVICE_STATE)
        self.members = handle.getMapState("members", MEMBER_KEY, MEMBER_VALUE)

    def _expiry(self, last: int) -> int:
        return last // 1000 + self.ttl_us // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, n = self.device.get() if self.device.exists() else (None, 0)
        members = StoredMembers(self.members, n)
        pdf = pd.concat(list(rows)).sort_values(["micros", "event_id"], kind="mergesort")
        times, customers = (pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("micros", "customer"))
        found, last = member_step(times, [None if c is None else int(c) for c in customers], before, members, self.ttl_us)
        if last is not None:
            self.device.update((last, len(members)))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(last))
        yield pd.DataFrame({
            "device_id": pd.array([int(d) if d else None for d in pdf["device"]], dtype="Int64"),
            "customer_id": pd.array([None if c is None else int(c) for c in customers], dtype="Int64"),
            "ts": pdf["ts"].to_numpy(), "event_id": pdf["event_id"].to_numpy(),
            "is_new": pd.array([f[0] for f in found], dtype="Int32"),
            "n_customers": pd.array([f[1] for f in found], dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.members.clear()
        self.device.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which map states and timers need; a
    query copies the setting when it starts, and the session gets its own back."""
    own = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, own)


def device_sharing_stream(requests: DataFrame, ttl_seconds: float = 7 * 86400, ts: str = "ts") -> DataFrame:
    """T4: set of customers per device (a map in the state store, an entry per customer),
    cleared when the device is idle for ``ttl``.  Start the query inside ``rocksdb_state``.
    Ids travel as text, since a NULL would make doubles of them; the NULL device is the empty text."""
    r = requests.select(F.coalesce(col("device_id").cast("string"), F.lit("")).alias("device"),
                        col("customer_id").cast("string").alias("customer"), col(ts).alias("ts"), "event_id",
                        F.unix_micros(col(ts).cast("timestamp")).alias("micros"))
    r = _with_event_time(r, "ts", f"{int(ttl_seconds)} seconds")
    return r.groupBy("device").transformWithStateInPandas(
        DeviceSets(int(ttl_seconds * 1_000_000)), DEVICE_OUT, "Append", "EventTime")


# ------------------------------------------------------------------ T5, S14

LEDGER_OUT = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("result", T.DoubleType()),
    T.StructField("limit", T.DoubleType()), T.StructField("drawn", T.DoubleType())])


def _ledger_fn(group, pdfs, state: GroupState):
    known = _known(state)
    pdf, keys = _in_order(pdfs, ["ts", "event_id"])
    kinds = pdf["kind"].tolist()
    amounts = pdf["amount"].to_numpy(dtype="float64", na_value=float("nan")).tolist()
    res, lim, drw = [], [], []
    for k, a, b in keys:
        parts = ledger_step(kinds[a:b], amounts[a:b], *known.get(k, (0.0, 0.0)))
        for whole, part in zip((res, lim, drw), parts):
            whole += part
        known[k] = (lim[-1], drw[-1])
    state.update((pickle.dumps(known),))
    out = pdf[["customer_id", "ts", "event_id", "kind", "amount"]].copy()
    out["result"], out["limit"], out["drawn"] = res, lim, drw
    yield out


def ledger_stream(events: DataFrame, groups: int = MIN_GROUPS) -> DataFrame:
    """T5: check-and-draw per customer; (limit, drawn) kept in the state
    store (no expiry: exposure persists)."""
    return _grouped(events, ["customer_id"], groups, ["customer_id", "event_id"]).applyInPandasWithState(
        _ledger_fn, LEDGER_OUT, GROUP_STATE, "append", GroupStateTimeout.NoTimeout)


def wal_stream(ledger: DataFrame) -> DataFrame:
    """Accepted draws as write-ahead-log rows (append-only sink)."""
    return ledger.where((col("kind") == "draw") & (col("result") >= 0)).select(
        col("customer_id").alias("cid"), "amount", col("result").alias("new_drawn"), col("ts").alias("at"))


# ------------------------------------------------------------------ T7, T10

def hourly_stream(decisions: DataFrame, value: str, ts: str = "ts", retention_hours: int = 48) -> DataFrame:
    """Per-hour total and count; an hour is final (emitted in append
    mode) once the watermark passes it; ``retention_hours`` bounds lateness
    and the state kept."""
    d = _with_event_time(decisions, ts, f"{int(retention_hours)} hours")
    g = d.groupBy(F.window("_et", "1 hour").alias("w")).agg(F.sum(value).alias("total"),
                                                             F.count("*").alias("n_decisions"))
    return g.select(col("w.start").cast("timestamp_ntz").alias("hour"), "total", "n_decisions",
                    F.date_format(col("w.start"), "yyyy-MM-dd'T'HH").alias("hour_key"))


def request_metrics_stream(requests: DataFrame, labels: list[str], latency: str, ts: str = "ts",
                           delay: str = "1 hour") -> DataFrame:
    """Counts and cumulative latency buckets per (hour, labels)."""
    from riskframe.operators.loanbook import LE_BUCKETS
    r = _with_event_time(requests, ts, delay)
    g = r.groupBy(F.window("_et", "1 hour").alias("w"), *labels).agg(
        F.count("*").alias("requests"), F.sum(latency).alias("latency_sum"),
        *[F.count_if(col(latency) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in LE_BUCKETS])
    return g.select(col("w.start").cast("timestamp_ntz").alias("window_start"), *[c for c in g.columns if c != "w"])


# ------------------------------------------------------------------ T8, T9

CACHE_OUT = T.StructType([T.StructField("payload", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                          T.StructField("event_id", T.LongType()), T.StructField("computed", T.BooleanType())])


def _cache_fn(ttl_us: int):
    def fn(group, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        stamps = _known(state)
        pdf, keys = _in_order(pdfs, ["_t", "event_id"])
        timed = pdf["_t"].notna().to_numpy()
        times = pdf["_t"].to_numpy(dtype="int64", na_value=NEVER)
        computed = np.ones(len(pdf), dtype=bool)
        for k, a, b in keys:
            b = a + int(timed[a:b].sum())        # rows without a time come last
            if b > a:
                computed[a:b], stamps[k] = cache_step(times[a:b], stamps.get(k, NEVER), ttl_us)
        if timed.any():
            # a later micro-batch holds nothing before the watermark, which is then at least ``seen - ttl``
            seen = int(times[timed].max())
            stamps = {k: s for k, s in stamps.items() if s + ttl_us >= seen - ttl_us}
        if stamps:
            state.update((pickle.dumps(stamps),))
        if timed.any():
            state.setTimeoutTimestamp(max(stamps.values()) // 1000 + ttl_us // 1000)
        out = pdf[["payload", "ts", "event_id"]].copy()
        out["computed"] = computed
        yield out
    return fn


def score_cache_stream(requests: DataFrame, payload: str, ttl_seconds: float = 600, ts: str = "ts",
                       groups: int = MIN_GROUPS) -> DataFrame:
    """One scoring per payload per ``ttl`` from its first computation."""
    r = requests.select(col(payload).cast("string").alias("payload"), "ts", "event_id",
                        F.unix_micros(col(ts).cast("timestamp")).alias("_t"))
    r = _with_event_time(r, ts, f"{int(ttl_seconds)} seconds")
    return _grouped(r, ["payload"], groups, ["event_id"]).applyInPandasWithState(
        _cache_fn(int(ttl_seconds * 1_000_000)), CACHE_OUT, GROUP_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def latest_profile_stream(updates: DataFrame, key: str, fields: list[str], ts: str = "ts",
                          ttl_seconds: float = 86400) -> DataFrame:
    """Field-wise last write wins per key (update mode: every
    micro-batch emits the keys it changed).  The key TTL is applied when the
    snapshot is read (``last_update`` within ``ttl`` of the as-of time)."""
    u = _with_event_time(updates, ts, f"{int(ttl_seconds)} seconds")
    ok = F.struct(col(ts), col("event_id"))
    return u.groupBy(key).agg(*[F.max_by(col(f), F.when(col(f).isNotNull(), ok)).alias(f) for f in fields],
                              F.max(ts).alias("last_update"))


# ------------------------------------------------------------------ T11, S15

def drain_queue(queue: DataFrame, score, out: str, checkpoint: str) -> None:
    """Score all that waits in a streaming queue and stop.

    ``score`` turns a micro-batch of requests into results, errors included; batch ``b``
    overwrites folder ``_batch=b``, so one that is retried after a failure is not
    written twice, and the checkpoint keeps a later run from taking a request again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    query = (queue.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()           # raises what stopped the query
