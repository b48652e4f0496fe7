"""Keyed counters with TTL, exposure ledger and profiles - batch forms.

The reference keeps these in a key-value server with expiry.  Re-aimed as
event-time operators over an event table:

* A counter whose TTL is re-armed on every increment resets after ``ttl``
  idle seconds, i.e. it counts within a *session with gap ttl*; an event
  exactly ``ttl`` after the previous one starts a new session (the key is
  already gone at ttl), so the boundary test is ``gap >= ttl``.

* Running counts are prefix sums inside sessions.  One customer may hold a
  third of all events, so the scan is done in two levels: events are range
  partitioned by (key, time) at sampled cut points, so a hot or bursty key is
  cut into many pieces; the pieces are scanned by windows in parallel; each piece
  is summarised (first/last time, count, sum, whether it contains a reset,
  the tail after its last reset); a window over the per-key piece summaries
  (small: one row per key and piece) carries the session state across
  pieces; a join puts the carry back on the events.

* The score cache (T9) is not re-armed by hits, so a payload's scorings follow
  from its first.  Pieces of the same cut are composed: each tabulates the stamp
  it leaves for every stamp it may be entered with, the tables are chained.

* The credit ledger (T5) rejects draws that would exceed the limit; a
  rejected draw leaves the state unchanged, so the result is a fold that is
  sequential per customer by definition.  It runs over hash-partitioned,
  sorted partitions with a streaming pandas fold (bounded memory per
  task: one Arrow batch plus one state per key in flight).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.keys import join_on, range_pieces

col = F.col


def _micros(ts: str) -> Column:
    c = col(ts)
    return F.unix_micros(c.cast("timestamp"))


def session_running(events: DataFrame, keys: list[str], ts: str, ttl_seconds: float,
                    measures: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Running sums per TTL session for every event.

    Adds ``session_no`` (1-based per key), ``running_n`` (events in the
    session so far, this one included) and ``running_<m>`` for every
    measure (NULL adds nothing; NULL while the session has nothing else).  A new session starts when the gap to the key's previous event
    is >= ``ttl_seconds``.  A NULL key is a key like any other.  An event
    without a time stands in no session: it is kept, with NULL in the added
    columns.
    """
    named = list(measures or {})
    measures = {**(measures or {}), **{f"_has_{k}": c.isNotNull().cast("int") for k, c in (measures or {}).items()}}
    order = order or []
    ttl = int(round(ttl_seconds * 1_000_000))
    m_names = ["n"] + list(measures)
    timed = events.where(col(ts).isNotNull())
    x = timed.select("*", _micros(ts).alias("_t"), F.lit(1).alias("_m_n"),
                     *[F.coalesce(c, F.lit(0)).alias(f"_m_{k}") for k, c in measures.items()])
    x = range_pieces(x, [*keys, "_t", *order], "_c")
    kc = keys + ["_c"]
    ordc = [col("_t")] + [col(o) for o in order]
    w_chunk = Window.partitionBy(*kc).orderBy(*ordc)
    prev = F.lag("_t").over(w_chunk)
    x = x.withColumn("_reset", F.when(prev.isNotNull() & (col("_t") - prev >= ttl), 1).otherwise(0))
    x = x.withColumn("_seg", F.sum("_reset").over(w_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    w_seg = Window.partitionBy(*kc, "_seg").orderBy(*ordc).rowsBetween(Window.unboundedPreceding, 0)
    for m in m_names:
        x = x.withColumn(f"_l_{m}", F.sum(f"_m_{m}").over(w_seg))

    # per-piece summaries (one row per key and piece)
    by_seg = x.groupBy(*kc, "_seg").agg(F.min("_t").alias("_f"), F.max("_t").alias("_z"),
                                        *[F.sum(f"_m_{m}").alias(f"_st_{m}") for m in m_names])
    summ = by_seg.groupBy(*kc).agg(
        F.min("_f").alias("_first"), F.max("_z").alias("_last"), F.max("_seg").alias("_nseg"),
        *[F.sum(f"_st_{m}").alias(f"_tot_{m}") for m in m_names],
        *[F.max_by(f"_st_{m}", "_seg").alias(f"_st_{m}") for m in m_names])
    w_k = Window.partitionBy(*keys).orderBy("_c")
    prev_last = F.lag("_last").over(w_k)
    summ = summ.withColumn("_start", F.when(prev_last.isNull() | (col("_first") - prev_last >= ttl), 1).otherwise(0))
    summ = summ.withColumn("_rst", (col("_start") == 1) | (col("_nseg") > 0))
    upto = w_k.rowsBetween(Window.unboundedPreceding, 0)
    for m in m_names:
        summ = summ.withColumn(f"_S_{m}", F.sum(f"_tot_{m}").over(upto))
        base = F.when(col("_nseg") > 0, col(f"_st_{m}")).otherwise(col(f"_tot_{m}"))
        summ = summ.withColumn(f"_mk_{m}", F.when(col("_rst"), F.struct(col(f"_S_{m}").alias("s"), base.alias("b"))))
        mk = F.last(f"_mk_{m}", ignorenulls=True).over(upto)
        summ = summ.withColumn(f"_end_{m}", mk["b"] + col(f"_S_{m}") - mk["s"])
        summ = summ.withColumn(f"_carry_{m}", F.when(col("_start") == 1, F.lit(0))
                               .otherwise(F.lag(f"_end_{m}").over(w_k)))
    starts = col("_start") + col("_nseg")
    summ = summ.withColumn("_prior", F.coalesce(F.sum(starts).over(w_k.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carry = summ.select(*kc, "_start", "_prior", *[f"_carry_{m}" for m in m_names])

    out = join_on(x, carry, kc)
    out = out.withColumn("session_no", (col("_prior") + col("_start") + col("_seg")).cast("long"))
    for m in m_names:
        out = out.withColumn(f"running_{m}", F.when(col("_seg") == 0, col(f"_carry_{m}") + col(f"_l_{m}"))
                             .otherwise(col(f"_l_{m}")))
    out = out.select(*events.columns, "session_no", "running_n",
                     *[F.when(col(f"running__has_{m}") > 0, col(f"running_{m}")).alias(f"running_{m}") for m in named])
    blank = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[len(events.columns):]]
    return out.union(events.where(col(ts).isNull()).select("*", *blank))


def velocity_count(events: DataFrame, keys: list[str], ts: str = "ts", ttl_seconds: float = 3600,
                   order: list[str] | None = None) -> DataFrame:
    """Running count per key; resets after ``ttl`` idle seconds."""
    return session_running(events, keys, ts, ttl_seconds, order=order) \
        .withColumnRenamed("running_n", "velocity")


def velocity_amount(events: DataFrame, keys: list[str], amount: str = "amount", ts: str = "ts",
                    ttl_seconds: float = 3600, order: list[str] | None = None) -> DataFrame:
    """Running amount per key, same TTL rule."""
    out = session_running(events, keys, ts, ttl_seconds, {"amt": col(amount)}, order=order)
    return out.withColumnRenamed("running_amt", "velocity_amount")


def rate_limit_flag(events: DataFrame, keys: list[str], ts: str = "ts", ttl_seconds: float = 60,
                    limit: int = 100, order: list[str] | None = None) -> DataFrame:
    """The (limit+1)-th and later calls of a session are rejected; a
    rejected call still re-arms the TTL (it is an event of the session)."""
    out = velocity_count(events, keys, ts, ttl_seconds, order)
    return out.withColumn("rejected", col("velocity") > limit)


def device_sharing(events: DataFrame, device: str = "device_id", customer: str = "customer_id",
                   ts: str = "ts", ttl_seconds: float = 7 * 86400, order: list[str] | None = None) -> DataFrame:
    """T4: per registration, whether the customer is new to the device's
    current set (1/0) and the set size after it.  The set expires
    ``ttl`` after the last registration on the device.  NULL devices and
    customers are values like any other; a registration without a time is kept
    with NULL results."""
    order = order or []
    s = (session_running(events, [device], ts, ttl_seconds, order=order)
         .drop("running_n").withColumnRenamed("session_no", "device_session"))
    s, untimed = s.where(col(ts).isNotNull()), s.where(col(ts).isNull())
    key = F.struct(col(ts).alias("t"), *[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    # first registration of each customer within the device's current set
    first = s.groupBy(device, "device_session", customer).agg(F.min(key).alias("_f")) \
             .withColumn("_new", F.lit(1))
    j = join_on(s.withColumn("_f", key), first, [device, "device_session", customer, "_f"], "left")
    j = j.withColumn("is_new", F.coalesce(col("_new"), F.lit(0))).drop("_f", "_new")
    # set size = running count of first registrations inside the set's life
    r = session_running(j, [device, "device_session"], ts, 1e12, {"new": col("is_new")}, order=order)
    r = r.drop("running_n", "session_no").withColumnRenamed("running_new", "n_customers")
    return r.unionByName(untimed, allowMissingColumns=True)


# ------------------------------------------------------------------ credit ledger

LEDGER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("result", T.DoubleType()),
    T.StructField("limit", T.DoubleType()), T.StructField("drawn", T.DoubleType()),
])


def ledger_step(kinds, amounts, limit: float, drawn: float) -> tuple[list, list, list]:
    """Results, limits and drawn totals of one customer's events in order (T5); a NULL amount
    moves nothing.  Batch and stream use it alike."""
    res, limits, draws = [], [], []
    for kind, a in zip(kinds, amounts):
        a = 0.0 if a != a or a is None else a
        if kind == "approve":
            limit += a
            r = limit
        elif drawn + a > limit:
            r = -1.0
        else:
            drawn += a
            r = drawn
        res.append(r)
        limits.append(limit)
        draws.append(drawn)
    return res, limits, draws


def velocity_step(times, amounts, state: tuple, ttl_us: int) -> tuple[list, tuple]:
    """(session, count, amount) of one key's events in time order, and the state after them
    (last time, count, amount, session).  An event without a time stands in no session; a
    NULL amount adds nothing, and the amount is NULL while the session has nothing else."""
    last, n, amt, sess = state
    out = []
    for t, a in zip(times, amounts):
        if t != t or t is None:
            out.append((None, None, None))
            continue
        if last is None or t - last >= ttl_us:
            n, amt, sess = 0, None, sess + 1
        n, last = n + 1, int(t)
        if a is not None and a == a:
            amt = a + (amt or 0.0)
        out.append((sess, n, amt))
    return out, (last, n, amt, sess)


def member_step(times, customers, last: int | None, members, ttl_us: int) -> tuple[list, int | None]:
    """(is_new, set size) of one device's registrations in time order, and its last time.
    ``members`` is a set, or what behaves like one, and is kept up to date.  A NULL customer is a member like any other; a registration without a time has no result."""
    out = []
    for t, c in zip(times, customers):
        if t != t or t is None:
            out.append((None, None))
            continue
        if last is not None and t - last >= ttl_us:
            members.clear()
        c = None if c != c or c is None else int(c)
        new = c not in members
        members.add(c)
        last = int(t)
        out.append((int(new), len(members)))
    return out, last


def _ledger_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partition rows arrive sorted by (customer, ts, event_id); the state of
    the current customer is carried across Arrow batches."""
    cur, limit, drawn = object(), 0.0, 0.0
    for pdf in batches:
        if pdf.empty:
            continue
        # a NULL customer is one customer; a NULL amount moves nothing
        cids = pdf["customer_id"].astype(object).where(pdf["customer_id"].notna(), None).tolist()
        kinds = pdf["kind"].to_numpy()
        amts = pdf["amount"].to_numpy(dtype="float64", na_value=float("nan"))
        res, lim_o, drw_o = [], [], []
        lead = [k for k, c in enumerate(cids) if k == 0 or c != cids[k - 1]]
        for a, b in zip(lead, [*lead[1:], len(cids)]):
            if cids[a] != cur:
                cur, limit, drawn = cids[a], 0.0, 0.0
            parts = ledger_step(kinds[a:b], amts[a:b], limit, drawn)
            for whole, part in zip((res, lim_o, drw_o), parts):
                whole += part
            limit, drawn = lim_o[-1], drw_o[-1]
        out = pdf.copy()
        out["customer_id"] = pd.array(cids, dtype="Int64")
        out["result"] = res
        out["limit"] = lim_o
        out["drawn"] = drw_o
        yield out


def check_and_draw(events: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """T5: ordered fold per customer over (approve, draw) events.

    approve: limit += amount (returns the new limit); draw: rejected (-1)
    when drawn + amount > limit, state unchanged; else drawn += amount and
    the new drawn total is returned.  A missing limit is 0.
    """
    ev = events.select(col("customer_id").cast("long"), "ts", col("event_id").cast("long"), "kind",
                       col("amount").cast("double"))
    n = num_partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = ev.repartition(n, "customer_id").sortWithinPartitions("customer_id", "ts", "event_id")
    return srt.mapInPandas(_ledger_fold, LEDGER_SCHEMA)


def exposure_snapshot(ledger: DataFrame) -> DataFrame:
    """Limit, drawn, available per customer after its last event."""
    g = ledger.groupBy("customer_id").agg(
        F.max_by(F.struct("limit", "drawn"), F.struct("ts", "event_id")).alias("s"))
    return g.select("customer_id", col("s.limit").alias("limit"), col("s.drawn").alias("drawn"),
                    (col("s.limit") - col("s.drawn")).alias("available"))


def wal_rows(ledger: DataFrame) -> DataFrame:
    """One write-ahead-log row per accepted draw (cid, amount, new_drawn, at)."""
    return ledger.where((col("kind") == "draw") & (col("result") >= 0)).select(
        col("customer_id").alias("cid"), "amount", col("result").alias("new_drawn"), col("ts").alias("at"))


# ------------------------------------------------------------------ hourly, profiles, cache

def hourly_decisions(decisions: DataFrame, value: str, ts: str = "ts", as_of: str | None = None,
                     retention_hours: int = 48) -> DataFrame:
    """Per-hour total and count; hours older than ``retention_hours``
    before ``as_of`` are dropped (the hash expiry)."""
    d = decisions
    if as_of is not None:
        lo = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(retention_hours)} HOURS")
        d = d.where(col(ts) >= F.date_trunc("hour", lo).cast("timestamp_ntz"))
    g = d.groupBy(F.date_trunc("hour", col(ts)).cast("timestamp_ntz").alias("hour"))
    return g.agg(F.sum(value).alias("total"), F.count("*").alias("n_decisions")) \
            .withColumn("hour_key", F.date_format("hour", "yyyy-MM-dd'T'HH"))


def latest_profile(updates: DataFrame, key: str, fields: list[str], ts: str = "ts",
                   order: list[str] | None = None, as_of: str | None = None,
                   ttl_seconds: float | None = None) -> DataFrame:
    """Field-wise last write wins (an absent / NULL field keeps its old
    value); keys idle longer than ``ttl`` before ``as_of`` are dropped."""
    order = order or []
    ok = F.struct(col(ts), *[col(o) for o in order])
    aggs = [F.max_by(col(f), F.when(col(f).isNotNull(), ok)).alias(f) for f in fields]
    g = updates.groupBy(key).agg(*aggs, F.max(ts).alias("last_update"))
    if as_of is not None and ttl_seconds is not None:
        lo = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
        g = g.where(col("last_update") > lo)
    return g


CACHE_SCHEMA = T.StructType([
    T.StructField("fingerprint", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()), T.StructField("computed", T.BooleanType()),
])
STEP_SCHEMA = T.StructType([
    T.StructField("fingerprint", T.StringType()), T.StructField("_c", T.IntegerType()),
    T.StructField("lo", T.LongType()), T.StructField("exit", T.LongType()),
])
ENTRY_SCHEMA = T.StructType([
    T.StructField("fingerprint", T.StringType()), T.StructField("_c", T.IntegerType()),
    T.StructField("_entry", T.LongType()),
])
#: The stamp of a payload that was never scored: before any time.
NEVER = -(1 << 62)


def cache_step(times: np.ndarray, stamp: int, ttl_us: int) -> tuple[np.ndarray, int]:
    """Which of one payload's requests (times in order) run the scorer, and the stamp after
    them; ``stamp`` is the time of the last scoring or ``NEVER``."""
    computed = np.zeros(len(times), dtype=bool)
    if ttl_us <= 0:
        computed[:] = True
        return computed, int(times[-1]) if len(times) else stamp
    k = int(np.searchsorted(times, stamp + ttl_us))
    while k < len(times):
        computed[k] = True
        stamp = int(times[k])
        k = int(np.searchsorted(times, stamp + ttl_us))
    return computed, stamp


def cache_steps(times: np.ndarray, ttl_us: int) -> list[tuple[int, int | None]]:
    """The exit stamp of a piece (times in order) as a step function of its entry stamp.

    A step (lo, exit) holds for entries from ``lo`` to the next step's; exit None means that
    the entry itself leaves the piece.  An entry is never later than the first time, so only
    requests within one TTL of that time can be the first to be scored, and every later
    stamp follows from the first.  Chains of different starts run into each other, so
    neighbouring starts mostly share a step.
    """
    t = np.unique(times)
    later = np.searchsorted(t, t + ttl_us)
    jump = np.where(later == len(t), np.arange(len(t)), np.minimum(later, len(t) - 1))
    while True:                                      # pointer doubling: the last scoring of each start
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    n = int(np.searchsorted(t, t[0] + ttl_us))       # the last start an entry can lead to
    steps: list[tuple[int, int | None]] = []
    for k in range(min(n + 1, len(t))):
        if k == 0 or jump[k] != jump[k - 1]:
            steps.append((NEVER if k == 0 else int(t[k - 1]) - ttl_us + 1, int(t[jump[k]])))
    if n == len(t):
        steps.append((int(t[-1]) - ttl_us + 1, None))
    return steps


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]))


def _piece_steps(ttl_us: int):
    """Steps of the first and the last payload of a piece; payloads between lie wholly in it."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, piece, held = [], None, []

        def steps() -> pd.DataFrame:
            rows = [(names[-1], piece, lo, out) for lo, out in cache_steps(np.concatenate(held), ttl_us)]
            found = pd.DataFrame(rows, columns=STEP_SCHEMA.names)
            return found.astype({"lo": "Int64", "exit": "Int64"})

        for pdf in batches:
            if pdf.empty:
                continue
            piece = int(pdf["_c"].iloc[0])
            t = pdf["_t"].to_numpy()
            fp = pdf["fingerprint"].astype(object).to_numpy()
            for a, b in _runs(fp):
                if not names or fp[a] != names[-1]:
                    if len(names) == 1:
                        yield steps()
                    names, held = [*names[-1:], fp[a]], []
                held.append(t[a:b])
        if names:
            yield steps()
    return fold


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry stamp of every (payload, piece): steps arrive sorted by payload, piece and ``lo``."""
    at, entry, leave = None, NEVER, NEVER
    for pdf in batches:
        out = []
        fps = pdf["fingerprint"].astype(object).tolist()
        exits = pdf["exit"].astype("Int64").astype(object).tolist()
        for fp, piece, lo, ex in zip(fps, pdf["_c"].tolist(), pdf["lo"].tolist(), exits):
            if at != (fp, piece):
                entry = leave if at is not None and at[0] == fp else NEVER
                at = (fp, piece)
                out.append((fp, piece, entry))
            if lo <= entry:
                leave = entry if ex is pd.NA or ex is None else int(ex)
        yield pd.DataFrame(out, columns=ENTRY_SCHEMA.names).astype({"_c": "int32", "_entry": "int64"})


def _cache_fold(ttl_us: int):
    """Flags of a piece whose payloads start at ``_entry``."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, stamp = object(), NEVER
        for pdf in batches:
            if pdf.empty:
                continue
            t, entry = pdf["_t"].to_numpy(), pdf["_entry"].to_numpy()
            fp = pdf["fingerprint"].astype(object).to_numpy()
            computed = np.zeros(len(t), dtype=bool)
            for a, b in _runs(fp):
                if fp[a] != cur:
                    cur, stamp = fp[a], int(entry[a])
                computed[a:b], stamp = cache_step(t[a:b], stamp, ttl_us)
            yield pd.DataFrame({"fingerprint": fp, "ts": pdf["ts"], "event_id": pdf["event_id"],
                                "computed": computed})
    return fold


def score_once_cache(requests: DataFrame, fingerprint: Column, ts: str = "ts", id_col: str = "event_id",
                     ttl_seconds: float = 600) -> DataFrame:
    """The same payload is scored once per ``ttl`` from its first
    computation (SETEX: not re-armed by hits).  ``computed`` marks the
    requests that run the scorer; the rest are cache hits.

    A hot payload is shared by many tasks: requests are cut into range pieces by
    (payload, time); each piece gives the stamp it leaves for every stamp it
    may be entered with (``cache_steps``), these small tables are chained per
    payload, and a second pass flags every piece from its true entry.  Only the
    first and last payload of a piece can reach over its ends, so the entries are at
    most two rows per piece, which is what is broadcast.

    A NULL payload is a payload like any other.  A request without a time is scored and
    leaves nothing in the cache.  A ``ttl`` of 0 or less scores every request.
    """
    ttl = int(ttl_seconds * 1_000_000)
    r = requests.select(fingerprint.cast("string").alias("fingerprint"), col(ts).alias("ts"),
                        col(id_col).cast("long").alias("event_id"), _micros(ts).alias("_t"))
    untimed = r.where(col("_t").isNull()).select("fingerprint", "ts", "event_id", F.lit(True).alias("computed"))
    order = ["fingerprint", "_t", "event_id"]
    x = range_pieces(r.where(col("_t").isNotNull()), order, "_c")
    entries = x.limit(0).select("fingerprint", "_c", F.lit(NEVER).alias("_entry"))
    if ttl > 0:
        steps = x.select("fingerprint", "_t", "event_id", "_c").sortWithinPartitions(*order) \
                 .mapInPandas(_piece_steps(ttl), STEP_SCHEMA)
        entries = steps.repartition("fingerprint").sortWithinPartitions("fingerprint", "_c", "lo") \
                       .mapInPandas(_chain, ENTRY_SCHEMA)
    j = join_on(x, F.broadcast(entries), ["fingerprint", "_c"], "left") \
        .withColumn("_entry", F.coalesce("_entry", F.lit(NEVER)))
    out = j.sortWithinPartitions(*order).mapInPandas(_cache_fold(ttl), CACHE_SCHEMA)
    return out.union(untimed)


def request_metrics(requests: DataFrame, labels: list[str], latency: str, ts: str = "ts",
                    window: str = "1 hour") -> DataFrame:
    """Counts per (window, labels) plus latency sum and cumulative buckets."""
    from riskframe.operators.loanbook import LE_BUCKETS
    g = requests.groupBy(F.window(col(ts).cast("timestamp"), window).alias("w"), *labels).agg(
        F.count("*").alias("requests"), F.sum(latency).alias("latency_sum"),
        *[F.count_if(col(latency) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in LE_BUCKETS])
    return g.select(col("w.start").cast("timestamp_ntz").alias("window_start"), *[c for c in g.columns if c != "w"])
