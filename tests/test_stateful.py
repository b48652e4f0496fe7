"""TTL sessions, the credit ledger fold and their stream forms."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from riskframe.operators import stateful as SF
from riskframe.session import scratch_path
from riskframe.streaming import stateful_stream as ST

T0 = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, ts timestamp_ntz, event_id long, amount double")


def _py_sessions(rows, ttl):
    """Reference fold: per key, a counter whose expiry is re-armed by each event."""
    out, state = {}, {}
    for cid, ts, eid, amt in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last, n, s, sess = state.get(cid, (None, 0, 0.0, 0))
        if last is None or (ts - last).total_seconds() >= ttl:
            n, s, sess = 0, 0.0, sess + 1
        n, s = n + 1, s + amt
        state[cid] = (ts, n, s, sess)
        out[eid] = (sess, n, round(s, 6))
    return out


def test_event_exactly_ttl_later_starts_a_new_session(spark):
    rows = [(1, T0, 1, 1.0), (1, T0 + dt.timedelta(seconds=59, microseconds=999999), 2, 1.0),
            (1, T0 + dt.timedelta(seconds=119, microseconds=999998), 3, 1.0),
            (1, T0 + dt.timedelta(seconds=179, microseconds=999998), 4, 1.0)]
    got = {r["event_id"]: (r["session_no"], r["velocity"])
           for r in SF.velocity_count(_events(spark, rows), ["customer_id"], ttl_seconds=60,
                                      order=["event_id"]).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (2, 1)}


def test_hot_key_across_many_chunks_matches_python_fold(spark):
    # one customer holds far more than a third of the events, spread over many time chunks
    rnd = random.Random(1)
    rows, t, eid = [], T0, 0
    for _ in range(3000):
        t = t + dt.timedelta(seconds=rnd.choice([5, 30, 400, 3600, 7200, 90000]))
        eid += 1
        rows.append((7, t, eid, float(rnd.randint(1, 9))))
    for c in range(20):
        for k in range(10):
            eid += 1
            rows.append((100 + c, T0 + dt.timedelta(hours=k * c), eid, 1.0))
    df = _events(spark, rows)
    got = SF.session_running(df, ["customer_id"], "ts", 3600, {"amt": F.col("amount")}, order=["event_id"])
    got = {r["event_id"]: (r["session_no"], r["running_n"], round(r["running_amt"], 6)) for r in got.collect()}
    assert got == _py_sessions(rows, 3600)


def test_density_sized_chunks_match_python_fold(spark):
    # the range cut splits keys into many pieces: carries must still be exact
    rnd = random.Random(6)
    rows, eid = [], 0
    for cid in (1, 2, 3):
        t = T0
        for _ in range(700 if cid == 1 else 50):
            t = t + dt.timedelta(seconds=rnd.choice([1, 20, 90, 700, 4000]))
            eid += 1
            rows.append((cid, t, eid, float(rnd.randint(1, 5))))
    got = SF.session_running(_events(spark, rows), ["customer_id"], "ts", 600, {"amt": F.col("amount")},
                             order=["event_id"])
    got = {r["event_id"]: (r["session_no"], r["running_n"], round(r["running_amt"], 6)) for r in got.collect()}
    assert got == _py_sessions(rows, 600)


def _py_ledger(events):
    out, st = {}, {}
    for cid, ts, eid, kind, amt in sorted(events, key=lambda r: (r[0], r[1], r[2])):
        lim, drw = st.get(cid, (0.0, 0.0))
        if kind == "approve":
            lim += amt
            res = lim
        elif drw + amt > lim:
            res = -1.0
        else:
            drw += amt
            res = drw
        st[cid] = (lim, drw)
        out[eid] = (res, lim, drw)
    return out


def test_check_and_draw_matches_fold_and_never_overdraws(spark):
    rnd = random.Random(4)
    ev = [(rnd.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(minutes=i), i,
           rnd.choice(["approve", "draw", "draw"]), float(rnd.randint(1, 50))) for i in range(2000)]
    df = spark.createDataFrame(ev, "customer_id long, ts timestamp_ntz, event_id long, kind string, amount double")
    got = SF.check_and_draw(df).collect()
    want = _py_ledger(ev)
    assert {r["event_id"]: (r["result"], r["limit"], r["drawn"]) for r in got} == want
    assert all(r["drawn"] <= r["limit"] + 1e-9 for r in got)
    snap = {r["customer_id"]: r for r in SF.exposure_snapshot(SF.check_and_draw(df)).collect()}
    for cid, r in snap.items():
        assert abs(r["available"] - (r["limit"] - r["drawn"])) < 1e-9


def test_stream_form_equals_batch_form(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(1, 5), T0 + dt.timedelta(seconds=rnd.randint(0, 40 * 3600)), i, float(rnd.randint(1, 9)))
            for i in range(600)]
    df = _events(spark, rows).withColumn("bucket", F.lit("x"))
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    ST.replay(df, "ts", base, lambda s: ST.velocity_stream(s, ["customer_id"], ttl_seconds=1800),
              ST.file_sink(base + "/out"))
    stream = {r["event_id"]: (r["session_no"], r["velocity"], round(r["velocity_amount"], 6))
              for r in spark.read.parquet(base + "/out").collect()}
    batch = {r["event_id"]: (r["session_no"], r["velocity"], round(r["velocity_amount"], 6))
             for r in SF.velocity_amount(SF.velocity_count(df, ["customer_id"], ttl_seconds=1800, order=["event_id"])
                                         .withColumnRenamed("velocity", "v0"), ["customer_id"],
                                         ttl_seconds=1800, order=["event_id"])
             .withColumnRenamed("v0", "velocity").collect()}
    assert stream == batch


def test_null_keys_and_times_are_kept(spark):
    rows = [(None, T0, 1, 1.0), (None, T0 + dt.timedelta(seconds=10), 2, 2.0), (1, T0, 3, 3.0), (1, None, 4, 4.0),
            (None, None, 5, 5.0), (None, T0 + dt.timedelta(seconds=500), 6, None)]
    ev = _events(spark, rows)
    got = {r.event_id: (r.session_no, r.velocity) for r in SF.velocity_count(ev, ["customer_id"], ttl_seconds=60).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (None, None), 5: (None, None), 6: (2, 1)}
    amounts = {r.event_id: r.velocity_amount for r in SF.velocity_amount(ev, ["customer_id"], ttl_seconds=60).collect()}
    assert amounts == {1: 1.0, 2: 3.0, 3: 3.0, 4: None, 5: None, 6: None}
    flags = {r.event_id: r.rejected for r in SF.rate_limit_flag(ev, ["customer_id"], ttl_seconds=60, limit=1).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: None, 5: None, 6: False}
    dev = spark.createDataFrame([(None, 1, T0, 1), (None, None, T0, 2), (None, None, T0, 3), (5, 1, None, 4)],
                                "device_id long, customer_id long, ts timestamp_ntz, event_id long")
    got = {r.event_id: (r.is_new, r.n_customers) for r in SF.device_sharing(dev, order=["event_id"]).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (0, 2), 4: (None, None)}


def test_ledger_takes_null_customers_and_amounts(spark):
    rows = [(None, T0, 1, "approve", 10.0), (None, T0 + dt.timedelta(1), 2, "draw", 4.0), (None, T0 + dt.timedelta(2), 3, "draw", 7.0),
            (1, T0, 4, "approve", None), (1, T0 + dt.timedelta(1), 5, "draw", 1.0)]
    df = spark.createDataFrame(rows, "customer_id long, ts timestamp_ntz, event_id long, kind string, amount double")
    got = {r.event_id: (r.customer_id, r.result) for r in SF.check_and_draw(df).collect()}
    assert got == {1: (None, 10.0), 2: (None, 4.0), 3: (None, -1.0), 4: (1, 0.0), 5: (1, -1.0)}


def test_bursty_hot_key_is_cut_evenly(spark):
    """All but ten of one key's events fall in a thousandth of its time span."""
    from riskframe.operators.keys import range_pieces
    rows = [(7, T0 + dt.timedelta(seconds=i), i, 1.0) for i in range(8000)]
    rows += [(7, T0 + dt.timedelta(days=100 + i), 9000 + i, 1.0) for i in range(10)]
    n = [r["count"] for r in range_pieces(_events(spark, rows), ["customer_id", "ts"], "_c").groupBy("_c").count().collect()]
    assert len(n) > 1 and max(n) <= 2 * sum(n) / len(n)


# ------------------------------------------------------------------ one fold for batch and stream

class _State:
    """What a stream fold needs of its state."""

    hasTimedOut = False

    def __init__(self):
        self.value, self.timeout = None, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, t):
        self.timeout = t


def _folded(fn, pdf, cut):
    """Rows of a key given to a stream fold in two micro-batches."""
    import pandas as pd
    state = _State()
    return pd.concat([x for part in (pdf[:cut], pdf[cut:]) for x in fn(("k",), iter([part]), state)])


class _Handle:
    """The handle and the state variables that ``DeviceSets`` needs, in memory."""

    def __init__(self):
        self.timers, self.value, self.entries, self.asked = set(), None, {}, 0

    getValueState = getMapState = lambda self, *_: _Handle()
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.remove(t)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.entries = None, {}

    def containsKey(self, key):
        self.asked += 1
        return key in self.entries

    def updateValue(self, key, value):
        self.entries[key] = value


def _device_sets(ttl_us):
    from riskframe.streaming.stateful_stream import DeviceSets
    sets = DeviceSets(ttl_us)
    sets.init(_Handle())
    return sets


def test_device_sets_read_only_the_customers_named():
    """A device of many customers: a later micro-batch asks the store for its own customers, once each."""
    import pandas as pd
    sets = _device_sets(10**9)
    first = pd.DataFrame({"micros": range(20000), "ts": pd.NaT, "event_id": range(20000), "device": "1",
                          "customer": [str(c) for c in range(20000)]})
    list(sets.handleInputRows((1,), iter([first[:9000], first[9000:]]), None))
    assert len(sets.members.entries) == 20000
    sets.members.asked = 0
    later = pd.DataFrame({"micros": range(30000, 30006), "ts": pd.NaT, "event_id": range(6), "device": "1",
                          "customer": ["5", "5", "20001", "5", "20001", "19999"]})
    out = pd.concat(sets.handleInputRows((1,), iter([later]), None))
    assert out["is_new"].tolist() == [0, 0, 1, 0, 0, 0] and out["n_customers"].tolist() == [20000] * 2 + [20001] * 4
    assert sets.members.asked == 3


def test_device_stream_with_nulls_equals_batch(spark):
    """Through Spark's state store, over several micro-batches and past the TTL."""
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, *range(12)]), T0 + dt.timedelta(minutes=rnd.randrange(6000)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "device_id long, customer_id long, ts timestamp_ntz, event_id long")
    ttl = 3 * 3600
    want = {r.event_id: (r.is_new, r.n_customers) for r in SF.device_sharing(df, ttl_seconds=ttl, order=["event_id"]).collect()}
    base = scratch_path(spark, f"devices-{uuid.uuid4().hex}")
    before = spark.conf.get(ST.STATE_STORE, None)
    with ST.rocksdb_state(spark):
        ST.replay(df, "ts", base, lambda s: ST.device_sharing_stream(s, ttl_seconds=ttl), ST.file_sink(f"{base}/out"))
    assert spark.conf.get(ST.STATE_STORE, None) == before
    out = spark.read.parquet(f"{base}/out").collect()
    assert {r.event_id: (r.is_new, r.n_customers) for r in out} == want and len(out) == len(rows)


def test_stream_folds_keep_null_times_customers_and_amounts():
    import pandas as pd
    from riskframe.streaming import stateful_stream as SS
    day = 86_400_000_000
    t = [None, 0, day, day, 10 * day, 11 * day]
    base = pd.DataFrame({"_t": pd.array(t, dtype="Int64"), "ts": pd.NaT, "event_id": range(6), "bucket": None, "device_id": 1,
                         "customer_id": pd.array([7, None, 7, None, None, 8], dtype="Int64"),
                         "amount": [1.0, 2.0, None, 4.0, None, 5.0]})
    # rows without a time land first, as in the given order
    got = _folded(SS._velocity_fn(2 * day), base, 3)
    rows = {r.event_id: r for r in got.itertuples()}
    none = lambda v: None if pd.isna(v) else v
    assert [none(rows[i].session_no) for i in range(6)] == [None, 1, 1, 1, 2, 2]
    assert [none(rows[i].velocity) for i in range(6)] == [None, 1, 2, 3, 1, 2]
    assert [none(rows[i].velocity_amount) for i in range(6)] == [None, 2.0, 2.0, 6.0, None, 5.0]
    sets = _device_sets(2 * day)
    base = base.assign(micros=base["_t"], device="1", customer=["7", None, "7", None, None, "8"])
    got = pd.concat([x for part in (base[:3], base[3:]) for x in sets.handleInputRows((1,), iter([part]), None)])
    got = {r.event_id: r for r in got.itertuples()}
    assert sets.handle.timers == {11 * day // 1000 + 2 * day // 1000} and sets.device.value == (11 * day, 2)
    sets.handleExpiredTimer((1,), None, None)
    assert not sets.device.exists() and not sets.members.entries
    assert [none(got[i].is_new) for i in range(6)] == [None, 1, 1, 0, 1, 1]
    assert [none(got[i].n_customers) for i in range(6)] == [None, 1, 2, 2, 1, 2]


def test_ledger_is_one_fold(spark):
    """Batch and stream ledgers agree row by row on NULL amounts and customers."""
    import pandas as pd
    from riskframe.operators import stateful as SO
    from riskframe.streaming import stateful_stream as SS
    rows = [(1, k, kind, amount) for k, (kind, amount) in enumerate(
        [("approve", 10.0), ("draw", None), ("draw", 4.0), ("approve", None), ("draw", 7.0), ("draw", 6.0)])]
    rows += [(None, 10 + k, kind, amount) for k, (kind, amount) in enumerate([("draw", 1.0), ("approve", 3.0), ("draw", 2.0)])]
    df = spark.createDataFrame(rows, "customer_id long, event_id long, kind string, amount double").selectExpr(
        "customer_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "event_id", "kind", "amount")
    batch = {r.event_id: (r.result, r.limit, r.drawn) for r in SO.check_and_draw(df).collect()}
    assert batch[5] == (10.0, 10.0, 10.0) and batch[4] == (-1.0, 10.0, 4.0) and batch[1] == (0.0, 10.0, 0.0) and batch[12] == (2.0, 3.0, 2.0)
    pdf = df.toPandas()
    for own in (pdf[pdf["customer_id"].notna()], pdf[pdf["customer_id"].isna()]):
        state = _State()
        for part in (own[:2], own[2:]):
            for out in SS._ledger_fn(("k",), iter([part]), state):
                assert all((r.result, r.limit, r.drawn) == batch[r.event_id] for r in out.itertuples())


# ------------------------------------------------------------------ score cache in pieces

def _py_cache(rows, ttl):
    """Plain fold: (payload, time in micros or None, id) -> ids that are scored."""
    stamp, scored = {}, set()
    for p, t, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if t is None:
            scored.add(i)
        elif p not in stamp or t >= stamp[p] + ttl:
            stamp[p] = t
            scored.add(i)
    return scored


def _requests(spark, rows):
    df = spark.createDataFrame([(p, None if t is None else t, i) for p, t, i in rows], "p string, t long, event_id long")
    return df.selectExpr("p", "CAST(timestamp_micros(t) AS timestamp_ntz) AS ts", "event_id")


def test_cache_steps_equal_the_fold_for_every_entry():
    import numpy as np
    rnd = random.Random(5)
    for _ in range(400):
        ttl = rnd.choice([1, 2, 5, 9, 40])
        times = np.array(sorted(rnd.choices(range(50, 50 + rnd.choice([3, 20, 100])), k=rnd.randint(1, 25))), dtype=np.int64)
        steps = SF.cache_steps(times, ttl)
        assert [lo for lo, _ in steps] == sorted({lo for lo, _ in steps}) and steps[0][0] == SF.NEVER
        for entry in [SF.NEVER, *range(0, int(times[0]) + 1)]:
            exit_ = [ex for lo, ex in steps if lo <= entry][-1]
            assert (entry if exit_ is None else exit_) == SF.cache_step(times, entry, ttl)[1]


def test_hot_payload_is_scored_by_many_tasks(spark):
    """Half of all requests are one payload: its pieces lie on many tasks, bursts, pauses and equal
    times cross their ends, and the flags equal a plain fold."""
    rnd = random.Random(11)
    ttl, rows, t = 600_000_000, [], 1_704_067_200_000_000
    for i in range(6000):
        t += rnd.choice([0, 0, 1, 1_000_000, 37_000_000, 599_999_999, 600_000_000] if i % 2000 < 60 else [0, 1, 7_000_000])
        rows.append(("hot", t, i))
    rows += [(None if k % 50 == 0 else f"p{k % 900}", 1_704_067_200_000_000 + rnd.randrange(4000) * 1_000_000, 6000 + k) for k in range(6000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        out = SF.score_once_cache(_requests(spark, rows), F.col("p")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(out) == len(rows)
    assert {r.event_id for r in out if r.computed} == _py_cache(rows, ttl)
    assert len({r.task for r in out if r.fingerprint == "hot"}) >= 8


def test_score_cache_awkward_rows(spark):
    t = 1_704_067_200_000_000
    rows = [("a", None, 1), ("a", t, 2), ("a", t, 3), ("a", t + 599_999_999, 4), ("a", t + 600_000_000, 5), ("a", None, 6),
            (None, t, 7), (None, t + 1, 8), ("", t, 9)]
    got = {r.event_id: r.computed for r in SF.score_once_cache(_requests(spark, rows), F.col("p")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True, 8: False, 9: True}
    assert SF.score_once_cache(_requests(spark, []), F.col("p")).collect() == []
    always = SF.score_once_cache(_requests(spark, rows), F.col("p"), ttl_seconds=0).collect()
    assert len(always) == len(rows) and all(r.computed for r in always)


def test_score_cache_is_one_fold():
    import pandas as pd
    from riskframe.streaming import stateful_stream as SS
    pdf = pd.DataFrame({"_t": pd.array([None, 0, 5, 10, 14, 20], dtype="Int64"), "payload": "a", "ts": pd.NaT, "event_id": range(6)})
    got = {r.event_id: r.computed for r in _folded(SS._cache_fn(10), pdf, 3).itertuples()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


# ------------------------------------------------------------------ streams by groups of keys

def _keyed(rows, cut):
    """Rows (key, time, id, amount) of many keys as a stream fold gets a group, in two micro-batches."""
    import pandas as pd
    pdf = pd.DataFrame({"_k": [str(k) for k, *_ in rows], "_t": pd.array([t for _, t, *_ in rows], dtype="Int64"), "ts": pd.NaT,
                        "event_id": [str(i) for _, _, i, _ in rows], "customer_id": [None if k is None else str(k) for k, *_ in rows],
                        "bucket": None, "payload": [k for k, *_ in rows], "kind": ["approve" if i % 3 else "draw" for _, _, i, _ in rows],
                        "amount": [a for *_, a in rows]})
    return pdf[:cut], pdf[cut:]


def test_a_call_folds_all_keys_of_a_group():
    """One call serves many keys, each from its own state, and whole ids stay exact beside a NULL."""
    import pandas as pd
    from riskframe.streaming import stateful_stream as SS
    rnd = random.Random(6)
    t, rows = 0, []
    for i in range(600):
        t += rnd.choice([0, 1, 4])
        rows.append((rnd.choice([None, (1 << 60) + 1, *range(30)]), t, (1 << 60) + i, rnd.choice([None, 1.0, 2.0])))
    rows = [(None, None, 1, 1.0), (5, None, 2, 1.0), *rows]
    want_n, want_cache, state, stamp = {}, set(), {}, {}
    for k, when, i, _ in rows:
        if when is None:
            want_n[i] = (None, None)
            want_cache.add(i)
            continue
        last, n, sess = state.get(k, (None, 0, 0))
        n, sess = (1, sess + 1) if last is None or when - last >= 40 else (n + 1, sess)
        state[k] = (when, n, sess)
        want_n[i] = (sess, n)
        if k not in stamp or when >= stamp[k] + 40:
            stamp[k] = when
            want_cache.add(i)
    none = lambda v: None if pd.isna(v) else int(v)
    kept = _State()
    got = pd.concat([x for part in _keyed(rows, 301) for x in SS._velocity_fn(40)(("g",), iter([part]), kept)])
    assert {int(i): (none(s), none(n)) for i, s, n in zip(got["event_id"], got["session_no"], got["velocity"])} == want_n
    assert {int(i): none(c) for i, c in zip(got["event_id"], got["customer_id"])} == {i: k for k, _, i, _ in rows}
    kept = _State()
    got = pd.concat([x for part in _keyed(rows, 301) for x in SS._cache_fn(40)(("g",), iter([part]), kept)])
    assert {int(i) for i, c in zip(got["event_id"], got["computed"]) if c} == want_cache
    assert kept.timeout is not None and len(SS._known(kept)) <= 32


def test_grouped_streams_equal_batch_in_spark(spark):
    """Many keys to a group, NULL keys, ids beyond doubles, several micro-batches; the table is staged by one write."""
    import os
    rnd = random.Random(9)
    rows = [(rnd.choice([None, (1 << 60) + 1, *range(40)]), T0 + dt.timedelta(seconds=rnd.randrange(90_000)), (1 << 60) + i,
             rnd.choice(["approve", "draw"]), rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(800)]
    df = spark.createDataFrame(rows, "customer_id long, ts timestamp_ntz, event_id long, kind string, amount double")
    df = df.withColumn("bucket", F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 4).cast("string")))

    def stream(name, build):
        base = scratch_path(spark, f"groups-{name}-{uuid.uuid4().hex}")
        ST.replay(df, "ts", base, build, ST.file_sink(f"{base}/out"))
        assert os.path.exists(f"{base}/staging/_SUCCESS")
        return spark.read.parquet(f"{base}/out")

    pick = lambda out, *cols: sorted(map(repr, out.select("customer_id", "event_id", *cols).collect()))
    got = stream("velocity", lambda s: ST.velocity_stream(s, ["customer_id", "bucket"], ttl_seconds=3600, groups=3))
    want = SF.velocity_amount(df, ["customer_id", "bucket"], ttl_seconds=3600, order=["event_id"])
    assert pick(got, "bucket", "session_no", "velocity_amount") == pick(want, "bucket", "session_no", "velocity_amount")
    got = stream("ledger", lambda s: ST.ledger_stream(s, 3))
    assert pick(got, "amount", "result", "limit", "drawn") == pick(SF.check_and_draw(df), "amount", "result", "limit", "drawn")
    payload = df.withColumn("payload", F.col("customer_id").cast("string"))
    got = stream("cache", lambda s: ST.score_cache_stream(s.withColumn("payload", F.col("customer_id").cast("string")), "payload", 600, groups=3))
    want = SF.score_once_cache(payload, F.col("payload"))
    assert {r.event_id: r.computed for r in got.collect()} == {r.event_id: r.computed for r in want.collect()}
