"""Keyed counters, exposure ledger, profiles, score cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import expressions as X
from riskframe.operators import stateful as SF
from riskframe.plans import fixtures_sql as S
from riskframe.plans.catalog import edge, query
from riskframe.sources import adapters as A

col = F.col


def _sessions_sql(keys: str, ttl_us: int, src: str = "requests") -> str:
    return f"""r AS (SELECT *, LAG(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS prev FROM {src}),
s AS (SELECT *, SUM(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= {ttl_us} THEN 1 ELSE 0 END)
          OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM r)"""


DAY = 86400


@query("velocity_count", S.with_(S.REQUESTS + ",\n" + _sessions_sql("customer_id, bucket", 2 * DAY * 10**6), """
SELECT customer_id, bucket, ts, event_id, CAST(session_no AS BIGINT) AS session_no,
       ROW_NUMBER() OVER (PARTITION BY customer_id, bucket, session_no ORDER BY ts, event_id) AS velocity FROM s"""))
def q_velocity_count(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "bucket", "ts", "event_id")
    return SF.velocity_count(r, ["customer_id", "bucket"], ttl_seconds=2 * DAY, order=["event_id"])


@query("velocity_amount", S.with_(S.REQUESTS + ",\n" + _sessions_sql("customer_id", DAY * 10**6), """
SELECT customer_id, ts, event_id, CAST(session_no AS BIGINT) AS session_no,
       ROUND(SUM(amount) OVER (PARTITION BY customer_id, session_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS velocity_amount
FROM s"""))
def q_velocity_amount(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "ts", "event_id", "amount")
    out = SF.velocity_amount(r, ["customer_id"], ttl_seconds=DAY, order=["event_id"])
    return edge(out.select("customer_id", "ts", "event_id", "session_no", "velocity_amount"))


@query("velocity_amount_bucket", S.with_(S.REQUESTS + ",\n" + _sessions_sql("customer_id, bucket", 2 * DAY * 10**6), """
SELECT customer_id, bucket, ts, event_id, CAST(session_no AS BIGINT) AS session_no,
       ROUND(SUM(amount) OVER (PARTITION BY customer_id, bucket, session_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS velocity_amount
FROM s"""))
def q_velocity_amount_bucket(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "bucket", "ts", "event_id", "amount")
    out = SF.velocity_amount(r, ["customer_id", "bucket"], ttl_seconds=2 * DAY, order=["event_id"])
    return edge(out.select("customer_id", "bucket", "ts", "event_id", "session_no", "velocity_amount"))


def _rate_sql(ttl: int, limit: int) -> str:
    return S.with_(S.REQUESTS + ",\n" + _sessions_sql("customer_id", ttl * 10**6), f"""
SELECT customer_id, ts, event_id, velocity, velocity > {limit} AS rejected FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, session_no ORDER BY ts, event_id) AS velocity FROM s)""")


@query("rate_limit_flag", _rate_sql(60, 100))
def q_rate_limit(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "ts", "event_id")
    return SF.rate_limit_flag(r, ["customer_id"], ttl_seconds=60, limit=100, order=["event_id"]) \
        .select("customer_id", "ts", "event_id", "velocity", "rejected")


@query("rate_limit_flag_daily", _rate_sql(DAY, 5))
def q_rate_limit_daily(spark, sf):
    r = A.requests(spark, sf).select("customer_id", "ts", "event_id")
    return SF.rate_limit_flag(r, ["customer_id"], ttl_seconds=DAY, limit=5, order=["event_id"]) \
        .select("customer_id", "ts", "event_id", "velocity", "rejected")


@query("device_sharing_stream", S.with_(S.REQUESTS + ",\n" + _sessions_sql("device_id", 7 * DAY * 10**6), """
SELECT device_id, customer_id, ts, event_id, is_new,
       SUM(is_new) OVER (PARTITION BY device_id, session_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_customers
FROM (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY device_id, session_no, customer_id ORDER BY ts, event_id) = 1
                     THEN 1 ELSE 0 END AS is_new FROM s)"""))
def q_device_sharing_stream(spark, sf):
    r = A.requests(spark, sf).select("device_id", "customer_id", "ts", "event_id")
    out = SF.device_sharing(r, order=["event_id"])
    return out.select("device_id", "customer_id", "ts", "event_id", "is_new", col("n_customers").cast("long"))


_LEDGER = "WITH RECURSIVE " + S.EXPOSURE_EVENTS + """,
ev AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS rn FROM exposure_events),
st AS (
  SELECT customer_id, rn, ts, event_id, kind, amount,
    CASE WHEN kind = 'approve' THEN amount ELSE 0.0 END AS lim,
    CASE WHEN kind = 'draw' AND amount <= 0.0 THEN amount ELSE 0.0 END AS drawn,
    CASE WHEN kind = 'approve' THEN amount WHEN amount > 0.0 THEN -1.0 ELSE amount END AS result
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.customer_id, e.rn, e.ts, e.event_id, e.kind, e.amount,
    CASE WHEN e.kind = 'approve' THEN s.lim + e.amount ELSE s.lim END,
    CASE WHEN e.kind = 'draw' AND s.drawn + e.amount <= s.lim THEN s.drawn + e.amount ELSE s.drawn END,
    CASE WHEN e.kind = 'approve' THEN s.lim + e.amount WHEN s.drawn + e.amount > s.lim THEN -1.0 ELSE s.drawn + e.amount END
  FROM st s JOIN ev e ON e.customer_id = s.customer_id AND e.rn = s.rn + 1)
"""


@query("check_and_draw", _LEDGER + """SELECT customer_id, ts, event_id, kind, ROUND(amount, 6) AS amount,
  ROUND(result, 6) AS result, ROUND(lim, 6) AS "limit", ROUND(drawn, 6) AS drawn FROM st""")
def q_check_and_draw(spark, sf):
    return edge(SF.check_and_draw(A.exposure_events(spark, sf)))


@query("exposure_snapshot", _LEDGER + """SELECT customer_id, ROUND(lim, 6) AS "limit", ROUND(drawn, 6) AS drawn,
  ROUND(lim - drawn, 6) AS available FROM st WHERE (customer_id, rn) IN (SELECT customer_id, MAX(rn) FROM ev GROUP BY 1)""")
def q_exposure_snapshot(spark, sf):
    return edge(SF.exposure_snapshot(SF.check_and_draw(A.exposure_events(spark, sf))))


@query("wal_append_rows", _LEDGER + """SELECT customer_id AS cid, ROUND(amount, 6) AS amount, ROUND(result, 6) AS new_drawn,
  ts AS at FROM st WHERE kind = 'draw' AND result >= 0""")
def q_wal(spark, sf):
    return edge(SF.wal_rows(SF.check_and_draw(A.exposure_events(spark, sf))))


@query("hourly_decisions", S.with_(S.REQUESTS, """
SELECT hour, ROUND(SUM(amount), 6) AS total, COUNT(*) AS n_decisions, strftime(hour, '%Y-%m-%dT%H') AS hour_key
FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, amount FROM requests
      WHERE ts >= date_trunc('hour', TIMESTAMP '2024-01-30 12:30:00' - INTERVAL 48 HOUR))
GROUP BY hour"""))
def q_hourly(spark, sf):
    return edge(SF.hourly_decisions(A.requests(spark, sf), "amount", as_of="2024-01-30 12:30:00"))


@query("hourly_decisions_all", S.with_(S.REQUESTS, """
SELECT hour, ROUND(SUM(amount), 6) AS total, COUNT(*) AS n_decisions, strftime(hour, '%Y-%m-%dT%H') AS hour_key
FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, amount FROM requests) GROUP BY hour"""))
def q_hourly_all(spark, sf):
    return edge(SF.hourly_decisions(A.requests(spark, sf), "amount"))


_PROFILE_SRC = """upd AS (SELECT user_id AS customer_id, ts, event_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS last_type,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS last_value FROM events)"""


@query("latest_profile", "WITH " + _PROFILE_SRC + """
SELECT customer_id, arg_max(last_type, (ts, event_id)) FILTER (WHERE last_type IS NOT NULL) AS last_type,
       ROUND(arg_max(last_value, (ts, event_id)) FILTER (WHERE last_value IS NOT NULL), 6) AS last_value,
       MAX(ts) AS last_update
FROM upd GROUP BY customer_id HAVING MAX(ts) > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 86400 SECOND""")
def q_latest_profile(spark, sf):
    from riskframe.sources.tables import table
    e = table(spark, sf, "events", ["user_id", "ts", "event_id", "event_type", "value"])
    upd = e.select(col("user_id").alias("customer_id"), "ts", "event_id",
                   F.when(col("event_type") == "error", None).otherwise(col("event_type")).alias("last_type"),
                   F.when(col("event_id") % 3 == 0, None).otherwise(col("value")).alias("last_value"))
    return edge(SF.latest_profile(upd, "customer_id", ["last_type", "last_value"], order=["event_id"],
                                  as_of="2024-01-31 00:00:00", ttl_seconds=86400))


_CACHE = "WITH RECURSIVE " + S.REQUESTS + """,
ev AS (SELECT fp, ts, event_id, epoch_us(ts) AS t, ROW_NUMBER() OVER (PARTITION BY fp ORDER BY ts, event_id) AS rn
       FROM (SELECT *, CAST(customer_id AS VARCHAR) || '|' || bucket AS fp FROM requests)),
st AS (
  SELECT fp, rn, ts, event_id, t AS stamp, true AS computed FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.fp, e.rn, e.ts, e.event_id,
         CASE WHEN e.t >= s.stamp + 600000000 THEN e.t ELSE s.stamp END,
         e.t >= s.stamp + 600000000
  FROM st s JOIN ev e ON e.fp = s.fp AND e.rn = s.rn + 1)
"""


def payload():
    """What is scored: a customer's request of one kind."""
    return F.concat_ws("|", col("customer_id").cast("string"), "bucket")


@query("score_once_cache", _CACHE + "SELECT fp AS payload, ts, event_id, computed FROM st")
def q_score_cache(spark, sf):
    r = A.requests(spark, sf)
    out = SF.score_once_cache(r, payload(), ttl_seconds=600)
    return out.withColumnRenamed("fingerprint", "payload")


@query("score_once_cache_counts", _CACHE + """SELECT COUNT(*) FILTER (WHERE computed) AS scored,
       COUNT(*) FILTER (WHERE NOT computed) AS cache_hits FROM st""")
def q_score_cache_counts(spark, sf):
    r = A.requests(spark, sf)
    fp = X.payload_fingerprint(["customer_id", "bucket"])
    out = SF.score_once_cache(r.withColumn("fp", fp), col("fp"), ttl_seconds=600)
    return out.agg(F.count_if(col("computed")).alias("scored"), F.count_if(~col("computed")).alias("cache_hits"))


@query("request_metrics", S.with_(S.REQUESTS, """
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, bucket, COUNT(*) AS requests,
       ROUND(SUM(amount / 100.0), 6) AS latency_sum, """ + ", ".join(
    f"COUNT(*) FILTER (WHERE amount / 100.0 <= {b}) AS le_{str(b).replace('.', '_')}" for b in
    [round(0.1 * i, 1) for i in range(11)]) + """
FROM requests GROUP BY 1, 2"""))
def q_request_metrics(spark, sf):
    r = A.requests(spark, sf).withColumn("latency", col("amount") / 100.0)
    return edge(SF.request_metrics(r, ["bucket"], "latency"))
