"""The adapters of ``riskframe.sources.adapters`` written again in plain SQL.

These CTEs run in DuckDB over the driver's views and are the independent
half of the oracle check: the Spark side is DataFrame code, this side is
SQL text, and both must give the same rows.
"""

from __future__ import annotations

PER_ORDER = """per_order AS (
  SELECT l_orderkey,
    COUNT(CASE WHEN l_returnflag = 'A' AND l_quantity >= 45 THEN 1 END) AS m_missed,
    COUNT(CASE WHEN l_linestatus = 'O' AND l_quantity >= 45 THEN 1 END) AS m_delinq,
    COUNT(CASE WHEN l_returnflag = 'R' AND l_quantity >= 40 THEN 1 END) AS m_30p,
    COUNT(CASE WHEN l_returnflag = 'R' AND l_quantity >= 48 THEN 1 END) AS m_60p,
    COUNT(CASE WHEN l_linestatus = 'O' AND l_quantity >= 49 THEN 1 END) AS m_d6,
    COUNT(CASE WHEN l_linestatus = 'O' AND l_quantity >= 47 THEN 1 END) AS m_d12,
    MAX(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS m_maxdel,
    COUNT(CASE WHEN l_discount <= 0.02 THEN 1 END) AS m_std,
    COUNT(CASE WHEN l_discount >= 0.09 AND l_returnflag = 'N' THEN 1 END) AS m_sub,
    COUNT(CASE WHEN l_discount >= 0.1 AND l_returnflag = 'A' THEN 1 END) AS m_dbt,
    COUNT(CASE WHEN l_discount >= 0.1 AND l_returnflag = 'R' THEN 1 END) AS m_lss
  FROM lineitem GROUP BY l_orderkey)"""

PER_CUST = """per_cust AS (
  SELECT o_custkey,
    COUNT(*) AS total_tl,
    COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS tot_closed_tl,
    COUNT(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS tot_active_tl,
    COUNT(CASE WHEN o_orderdate >= TIMESTAMP '2001-02-01' THEN 1 END) AS total_tl_opened_l6m,
    COUNT(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 END) AS secured_tl,
    COUNT(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 1 END) AS unsecured_tl,
    COUNT(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS tot_enq,
    COUNT(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0 THEN 1 END) AS enq_l3m,
    COUNT(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS enq_l12m,
    COUNT(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 3 = 0 THEN 1 END) AS cc_enq_l6m,
    COUNT(CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 3 = 0 THEN 1 END) AS pl_enq_l6m,
    SUM(m_missed) AS tot_missed_pmnt, SUM(m_delinq) AS num_times_delinquent,
    MAX(m_maxdel) AS max_delinquency_level,
    SUM(m_30p) AS num_times_30p_dpd, SUM(m_60p) AS num_times_60p_dpd,
    SUM(m_d6) AS num_deliq_6mts, SUM(m_d12) AS num_deliq_12mts,
    SUM(m_std) AS num_std, SUM(m_sub) AS num_sub, SUM(m_dbt) AS num_dbt, SUM(m_lss) AS num_lss,
    MAX(o_orderdate) AS created_at
  FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey
  GROUP BY o_custkey)"""

_COUNTS = ["total_tl", "tot_closed_tl", "tot_active_tl", "total_tl_opened_l6m", "secured_tl",
           "unsecured_tl", "tot_missed_pmnt", "num_times_delinquent", "num_times_30p_dpd",
           "num_times_60p_dpd", "num_deliq_6mts", "num_deliq_12mts", "num_std", "num_sub",
           "num_dbt", "num_lss", "tot_enq", "enq_l3m", "enq_l12m", "cc_enq_l6m", "pl_enq_l6m"]


def _pick(key: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} {whens} END"


_EDU = ["SSC", "12TH", "GRADUATE", "UNDER GRADUATE", "POST-GRADUATE"]
_PROD = ["PL", "CC", "ConsumerLoan", "AL", "HL", "others", None]

APPLICANTS = f"""{PER_ORDER},
{PER_CUST},
applicants AS (
  SELECT c_custkey AS prospectid,
    CAST(CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE 21 + (c_custkey * 7) % 45 END AS INTEGER) AS age,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
    CASE WHEN c_nationkey % 3 = 0 THEN 'Single' ELSE 'Married' END AS maritalstatus,
    {_pick('c_nationkey % 5', _EDU)} AS education,
    CAST(FLOOR(c_acctbal * 5) AS INTEGER) AS netmonthlyincome,
    CAST(CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE 469 + (c_custkey * 37) % 343 END AS INTEGER) AS credit_score,
    CASE WHEN c_custkey % 89 = 0 THEN NULL
         WHEN 469 + (c_custkey * 37) % 343 + (c_custkey * 13) % 61 - 30 > 701 THEN 'P1'
         WHEN 469 + (c_custkey * 37) % 343 + (c_custkey * 13) % 61 - 30 > 668 THEN 'P2'
         WHEN 469 + (c_custkey * 37) % 343 + (c_custkey * 13) % 61 - 30 > 637 THEN 'P3'
         ELSE 'P4' END AS approved_flag,
    {", ".join(f"CAST(COALESCE({c}, 0) AS INTEGER) AS {c}" for c in _COUNTS)},
    CAST(max_delinquency_level AS INTEGER) AS max_delinquency_level,
    CASE WHEN c_custkey % 53 = 0 THEN -99999.0::DOUBLE WHEN c_custkey % 59 = 0 THEN NULL
         ELSE CAST((c_custkey * 53) % 101 AS DOUBLE) END AS cc_utilization,
    CAST((c_custkey * 29) % 97 AS DOUBLE) AS pl_utilization,
    {_pick('(c_custkey * 5) % 7', _PROD)} AS first_prod_enq2,
    {_pick('(c_custkey * 11) % 7', _PROD)} AS last_prod_enq2,
    created_at
  FROM customer LEFT JOIN per_cust ON c_custkey = o_custkey)"""

_MODELS = [("logreg", 31, 1009, 400, 1409.0), ("forest", 17, 1009, 150, 1159.0),
           ("knn", 7, 11, 3, 14.0)]

SCORED = "scored AS (\n" + "\n  UNION ALL\n".join(
    f"""  SELECT o_orderkey AS row_id, '{name}' AS model,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         CAST((o_orderkey * {mult}) % {mod} + (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * {lift} AS DOUBLE) / {den} AS p,
         CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         o_orderdate AS scored_at
  FROM orders""" for name, mult, mod, lift, den in _MODELS) + ")"

MONITORING = SCORED + """,
monitoring AS (
  SELECT model AS model_name, MAX(scored_at) - to_days(ascii(model) % 7) AS scored_at,
    CAST((SUM(row_id * ascii(model) % 13) * 7 + COUNT(*)) % 100 AS DOUBLE) / 100.0 AS gini,
    CAST((SUM(row_id * ascii(model) % 11) * 3 + COUNT(*) * 7) % 100 AS DOUBLE) / 100.0 AS ks,
    CASE WHEN month(date_trunc('month', scored_at)) = 2 THEN NULL
         ELSE CAST((SUM(row_id * ascii(model) % 17) + COUNT(*)) % 40 AS DOUBLE) / 100.0 END AS psi,
    0.30::DOUBLE AS gini_min, 0.20::DOUBLE AS ks_min, 0.25::DOUBLE AS psi_max
  FROM scored GROUP BY model, date_trunc('month', scored_at))"""

MODEL_METRICS = SCORED + """,
mm_counts AS (
  SELECT model, COUNT(*) AS n,
    COUNT(CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1 END) AS correct,
    COUNT(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp,
    COUNT(CASE WHEN p >= 0.5 THEN 1 END) AS pp,
    COUNT(CASE WHEN y = 1 THEN 1 END) AS ap
  FROM scored GROUP BY model),
mm_pr AS (
  SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS prec,
            CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS rec FROM mm_counts),
model_metrics AS (
  SELECT model AS model_name, correct / n AS accuracy, prec AS precision, rec AS recall,
    CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1_score,
    (tp / GREATEST(ap, 1) + (n - pp - ap + tp) / GREATEST(n - ap, 1)) / 2 AS roc_auc
  FROM mm_pr)"""

_MC_MODELS = [("logreg", 31), ("forest", 17), ("knn", 5)]
_Y = "(LEAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 4) - 1)"


def _w(mult: int, c: int) -> str:
    return f"CAST((o_orderkey * {mult + c}) % 7 + CASE WHEN {_Y} = {c} THEN 6 ELSE 0 END + 1 AS DOUBLE)"


MULTICLASS = "mc AS (\n" + "\n  UNION ALL\n".join(
    f"""  SELECT o_orderkey AS row_id, '{name}' AS model, {_Y} AS y,
         [{', '.join(f"{_w(mult, c)} / ({' + '.join(_w(mult, d) for d in range(4))})" for c in range(4))}] AS probs
  FROM orders""" for name, mult in _MC_MODELS) + ")"

MC_PRED = MULTICLASS + """,
mcp AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS pred FROM mc)"""

MC_LONG = MC_PRED + """,
mcl AS (SELECT row_id, model, y, pred, generate_subscripts(probs, 1) - 1 AS cls, unnest(probs) AS p FROM mcp)"""

PORTFOLIO = """portfolio AS (
  SELECT o_orderkey AS loan_id, o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m') AS vintage,
    CAST((o_orderkey * 7) % 24 + 1 AS INTEGER) AS mob,
    CASE WHEN (o_orderkey * 13) % 100 < 6 THEN 1 ELSE 0 END AS dpd30_flag,
    CASE WHEN (o_orderkey * 17) % 100 < 3 THEN 1 ELSE 0 END AS first_payment_miss,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS approved_flag,
    CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' ELSE 'C' END AS decision_band
  FROM orders)"""

REQUESTS = """requests AS (
  SELECT user_id AS customer_id, event_type AS bucket, ts, event_id, value AS amount,
         (user_id * 7) % 41 AS device_id
  FROM events)"""

EXPOSURE_EVENTS = """exposure_events AS (
  SELECT user_id AS customer_id, ts, event_id,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'approve' ELSE 'draw' END AS kind,
         value AS amount
  FROM events)"""


# A generated report per document: prose, fenced or bare JSON, at times with keys
# missing, a key too many, a broken end, or no JSON at all; citations resolve in
# part.  The same expression runs in both engines (string concatenation only).
_ID = "CAST(doc_id AS STRING)"
_CITE = "'(doc_' || " + _ID + " || '.pdf p' || CAST(doc_id % 3 + 1 AS STRING) || ')'"
REPORT_TEXT = f"""CASE WHEN doc_id % 11 = 0 THEN 'Note ' || {_ID} ||
    ': no structured answer. Standard accounts stay. Sub-standard ones score 650-700; doubtful ones 500 to 650 go to loss. ' || {_CITE}
  ELSE CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) WHEN 1 THEN '' WHEN 2 THEN 'Summary follows. ' ELSE '  ```' || chr(10) END
    || '{{"summary": "Gini 0.' || CAST(doc_id % 90 + 10 AS STRING) || ' as in ' || {_CITE} || '"'
    || CASE WHEN doc_id % 5 <> 0 THEN ', "gini": 0.' || CAST(doc_id % 90 + 10 AS STRING) ELSE '' END
    || CASE WHEN doc_id % 6 <> 1 THEN ', "ks": 0.25' ELSE '' END
    || ', "psi": 0.1' || CAST(doc_id % 10 AS STRING) || ', "actions": ["Review (doc_1.pdf p1)", "Escalate"'
    || CASE WHEN doc_id % 2 = 0 THEN ', "Monitor (doc_9999999.pdf p2)"' ELSE '' END || ']'
    || CASE WHEN doc_id % 8 = 3 THEN ', "note": "extra"' ELSE '' END
    || CASE WHEN doc_id % 13 = 5 THEN '' ELSE '}}' END
    || CASE doc_id % 4 WHEN 0 THEN chr(10) || '```' WHEN 1 THEN '' WHEN 2 THEN ' End of report.' ELSE chr(10) || '```  ' END
  END"""

REPORTS = f"reports AS (SELECT doc_id, {REPORT_TEXT} AS text FROM documents)"


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
