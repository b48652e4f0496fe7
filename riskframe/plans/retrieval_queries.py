"""Vector retrieval, KNN vote and narrative-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import expressions as X
from riskframe.operators import retrieval as RT
from riskframe.operators import selection as SEL
from riskframe.plans import fixtures_sql as S
from riskframe.plans.catalog import edge, query
from riskframe.sources import adapters as A
from riskframe.sources import tables as TB

col = F.col


def _emb(spark, sf):
    return TB.table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])


#: The given query set: every vector whose id is divisible by this.
QUERY_EVERY = 50


def _asked(e):
    """The query set; it is searched for among all vectors."""
    return e.where(col("vec_id") % QUERY_EVERY == 0)


@query("knn_cosine_exact", """
SELECT q_id, c_id, ROUND(score, 6) AS score FROM (
  SELECT a.vec_id AS q_id, b.vec_id AS c_id,
         list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY
           list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rn <= 5""")
def q_knn_exact(spark, sf):
    e = _emb(spark, sf)
    return edge(RT.knn_topk(_asked(e), e, "vec_id", "vec_id", k=5, exclude_self=True)
                .select("q_id", "c_id", "score"))


@query("ann_search")
def q_ann(spark, sf):
    e = _emb(spark, sf)
    assigned, cent = RT.ivf_index(e, "vec_id")
    return RT.ann_search(_asked(e), "vec_id", assigned, cent, k=5, exclude_self=True)


@query("ann_recall")
def q_ann_recall(spark, sf):
    e = _emb(spark, sf)
    assigned, cent = RT.ivf_index(e, "vec_id")
    approx = RT.ann_search(_asked(e), "vec_id", assigned, cent, k=5, exclude_self=True)
    exact = RT.knn_topk(_asked(e), e, "vec_id", "vec_id", k=5, exclude_self=True)
    return RT.recall_at_k(approx, exact)


@query("retrieve_two_collections", """
WITH pairs AS (
  SELECT a.vec_id AS q_id, b.vec_id AS c_id, CASE WHEN b.label < 5 THEN 'customers' ELSE 'policies' END AS collection,
         list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_id, collection ORDER BY score DESC, c_id) AS rank FROM pairs
  QUALIFY rank <= CASE WHEN collection = 'customers' THEN 3 ELSE 5 END)
SELECT q_id, collection, list(c_id ORDER BY rank) AS hit_ids, list(ROUND(score, 6) ORDER BY rank) AS hit_scores,
       CAST(COUNT(*) AS INTEGER) AS n_hits
FROM ranked GROUP BY q_id, collection""")
def q_two_collections(spark, sf):
    e = _emb(spark, sf).withColumn("collection", F.when(col("label") < 5, "customers").otherwise("policies"))
    r = RT.knn_per_collection(_asked(e), e, "vec_id", "vec_id", "collection", {"customers": 3, "policies": 5},
                              exclude_self=True)
    return r.select("q_id", "collection", F.transform("hits", lambda h: h["c_id"]).alias("hit_ids"),
                    F.transform("hits", lambda h: F.round(h["score"], 6)).alias("hit_scores"), "n_hits")


def _brute_sql(dist: str, k: int = 5) -> str:
    """Brute-force top-k over every (query, corpus) pair - the oracle only."""
    return f"""nn AS (
  SELECT q_id, c_id, c_label, d, row_number() OVER (PARTITION BY q_id ORDER BY d, c_id) AS rank FROM (
    SELECT a.vec_id AS q_id, b.vec_id AS c_id, b.label AS c_label,
           {dist.format(a="CAST(a.embedding AS DOUBLE[])", b="CAST(b.embedding AS DOUBLE[])")} AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
  QUALIFY rank <= {k})"""


_EUCLID = "list_distance({a}, {b})"
_COS = "-list_cosine_similarity({a}, {b})"


@query("knn_classify", "WITH " + _brute_sql(_EUCLID) + """,
votes AS (SELECT q_id, c_label AS label, SUM(CASE WHEN d = 0 THEN 1e300 ELSE 1.0 / d END) AS weight FROM nn GROUP BY ALL)
SELECT q_id, CAST(arg_max(label, (weight, -label)) AS INTEGER) AS predicted, ROUND(MAX(weight), 6) AS vote_weight
FROM votes GROUP BY q_id""")
def q_knn_classify(spark, sf):
    e = _emb(spark, sf)
    return edge(RT.knn_classify(_asked(e), e, "vec_id", "vec_id", "label", k=5, weights="distance"))


@query("label_filtered_neighbours", "WITH " + _brute_sql(_EUCLID) + """
SELECT q_id, CAST(rank AS INTEGER) AS rank, c_id, c_label, ROUND(d, 6) AS distance FROM nn""")
def q_label_neighbours(spark, sf):
    e = _emb(spark, sf)
    hits = RT.knn_topk(_asked(e), e, "vec_id", "vec_id", k=5, metric="euclidean", exclude_self=True)
    lab = e.select(col("vec_id").alias("c_id"), col("label").alias("c_label"))
    return edge(hits.join(lab, "c_id").select("q_id", "rank", "c_id", "c_label", (-col("score")).alias("distance")))


@query("retrieval_eval", "WITH " + _brute_sql(_COS) + """
SELECT ROUND(AVG(p), 6) AS mean_precision_at_k, COUNT(*) AS queries FROM (
  SELECT nn.q_id, AVG(CASE WHEN q.label = nn.c_label THEN 1.0 ELSE 0.0 END) AS p
  FROM nn JOIN embeddings q ON q.vec_id = nn.q_id GROUP BY nn.q_id)""")
def q_retrieval_eval(spark, sf):
    e = _emb(spark, sf)
    hits = RT.knn_topk(_asked(e), e, "vec_id", "vec_id", k=5, exclude_self=True)
    return edge(RT.label_precision_at_k(hits, e, "vec_id", "label"))


#: Characters of a hit's text that the log keeps.
PREVIEW = 300


@query("retrieval_log", "WITH " + _brute_sql(_COS) + f"""
SELECT nn.q_id, CAST(nn.rank AS INTEGER) AS rank, nn.c_id, ROUND(-nn.d, 6) AS score, substring(t.text, 1, {PREVIEW}) AS preview
FROM nn LEFT JOIN documents t ON t.doc_id = nn.c_id""")
def q_retrieval_log(spark, sf):
    """Every hit with the start of its document's text."""
    e = _emb(spark, sf)
    hits = RT.knn_topk(_asked(e), e, "vec_id", "vec_id", k=5, exclude_self=True)
    texts = TB.table(spark, sf, "documents", ["doc_id", "text"]).select(col("doc_id").alias("c_id"), X.truncate_context("text", PREVIEW).alias("preview"))
    return edge(hits.join(texts, "c_id", "left").select("q_id", "rank", "c_id", "score", "preview"))


_GROUPS = {"trade_lines": ["total_tl", "tot_active_tl", "unsecured_tl"],
           "delinquency": ["num_times_delinquent", "num_times_30p_dpd", "num_times_60p_dpd"],
           "demographics": ["maritalstatus", "education"]}
_DERIVED = ["unsecured_ratio", "active_ratio"]


def _narr_sql() -> str:
    parts = ["'CUSTOMER_PROFILE id=' || CAST(prospectid AS VARCHAR)"]
    for g, cols in _GROUPS.items():
        body = "concat_ws(chr(10), " + ", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN ' {c}=' || CAST({c} AS VARCHAR) END" for c in cols) + ")"
        parts.append(f"CASE WHEN length({body}) > 0 THEN '[{g.upper()}]' || chr(10) || {body} END")
    dv = {"unsecured_ratio": "CASE WHEN unsecured_tl IS NULL THEN 0.0 ELSE CAST(unsecured_tl AS DOUBLE) / (COALESCE(total_tl, 0) + 1) END",
          "active_ratio": "CASE WHEN tot_active_tl IS NULL THEN 0.0 ELSE CAST(tot_active_tl AS DOUBLE) / (COALESCE(total_tl, 0) + 1) END"}
    body = "concat_ws(chr(10), " + ", ".join(f"' {c}=' || printf('%.4f', {dv[c]})" for c in _DERIVED) + ")"
    parts.append(f"'[DERIVED]' || chr(10) || {body}")
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


@query("row_narrative", S.with_(S.APPLICANTS, f"SELECT prospectid, {_narr_sql()} AS narrative FROM applicants"))
def q_narrative(spark, sf):
    app = A.applicants(spark, sf)
    feats = X.derived_features(app.columns)
    a = app.select("*", *[feats[c].alias(c) for c in _DERIVED])
    return a.select("prospectid", X.row_narrative("prospectid", _GROUPS, _DERIVED).alias("narrative"))


#: Applicants that get a document, by seeded sample.
DOCUMENT_SAMPLE = 5000


@query("customer_documents", S.with_(S.APPLICANTS, f"""
SELECT prospectid, {_narr_sql()} AS page_content, MAP {{'approved_flag': COALESCE(approved_flag, 'unknown'),
  'customer_id': CAST(prospectid AS VARCHAR), 'doc_type': 'customer'}} AS metadata
FROM applicants ORDER BY md5('42:' || CAST(prospectid AS VARCHAR)), prospectid LIMIT {DOCUMENT_SAMPLE}"""))
def q_customer_docs(spark, sf):
    app = A.applicants(spark, sf)
    feats = X.derived_features(app.columns)
    a = SEL.seeded_sample(app.select("*", *[feats[c].alias(c) for c in _DERIVED]), DOCUMENT_SAMPLE, "prospectid")
    meta = F.create_map(F.lit("approved_flag"), F.coalesce(col("approved_flag"), F.lit("unknown")),
                        F.lit("customer_id"), col("prospectid").cast("string"), F.lit("doc_type"), F.lit("customer"))
    return a.select("prospectid", X.row_narrative("prospectid", _GROUPS, _DERIVED).alias("page_content"),
                    meta.alias("metadata"))


@query("policy_focus_query", S.with_(S.APPLICANTS, """
SELECT prospectid, 'credit risk policy for applicant with credit_score=' || COALESCE(CAST(credit_score AS VARCHAR), 'unknown')
  || ', missed payments=' || CAST(tot_missed_pmnt AS VARCHAR) || ', 60+ dpd=' || CAST(num_times_60p_dpd AS VARCHAR)
  || ', class=' || COALESCE(approved_flag, 'unknown') AS query FROM applicants"""))
def q_policy_query(spark, sf):
    a = A.applicants(spark, sf)
    q = F.concat(F.lit("credit risk policy for applicant with credit_score="),
                 F.coalesce(col("credit_score").cast("string"), F.lit("unknown")),
                 F.lit(", missed payments="), col("tot_missed_pmnt").cast("string"),
                 F.lit(", 60+ dpd="), col("num_times_60p_dpd").cast("string"),
                 F.lit(", class="), F.coalesce(col("approved_flag"), F.lit("unknown")))
    return a.select("prospectid", q.alias("query"))


@query("prompt_context_assembly", """
WITH pairs AS (
  SELECT a.vec_id AS q_id, b.vec_id AS c_id, IF(b.label < 5, 'customers', 'policies') AS collection,
         list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id, collection ORDER BY score DESC, c_id) AS rank FROM pairs
  QUALIFY rank <= IF(collection = 'customers', 3, 5)),
blocks AS (SELECT q_id, upper(collection) || ':' || chr(10) || string_agg(printf('  #%d id=%d score=%.4f', rank, c_id, score), chr(10)
  ORDER BY rank) AS block FROM ranked GROUP BY q_id, collection)
SELECT q_id, 'CASE id=' || CAST(q_id AS VARCHAR) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY block)
  || chr(10) || 'Return ONLY JSON.' AS prompt FROM blocks GROUP BY q_id""")
def q_prompt_context(spark, sf):
    e = _emb(spark, sf).withColumn("collection", F.when(col("label") < 5, "customers").otherwise("policies"))
    hits = RT.knn_per_collection(_asked(e), e, "vec_id", "vec_id", "collection", {"customers": 3, "policies": 5},
                                 exclude_self=True)
    lines = F.array_join(F.transform("hits", lambda h: F.format_string(
        "  #%d id=%d score=%.4f", h["rank"], h["c_id"], h["score"])), "\n")
    block = F.concat(F.upper(col("collection")), F.lit(":\n"), lines)
    g = hits.groupBy("q_id").agg(F.array_join(F.sort_array(F.collect_list(block)), "\n\n").alias("context"))
    return g.select("q_id", F.concat(F.lit("CASE id="), col("q_id").cast("string"), F.lit("\n"),
                                     col("context"), F.lit("\nReturn ONLY JSON.")).alias("prompt"))
