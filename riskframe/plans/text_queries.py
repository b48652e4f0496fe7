"""Chunking and grounding-audit queries over documents, pages, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import expressions as X
from riskframe.operators import text as TX
from riskframe.plans import fixtures_sql as S
from riskframe.plans.catalog import query
from riskframe.sources import adapters as A
from riskframe.sources import tables as TB

col = F.col


def _docs(spark, sf):
    return TB.table(spark, sf, "documents", ["doc_id", "text"])


@query("chunk_fixed_overlap", """
SELECT doc_id, CAST(k AS INTEGER) AS chunk_idx, CAST(doc_id AS VARCHAR) || '::p1::c' || CAST(k AS VARCHAR) AS chunk_id,
       CAST(k * 700 AS INTEGER) AS start, substring(text, CAST(k * 700 + 1 AS INTEGER), 800) AS text
FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 800 THEN 1
                                            ELSE CAST(ceil((length(text) - 800) / 700.0) AS INTEGER) + 1 END)) AS k
      FROM documents)""")
def q_chunk_fixed(spark, sf):
    return TX.chunk_fixed_overlap(_docs(spark, sf))


@query("chunk_counts_fixed", """
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 800 THEN 1
                    ELSE CAST(ceil((length(text) - 800) / 700.0) AS INTEGER) + 1 END AS n_chunks FROM documents""")
def q_chunk_counts(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", TX.n_fixed_chunks(F.length("text"), 800, 100).alias("n_chunks"))


@query("chunk_by_keywords")
def q_chunk_keywords(spark, sf):
    return TX.chunk_by_keywords(_docs(spark, sf))


@query("chunk_by_score_ranges")
def q_chunk_ranges(spark, sf):
    return TX.chunk_by_score_ranges(_docs(spark, sf))


@query("chunk_recursive")
def q_chunk_recursive(spark, sf):
    return TX.chunk_recursive(_docs(spark, sf), size=700, overlap=80, separators=TX.FRAUD_SEPARATORS)


@query("union_chunks")
def q_union_chunks(spark, sf):
    d = _docs(spark, sf)
    u = TX.union_chunks({
        "policy": TX.chunk_fixed_overlap(d).select("doc_id", "chunk_idx", "text"),
        "delinquency": TX.chunk_by_keywords(d),
        "scorecard": TX.chunk_by_score_ranges(d),
        "fraud": TX.chunk_recursive(d, size=700, overlap=80, separators=TX.FRAUD_SEPARATORS)
                   .withColumn("typology", F.lit("unspecified")),
    })
    return u.groupBy("doc_type").agg(F.count("*").alias("n_chunks"))


@query("decimal_numbers", r"""
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\d+\.\d+'))) AS numbers FROM documents""")
def q_decimal_numbers(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_sort(X.decimal_numbers("text")).alias("numbers"))


_ALLOWED = r"""allowed AS (SELECT DISTINCT unnest(regexp_extract_all(html, '\d+\.\d+')) AS number FROM pages)"""


@query("invented_numbers", "WITH " + _ALLOWED + r""",
used AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\d+\.\d+')) AS number FROM documents)
SELECT doc_id, number FROM used WHERE number NOT IN (SELECT number FROM allowed)""")
def q_invented(spark, sf):
    pages = TB.table(spark, sf, "pages", ["html"])
    allowed = pages.select(F.explode(X.decimal_numbers("html")).alias("number"))
    return TX.invented_numbers(_docs(spark, sf), allowed).select("doc_id", "number")


_CITED = f"""cited AS (
  SELECT doc_id, trim(s.d) AS doc, CAST(s.p AS INTEGER) AS page FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{X.PDF_CITATION}', ['d', 'p'])) AS s FROM reports))"""


@query("pdf_citations", S.with_(S.REPORTS + ",\n" + _CITED, "SELECT * FROM cited"))
def q_citations(spark, sf):
    return TX.citations(A.generated_reports(spark, sf))


def _chunk_index(spark, sf):
    """Pages of the indexed documents: a text of n characters has n / 3000 pages,
    rounded up."""
    d = TB.table(spark, sf, "documents", ["doc_id", "text"]).where(F.length("text") > 0)
    pages = F.sequence(F.lit(1), F.ceil(F.length("text") / F.lit(3000)).cast("int"))
    return d.select(F.concat(F.lit("doc_"), col("doc_id").cast("string"), F.lit(".pdf")).alias("doc"),
                    F.explode(pages).alias("page"))


_INDEX = """idx AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS doc,
  unnest(range(1, CAST(ceil(length(text) / 3000.0) AS INTEGER) + 1)) AS page FROM documents WHERE length(text) > 0)"""
_OPEN = "open_citation AS (SELECT c.* FROM cited c WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.doc = c.doc AND i.page = c.page))"


@query("unresolved_citations", S.with_(",\n".join([S.REPORTS, _CITED, _INDEX, _OPEN]), "SELECT doc_id, doc, page FROM open_citation"))
def q_unresolved(spark, sf):
    return TX.unresolved_citations(A.generated_reports(spark, sf), _chunk_index(spark, sf))


_JSON = r"""bodies AS (SELECT doc_id, trim(regexp_replace(trim(text, E' \n\t\r'), '(?m)^```(json)?|```$', '', 'g'), E' \n\t\r') AS b FROM reports),
spans AS (SELECT doc_id, b, regexp_extract(b, '(?s)(\{.*\})', 1) AS s FROM bodies),
parsed AS (SELECT doc_id, CASE WHEN json_valid(b) THEN b WHEN length(s) > 0 AND json_valid(s) THEN s
  ELSE CAST(json_object('raw_text', b, 'parse_error', true) AS VARCHAR) END AS json FROM spans)"""


@query("json_extract_lenient", S.with_(S.REPORTS + ",\n" + _JSON, "SELECT * FROM parsed"))
def q_json_lenient(spark, sf):
    return A.generated_reports(spark, sf).select("doc_id", X.json_extract_lenient("text").alias("json"))


_REQ = "['actions', 'gini', 'ks', 'psi', 'summary']"
_KEYS = f"""keyed AS (SELECT doc_id,
  list_sort(list_filter({_REQ}, lambda k: NOT list_contains(json_keys(json), k))) AS missing,
  list_sort(list_filter(json_keys(json), lambda k: NOT list_contains({_REQ}, k))) AS extra, json FROM parsed)"""


@query("key_set_difference", S.with_(",\n".join([S.REPORTS, _JSON, _KEYS]), "SELECT doc_id, missing, extra FROM keyed"))
def q_keys(spark, sf):
    j = A.generated_reports(spark, sf).select("doc_id", X.json_extract_lenient("text").alias("json"))
    return TX.key_set_difference(j, "doc_id", "json")


@query("grounding_audit", S.with_(",\n".join([S.REPORTS, _CITED, _INDEX, _OPEN, _JSON, _KEYS, _ALLOWED, r"""
used AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\d+\.\d+')) AS number FROM reports),
acts AS (SELECT doc_id, COALESCE(CAST(json_extract(json, '$.actions') AS VARCHAR[]), []) AS a FROM parsed)"""]), r"""
SELECT r.doc_id,
  CAST((SELECT COUNT(*) FROM used u WHERE u.doc_id = r.doc_id) AS INTEGER) AS n_numbers,
  (SELECT COUNT(*) FROM used u WHERE u.doc_id = r.doc_id AND u.number NOT IN (SELECT number FROM allowed)) AS n_invented,
  CAST((SELECT COUNT(*) FROM cited c WHERE c.doc_id = r.doc_id) AS INTEGER) AS n_citations,
  (SELECT COUNT(*) FROM open_citation c WHERE c.doc_id = r.doc_id) AS n_unresolved, missing, extra,
  CAST(len(a) AS INTEGER) AS n_actions,
  CAST(len(list_filter(a, lambda x: NOT regexp_matches(x, '\.pdf\s*p\d+'))) AS INTEGER) AS uncited_actions,
  len(a) < 3 AS too_few_actions
FROM reports r JOIN keyed k ON k.doc_id = r.doc_id JOIN acts ON acts.doc_id = r.doc_id"""))
def q_grounding(spark, sf):
    pages = TB.table(spark, sf, "pages", ["html"])
    allowed = pages.select(F.explode(X.decimal_numbers("html")).alias("number"))
    return TX.grounding_audit(A.generated_reports(spark, sf), allowed, _chunk_index(spark, sf))


@query("chunk_reports_by_keywords")
def q_report_keywords(spark, sf):
    return TX.chunk_by_keywords(A.generated_reports(spark, sf))


@query("chunk_reports_by_score_ranges")
def q_report_ranges(spark, sf):
    return TX.chunk_by_score_ranges(A.generated_reports(spark, sf))


_WORD_HITS = ", ".join(f"{{'idx': instr(lower(text), '{k.lower()}') - 1, 'kw': '{k}'}}" for k in TX.DELINQUENCY_KEYWORDS)


@query("report_keyword_sections", S.with_(S.REPORTS + f""",
hits AS (SELECT doc_id, text, list_sort(list_filter([{_WORD_HITS}], lambda x: x.idx >= 0)) AS h FROM reports),
cuts AS (SELECT doc_id, text, h, unnest(range(1, len(h) + 1)) AS k FROM hits),
sections AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_idx, lower(h[k].kw) AS class_level,
  trim(substring(text, h[k].idx + 1, coalesce(h[k + 1].idx, length(text)) - h[k].idx), E' \\n\\r\\t') AS text FROM cuts)""",
                                         "SELECT * FROM sections WHERE length(text) >= 30"))
def q_keyword_sections(spark, sf):
    """R2 without the fallback: the sections between the first hits of the headings."""
    return TX.chunk_by_keywords(A.generated_reports(spark, sf)).where(col("class_level") != "unknown")


@query("report_score_sections", S.with_(S.REPORTS + f""",
found AS (SELECT doc_id, regexp_extract_all(text, '{TX.SCORE_RANGE}') AS m, string_split_regex(text, '{TX.SCORE_RANGE}') AS p FROM reports),
cuts AS (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS k FROM found),
sections AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_idx, CAST(regexp_extract(m[k], '{TX.SCORE_RANGE}', 1) AS INTEGER) AS min_score,
  CAST(regexp_extract(m[k], '{TX.SCORE_RANGE}', 2) AS INTEGER) AS max_score, trim(m[k] || p[k + 1], E' \\n\\r\\t') AS text FROM cuts)""",
                                       "SELECT * FROM sections WHERE length(text) >= 30"))
def q_score_sections(spark, sf):
    """R3 without the fallback: a section from every score range to the next."""
    return TX.chunk_by_score_ranges(A.generated_reports(spark, sf)).where(col("min_score").isNotNull())


@query("truncate_context", """
SELECT conv_id, turn, substring(text, 1, 600) AS preview,
  CASE WHEN length(text) > 20000 THEN substring(text, 1, 20000) || ' [truncated]' ELSE text END AS message
FROM conversations""")
def q_truncate(spark, sf):
    c = TB.table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", X.truncate_context("text", 600).alias("preview"),
                    X.truncate_context("text", 20000, " [truncated]").alias("message"))


@query("leading_identifier", r"""
SELECT conv_id, turn, CASE WHEN length(regexp_extract(text, '^\s*([A-Za-z0-9_]+)', 1)) > 0
  THEN regexp_extract(text, '^\s*([A-Za-z0-9_]+)', 1) ELSE text END AS feature FROM conversations""")
def q_leading(spark, sf):
    c = TB.table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", X.leading_identifier("text").alias("feature"))
