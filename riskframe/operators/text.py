"""Document chunking (R1-R4, X3) and text checks.

R1-R3 are JVM expressions (sequence/posexplode/substring; regex match
offsets are recovered with an ``aggregate`` over the matches and
``locate``).  R4, a recursive separator splitter, is plain string work per
document and runs in an Arrow-batched ``mapInPandas``.  Whole texts are
always processed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import expressions as X

col = F.col

# Fixed value: characters Python's str.strip() removes by default.
PY_WS = r"[\s\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def py_strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{PY_WS}+|{PY_WS}+$", "")


# ------------------------------------------------------------------ R1

def n_fixed_chunks(length: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return (F.when(length == 0, 0).when(length <= size, 1)
            .otherwise(F.ceil((length - size) / F.lit(step)).cast("int") + 1))


def chunk_fixed_overlap(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                        size: int = 800, overlap: int = 100, page: int = 1) -> DataFrame:
    """Windows of ``size`` characters advancing by ``size - overlap``
    until one reaches the end; empty text -> no chunk; id ``doc::pN::cI``."""
    n = n_fixed_chunks(F.length(col(text)), size, overlap)
    x = docs.select(id_col, text, F.posexplode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx", "_k"))
    start = col("chunk_idx") * (size - overlap)
    return x.select(
        id_col, "chunk_idx",
        F.concat(col(id_col).cast("string"), F.lit(f"::p{page}::c"), col("chunk_idx").cast("string")).alias("chunk_id"),
        start.alias("start"), F.substring(col(text), start + 1, size).alias("text"))


# ------------------------------------------------------------------ R4

# Default separator lists of the recursive splitter.
DEFAULT_SEPARATORS = ["\n\n", "\n", " ", ""]
FRAUD_SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", " "]
POLICY_SEPARATORS = ["\n\n", "\n", ". ", " "]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, cur, total = [], [], 0
    for p in pieces:
        n = len(p)
        if total + n > size and cur:
            doc = "".join(cur).strip()
            if doc:
                out.append(doc)
            while total > overlap or (total + n > size and total > 0):
                total -= len(cur[0])
                cur.pop(0)
        cur.append(p)
        total += n
    doc = "".join(cur).strip()
    if doc:
        out.append(doc)
    return out


def recursive_split(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Greedy recursive splitter: split on the first separator present
    (kept at the start of the following piece), merge pieces up to ``size``
    with ``overlap`` carried, and split oversize pieces with the next
    separators; the empty separator splits into characters."""
    if not text:
        return []
    sep, rest = separators[-1] if separators else "", []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1:]
            break
    if sep:
        parts = text.split(sep)
        pieces = [parts[0]] + [sep + p for p in parts[1:]]
    else:
        pieces = list(text)
    pieces = [p for p in pieces if p]
    out, good = [], []
    for p in pieces:
        if len(p) < size:
            good.append(p)
            continue
        if good:
            out.extend(_merge(good, size, overlap))
            good = []
        if not rest:
            out.append(p)
        else:
            out.extend(recursive_split(p, size, overlap, rest))
    if good:
        out.extend(_merge(good, size, overlap))
    return out


def chunk_recursive(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 800,
                    overlap: int = 100, separators: list[str] | None = None) -> DataFrame:
    """Recursive splitter over whole documents, one task per partition."""
    seps = list(separators or DEFAULT_SEPARATORS)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("chunk_idx", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size_out = [], 0
            for d, t in zip(pdf[id_col], pdf[text]):
                rows += [(d, i, c) for i, c in enumerate(recursive_split(t or "", size, overlap, seps))]
                size_out += len(t or "")
                if size_out > 8_000_000:             # a task holds the chunks of about 8 MB of text
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows, size_out = [], 0
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select(id_col, text).mapInPandas(run, schema)


# ------------------------------------------------------------------ R2

# Classification headings of the delinquency chunker.
DELINQUENCY_KEYWORDS = ["Standard", "Sub-standard", "Substandrad", "Doubtful", "Loss"]


def chunk_by_keywords(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                      keywords: list[str] | None = None, min_len: int = 30,
                      fallback_size: int = 800, fallback_overlap: int = 100) -> DataFrame:
    """R2: slice between the first case-insensitive hit of each keyword
    (hits sorted by offset, then keyword); slices shorter than ``min_len``
    after stripping are dropped but keep their index; documents without a
    hit fall back to R4.  Output: (id, chunk_idx, class_level, text)."""
    kws = keywords or DELINQUENCY_KEYWORDS
    low = F.lower(col(text))
    hits = F.filter(F.array(*[F.struct((F.instr(low, F.lit(k.lower())) - 1).alias("idx"), F.lit(k).alias("kw"))
                              for k in kws]), lambda s: s["idx"] >= 0)
    x = docs.select(id_col, text, F.array_sort(hits).alias("_h"))
    hit_docs = x.where(F.size("_h") > 0)
    e = hit_docs.select(id_col, text, "_h", F.posexplode("_h").alias("chunk_idx", "_p"))
    nxt = F.coalesce(F.try_element_at(col("_h"), col("chunk_idx") + 2)["idx"], F.length(col(text)))
    piece = py_strip(F.substring(col(text), col("_p.idx") + 1, nxt - col("_p.idx")))
    kw_chunks = (e.select(id_col, "chunk_idx", F.lower(col("_p.kw")).alias("class_level"), piece.alias("text"))
                 .where(F.length("text") >= min_len))
    fb = chunk_recursive(x.where(F.size("_h") == 0).select(id_col, text), id_col, text,
                         fallback_size, fallback_overlap)
    return kw_chunks.unionByName(fb.withColumn("class_level", F.lit("unknown")))


# ------------------------------------------------------------------ R3

# Fixed value: a three-digit score range such as "700-750" or "700 to 750".
SCORE_RANGE = r"(\d{3})\s*[--to]+\s*(\d{3})"


def match_offsets(text: Column, pattern: str) -> Column:
    """1-based start of every non-overlapping match, left to right."""
    ms = F.regexp_extract_all(text, F.lit(pattern), 0)
    init = F.struct(F.lit(1).alias("pos"), F.array().cast("array<int>").alias("offs"))
    acc = F.aggregate(ms, init, lambda a, m: F.struct(
        (F.call_function("locate", m, text, a["pos"]) + F.length(m)).alias("pos"),
        F.array_append(a["offs"], F.call_function("locate", m, text, a["pos"])).alias("offs")))
    return acc["offs"]


def chunk_by_score_ranges(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_len: int = 30,
                          fallback_size: int = 700, fallback_overlap: int = 80) -> DataFrame:
    """A chunk starts at every score-range match and runs to the next;
    min/max score from the match; no match -> R4 (700/80)."""
    t = col(text)
    x = docs.select(id_col, text, match_offsets(t, SCORE_RANGE).alias("_o"),
                    F.regexp_extract_all(t, F.lit(SCORE_RANGE), 1).alias("_lo"),
                    F.regexp_extract_all(t, F.lit(SCORE_RANGE), 2).alias("_hi"))
    e = x.where(F.size("_o") > 0).select(id_col, text, "_o", "_lo", "_hi",
                                         F.posexplode("_o").alias("chunk_idx", "_s"))
    nxt = F.coalesce(F.try_element_at(col("_o"), col("chunk_idx") + 2), F.length(t) + 1)
    piece = py_strip(F.substring(t, col("_s"), nxt - col("_s")))
    rng = e.select(id_col, "chunk_idx",
                   F.element_at("_lo", col("chunk_idx") + 1).cast("int").alias("min_score"),
                   F.element_at("_hi", col("chunk_idx") + 1).cast("int").alias("max_score"),
                   piece.alias("text")).where(F.length("text") >= min_len)
    fb = chunk_recursive(x.where(F.size("_o") == 0).select(id_col, text), id_col, text,
                         fallback_size, fallback_overlap, POLICY_SEPARATORS)
    fb = fb.select(id_col, "chunk_idx", F.lit(None).cast("int").alias("min_score"),
                   F.lit(None).cast("int").alias("max_score"), "text")
    return rng.unionByName(fb)


def union_chunks(parts: dict[str, DataFrame]) -> DataFrame:
    """Differently annotated chunk sets in one table (missing metadata
    columns become NULL), tagged with ``doc_type``."""
    out = None
    for name, df in parts.items():
        d = df.withColumn("doc_type", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ audits

def numbers_long(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, number) for every distinct decimal number of each text."""
    return docs.select(id_col, F.explode(X.decimal_numbers(col(text))).alias("number"))


def invented_numbers(reports: DataFrame, allowed: DataFrame, id_col: str = "doc_id", text: str = "text",
                     allowed_col: str = "number") -> DataFrame:
    """Numbers used in each report that are not in the allowed set; the
    allowed set is a table (anti-join), never a driver-side list."""
    used = numbers_long(reports, id_col, text)
    return used.join(allowed.select(col(allowed_col).alias("number")).distinct(), "number", "left_anti")


def citations(reports: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """F16: one row per (doc, page) citation found in each report."""
    return reports.select(id_col, F.explode(X.pdf_citations(col(text))).alias("c")) \
                  .select(id_col, col("c.doc").alias("doc"), col("c.page").alias("page"))


def unresolved_citations(reports: DataFrame, index: DataFrame, id_col: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """Citations with no (doc, page) chunk in the index - one anti-join
    instead of a query per citation."""
    return citations(reports, id_col, text).join(index.select("doc", "page").distinct(), ["doc", "page"], "left_anti")


# Keys the generated JSON must carry exactly.
REQUIRED_KEYS = ["actions", "gini", "ks", "psi", "summary"]


def _key_diff(json_col: str, required: list[str] | None = None) -> tuple[Column, Column]:
    req = F.array(*[F.lit(k) for k in sorted(required or REQUIRED_KEYS)])
    keys = F.coalesce(F.json_object_keys(col(json_col)), F.array().cast("array<string>"))
    return (F.array_sort(F.array_except(req, keys)).alias("missing"),
            F.array_sort(F.array_except(keys, req)).alias("extra"))


def key_set_difference(docs: DataFrame, id_col: str, json_col: str,
                       required: list[str] | None = None) -> DataFrame:
    """Missing and extra top-level keys of each JSON object."""
    return docs.select(id_col, *_key_diff(json_col, required))


def grounding_audit(reports: DataFrame, allowed: DataFrame, index: DataFrame, id_col: str = "doc_id",
                    text: str = "text", allowed_col: str = "number") -> DataFrame:
    """Per report - numbers used, invented numbers, citations,
    unresolved citations, JSON key checks and action citations.

    One projection over the text yields the number and citation arrays and
    the JSON; counts are array sizes.  Only the two checks against other
    tables (allowed numbers, citation index) explode and anti-join, and
    their per-report counts are joined back on the report id.
    """
    base = reports.select(id_col, X.decimal_numbers(col(text)).alias("_nums"),
                          X.pdf_citations(col(text)).alias("_cits"),
                          X.json_extract_lenient(col(text)).alias("_j"))
    ok = allowed.select(col(allowed_col).alias("number")).distinct()
    inv = (base.select(id_col, F.explode("_nums").alias("number")).join(ok, "number", "left_anti")
           .groupBy(id_col).agg(F.count("*").alias("n_invented")))
    unr = (base.select(id_col, F.explode("_cits").alias("c"))
           .select(id_col, col("c.doc").alias("doc"), col("c.page").alias("page"))
           .join(index.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
           .groupBy(id_col).agg(F.count("*").alias("n_unresolved")))
    actions = F.from_json(F.get_json_object(col("_j"), "$.actions"), "array<string>")
    per = base.select(
        id_col,
        F.coalesce(F.size("_nums"), F.lit(0)).alias("n_numbers"),
        F.coalesce(F.size("_cits"), F.lit(0)).alias("n_citations"),
        *_key_diff("_j"),
        F.coalesce(F.size(actions), F.lit(0)).alias("n_actions"),
        F.coalesce(F.size(F.filter(actions, lambda a: ~a.rlike(r"\.pdf\s*p\d+"))), F.lit(0)).alias("uncited_actions"))
    out = per.join(inv, id_col, "left").join(unr, id_col, "left").fillna(0, ["n_invented", "n_unresolved"])
    return out.select(id_col, "n_numbers", "n_invented", "n_citations", "n_unresolved", "missing", "extra",
                      "n_actions", "uncited_actions", (col("n_actions") < 3).alias("too_few_actions"))
