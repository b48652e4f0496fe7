"""Column expressions (F*, P*): bands, statuses, derived features, routing.

All of these are plain ``pyspark.sql.functions`` expressions, so they stay
inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

col = F.col


def _c(x: str | Column) -> Column:
    return col(x) if isinstance(x, str) else x


def _is_nan(x: Column) -> Column:
    """True for NaN doubles; NULL-safe (false for NULL)."""
    return F.coalesce(F.isnan(x), F.lit(False))


# ---------------------------------------------------------------- F-functions

def safe_div(a: str | Column, b: str | Column) -> Column:
    """a/b, 0.0 when either side is NULL/NaN or b is 0 (no ANSI error)."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    bad = a.isNull() | b.isNull() | _is_nan(a) | _is_nan(b) | (b == 0)
    return F.when(bad, F.lit(0.0)).otherwise(F.try_divide(a, b))


def round_half_even(x: str | Column, scale: int) -> Column:
    """Python ``round(x, n)``."""
    return F.bround(_c(x), scale)


def round_half_up(x: str | Column, scale: int) -> Column:
    """SQL ROUND on a numeric value."""
    return F.round(_c(x), scale)


def nullif_divide(a: str | Column, b: str | Column) -> Column:
    """a / NULLIF(b, 0)."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0)))


def month_trunc_date(ts: str | Column) -> Column:
    """date_trunc('month', ts)::date."""
    return F.to_date(F.date_trunc("month", _c(ts)))


def hour_key(ts: str | Column) -> Column:
    """'YYYY-MM-DDTHH' in the session time zone (pinned to UTC)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH")


def vintage_key(ts: str | Column) -> Column:
    """'YYYY-MM' period."""
    return F.date_format(_c(ts), "yyyy-MM")


def log1p_transform(x: str | Column) -> Column:
    """F8: log(1+x); values below -1 give NULL (clean sentinels first)."""
    x = _c(x)
    return F.when(x >= -1, F.log1p(x))


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """bound x to [lo, hi]; NULL stays NULL (least/greatest skip NULLs)."""
    x = _c(x)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def payload_fingerprint(cols: list[str], n_hex: int = 16) -> Column:
    """first ``n_hex`` hex chars of SHA-256 over a sorted-key JSON of ``cols``."""
    return F.substring(F.sha2(F.to_json(F.struct(*[col(c) for c in sorted(cols)])), 256), 1, n_hex)


def json_sanitize(x: str | Column) -> Column:
    """NaN / +-inf to NULL for a double column."""
    x = _c(x)
    return F.when(_is_nan(x) | x.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(x)


def parse_vector_text(x: str | Column) -> Column:
    """'[0.1, 0.2]' -> array<float>."""
    return F.from_json(_c(x), "array<float>")


def strip_code_fences(x: str | Column) -> Column:
    """Drop the fence marks at the start and end of lines and the outer white space."""
    t = F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?m)^```(json)?|```$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def json_extract_lenient(x: str | Column) -> Column:
    """JSON text out of generated text: the unfenced text if it parses, else its
    widest ``{...}`` span if that parses, else an object that holds the text
    as ``raw_text`` and marks ``parse_error``."""
    body = strip_code_fences(x)
    span = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    ok_span = (F.length(span) > 0) & F.try_parse_json(span).isNotNull()
    failed = F.to_json(F.struct(body.alias("raw_text"), F.lit(True).alias("parse_error")))
    return F.when(F.try_parse_json(body).isNotNull(), body).when(ok_span, span).when(body.isNotNull(), failed)


def decimal_numbers(x: str | Column) -> Column:
    """distinct ``\\d+\\.\\d+`` tokens in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"\d+\.\d+"), 0))


# Fixed value: the citation pattern "<name>.pdf p<page>".
PDF_CITATION = r"([A-Za-z0-9_\- ]+\.pdf)\s*p(\d+)"


def pdf_citations(x: str | Column) -> Column:
    """F16: array<struct<doc, page>> of (doc trimmed, page int) citations."""
    # Exact prefilter: a match needs the literal ".pdf"; without it the
    # backtracking scan would be quadratic on long texts.
    has = F.coalesce(F.instr(_c(x), ".pdf") > 0, F.lit(False))
    docs = F.regexp_extract_all(_c(x), F.lit(PDF_CITATION), 1)
    pages = F.regexp_extract_all(_c(x), F.lit(PDF_CITATION), 2)
    found = F.transform(F.arrays_zip(docs.alias("d"), pages.alias("p")),
                        lambda s: F.struct(F.trim(s["d"]).alias("doc"),
                                           s["p"].cast("int").alias("page")))
    return F.when(has, found).otherwise(
        F.array().cast("array<struct<doc:string,page:int>>"))


def leading_identifier(x: str | Column) -> Column:
    """leading feature name of a condition string, else the whole text."""
    ident = F.regexp_extract(_c(x), r"^\s*([A-Za-z0-9_]+)", 1)
    return F.when(F.length(ident) > 0, ident).otherwise(_c(x))


def percent_100(p: str | Column) -> Column:
    """round(p*100, 2) with Python half-even rounding."""
    return F.bround(_c(p) * 100, 2)


def truncate_context(x: str | Column, n: int, marker: str | None = None) -> Column:
    """first n characters; with ``marker`` appended when text was cut."""
    x = _c(x)
    cut = F.substring(x, 1, n)
    if marker is None:
        return cut
    return F.when(F.length(x) > n, F.concat(cut, F.lit(marker))).otherwise(x)


def missing_default(meta: str | Column, key: str, default: str) -> Column:
    """metadata lookup with a default."""
    return F.coalesce(F.try_element_at(_c(meta), F.lit(key)), F.lit(default))


def row_narrative(id_col: str, groups: dict[str, list[str]], derived: list[str]) -> Column:
    """sectioned narrative; NULL columns and empty groups skipped,
    derived values printed with four decimals."""
    parts = [F.concat(F.lit("CUSTOMER_PROFILE id="), col(id_col).cast("string"))]
    for name, cols in list(groups.items()) + [("derived", derived)]:
        if name == "derived":
            lines = [F.when(col(c).isNotNull(),
                            F.concat(F.lit(f" {c}="), F.format_string("%.4f", col(c).cast("double"))))
                     for c in cols]
        else:
            lines = [F.when(col(c).isNotNull(), F.concat(F.lit(f" {c}="), col(c).cast("string")))
                     for c in cols]
        body = F.concat_ws("\n", *lines)
        parts.append(F.when(F.length(body) > 0,
                            F.concat(F.lit(f"[{name.upper()}]\n"), body)))
    return F.concat_ws("\n", *parts)


# ------------------------------------------------------------------ bands

def score_band_5(score: str | Column = "credit_score") -> Column:
    """NULL score falls into ELSE ('Very High'), as in the CASE."""
    s = _c(score)
    return (F.when(s < 600, "Very Low").when(s < 650, "Low").when(s < 700, "Medium")
            .when(s < 800, "High").otherwise("Very High"))


def score_segment_risk(score: str | Column = "credit_score") -> Column:
    """P5: same cuts, risk wording."""
    s = _c(score)
    return (F.when(s < 600, "Very High Risk").when(s < 650, "High Risk")
            .when(s < 700, "Medium Risk").when(s < 800, "Low Risk").otherwise("Very Low Risk"))


def score_band_6(score: str | Column = "credit_score") -> Column:
    """0-599 ... 750-799, 800+ (NULL -> '800+')."""
    s = _c(score)
    return (F.when(s < 600, "0-599").when(s < 650, "600-649").when(s < 700, "650-699")
            .when(s < 750, "700-749").when(s < 800, "750-799").otherwise("800+"))


def score_band_mislabelled(score: str | Column = "credit_score", labels: str = "reference") -> Column:
    """The reference labels are shifted one band ('<650' is called
    '650-699'); ``labels='corrected'`` gives the intended names."""
    s = _c(score)
    if labels == "reference":
        names = ("<600", "650-699", "700-799", "800+")
    elif labels == "corrected":
        names = ("<600", "600-649", "650-699", "700+")
    else:
        raise ValueError(labels)
    return (F.when(s < 600, names[0]).when(s < 650, names[1]).when(s < 700, names[2])
            .otherwise(names[3]))


def band_sort_key(band: str | Column) -> Column:
    """Sort key of P7 (lists a label P7 never produces, as the reference)."""
    b = _c(band)
    return (F.when(b == "<600", 1).when(b == "600-649", 2).when(b == "650-699", 3)
            .when(b == "700-799", 4).when(b == "800+", 5))


def delinquency_segment(n: str | Column = "num_times_delinquent") -> Column:
    """P8."""
    x = _c(n)
    return (F.when(x == 0, "No Delinquency").when(x <= 2, "LOW Delinquency")
            .when(x <= 5, "Moderate Delinquency").otherwise("Severe Delinquency"))


def dpd_segment(n30: str | Column = "num_times_30p_dpd", n60: str | Column = "num_times_60p_dpd") -> Column:
    """P9."""
    return (F.when(_c(n60) > 0, "60+ DPD").when(_c(n30) > 0, "30+ DPD")
            .otherwise("No Serious DPD"))


# ---------------------------------------------------------- monitoring

# Default bounds of the monitoring rules.
DEFAULT_THRESHOLDS = {"gini_min": 0.30, "ks_min": 0.20, "psi_max": 0.25}


def thresholds(own: dict | None = None) -> dict:
    """The default bounds with the caller's own put over them."""
    return DEFAULT_THRESHOLDS | (own or {})




def monitor_status(gini="gini", ks="ks", psi="psi", gini_min="gini_min", ks_min="ks_min",
                   psi_max="psi_max") -> Column:
    """P10: first breach wins; NULL (and NaN, guarded) falls through to the next test."""
    g, k, p = _c(gini), _c(ks), _c(psi)
    gm = _c(gini_min) if isinstance(gini_min, (str, Column)) else F.lit(gini_min)
    km = _c(ks_min) if isinstance(ks_min, (str, Column)) else F.lit(ks_min)
    pm = _c(psi_max) if isinstance(psi_max, (str, Column)) else F.lit(psi_max)
    return (F.when(~_is_nan(g) & (g < gm), "GINI_LOW")
            .when(~_is_nan(k) & (k < km), "KS_LOW")
            .when(~_is_nan(p) & (p > pm), "PSI_HIGH")
            .otherwise("OK"))


def is_healthy(gini="gini", ks="ks", psi="psi", gini_min="gini_min", ks_min="ks_min",
               psi_max="psi_max") -> Column:
    """SQL three-valued conjunction: NULL if any metric is NULL and none fails."""
    return (_c(gini) >= _c(gini_min)) & (_c(ks) >= _c(ks_min)) & (_c(psi) <= _c(psi_max))


# ------------------------------------------------------------- features

def _num(name: str, present: set[str], default: float = 0.0) -> Column:
    """Column as double if present, else the default (absent column counts as 0)."""
    if name in present:
        return col(name).cast("double")
    return F.lit(default).cast("double")


def derived_features(columns: list[str]) -> dict[str, Column]:
    """Seven derived features (names are lower-case columns of the input).

    ratio = a/(b+1) with 0.0 when a side is NULL or the denominator is 0;
    an absent column counts as 0 (numerator) / 0 (denominator base).
    """
    present = {c.lower() for c in columns}

    def ratio(a: str, b: str) -> Column:
        den = F.coalesce(_num(b, present), F.lit(0.0)) + 1
        return safe_div(_num(a, present), den)

    return {
        "delinq_velocity": ratio("num_deliq_6mts", "num_deliq_12mts"),
        "enq_velocity": ratio("enq_l3m", "enq_l12m"),
        "unsecured_ratio": ratio("unsecured_tl", "total_tl"),
        "active_ratio": ratio("tot_active_tl", "total_tl"),
        "recent_open_ratio": ratio("total_tl_opened_l6m", "total_tl"),
        "dpd_score": F.coalesce(_num("num_times_30p_dpd", present), F.lit(0.0))
                     + 2 * F.coalesce(_num("num_times_60p_dpd", present), F.lit(0.0)),
        "asset_class_score": F.coalesce(_num("num_sub", present), F.lit(0.0))
                             + 2 * F.coalesce(_num("num_dbt", present), F.lit(0.0))
                             + 3 * F.coalesce(_num("num_lss", present), F.lit(0.0)),
    }


def secured_account_flag(secured: str | Column = "secured_tl",
                         unsecured: str | Column = "unsecured_tl") -> Column:
    """1 when secured - unsecured > 1 (NULL difference -> 0)."""
    return F.when((_c(secured) - _c(unsecured)) > 1, 1).otherwise(0)


def normalize_missing(x: str | Column, sentinel: float | None = -99999,
                      fill: float | Column | None = None) -> Column:
    """Sentinel, NaN and +-inf become NULL, then optionally ``fill``."""
    x = _c(x)
    bad = _is_nan(x) | x.isin(float("inf"), float("-inf"))
    if sentinel is not None:
        bad = bad | (x == sentinel)
    out = F.when(bad, F.lit(None)).otherwise(x)
    if fill is not None:
        out = F.coalesce(out, fill if isinstance(fill, Column) else F.lit(fill))
    return out


def screen_bits(income="netmonthlyincome", deliq_6m="num_deliq_6mts", unsecured="unsecured_tl",
                total="total_tl", last_prod="last_prod_enq2") -> Column:
    """bit0 income<20000, bit1 deliq_6m>0, bit2 unsecured/max(total,1)>0.7,
    bit3 last product 'al'.  Inputs are read as text and parsed; a value that
    does not parse stops the evaluation there, keeping the earlier bits."""
    def parse(c, typ):
        s = _c(c).cast("string")
        v = s.try_cast(typ)
        empty = s.isNull() | (s == "") | (v == 0)
        return v, empty, s.isNull() | (s == "") | v.isNotNull()

    inc, inc_empty, inc_ok = parse(income, "double")
    inc_v = F.when(inc_empty, F.lit(0.0)).otherwise(inc)
    dq, dq_empty, dq_ok = parse(deliq_6m, "int")
    dq_v = F.when(dq_empty, F.lit(0)).otherwise(dq)
    un, un_empty, un_ok = parse(unsecured, "double")
    un_v = F.when(un_empty, F.lit(0.0)).otherwise(un)
    tt, tt_empty, tt_ok = parse(total, "double")
    tt_v = F.when(tt_empty, F.lit(1.0)).otherwise(tt)
    ok0 = inc_ok
    ok1 = ok0 & dq_ok
    ok2 = ok1 & un_ok & tt_ok
    b0 = F.when(ok0 & (inc_v < 20000), 1).otherwise(0)
    b1 = F.when(ok1 & (dq_v > 0), 2).otherwise(0)
    b2 = F.when(ok2 & ((un_v / F.greatest(tt_v, F.lit(1.0))) > 0.7), 4).otherwise(0)
    lp = F.coalesce(_c(last_prod).cast("string"), F.lit("None"))
    b3 = F.when(ok2 & (F.lower(lp) == "al"), 8).otherwise(0)
    return b0.bitwiseOR(b1).bitwiseOR(b2).bitwiseOR(b3)


def screen_high_risk(bits: str | Column = "screen_bits") -> Column:
    """Bit 1 set."""
    return _c(bits).bitwiseAND(F.lit(2)) != 0


# ------------------------------------------------------------- routing

def _route(p: Column, low: float, high: float, labels: tuple[str, str, str]) -> Column:
    """NaN never satisfies a comparison in the reference, so it lands in the
    middle branch; in Spark NaN > x is true, hence the guard."""
    nan = _is_nan(p) | p.isNull()
    return F.when(~nan & (p < low), labels[0]).when(~nan & (p > high), labels[1]).otherwise(labels[2])


def policy_route_credit(p: str | Column, confidence: str | Column | None = None,
                        reject_below: float = 0.30, approve_above: float = 0.90,
                        middle: str = "RAG_LLM") -> dict[str, Column]:
    """Deterministic gate of the credit decision.

    ``confidence`` defaults to the primary probability (the reference reads
    a key that never exists, so its confidence always equals it).
    Returns output columns; ``middle='MANUAL_REVIEW'`` is P18.
    """
    p = _c(p)
    conf = p if confidence is None else _c(confidence)
    route = _route(p, reject_below, approve_above, ("AUTO_REJECT", "AUTO_APPROVE", middle))
    provider = F.when(route.isin("AUTO_REJECT", "AUTO_APPROVE"), "ML_Policy_Engine").otherwise(
        "Rule_Engine (Human review)" if middle == "MANUAL_REVIEW" else "RAG_LLM")
    action = (F.when(route == "AUTO_REJECT", "Decline - risk score below cut-off")
              .when(route == "AUTO_APPROVE", "Approve - strong profile")
              .otherwise("Manual review" if middle == "MANUAL_REVIEW" else "Retrieve context and explain"))
    review = (F.when(route == "AUTO_REJECT", F.coalesce(conf < 0.6, F.lit(False)))
              .when(route == "AUTO_APPROVE", F.lit(False)).otherwise(F.lit(True)))
    return {"decision_route": route, "provider": provider, "risk_score": p,
            "risk_score_100": percent_100(p), "recommended_action": action,
            "confidence": conf.cast("double"), "needs_human_review": review}


def policy_route_fraud(fp: str | Column, confidence: str | Column | None = None,
                       allow_below: float = 0.10, block_above: float = 0.85,
                       review_rule: str = "service") -> dict[str, Column]:
    """AUTO_ALLOW/Low, AUTO_BLOCK/Critical, else RAG_LLM.

    ``review_rule='service'``: review when the predicted-class probability
    fails the 0.6 test (allow: not > 0.6; block: < 0.6); ``'notebook'``:
    review when fp < 0.6 on the automatic routes.
    """
    fp = _c(fp)
    conf = fp if confidence is None else _c(confidence)
    route = _route(fp, allow_below, block_above, ("AUTO_ALLOW", "AUTO_BLOCK", "RAG_LLM"))
    band = F.when(route == "AUTO_ALLOW", "Low").when(route == "AUTO_BLOCK", "Critical")
    action = F.when(route == "AUTO_ALLOW", "allow").when(route == "AUTO_BLOCK", "block")
    if review_rule == "service":
        review = (F.when(route == "AUTO_ALLOW", ~F.coalesce(conf > 0.6, F.lit(False)))
                  .when(route == "AUTO_BLOCK", F.coalesce(conf < 0.6, F.lit(False)))
                  .otherwise(F.lit(True)))
    elif review_rule == "notebook":
        review = F.when(route == "RAG_LLM", F.lit(True)).otherwise(F.coalesce(fp < 0.6, F.lit(False)))
    else:
        raise ValueError(review_rule)
    return {"decision_route": route, "fraud_probability": fp,
            "fraud_probability_100": percent_100(fp), "fraud_band": band,
            "typology": F.when(route != "RAG_LLM", "unknown"),
            "recommended_action": action, "confidence": conf.cast("double"),
            "needs_human_review": review}


# First-product remap of the credit service.
FIRST_PRODUCT_MAP = {"PL": "P1", "CC": "P2", "ConsumerLoan": "P3"}


def first_product_remap(x: str | Column = "first_prod_enq2") -> Column:
    """PL->P1, CC->P2, ConsumerLoan->P3, anything else -> P4."""
    m = F.create_map(*[F.lit(v) for kv in FIRST_PRODUCT_MAP.items() for v in kv])
    return F.coalesce(F.try_element_at(m, _c(x)), F.lit("P4"))


# Product values that do not count as a propensity positive.
NON_PRODUCTS = ("none", "others", "nan", "")


def propensity_label(x: str | Column = "last_prod_enq2") -> Column:
    """1 unless lower(trim(x)) is a non-product; NULL counts as positive
    (as ``isin`` on a missing value is false in the reference)."""
    v = F.lower(F.trim(_c(x)))
    return F.when(v.isNull(), 1).when(v.isin(*NON_PRODUCTS), 0).otherwise(1)


def class_decision_flag(pred: str | Column) -> Column:
    """Class 0 shown as APPROVED, any other as REVIEW."""
    return F.when(_c(pred) == 0, "APPROVED").otherwise("REVIEW")


def argmax_class(probs: str | Column) -> Column:
    """Index of the first maximum (0-based)."""
    p = _c(probs)
    return F.array_position(p, F.array_max(p)) - 1
