"""Feature projection of dynamic payloads (P30) and label encoding helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

col = F.col


def align_features(df: DataFrame, payload: str, features: list[str], fill: float | None = 0.0,
                   keep: list[str] | None = None) -> DataFrame:
    """Project a ``MAP<STRING,STRING>`` payload onto the declared feature
    list, in order.  Absent keys and non-numeric text become NULL, then
    ``fill`` (the caller's choice: -99999, 0, or None to keep NULL)."""
    out = []
    for f in features:
        v = F.try_element_at(col(payload), F.lit(f)).try_cast("double")
        out.append((F.coalesce(v, F.lit(fill)) if fill is not None else v).alias(f))
    return df.select(*(keep or []), *out)


def read_payloads(df: DataFrame, payload: str, numeric: list[str], text: list[str], key: str) -> DataFrame:
    """Typed columns of JSON payloads, and ``error`` where a row cannot be scored.

    A bad row is a value, not a failure: ``malformed payload``, ``<name>: missing`` or
    ``<name>: not a number``, joined by '; '.  A JSON null is a NULL value.
    """
    read = df.select(key, F.from_json(payload, "map<string,string>", {"mode": "PERMISSIVE"}).alias("_m"))
    faults = []
    for f in [*numeric, *text]:
        v = F.try_element_at(col("_m"), F.lit(f))
        wrong = F.when(v.isNotNull() & v.try_cast("double").isNull(), f"{f}: not a number") if f in numeric else F.lit(None).cast("string")
        faults.append(F.when(~F.map_contains_key("_m", f), f"{f}: missing").otherwise(wrong))
    listed = F.concat_ws("; ", *faults)
    error = F.when(col("_m").isNull(), "malformed payload").when(listed != "", listed)
    value = lambda f: F.try_element_at(col("_m"), F.lit(f))
    return read.select(key, *[value(f).try_cast("double").alias(f) for f in numeric], *[value(f).alias(f) for f in text],
                       error.alias("error"))
