"""Every query with an oracle must equal DuckDB on the same parquet tables."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    import decimal
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):                    # collect() does not keep a map's entry order
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(rows, df.columns) == _canon(res.fetchall(), ocols)


def test_exported_class_order(spark, duck):
    """The map's entry order is part of the exported value."""
    from pyspark.sql import functions as F
    got = QUERIES["export_class_distribution"](spark, SF_SMALL).select(
        F.transform(F.map_entries("class_distribution"), lambda e: e["key"]).alias("k")).first().k
    want = duck.execute(f"SELECT map_keys(class_distribution), typeof(rows) FROM ({ORACLES['export_class_distribution']})").fetchone()
    assert list(got) == list(want[0]) == sorted(got) and want[1] == "BIGINT"
