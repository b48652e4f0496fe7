"""Hard negatives against brute force with Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import hard_negatives as N
from riskframe.llm.queries import QUERIES
from tests.llm.helpers import SF


def mined(rows, is_anchor, k=5, n=5, low=80, high=100):
    """rows: (id, label, vector)."""
    ok = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows
          if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, anchors = [], {(i, label, tuple(np.trim_zeros(v, "b"))) for i, label, v in ok if is_anchor(i)}
    for i, label, v in anchors:
        score = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ok]
        for s, j, _ in sorted(x for x in score if x[2] == label and x[1] != i)[:k]:
            found = sorted(x for x in score if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:n]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m, _) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query_on_data(spark):
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rows_of(QUERIES["op13_hard_negatives"](spark, SF))
    assert got == mined(rows, lambda i: i % 100 == 0) and got


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 10), (40, 40, 40), (33, 65, 129), (256, 64, 700), (5, 0, 7)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for top in (3, 1 << 20, 1 << 62):            # the last wraps around, as int64 does
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (N.strassen(a, b) == a @ b).all()


def test_heaps_keep_the_best_of_any_order():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        score = rng.integers(-4, 5, (3, n))
        score[0, 0] = np.iinfo(np.int64).min
        ids, valid = rng.permutation(n), rng.random((3, n)) < 0.7
        heap, at = N.Heaps(3, 4), 0
        while at < n:
            part = np.arange(at, min(n, at + int(rng.integers(1, 20))))
            part = part[np.argsort(ids[part])]
            heap.merge(slice(0, 3), score[:, part], ids[part], valid[:, part])
            at += len(part)
        got = dict(heap.rows())
        for r in range(3):
            want = sorted((-int(s), int(i)) for s, i, v in zip(score[r], ids, valid[r]) if v)[:4]
            assert [(-e["score"], e["id"]) for e in got.get(r, [])] == want


def awkward():
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-2, 3, 8) / 4]) for i in range(400)]
    rows += [(500 + i, i % 2, [0.5, 0.5] + [0.0] * 6) for i in range(300)]          # one very common vector
    rows += [(None, 1, [1.0]), (1000, None, [1.0]), (1100, 1, None), (1200, 1, [None, 1.0]), (1300, 1, [float("nan")]),
             (1400, 1, [float("inf")]), (1500, 1, []), (1600, 2, [1.0, 1.0]), (100, 1, rows[100][2]), (200, rows[200][1], rows[200][2]),
             (1700, 9, [1.0] * 8), (1800, -1, [-1.0] * 8), (17, 2, rows[17][2]), (17, 2, rows[17][2])]
    return rows


def test_awkward_rows_over_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in awkward()],
                               "vec_id long, label int, embedding array<double>, tile int, slot int, heap string").repartition(4)
    got = rows_of(N.hard_negatives(df, F.col("vec_id") % 100 == 0))
    assert got == mined(awkward(), lambda i: i % 100 == 0) and len(got) > 100


def test_fewer_and_none(spark):
    schema = "vec_id long, label int, embedding array<float>"
    few = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.9]), (3, 0, [0.5])]
    got = rows_of(N.hard_negatives(spark.createDataFrame(few, schema), F.col("vec_id") == 0))
    assert got == [(0, 1, 1, 2, 65536, 58880)]
    assert N.hard_negatives(spark.createDataFrame(few, schema), F.lit(False)).count() == 0
    assert N.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
