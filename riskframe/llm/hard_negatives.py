"""Hard negatives by exact integer inner products of anchors with all rows.

Components become integers, ``floor(scale * x)``.  Rows are packed, where they are read,
into blocks of ``BLOCK_ROWS`` rows sorted by label; anchors (a stated part of the rows) into tiles
of about ``ANCHOR_ROWS``.  Every anchor tile meets every block once, in a slot of the
(tile, slot) grid, and a task goes through its blocks one at a time: Strassen's recursive
multiplication (operands zero-padded to halve evenly, int64 additions and products, so
exact) gives the scores, and bounded heaps per anchor keep the best, merged from block to
block in the task and from slot to slot by Spark.

Two passes: the first multiplies anchors with rows of their own label and keeps the best
``positives``; the second multiplies them with all other labels and keeps, per positive,
the best ``negatives`` whose score lies in the window [low, high] percent of the
positive's.  Slots are as many as the shuffle has partitions, so what leaves the tasks
grows with the anchors alone, and no two rows are ever paired outside a task.

Defined cases: rows with a null id or label, a null vector or a null or non-finite component
take no part; a shorter vector counts as zero-padded, an empty one as zero; repeated rows
each take part, but a repeated anchor answers once; an anchor's positives have another id, its
negatives another label; integers are int64, components beyond it saturate and scores wrap around; extra
columns are not read; an empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

ANCHOR_ROWS, BLOCK_ROWS = 1024, 4096
#: Score tiles of one product are at most this large (int64).
TILE = (256, 1024)
#: Strassen stops halving at this side.
LEAF = 16
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 product (m, k) x (k, n); zero-padded so that every level halves evenly."""
    (m, k), n = a.shape, b.shape[1]
    levels = max(0, min(m, k, n, 1 << 12).bit_length() - LEAF.bit_length())
    if levels == 0:
        return a @ np.asfortranarray(b)
    unit = 1 << levels
    up = [-(-x // unit) * unit for x in (m, k, n)]
    if up != [m, k, n]:
        a = np.pad(a, ((0, up[0] - m), (0, up[1] - k)))
        b = np.pad(b, ((0, up[1] - k), (0, up[2] - n)))
    return _halved(a, b, levels)[:m, :n]


def _halved(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if levels == 0:
        return a @ np.asfortranarray(b)
    (m, k), n = (x // 2 for x in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _halved(a11 + a22, b11 + b22, levels - 1)
    p2 = _halved(a21 + a22, b11, levels - 1)
    p3 = _halved(a11, b12 - b22, levels - 1)
    p4 = _halved(a22, b21 - b11, levels - 1)
    p5 = _halved(a11 + a12, b22, levels - 1)
    p6 = _halved(a21 - a11, b11 + b12, levels - 1)
    p7 = _halved(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``k`` (score, id) of every row: higher scores first, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), LEAST)
        self.id = np.zeros((rows, k), np.int64)
        self.full = np.zeros((rows, k), bool)

    def rows(self) -> Iterator[tuple[int, list[dict]]]:
        """(row, entries from the best on) of every row that has any."""
        for r in np.flatnonzero(self.full[:, 0]):
            f = self.full[r]
            yield int(r), [{"score": s, "id": i} for s, i in zip(self.score[r][f].tolist(), self.id[r][f].tolist())]

    def merge(self, rows: slice, score: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Take in candidates (columns in ascending order of ``ids``) of some rows."""
        floor = np.where(self.full[rows, -1], self.score[rows, -1], LEAST)
        live = valid & (score >= floor[:, None])
        some = np.flatnonzero(live.any(axis=0))  # columns that can enter a heap at all
        if len(some) == 0:
            return
        score, live, ids = score[:, some], live[:, some], ids[some]
        masked = np.where(live, score, LEAST)
        each = np.arange(len(score))
        got = [(self.score[rows], self.id[rows], self.full[rows])]
        for _ in range(min(self.k, len(some))):
            at = np.argmax(masked, axis=1)
            # a candidate may itself score LEAST: then the first live column is the best
            at = np.where(live[each, at], at, np.argmax(live, axis=1))
            got.append((score[each, at][:, None], ids[at][:, None], live[each, at][:, None]))
            masked[each, at] = LEAST
            live[each, at] = False
        s, i, f = (np.concatenate(x, axis=1) for x in zip(*got))
        # full entries first, by descending score (~ reverses int64 without overflow), then ascending id
        order = np.lexsort((i, ~s, ~f), axis=-1)[:, :self.k]
        row = each[:, None]
        self.score[rows], self.id[rows], self.full[rows] = s[row, order], i[row, order], f[row, order]


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]) -> dict:
    """One block: rows sorted by label and id, in the narrowest integers that hold them."""
    m = np.zeros((len(ids), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(m, vectors):
        row[:len(v)] = v
    order = np.lexsort((ids, labels))
    top = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if top <= np.iinfo(k).max)
    return {"n": len(ids), "width": m.shape[1], "kind": kind, "ids": ids[order].tobytes(), "labels": labels[order].tobytes(),
            "matrix": m[order].astype(kind).tobytes()}


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision, saturated to int64."""
    x = np.floor(x.astype(np.float64) * scale)
    inside = np.clip(x, -2.0 ** 63, np.nextafter(2.0 ** 63, 0)).astype(np.int64)
    return np.where(x >= 2.0 ** 63, np.iinfo(np.int64).max, inside)


def _rows(scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for b in batches:
        col = b.column("vector")
        flat = _whole(col.flatten().to_numpy(zero_copy_only=False), scale)
        offs = np.asarray(col.offsets) - col.offsets[0].as_py()
        for i, label, s, e in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), offs[:-1], offs[1:]):
            yield i, label, flat[s:e]


def _blocks(scale: int):
    """Rows (id, label, vector) -> packed blocks of at most BLOCK_ROWS rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(scale, batches)
        while some := list(islice(rows, BLOCK_ROWS)):
            ids, labels, vectors = zip(*some)
            row = _packed(np.array(ids, np.int64), np.array(labels, np.int64), vectors)
            yield pa.RecordBatch.from_pylist([row], schema=_PACKED)
    return run


def _keys(scale: int):
    """Rows (id, label, vector) -> (id, label, key), the integers without trailing zeros as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(scale, batches)
        while some := list(islice(rows, BLOCK_ROWS)):
            ids, labels, vectors = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()),
                                              pa.array([np.trim_zeros(v, "b").tobytes() for v in vectors], pa.binary())], ["id", "label", "key"])
    return run


PACKED = "n int, width int, kind string, ids binary, labels binary, matrix binary"
_PACKED = pa.schema([("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()),
                     ("labels", pa.binary()), ("matrix", pa.binary())])
HEAP = "array<struct<score:long,id:long>>"
_HEAP = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.frombuffer(row["matrix"], row["kind"]).reshape(row["n"], row["width"]).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), m


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, k - x.shape[1]))) if x.shape[1] < k else x for x in (a, b))
    return strassen(a, b.T)


def _runs(labels: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.flatnonzero(np.diff(labels, prepend=labels[:1] - 1)) if len(labels) else []
    for s, e in zip(cut, [*cut[1:], len(labels)]):
        yield int(labels[s]), slice(int(s), int(e))


def _tiles(part: slice, size: int) -> Iterator[slice]:
    for s in range(part.start, part.stop, size):
        yield slice(s, min(part.stop, s + size))


class Positives:
    """Heaps of the anchors' best rows of the same label."""

    schema = f"tile int, row int, heap {HEAP}"
    arrow = pa.schema([("tile", pa.int32()), ("row", pa.int32()), ("heap", _HEAP)])

    def __init__(self, anchor: dict, k: int):
        self.tile = anchor["tile"]
        self.ids, self.labels, self.m = _matrix(anchor)
        self.heaps = Heaps(len(self.ids), k)

    def block(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        theirs = dict(_runs(labels))
        for label, mine in _runs(self.labels):
            if label in theirs:
                for a in _tiles(mine, TILE[0]):
                    for b in _tiles(theirs[label], TILE[1]):
                        self.heaps.merge(a, _product(self.m[a], m[b]), ids[b], self.ids[a][:, None] != ids[b][None, :])

    def rows(self) -> Iterator[dict]:
        for r, heap in self.heaps.rows():
            yield {"tile": self.tile, "row": r, "heap": heap}


class Windows:
    """Heaps of the best other-label rows inside the score window of each positive."""

    schema = f"tile int, row int, ordinal int, anchor long, positive_id long, positive_score long, heap {HEAP}"
    arrow = pa.schema([("tile", pa.int32()), ("row", pa.int32()), ("ordinal", pa.int32()), ("anchor", pa.int64()),
                       ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("heap", _HEAP)])

    def __init__(self, anchor: dict, k: int, low: int, high: int):
        self.tile = anchor["tile"]
        self.ids, self.labels, self.m = _matrix(anchor)
        self.positives = {x["row"]: [(p["score"], p["id"]) for p in x["heap"]] for x in anchor["heaps"]}
        most = max(map(len, self.positives.values()), default=0)
        # whole-number bounds of low * p <= 100 * s <= high * p, by Python's unbounded integers
        self.lo = np.full((len(self.ids), most), np.iinfo(np.int64).max)
        self.hi = np.full((len(self.ids), most), LEAST)
        for r, got in self.positives.items():
            for j, (p, _) in enumerate(got):
                a, b = max(-((-low * p) // 100), LEAST), min(high * p // 100, np.iinfo(np.int64).max)
                if a <= b:
                    self.lo[r, j], self.hi[r, j] = a, b
        self.heaps = [Heaps(len(self.ids), k) for _ in range(most)]

    def block(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        for label, mine in _runs(self.labels):
            s, e = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
            other = np.concatenate([np.arange(s), np.arange(e, len(labels))])
            other = other[np.argsort(ids[other], kind="stable")]
            for b in _tiles(slice(0, len(other)), TILE[1]):
                some = other[b]
                for a in _tiles(mine, TILE[0]):
                    score = _product(self.m[a], m[some])
                    for j, heap in enumerate(self.heaps):
                        heap.merge(a, score, ids[some], (score >= self.lo[a, j, None]) & (score <= self.hi[a, j, None]))

    def rows(self) -> Iterator[dict]:
        for j, heap in enumerate(self.heaps):
            for r, found in heap.rows():
                p, i = self.positives[r][j]
                yield {"tile": self.tile, "row": r, "ordinal": j, "anchor": int(self.ids[r]), "positive_id": i,
                       "positive_score": p, "heap": found}


def _meet(kind: type, *args):
    """Rows in order of (tile, slot), the anchors of a tile before its blocks -> its heaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            rows = state.rows() if state else iter(())
            while some := list(islice(rows, 1000)):
                yield pa.RecordBatch.from_pylist(some, schema=kind.arrow)

        state, where = None, None
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in b.schema.names}
                if (here := (row["tile"], row["slot"])) != where:
                    yield from out()
                    state, where = None, here
                if row["is_anchor"]:
                    state = kind(row, *args)
                elif state:                      # a tile number may have no anchors
                    state.block(*_matrix(row))
        yield from out()
    return run


def _meetings(anchors: DataFrame, blocks: DataFrame, tiles: int, kind: type, *args) -> DataFrame:
    """Every anchor tile against every block, the blocks dealt over the slots of the tile."""
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, math.ceil(parts / tiles))
    none = F.lit(None).cast(f"array<struct<row:int,heap:{HEAP}>>")
    left = anchors if "heaps" in anchors.columns else anchors.withColumn("heaps", none)
    left = left.withColumns({"slot": F.explode(F.sequence(F.lit(0), F.lit(slots - 1))), "is_anchor": F.lit(True)})
    right = blocks.withColumns({"slot": F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"), "is_anchor": F.lit(False), "heaps": none,
                                "tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    met = left.unionByName(right).repartition(parts, "tile", "slot").sortWithinPartitions("tile", "slot", F.col("is_anchor").desc())
    return met.mapInArrow(_meet(kind, *args), kind.schema)


def _merged(k: int) -> Column:
    """The best k of the heaps of all slots, whose number does not depend on the data."""
    best = F.expr("array_sort(flatten(collect_list(heap)), (x, y) -> CASE WHEN x.score > y.score THEN -1 "
                  "WHEN x.score < y.score THEN 1 WHEN x.id < y.id THEN -1 WHEN x.id > y.id THEN 1 ELSE 0 END)")
    return F.slice(best, 1, k)


def _pack_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    vectors = [np.frombuffer(x, np.int64) for x in pdf["key"]]
    row = _packed(pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), vectors)
    return pd.DataFrame([{"tile": int(key[0]), **row}])


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the columns of ``rows``; ``low`` and ``high`` are percent.
    """
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    flat = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).cast("array<double>").alias("vector")]
    blocks = cut_lineage(usable.select(*flat).mapInArrow(_blocks(scale), PACKED))
    own = cut_lineage(usable.where(is_anchor).select(*flat).mapInArrow(_keys(scale), "id long, label long, key binary").distinct())
    tiles = max(1, math.ceil(own.count() / ANCHOR_ROWS))
    dealt = own.withColumn("tile", F.pmod(F.xxhash64("id", "label", "key"), F.lit(tiles)).cast("int"))
    anchors = cut_lineage(dealt.groupBy("tile").applyInPandas(_pack_tile, f"tile int, {PACKED}"))

    best = _meetings(anchors, blocks, tiles, Positives, positives).groupBy("tile", "row").agg(_merged(positives).alias("heap"))
    heaps = best.groupBy("tile").agg(F.collect_list(F.struct("row", "heap")).alias("heaps"))     # one tile's anchors
    found = _meetings(cut_lineage(anchors.join(heaps, "tile")), blocks, tiles, Windows, negatives, low, high)
    kept = found.groupBy("tile", "row", "ordinal", "anchor", "positive_id", "positive_score").agg(_merged(negatives).alias("heap"))
    out = kept.select("anchor", "positive_id", "positive_score", F.posexplode("heap").alias("at", "negative"))
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).alias("rank"),
                      F.col("negative.id").alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score"))
