"""Embedding near-dedup: spherical k-means cells, blocked cosines, components.

1. Vectors with equal components collapse to one row with a count, so hot copies
   cost nothing.  Vectors that are null, zero, or hold null or non-finite
   components take no part and link with nothing.
2. **Cells.**  Spherical k-means (``k`` about n / ``CELL_ROWS``, within
   [1, ``MAX_CELLS``]) is fitted on at most ``FIT_ROWS`` vectors, those whose id
   hashes low; every vector is then assigned to its nearest
   centroid.
3. **Probes.**  A vector also visits the cells of smaller number that can hold a
   partner.  Two exact bounds rule the others out: of a pair at cosine s or more on
   either side of the plane between two centroids, both lie within
   sqrt(1 - s^2) |c - c'| of it, and a partner's angle to its centroid is at most
   the cell's radius, measured over all its vectors.  No link is missed, whatever
   the vectors' distribution.  Vectors without cluster structure are near many
   planes, and the work then nears all blocks against all.  A number for ``reach``
   replaces the first bound by that many deviations of a partner in a uniformly
   random direction, 1 / sqrt(dim) each: less work, but links are lost, many of
   them where the vectors have few intrinsic dimensions.
4. **Blocks.**  Cells are numbered along the main axis of their centroids, and
   consecutive ones are packed into blocks of about ``BLOCK`` rows (fewer for long
   vectors), so a vector is sent once to all the cells of a block that it visits.
   A block of more rows is split and compared part by part in double precision, so
   a hot cell is shared by tasks and no group is held whole.  Two parts
   return per vector only its number of links and one edge to the smallest vector of
   its linked group inside them: the links' components survive, their number
   stays linear.
5. Components of those edges; the smallest ``vec_id`` of each is kept.

Defined cases: rows that share a vec_id count as one vector (the smallest of
their contents); vectors of different length never link; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.batches import hash_sample
from riskframe.llm.graph import components, local_components
from riskframe.session import cut_lineage

CELL_ROWS = 1024
MAX_CELLS = 4096
FIT_ROWS = 40_000
#: Rows of a block, and components that its vectors hold at most; rows compared at a time.
BLOCK, BLOCK_VALUES, SLICE = 8192, 1 << 21, 256


def block_rows(dim: int) -> int:
    return max(SLICE, min(BLOCK, BLOCK_VALUES // dim))


def _unit(col) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in col])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; empty cells are re-seeded from the rows that
    fit worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best = np.concatenate([(x[i:i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        norm = np.linalg.norm(total, axis=1)
        bad = np.flatnonzero(norm < 1e-12)
        if len(bad):
            fit = np.einsum("ij,ij->i", x, c[best])
            total[bad] = x[np.argsort(fit, kind="stable")[:len(bad)]]
            norm = np.linalg.norm(total, axis=1)
        c = total / norm[:, None]
    # neighbours get neighbouring numbers: the main axis of the centroids
    axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
    return c[np.argsort(c @ axis, kind="stable")]


def _homes(cells: dict[int, np.ndarray], vec: list) -> Iterator[tuple]:
    """(length, rows, cosines to the centroids, nearest centroid) of vectors by length."""
    size = np.array([len(v) for v in vec])
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        sim = _unit([vec[i] for i in rows]) @ cells.get(dim, np.eye(1, dim)).T
        yield dim, rows, sim, sim.argmax(axis=1)


def _radii(cells_bc):
    """Per task: the smallest cosine of a cell's vectors to its centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                for dim, _, sim, home in _homes(cells_bc.value, b.slice(lo, 1024).column("vec").to_pylist()):
                    low = least.setdefault(dim, np.full(sim.shape[1], np.inf))
                    np.minimum.at(low, home, sim.max(axis=1))
        for dim, low in least.items():
            cell = np.flatnonzero(low < np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(low[cell])],
                ["dim", "cell", "low"])
    return run


def _assign(cells_bc, radii_bc, packed: dict[int, int], similarity: float, reach: float | None):
    """Home cell, its block and the blocks that a vector visits; ``packed`` cells make a block."""
    bend = math.sqrt(max(0.0, 1 - similarity ** 2))
    angle = math.acos(max(-1.0, min(1.0, similarity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = cells_bc.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                for dim, rows, sim, home in _homes(cells, part.column("vec").to_pylist()):
                    c, at = cells.get(dim, np.eye(1, dim)), np.arange(len(rows))
                    near = np.arccos(np.clip(sim, -1, 1)) <= radii_bc.value[dim] + angle + 1e-6
                    if similarity > 0:                # the bound on the plane needs an acute angle
                        gap = np.sqrt(np.maximum(0, 2 - 2 * c[home] @ c.T))
                        share = 1.0 if reach is None else min(reach / math.sqrt(dim), 1.0)
                        near &= sim[at, home][:, None] - sim <= share * bend * gap + 1e-9
                    # of two cells the larger number visits the smaller
                    near &= np.arange(len(c))[None, :] < home[:, None]
                    near[at, home] = True
                    take, wide = pa.array(rows), packed[dim]
                    first = np.arange(0, near.shape[1], wide)
                    visits = np.logical_or.reduceat(near, first, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(take), part.column("n").take(take), part.column("vec").take(take),
                         pa.array(np.full(len(rows), dim, np.int32)), pa.array(home.astype(np.int32)),
                         pa.array((home // wide).astype(np.int32)),
                         pa.array([np.flatnonzero(r).astype(np.int32) for r in visits], pa.list_(pa.int32()))],
                        ["id", "n", "vec", "dim", "home", "own", "probes"])
    return run


def _compare(similarity: float):
    """Links between the visitors and the residents of a block, in parts.

    A pair of one cell stands here in both orders and credits its first side; any
    other pair is met once, where the vector of the larger cell visits, and
    credits both sides.
    """
    names = ["id", "links", "root"]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        if not len(left) or not len(right):
            return none
        y, b, home_b, n_b = _unit(right["vec_r"]), *(right[c].to_numpy() for c in ("id_r", "home_r", "n_r"))
        x, a, home_a, n_a = _unit(left["vec"]), *(left[c].to_numpy() for c in ("id", "home", "n"))
        credit_a, credit_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        forests = []
        for lo in range(0, len(a), SLICE):
            part = slice(lo, lo + SLICE)
            cos = x[part] @ y.T
            near = cos >= similarity
            for i, j in np.argwhere(np.abs(cos - similarity) < 1e-12):   # one value for either order
                u, v = (x[lo + i], y[j]) if a[lo + i] < b[j] else (y[j], x[lo + i])
                near[i, j] = math.fsum(u * v) >= similarity
            near &= (a[part, None] != b) & (home_b <= home_a[part, None])
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i += lo
            np.add.at(credit_a, i, n_b[j])
            cross = home_b[j] < home_a[i]
            np.add.at(credit_b, j[cross], n_a[i[cross]])
            forests.append(local_components(a[i], b[j]))
        if not forests:
            return none
        nodes, root = local_components(*(np.concatenate(ends) for ends in zip(*forests)))
        links = np.zeros(len(nodes), np.int64)
        for ids, credit in ((a, credit_a), (b, credit_b)):
            np.add.at(links, np.searchsorted(nodes, ids[credit > 0]), credit[credit > 0])
        return pd.DataFrame({"id": nodes, "links": links, "root": root})
    return run


def embedding_near_duplicates(vectors: DataFrame, similarity: float = 0.95, reach: float | None = None,
                              id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector id: ``id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fine = fine & F.exists("vec", lambda v: v != 0)
    ids = base.where("id IS NOT NULL").groupBy("id").agg(F.min(F.when(fine, F.col("vec"))).alias("vec"))
    ids = cut_lineage(ids)
    kinds = cut_lineage(ids.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")))

    # one row per vector length
    sizes = {r.dim: r["count"] for r in kinds.groupBy(F.size("vec").alias("dim")).count().collect()}
    sample = hash_sample(kinds.select("id", "vec"), "id", sum(sizes.values()), FIT_ROWS).collect()
    sample.sort(key=lambda r: r.id)
    cells = {}
    for dim, n in sizes.items():
        rows = [r.vec for r in sample if len(r.vec) == dim]
        if rows:
            cells[dim] = spherical_kmeans(_unit(rows), max(1, min(MAX_CELLS, n // CELL_ROWS, len(rows) // 4)))
    cell_bc = spark.sparkContext.broadcast(cells)

    radii = {dim: np.full(len(cells.get(dim, [0])), -np.inf) for dim in sizes}      # an empty cell is not visited
    for r in kinds.select("vec").mapInArrow(_radii(cell_bc), "dim int, cell int, low double").groupBy("dim", "cell").agg(
            F.min("low").alias("low")).collect():           # a row per cell
        radii[r.dim][r.cell] = math.acos(max(-1.0, min(1.0, r.low)))
    radii_bc = spark.sparkContext.broadcast(radii)

    # cells of a block, so that it holds about its number of rows
    packed = {dim: max(1, round(block_rows(dim) * len(radii[dim]) / n)) for dim, n in sizes.items()}
    vec_type = kinds.schema["vec"].dataType.simpleString()
    placed = cut_lineage(kinds.select("id", "n", "vec").mapInArrow(
        _assign(cell_bc, radii_bc, packed, similarity, reach),
        f"id long, n long, vec {vec_type}, dim int, home int, own int, probes array<int>"))

    visits = placed.withColumn("block", F.explode("probes"))
    full = F.greatest(F.lit(SLICE), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / F.col("dim"))))
    parts = lambda c: F.ceil(F.count("*") / full).cast("int").alias(c)
    homes = placed.groupBy("dim", F.col("own").alias("block")).agg(parts("rparts"))
    blocks = cut_lineage(placed.select("dim", F.explode("probes").alias("block")).groupBy("dim", "block").agg(
        parts("vparts")).join(homes, ["dim", "block"]))
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(blocks, ["dim", "block"]).select(
        "dim", "block", pick("vparts").alias("v"), every("rparts").alias("r"), "id", "n", "vec", "home")
    right = placed.withColumn("block", F.col("own")).join(blocks, ["dim", "block"]).select(
        "dim", "block", every("vparts").alias("v"), pick("rparts").alias("r"), "id", "n", "vec", "home")
    key = ["dim", "block", "v", "r"]
    right = right.toDF(*[f"{c}_r" for c in right.columns])
    met = cut_lineage(left.groupBy(*key).cogroup(right.groupBy(*[f"{c}_r" for c in key])).applyInPandas(
        _compare(similarity), "id long, links long, root long"))

    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = kinds.join(counts, "id", "left").join(classes, F.col("id") == F.col("node"), "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    out = ids.join(named, "vec", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    unnamed = base.where("id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(unnamed).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
