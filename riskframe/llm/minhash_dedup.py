"""MinHash near-dedup: BagMinHash signatures, bands, exact multiset overlap.

A document is the multiset of its five-word shingles (a document of fewer words
is one shingle of all of them).  Two documents are linked if the Jaccard
similarity of their multisets - sum of minima over sum of maxima of the
counts - is at least ``similarity``; classes are the components of the links.

**Signature.**  The weight axis of every shingle is discretised into the dyadic
intervals [0,1), [1,2), [2,4), [4,8)...  Each (shingle, interval) owns a Poisson
process of rate (components x length), seeded by its hash: points come in
ascending time, each with a component and a position inside the interval, and a
point counts if its position lies below the shingle's count (only the topmost
interval is cut).  A component keeps its earliest point, so two documents agree
on it with probability equal to their weighted Jaccard similarity.  Points past
a bound on the latest of all minima, (ln m + 2.5) / total weight, are never
drawn; the few documents with a component still empty go on to a doubled bound.

**Bands.**  ``bands`` bands of ``rows`` components: at similarity 0.8 a pair meets
in none with probability (1 - 0.8^7)^36 = 0.0002, at 0.85 with 8e-7.

**Verification without all pairs.**  Equal multisets collapse to one
representative first.  In every bucket each member is checked against the
bucket's smallest member only (a star) by exact counts; components of those
links follow.  Buckets whose members are all in one component are settled.  In
the others, members of *different* components are compared in block pairs of
fixed size: whole signatures rule out pairs five standard deviations below the
threshold (a miss probability of 3e-7), the rest are checked by exact overlap
unless already connected, and a block pair returns a spanning forest of the components it linked, never
its pairs.  Nothing is capped; large stars are salted.

Defined cases: null and empty texts have no shingles and link with nothing; rows
with a null id are returned with a null class and are kept; different texts of
one id are classed each on its own, and of those in one class named by that id the
one of smallest hash is kept; repeated rows are repeated in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches
from riskframe.llm.graph import components
from riskframe.session import cut_lineage, tasks_for

U64 = np.uint64
BLOCK = 1024
#: Members of a star that are checked against one copy of its center.
STAR = 512


def shingle_counts(data: np.ndarray, offs: np.ndarray, size: int = 5):
    """Distinct shingles of each document: (hash, count, document), sorted by
    document and hash."""
    w = H.cut_words(data, offs)
    prefix = H.run_hashes(w.hash)
    n = w.counts
    grams = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), grams)
    at = w.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    h = H.run_hash(prefix, at, np.minimum(size, n)[doc])
    stop = np.cumsum(grams)
    for a, b in zip(stop - grams, stop):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    lead = np.flatnonzero(new)
    return h[lead], np.diff(np.append(lead, len(h))), doc[lead]


def _points(key, size, limit, cut, deadline, m):
    """All points of the processes before ``deadline``: (row, component, time, id)."""
    out = []
    live, t, k, block = np.arange(len(key)), np.zeros(len(key)), 0, 1
    while len(live):
        seed = key[live, None] + np.arange(k, k + block, dtype=U64)[None, :] * U64(0xD1342543DE82EF95)
        a = H.mix(seed)
        gap = -np.log(((a >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / (m * size[live])[:, None]
        at = t[live, None] + np.cumsum(gap, axis=1)
        b = H.mix(a)
        good = at < deadline[live, None]
        row = np.broadcast_to(live[:, None], good.shape)[good]
        b, tt = b[good], at[good]
        inside = ~cut[row] | (((b >> U64(32)).astype(np.float64) * 2.0 ** -32) * size[row] < limit[row])
        c = ((b & U64(0xFFFFFFFF)) * U64(m)) >> U64(32)
        out.append((row[inside], c[inside].astype(np.int64), tt[inside], H.mix(b[inside] + U64(7))))
        t[live] = at[:, -1]
        live = live[at[:, -1] < deadline[live]]
        k, block = k + block, min(64, max(1, k + block))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def signatures(shingle: np.ndarray, count: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures, one row of ``m`` point ids per document (0 if it
    has no shingles)."""
    levels = np.ones(len(count), np.int64)
    big = count > 1
    levels[big] = 1 + np.ceil(np.log2(count[big])).astype(np.int64)
    row = np.repeat(np.arange(len(count)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    size = np.maximum(low, 1).astype(np.float64)
    limit = (count[row] - low).astype(np.float64)
    cut = limit < size
    key = H.mix(shingle[row] ^ H.mix(level.astype(U64)))
    of = doc[row]
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    bound = (math.log(m) + 2.5) / np.maximum(weight, 1)
    best = np.full(n_docs * m, np.inf)
    ident = np.zeros(n_docs * m, U64)
    todo = np.arange(len(row))
    while len(todo):
        r, c, t, v = _points(key[todo], size[todo], limit[todo], cut[todo], bound[of[todo]], m)
        slot = of[todo][r] * m + c
        np.minimum.at(best, slot, t)
        win = t == best[slot]
        ident[slot[win]] = v[win]
        short = np.isinf(best).reshape(n_docs, m).any(axis=1) & (weight > 0)
        bound[short] *= 2
        todo = todo[short[of[todo]]]
    return ident.reshape(n_docs, m)


def _sign(bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in H.slices(batches):
            n = b.num_rows
            h, count, doc = shingle_counts(*H.text_buffer(b.column("text")))
            sig = signatures(h, count, doc, n, m)
            power = H._table("pow", rows + 1)
            band = (sig.reshape(n, bands, rows) * power[1:]).sum(axis=2, dtype=U64)
            band = H.mix(band ^ H.mix(np.arange(bands, dtype=U64))[None, :])
            lead = np.searchsorted(doc, np.arange(n))
            some = np.diff(np.append(lead, len(doc))) > 0
            c1, c2 = np.zeros(n, U64), np.zeros(n, U64)
            if len(h):
                c1[some] = np.add.reduceat(H.mix(h + count.astype(U64) * U64(H.BASE)), lead[some])
                c2[some] = np.add.reduceat(H.mix(h ^ H.mix(count.astype(U64))), lead[some])
            weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            keep = np.flatnonzero(some)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), b.column("tkey").take(take), pa.array(weight[keep]), H.as_long(c1[keep]),
                 H.as_long(c2[keep]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands),
                                          H.as_long(band[keep].ravel())),
                 pa.array([x.tobytes() for x in (sig[keep] & U64(255)).astype(np.uint8)], pa.binary())],
                ["id", "tkey", "weight", "c1", "c2", "bands", "sig"])
    return run


def _overlap(similarity: float):
    """Rows sorted by (center, salt, member); a center's own row leads its group."""
    def bag(z, packed):
        data = np.frombuffer(z.decompress(packed), np.uint8)
        h, count, _ = shingle_counts(data, np.array([0, len(data)]))
        return h, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        center, mine = None, None
        for b in batches:
            a_out, b_out, j_out = [], [], []
            for c, i, packed in zip(b.column("center").to_pylist(), b.column("id").to_pylist(), b.column("packed")):
                h, n = bag(z, packed.as_py())
                if i == c:
                    center, mine = c, (h, n)
                    continue
                if c != center:
                    raise ValueError("a member came before its center")
                _, x, y = np.intersect1d(mine[0], h, assume_unique=True, return_indices=True)
                both = int(np.minimum(mine[1][x], n[y]).sum())
                either = int(mine[1].sum() + n.sum()) - both
                a_out.append(c)
                b_out.append(i)
                j_out.append(both / either)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()),
                                              pa.array(j_out, pa.float64())], ["a", "b", "jaccard"])
    return run


def _verify(pairs: DataFrame, packed: DataFrame, similarity: float) -> DataFrame:
    """Exact similarity of distinct pairs ``(a, b, salt)``; a center with many members
    is dealt over its salts, each with its own copy of the center."""
    rows = pairs.select(F.col("a").alias("center"), "salt", F.col("b").alias("id"))
    centers = rows.select("center", "salt").distinct().select("center", "salt", F.col("center").alias("id"))
    full = rows.union(centers).join(packed, "id")
    full = full.repartition("center", "salt").sortWithinPartitions(
        "center", "salt", F.col("id") != F.col("center"), "id")
    return full.select("center", "id", "packed").mapInArrow(_overlap(similarity), "a long, b long, jaccard double")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = [z.compress((t or "").encode()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tkey"), pa.array(packed, pa.binary())],
                                         ["id", "tkey", "packed"])


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``x[i]``, ``y[j]`` where ``want``; by
    0/1 matrix products over slices of the elements, or pair by pair if cheaper."""
    size = lambda sets: sum(map(len, sets)) / max(1, len(sets))
    out = np.zeros(want.shape, np.int64)
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    if want.sum() * (size(x) + size(y)) * 20 < want.size * len(both) * 0.1:
        for i, j in np.argwhere(want):
            out[i, j] = len(np.intersect1d(x[i], y[j], assume_unique=True))
        return out

    def places(sets):
        row = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        ok = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (rx, cx), (ry, cy) = places(x), places(y)
    for lo in range(0, len(both), 4096):
        a = np.zeros((len(x), 4096), np.float32)
        b = np.zeros((len(y), 4096), np.float32)
        for m, r, c in ((a, rx, cx), (b, ry, cy)):
            s, e = np.searchsorted(c, [lo, lo + 4096])
            m[r[s:e], c[s:e] - lo] = 1
        out += np.rint(a @ b.T).astype(np.int64)
    return out


def _bag(z, packed: bytes) -> np.ndarray:
    """A multiset as the sorted set of (shingle, how manieth occurrence)."""
    data = np.frombuffer(z.decompress(packed), np.uint8)
    h, n, _ = shingle_counts(data, np.array([0, len(data)]))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(H.mix(np.repeat(h, n) + nth.astype(U64) * U64(H.BASE)))


def _across(similarity: float, m: int, per_band: int):
    """Links between different components within one block pair of a bucket.

    A pair is looked at in the first band it shares only (by the low bytes of the band's
    components, all equal by chance with probability 2^-56).  Signatures rule out
    pairs five standard deviations below the threshold.  The rest are checked by
    exact overlap from the best estimate down, skipping pairs that the links found
    here already connect; if many stay open, they are counted at once.  Returned are
    the linked components as (component, smallest component it is linked to
    here), at most one row per component.
    """
    least = m * similarity - 5 * math.sqrt(m * similarity * (1 - similarity))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part, other, band = int(key[2]), int(key[3]), int(key[1])
        x = np.flatnonzero(rows["part"].to_numpy() == part)
        y = x if part == other else np.flatnonzero(rows["part"].to_numpy() == other)
        rep, comp, weight = rows["rep"].to_numpy(), rows["component"].to_numpy(), rows["weight"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), m)
        before = sig[:, :band * per_band].reshape(len(rows), band, per_band)
        at_x, at_y, agree = [], [], []
        for i in x:
            j = y[comp[y] != comp[i]]
            if part == other:
                j = j[rep[j] > rep[i]]
            j = j[np.minimum(weight[j], weight[i]) >= similarity * np.maximum(weight[j], weight[i])]
            same = (sig[j] == sig[i]).sum(axis=1)
            j, same = j[same >= least], same[same >= least]
            first = ~(before[j] == before[i]).all(axis=2).any(axis=1)
            at_x.append(np.full(first.sum(), i))
            at_y.append(j[first])
            agree.append(same[first])
        order = np.argsort(-np.concatenate(agree), kind="stable") if agree else []
        if not len(order):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        at_x, at_y = np.concatenate(at_x)[order], np.concatenate(at_y)[order]
        z, bags, root = zstandard.ZstdDecompressor(), {}, {}

        def bag(i: int) -> np.ndarray:
            if i not in bags:
                bags[i] = _bag(z, rows["packed"].iloc[i])
            return bags[i]

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        def link(i: int, j: int, both: int) -> None:
            if both >= similarity * (weight[i] + weight[j] - both):
                a, b = find(comp[i]), find(comp[j])
                root[max(a, b)] = min(a, b)

        tries = 4 * len(rows)
        for k, (i, j) in enumerate(zip(at_x.tolist(), at_y.tolist())):
            if find(comp[i]) == find(comp[j]):
                continue
            if tries == 0:
                open_ = np.array([find(comp[p]) != find(comp[q]) for p, q in zip(at_x[k:], at_y[k:])])
                ux, px = np.unique(at_x[k:][open_], return_inverse=True)
                uy, py = np.unique(at_y[k:][open_], return_inverse=True)
                want = np.zeros((len(ux), len(uy)), bool)
                want[px, py] = True
                both = _shared_counts([bag(i) for i in ux.tolist()], [bag(j) for j in uy.tolist()], want)
                for p, q in zip(px, py):
                    link(ux[p], uy[q], int(both[p, q]))
                break
            tries -= 1
            link(i, j, len(np.intersect1d(bag(i), bag(j), assume_unique=True)))
        node = np.array(list(root), np.int64)
        return pd.DataFrame({"a": node, "b": np.array([find(c) for c in node.tolist()], np.int64)})
    return run


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 36, rows: int = 7,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, text_hash, component_id, kept``.

    ``component_id`` is the smallest id of the row's class and ``kept`` marks the
    class's own row; both follow from links of similarity at least
    ``similarity``.  ``text_hash`` is xxhash64 of the text.
    """
    text_batches(docs)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("tkey"))
    texts = base.where("id IS NOT NULL")
    signed = cut_lineage(texts.mapInArrow(
        _sign(bands, rows), "id long, tkey long, weight long, c1 long, c2 long, bands array<long>, sig binary"))
    tasks = tasks_for(signed.count())

    # one representative per distinct multiset; its number ``rep`` stands for the content, not for
    # an id, since one id may have several contents
    content = signed.groupBy("c1", "c2").agg(F.min(F.struct("id", "tkey")).alias("r"))
    content = cut_lineage(content.select("c1", "c2", F.col("r.id").alias("id"), F.col("r.tkey").alias("tkey"),
                                         F.monotonically_increasing_id().alias("rep")), tasks)
    reps = cut_lineage(signed.join(content.select("rep", "id", "tkey"), ["id", "tkey"]).dropDuplicates(["rep"])
                       .select("rep", "id", "tkey", "weight", "bands", "sig"), tasks)

    banded = reps.select("rep", "weight", F.posexplode("bands").alias("band", "bucket"))
    heads = banded.groupBy("bucket").agg(F.min(F.struct("rep", "weight")).alias("h"), F.count("*").alias("n"))
    heads = cut_lineage(heads.where("n > 1").select("bucket", F.col("h.rep").alias("head"), F.col("h.weight").alias("head_weight"),
                                                    F.ceil(F.col("n") / F.lit(STAR)).cast("int").alias("salts")), tasks)
    met = cut_lineage(banded.join(heads, "bucket"), tasks)

    involved = met.select("rep").distinct().join(reps.select("rep", "id", "tkey"), "rep")
    packed = cut_lineage(texts.mapInArrow(_pack, "id long, tkey long, packed binary").join(involved, ["id", "tkey"])
                         .dropDuplicates(["rep"]).select(F.col("rep").alias("id"), "packed"), tasks)

    fits = F.least("weight", "head_weight") >= F.lit(similarity) * F.greatest("weight", "head_weight")
    star = cut_lineage(met.where((F.col("rep") != F.col("head")) & fits)
                       .groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(F.max("salts").alias("salts"))
                       .select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), tasks)
    checked = cut_lineage(_verify(star, packed, similarity), tasks)
    links = checked.where(F.col("jaccard") >= similarity).select("a", "b")
    first = components(links, tasks=tasks)

    labelled = met.select("bucket", "band", "rep", "weight").join(first, F.col("rep") == F.col("node"), "left").select(
        "bucket", "band", "rep", "weight", F.coalesce("component", "rep").alias("component"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    open_ = open_.where("x <> y").select("bucket", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts"))
    left = labelled.join(open_, "bucket").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    left = cut_lineage(left, tasks).join(reps.select("rep", "sig"), "rep").join(packed.withColumnRenamed("id", "rep"), "rep")
    # a row goes to the block pairs (p, q), p <= q, that its part is in
    pair = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    left = left.select("bucket", "band", F.col("part"), pair, "rep", "weight", "component", "sig", "packed")
    left = left.select(F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), *[
        c for c in left.columns if c != "other"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    late = left.repartition(n, "bucket", "band", "p", "q").groupBy("bucket", "band", "p", "q").applyInPandas(
        _across(similarity, bands * rows, rows), "a long, b long")
    classes = components(links.union(late), tasks=tasks)

    # only now the contents' smallest ids name the classes
    member = content.join(classes, F.col("rep") == F.col("node"), "left").select(
        "c1", "c2", "id", "tkey", F.coalesce("component", "rep").alias("component"))
    member = cut_lineage(member, tasks)
    names = member.groupBy("component").agg(F.min(F.struct("id", "tkey")).alias("own"))
    named = member.join(names, "component").select(
        "c1", "c2", F.col("own.id").alias("component_id"), F.col("own.tkey").alias("own_key"))
    found = signed.select("id", "tkey", "c1", "c2").distinct().join(named, ["c1", "c2"]).select(
        "id", "tkey", "component_id", "own_key")
    keys = base.select("id", "tkey")
    out = keys.join(found, ["id", "tkey"], "left")
    component = F.coalesce("component_id", "id")
    own = (component == F.col("id")) & (F.coalesce("own_key", "tkey") == F.col("tkey"))
    return out.select("id", F.col("tkey").alias("text_hash"), component.alias("component_id"),
                      F.coalesce(own, F.lit(True)).alias("kept"))
