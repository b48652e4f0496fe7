"""Benchmark decontamination: q-gram lemma filter, then banded alignment.

A document is contaminated by a benchmark item if some substring of it lies
within e = floor(``max_edit_rate`` x length) character edits of the whole item;
both are lower-cased and runs of white space become one space.

1. **Count.**  Every q-gram of every document is looked up among the items'
   q-grams.  A hit at document position p of a gram at item position o lies on
   diagonal p - o.  An occurrence with at most e edits stays within e diagonals
   of its start and keeps at least L + 1 - q (1 + e) of the item's q-grams (the
   q-gram lemma: one edit destroys at most q of them), so hits are counted in
   overlapping diagonal bands of width 2w with w > 2e, at least one of which
   holds them all.
2. **Retain** the bands that reach the bound.
3. **Verify** each by semi-global alignment restricted to the band.

Items are a given query set: they are compared with all documents in blocks of at
most ``BLOCK_CHARS`` characters of items, so what is sent to the tasks is bounded
however large the benchmark is; a larger one takes several passes.

Defined cases: null or empty texts and items match nothing; an item shorter than
q characters has no q-gram and matches nothing; an item too short for the edit
budget uses the largest budget whose bound is still positive; repeated documents
and items each give their own rows; rows with a null id keep it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches

U64 = np.uint64
BLOCK_CHARS, PIECE = 1_000_000, 4_000_000
TABLE_BITS = 22
OUT = "id long, text_hash long, item_id long, start int, end int, edits int, item_chars int, shared_grams int"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position, by doubling."""
    if len(codes) < q:
        return np.zeros(0, U64)
    h = H.mix(codes.astype(U64))
    parts, size, left = None, 1, q          # parts: hash of the first (q - left) characters
    done = 0
    while left:
        if left & 1:
            if parts is None:
                parts, done = h, size
            else:
                n = len(h) - done
                parts = parts[:n] * U64(pow(H.BASE, size, 1 << 64)) + h[done:done + n]
                done += size
        left >>= 1
        if left:
            h = h[:-size] * U64(pow(H.BASE, size, 1 << 64)) + h[size:]
            size *= 2
    return H.mix(parts[:len(codes) - q + 1])


class ItemIndex:
    """Sorted q-gram postings of a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, max_edit_rate: float):
        self.q = q
        self.ids, self.codes, self.edits, self.least = [], [], [], []
        grams, owner, at = [], [], []
        for item_id, text in items:
            codes = _codes(text)
            size = len(codes)
            if size < q:
                continue
            e = min(int(max_edit_rate * size), (size + 1 - q - 1) // q)
            h = gram_hashes(codes, q)
            grams.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            at.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.codes.append(codes)
            self.edits.append(e)
            self.least.append(size + 1 - q * (1 + e))
        self.edits, self.least = np.array(self.edits, np.int64), np.array(self.least, np.int64)
        g = np.concatenate(grams) if grams else np.zeros(0, U64)
        order = np.argsort(g, kind="stable")
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.zeros(0, np.int64))[order]
        self.grams, self.lead, self.size = np.unique(g[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> U64(64 - TABLE_BITS)] = True

    def regions(self, codes: np.ndarray, offs: np.ndarray):
        """(document, item, lowest diagonal, hits) of every band over its bound.

        ``codes`` holds all documents of a slice, ``offs`` their bounds.
        """
        none = np.zeros((4, 0), np.int64)
        if len(codes) < self.q or not self.ids:
            return none
        h = gram_hashes(codes, self.q)
        p = np.flatnonzero(self.table[h >> U64(64 - TABLE_BITS)])
        k = np.searchsorted(self.grams, h[p])
        k[k == len(self.grams)] = 0
        same = self.grams[k] == h[p]
        p, k = p[same], k[same]
        doc = np.searchsorted(offs, p, side="right") - 1
        inside = p + self.q <= offs[doc + 1]
        p, k, doc = p[inside], k[inside], doc[inside]
        n = self.size[k]
        shift = max(map(len, self.codes))       # keeps diagonals positive
        span = len(codes) + 4 * shift           # more than there are bands
        tally: list[list[tuple]] = [[], []]
        # hits are expanded to postings a piece at a time
        for piece in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(n) // PIECE)) + 1):
            m = n[piece]
            post = np.repeat(self.lead[k[piece]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item, d = self.owner[post], np.repeat(doc[piece], m)
            diag = np.repeat(p[piece], m) - offs[d] - self.at[post] + shift
            width = width_of(self.edits, item)
            for half in (0, 1):                 # two tilings, each shifted by half a band
                band = (diag + half * width) // (2 * width)
                tally[half].append(np.unique((d * len(self.ids) + item) * span + band, return_counts=True))
        found = []
        for half, parts in enumerate(tally):
            key, at = np.unique(np.concatenate([u for u, _ in parts]), return_inverse=True)
            hits = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(key)).astype(np.int64)
            pair, band = key // span, key % span
            d, i = pair // len(self.ids), pair % len(self.ids)
            ok = hits >= self.least[i]
            d, i, band = d[ok], i[ok], band[ok]
            low = band * 2 * width_of(self.edits, i) - half * width_of(self.edits, i) - shift
            found.append(np.stack([d, i, low, hits[ok]]))
        return np.concatenate(found, axis=1)


def width_of(edits: np.ndarray, item: np.ndarray) -> np.ndarray:
    return 2 * edits[item] + 1


def banded_alignment(item: np.ndarray, doc: np.ndarray, low: int, high: int, e: int):
    """Best (edits, start, end) of the whole item against a substring of ``doc``
    that starts on a diagonal in [low, high] and strays at most ``e`` from it;
    None if it needs more than ``e`` edits.

    Row i holds diagonals low - e .. high + e; row 0 is free on the start
    diagonals.  A row's deletions run along the diagonal, insertions to the left
    are resolved by a running minimum of value minus position.
    """
    a, b = low - e, high + e
    width = b - a + 1
    far = e + 1
    lane = np.arange(width)
    row = np.where((lane + a >= max(low, 0)) & (lane + a <= min(high, len(doc))), 0, far).astype(np.int64)
    origin = lane + a
    for i, c in enumerate(item):
        j = lane + a + i                     # document position before this step
        valid = (j >= 0) & (j < len(doc))
        sub = np.full(width, far, np.int64)
        sub[valid] = row[valid] + (doc[j[valid]] != c)
        up = np.append(row[1:] + 1, far)     # item character without partner
        up_from = np.append(origin[1:], 0)
        new = np.minimum(sub, up)
        new_from = np.where(sub <= up, origin, up_from)
        reach = (j + 1 >= 0) & (j + 1 <= len(doc))
        new[~reach] = far
        slack = new - lane                   # document characters without partner
        best = np.minimum.accumulate(slack)
        src = np.maximum.accumulate(np.where(slack == best, lane, 0))
        use = best + lane < new
        new = np.where(use, best + lane, new)
        new[~reach] = far
        origin = np.where(use, new_from[src], new_from)
        row = np.minimum(new, far)
        if row.min() > e:
            return None
    k = int(np.argmin(row))
    if row[k] > e:
        return None
    return int(row[k]), int(origin[k]), int(k + a + len(item))


def _match(index_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = index_bc.value
        for b in H.slices(batches, limit=1 << 20):
            texts = [normalise(t) for t in b.column("text").to_pylist()]
            offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            codes = _codes("".join(texts))
            rows: dict[tuple[int, int], tuple] = {}
            region = index.regions(codes, offs)
            for d, i, low, hits in region.T[np.argsort(-region[3], kind="stable")].tolist():
                item, e = index.codes[i], int(index.edits[i])
                doc = codes[offs[d]:offs[d + 1]]
                have = rows.get((d, i))
                if have and have[0] == 0:
                    continue
                high = low + 2 * (2 * e + 1) - 1
                got = None
                near = texts[d][max(low, 0):high + len(item)]
                exact = near.find(item.tobytes().decode("utf-32-le", "surrogatepass"))
                if exact >= 0:
                    at = max(low, 0) + exact
                    got = (0, at, at + len(item))
                else:
                    got = banded_alignment(item, doc, low, high, e)
                if got and (have is None or (got[0], got[1]) < have[:2]):
                    rows[(d, i)] = (*got, hits)
            if rows:
                keys = sorted(rows)
                take = pa.array([d for d, _ in keys], pa.int64())
                v = [rows[k] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("text_hash").take(take), pa.array([index.ids[i] for _, i in keys], pa.int64()),
                     pa.array([x[1] for x in v], pa.int32()), pa.array([x[2] for x in v], pa.int32()),
                     pa.array([x[0] for x in v], pa.int32()),
                     pa.array([len(index.codes[i]) for _, i in keys], pa.int32()), pa.array([x[3] for x in v], pa.int32())],
                    ["id", "text_hash", "item_id", "start", "end", "edits", "item_chars", "shared_grams"])
    return run


def item_blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``limit`` normalised characters, streamed to the
    driver one partition at a time; at most one block is held."""
    block, size = [], 0
    for r in items.toLocalIterator():
        text = normalise(r.text)
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((r.id, text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, q: int = 12, max_edit_rate: float = 0.06,
                 id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item) with an occurrence: ``id, text_hash, item_id,
    start, end, edits, item_chars, shared_grams``; the best occurrence, positions in
    the normalised document."""
    text_batches(docs)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    parts = []
    for block in item_blocks(wanted):
        index = spark.sparkContext.broadcast(ItemIndex(block, q, max_edit_rate))
        parts.append(base.mapInArrow(_match(index), OUT))
    if not parts:
        return spark.createDataFrame([], OUT)
    return reduce(DataFrame.union, parts)
