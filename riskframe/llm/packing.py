"""Sequence packing by length patterns fitted with non-negative least squares.

1. Every document becomes ids plus an end id; one longer than ``capacity`` is cut into
   pieces of ``capacity`` and a rest.  Pieces are written once, each with its partition
   and its rank among that partition's pieces of the same length.
2. The histogram of lengths (at most ``capacity`` rows, whatever the corpus) is all the
   driver sees.  Patterns of two or three lengths that fill a sequence exactly are
   enumerated, non-negative least squares fits how often each is repeated, and the counts
   are rounded down (so that what is left stays as mixed as the whole), without using a
   length more often than it occurs.
3. The residual is packed best-fit: the longest length left, then ever the longest that
   still fits, the same filling repeated while its lengths last.  Full pieces stand alone.
4. A pattern repeated r times owns r consecutive sequences and, of each of its lengths,
   a run of consecutive ranks.  A piece's rank over the corpus (counts per partition
   and length, summed up over partitions) gives its run, hence sequence and offset, so
   no length, however frequent, meets in one task.

Defined cases: null and empty texts hold only the end id; null and repeated ids are
packed row by row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches
from riskframe.llm.recent import kept
from riskframe.llm.token_files import FORMAT, ChunkEncoder, fresh_folder
from riskframe.session import cut_lineage

#: Patterns kept per largest length: those whose scarcer partner is most frequent.
PARTNERS = 8
#: Steps of the accelerated projected gradient.
STEPS = 300

#: One filling of a sequence: (length, how often) pairs, and its number of repeats.
Filling = tuple[list[tuple[int, int]], int]


def length_patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of two or three occurring lengths (0: none) whose sum is ``capacity``."""
    occurs = np.flatnonzero(hist[:capacity])
    long = occurs[(2 * occurs >= capacity) & (hist[capacity - occurs] > 0)]
    found = [np.stack([long, capacity - long, np.zeros_like(long)], axis=1)]
    for a in occurs:
        b = occurs[(2 * occurs >= capacity - a) & (occurs <= min(a, capacity - a - 1))]
        b = b[hist[capacity - a - b] > 0]
        if len(b) > PARTNERS:
            scarcer = np.minimum(hist[b], hist[capacity - a - b])
            b = b[np.argsort(-scarcer, kind="stable")[:PARTNERS]]
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], axis=1))
    return np.concatenate(found)


def fit_repeats(patterns: np.ndarray, hist: np.ndarray, capacity: int) -> np.ndarray:
    """Repeats x >= 0 that minimise sum over lengths l of l * (pieces used - hist[l])^2.

    Long pieces weigh more, as what is left of them is the hardest to place.
    """
    weight, goal = np.arange(capacity + 1) / capacity, hist.astype(float)
    flat, width = patterns.ravel(), patterns.shape[1]

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, width), capacity + 1)

    def gradient(rest: np.ndarray) -> np.ndarray:
        return (weight * rest)[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(30):                          # largest eigenvalue, for the step size
        u = gradient(used(v))
        steep = np.linalg.norm(u)
        v = u / steep
    x = ahead = np.zeros(len(patterns))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, ahead - gradient(used(ahead) - goal) / (1.05 * steep))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def round_repeats(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[Filling]:
    """Repeats rounded down, the largest first, as far as pieces are ``left`` (which is reduced)."""
    out = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        lengths, often = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        times = int(min(int(x[k]), (left[lengths] // often).min()))
        if times:
            left[lengths] -= times * often
            out.append((list(zip(lengths.tolist(), often.tolist())), times))
    return out


def pack_residual(left: np.ndarray, capacity: int) -> list[Filling]:
    """Fillings for all pieces ``left``; every one uses up a length or all but a part of it."""
    lengths, out = np.flatnonzero(left).tolist(), []
    while lengths:
        space, at, pick = capacity, len(lengths), []
        while space and (at := min(at, bisect_right(lengths, space)) - 1) >= 0:
            often = min(int(left[lengths[at]]), space // lengths[at])
            pick.append((lengths[at], often))
            space -= often * lengths[at]
        times = min(int(left[n]) // often for n, often in pick)
        for n, often in pick:
            left[n] -= times * often
        lengths = [n for n in lengths if left[n]]
        out.append((pick, times))
    return out


def fillings(hist: np.ndarray, capacity: int) -> list[Filling]:
    """How to pack ``hist[length]`` pieces of each length; uses every piece once."""
    left = hist.copy()
    out = [([(capacity, 1)], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = length_patterns(left, capacity)
    if len(patterns):
        out += round_repeats(patterns, fit_repeats(patterns, left, capacity), left)
    return out + pack_residual(left, capacity)


class Runs:
    """Runs of ranks per length, and the sequence and offset each rank gets."""

    def __init__(self, plan: list[Filling], capacity: int):
        self.bits = 62 - int(capacity).bit_length()
        taken, rows, sequence = {}, [], 0
        for pick, times in plan:
            offset = 0
            for length, often in pick:
                first = taken.get(length, 0)
                rows.append((length << self.bits | first, first, often, sequence, offset))
                taken[length] = first + often * times
                offset += often * length
            sequence += times
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, first, often, sequence, offset = self.table
        at = np.searchsorted(key, length << self.bits | rank, side="right") - 1
        times, which = np.divmod(rank - first[at], often[at])
        return sequence[at] + times, offset[at] + which * length


PIECES = "id long, part int, piece int, start long, length long, local long, ids_crc32 long, ids array<int>"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = kept(f"chunks {path}", lambda: ChunkEncoder(path))
        met = np.zeros(capacity + 1, np.int64)   # pieces of each length so far
        gc.disable()                             # millions of chunks, no reference cycles
        try:
            for b in H.slices(batches, limit=4 * H.SLICE_BYTES):
                flat, n = encode.ended(b.column("text"), end_id)
                stop = np.cumsum(n)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                begin = (stop - n)[row] + start
                crc = [zlib.crc32(flat[s:s + k]) for s, k in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                same = length[order]
                local = np.empty(len(row), np.int64)
                local[order] = met[same] + np.arange(len(row)) - np.searchsorted(same, same)
                met += np.bincount(length, minlength=capacity + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, stop[-1]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(row)), b.column("part").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(local), pa.array(crc, pa.int64()), lists],
                    ["id", "part", "piece", "start", "length", "local", "ids_crc32", "ids"])
        finally:
            gc.enable()
    return run


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, ids, sequence_id, offset`` per piece; ids
    are read only where selected."""
    text_batches(docs)
    spark = docs.sparkSession
    folder = fresh_folder(spark, "pieces")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    kind = base.schema["id"].dataType.simpleString()
    cut = base.mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECES.replace("id long", f"id {kind}", 1))
    cut.write.options(**FORMAT).parquet(folder)
    pieces = spark.read.parquet(folder)

    counts = cut_lineage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():      # at most `capacity` rows
        hist[r["length"]] = r["n"]
    runs = Runs(fillings(hist, capacity), capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = runs.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part"))
                                              - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("at", place("length", F.col("before") + F.col("local")))
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")
