"""Substring dedup: seed on winnowed anchors, extend, keep maximal repeats.

A *window* is ``window`` consecutive words of one document.  Every word covered
by a window whose word sequence also occurs in a document with a smaller id is
removed; windows are judged on the input.

1. **Seed.**  Each window selects an anchor: the smallest hash among its
   k-word grams.  Equal windows select equal anchors, and neighbouring windows
   mostly share one, so a document becomes short *blocks* - maximal runs of
   windows with one anchor - about one row per 17 words instead of one per word.
2. **Join.**  Blocks meet on their anchor.  Anchors of a single document drop out.
3. **Extend.**  If all blocks of an anchor have the same words (one content hash)
   the repeat extends over the whole block, and every document but the first
   loses it.  Otherwise one representative document per distinct block extends
   window by window (hashes of single windows, compared under the anchor); all
   other documents repeat a representative's block in full.
4. Overlapping windows of a document are merged into maximal repeats.

Hot anchors and copies: only minima per key are aggregated (map-side combine),
pairs are never formed, and the join back is against a written table of one row
per key, so Spark may split its skewed partitions.

Defined cases: a null text has no words; a null id is never removed from and
removes nothing; rows with the same id never remove from each other, whatever
their texts; repeated rows each appear in the result; other columns travel in
``row`` and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches
from riskframe.session import cut_lineage, tasks_for

#: Blocks that one task handles at least: those of some 4,000 documents.
TASK_BLOCKS = 50_000

BLOCKS = "id long, tkey long, anchor long, body long, start int, n int"


def _gram(window: int) -> tuple[int, int]:
    """(grams per window, words per gram): a power of two of grams, about two
    thirds of the window."""
    width = 1
    while width * 2 <= max(1, window * 2 // 3):
        width *= 2
    return width, window - width + 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` (a power of two) consecutive lanes."""
    step = 1
    while step < width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def _find_blocks(window: int):
    width, gram = _gram(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in H.slices(batches):
            data, offs = H.text_buffer(b.column("text"))
            w = H.cut_words(data, offs)
            total = len(w.hash)
            if total < window:
                continue
            prefix = H.run_hashes(w.hash)
            grams = H.run_hash(prefix, np.arange(total - gram + 1), gram)
            low = _sliding_min(grams, width)          # one per window start
            at = np.arange(total - window + 1)
            ok = at + window <= w.first[1:][w.doc[at]]
            new = ok.copy()
            new[1:] &= ~(ok[:-1] & (w.doc[at[1:]] == w.doc[at[:-1]]) & (low[1:] == low[:-1]))
            start = np.flatnonzero(new)
            if len(start) == 0:
                continue
            # a block ends before the next one or the next invalid start
            stop = np.flatnonzero(np.concatenate([new | ~ok, [True]]))
            n = stop[np.searchsorted(stop, start, side="right")] - start
            body = H.run_hash(prefix, start, n + (window - 1))
            doc = w.doc[start]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), b.column("tkey").take(take), H.as_long(low[start]), H.as_long(body),
                 pa.array((start - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["id", "tkey", "anchor", "body", "start", "n"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed where they are shuffled for extension."""
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = [z.compress((t or "").encode()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tkey"), pa.array(packed, pa.binary())],
                                         ["id", "tkey", "packed"])


def _extend(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for i, (packed, blocks) in enumerate(zip(b.column("packed").to_pylist(), b.column("blocks").to_pylist())):
                data = np.frombuffer(z.decompress(packed), np.uint8)
                w = H.cut_words(data, np.array([0, len(data)]))
                prefix = H.run_hashes(w.hash)
                n = np.array([x["n"] for x in blocks])
                first = np.repeat([x["start"] for x in blocks], n)
                at = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, b.column("id")[i].as_py())),
                     pa.array(np.full(rows, b.column("tkey")[i].as_py())),
                     pa.array(np.repeat(np.array([x["anchor"] for x in blocks], np.int64), n)),
                     H.as_long(H.run_hash(prefix, at, window)), pa.array(at.astype(np.int32))],
                    ["id", "tkey", "anchor", "body", "start"])
    return run


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Drop the words under each document's removed spans.  With ``whole`` a text
    that loses nothing stays as it is, white space included."""
    for b in H.slices(batches):
        kept, n_words, n_removed, merged = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            words = (text or "").encode().split()
            n_words.append(len(words))
            out: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            n_removed.append(sum(e - s for s, e in out))
            for s, e in reversed(out):
                del words[s:e]
            kept.append(text or "" if whole and not out else b" ".join(words).decode())
            merged.append([{"s": s, "e": e} for s, e in out])
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(merged, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
             pa.array(kept, pa.string())],
            ["id", "row", "n_words", "n_removed", "removed", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                    carry: list[str] | None = None, keep_whole: bool = False) -> DataFrame:
    """One row per input row: ``id, row, n_words, n_removed, removed, kept_text``.

    ``removed`` lists the maximal removed spans in words, [s, e); ``kept_text``
    joins the remaining words by one space (with ``keep_whole`` only where words
    were removed); ``row`` is a struct of the ``carry`` columns of the input.
    """
    text_batches(docs)
    row = F.struct(*[F.col(c) for c in carry or []]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("tkey"), row.alias("row"))
    texts = base.where("id IS NOT NULL").select("id", "tkey", "text")
    blocks = cut_lineage(texts.mapInArrow(_find_blocks(window), BLOCKS))
    tasks = tasks_for(blocks.count(), TASK_BLOCKS)

    per_anchor = blocks.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"),
                                              F.min("body").alias("b0"), F.max("body").alias("b1"))
    shared = cut_lineage(per_anchor.where("lo < hi").select("anchor", "lo", (F.col("b0") != F.col("b1")).alias("varied")), tasks)
    met = cut_lineage(blocks.join(shared, "anchor"), tasks)

    plain = met.where("NOT varied AND id > lo")
    varied = met.where("varied")
    first = cut_lineage(varied.groupBy("anchor", "body").agg(F.min("id").alias("body_lo")), tasks)
    varied = varied.join(first, ["anchor", "body"])
    copied = varied.where("id > body_lo")
    spans = plain.select("id", "tkey", "start", "n").union(copied.select("id", "tkey", "start", "n")).select(
        "id", "tkey", F.col("start").alias("s"), (F.col("start") + F.col("n") + F.lit(window - 1)).alias("e"))

    lead = varied.where("id = body_lo").groupBy("id", "tkey").agg(
        F.collect_list(F.struct("anchor", "start", "n")).alias("blocks"))
    packed = texts.mapInArrow(_pack, "id long, tkey long, packed binary").dropDuplicates(["id", "tkey"])
    single = cut_lineage(packed.join(lead, ["id", "tkey"]).mapInArrow(
        _extend(window), "id long, tkey long, anchor long, body long, start int"), tasks)
    seen = single.groupBy("anchor", "body").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    seen = cut_lineage(seen.where("lo < hi").select("anchor", "body", "lo"), tasks)
    later = single.join(seen, ["anchor", "body"]).where("id > lo")
    spans = spans.union(later.select("id", "tkey", F.col("start").alias("s"), (F.col("start") + F.lit(window)).alias("e")))

    per_doc = spans.groupBy("id", "tkey").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    todo = base.join(per_doc, (base.id == per_doc.id) & (base.tkey == per_doc.tkey), "left").select(
        base.id, base.row, base.text, per_doc.spans)
    row_type = base.schema["row"].dataType.simpleString()
    return todo.mapInArrow(partial(_cut, whole=keep_whole), f"id long, row {row_type}, n_words long, n_removed long, "
                                 "removed array<struct<s:int,e:int>>, kept_text string")
