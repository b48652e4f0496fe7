"""Token-id files: ids of each document as a Parquet list column.

**Format.**  A folder of Parquet files, in ascending order of the document id
within and across files.  One row per document: ``id``, ``n_tokens``, ``local_start``
(ids of the file before the document) and ``ids`` (list of int32).  Ids are
dictionary encoded (a vocabulary under ``MAX_DICTIONARY`` entries fits one
dictionary page; the v2 writer falls back to delta-packed pages), the counters
are delta encoded, row groups and pages have fixed byte sizes, and pages carry
column indexes.  So metadata is read without touching token pages, and an id
range reads only the pages that hold it (``read_documents``).

**Order.**  Texts are range partitioned by document id before they are encoded, so
sampling for the ranges never runs the tokenizer, and each task writes one
contiguous range.

**Speed.**  The tokenizer's pre-tokeniser never joins across white space, so each
white-space-separated chunk encodes alone; a worker looks each distinct chunk of a slice
up in a table of the last ``CACHE_CHUNKS`` or so and encodes those it lacks.

Defined cases: null and empty texts hold only the end id; null ids sort first and
are kept; rows that share an id follow each other in the order of their texts;
repeated rows are repeated; other columns are not read.
"""

from __future__ import annotations

import gc
import os
import re
import string
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches
from riskframe.llm.recent import Recent, kept
from riskframe.session import scratch_path

#: Two generations of about 200 bytes an entry stay beside the executor's heap, per worker.
CACHE_CHUNKS = 300_000
#: Distinct int32 values that fit the writer's dictionary page below.
MAX_DICTIONARY = 1 << 18
FORMAT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(4 * MAX_DICTIONARY),
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


@lru_cache(4096)
def _ends_word(end: bytes) -> bool:
    """Whether UTF-8 bytes end in a letter or digit that stays one when normalised."""
    last = end.decode("utf-8", "ignore")[-1:]
    return last != "" and all(x.isalnum() for x in unicodedata.normalize("NFC", last).lower())


class ChunkEncoder:
    """Encode texts chunk by chunk with a bounded table of recent chunks.

    Chunks are bytes with A-Z folded (the tokenizer folds them too).  A run of
    ASCII marks after a letter or digit is a pre-token of its own, so it is
    solved apart from the word before it.  The chunks of many texts are reduced to the
    distinct ones by Arrow, so the table is asked once per distinct chunk.  New chunks are
    encoded together: those of a-z alone by the tokenizer's model without normaliser and
    pattern (neither changes or cuts them), those of other letters are one pre-token each;
    both end at an end-of-word id.  The rest is kept apart by a special token that none
    of them holds.  A text that holds the start of a special token is encoded whole.
    """

    FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    ALNUM, MARKS = b"abcdefghijklmnopqrstuvwxyz0123456789", string.punctuation.encode()
    #: By byte: part of a chunk, a mark that may end a word, a letter or digit.
    SOLID = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
    STOP, BEFORE = np.isin(np.arange(256), list(MARKS)), np.isin(np.arange(256), list(ALNUM))

    def __init__(self, path: str, separator: str = "<|startoftext|>"):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.separator, self.mark = separator, re.compile(re.escape(separator[:2].encode()))
        self.separator_id = self.tokenizer.token_to_id(separator)
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.ends_word = np.array([x.endswith("</w>") for x in names])
        self.kind = np.dtype(np.uint16 if len(self.ends_word) <= 1 << 16 else np.int32)
        self.seen = Recent(CACHE_CHUNKS)         # chunk -> bytes of its ids

    def whole(self, text: str, plain: bool = False) -> np.ndarray:
        tokenizer = self.plain if plain else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _store(self, chunks: list[bytes], ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        raw, now, size = ids.tobytes(), self.seen.now, self.kind.itemsize
        for c, s, e in zip(chunks, (size * start).tolist(), (size * stop).tolist()):
            now[c] = raw[s:e]

    def _solve(self, plain: list[bytes], chunks: list[bytes]) -> None:
        words, others = [], []
        for c in chunks:
            (words if c.decode().isalpha() else others).append(c)
        for kind in (plain, words):
            for i in range(0, len(kind), 1024):
                some = kind[i:i + 1024]
                ids = self.whole(b" ".join(some).decode(), plain=kind is plain)
                stop = np.flatnonzero(self.ends_word[ids]) + 1
                if len(stop) != len(some):       # a letter that normalises to another class
                    others += some
                    continue
                self._store(some, ids, np.concatenate([[0], stop[:-1]]), stop)
        for i in range(0, len(others), 1024):
            some = others[i:i + 1024]
            ids = self.whole(f" {self.separator} ".join(c.decode() for c in some))
            stop = np.append(np.flatnonzero(ids == self.separator_id), len(ids))
            self._store(some, ids, np.concatenate([[0], stop[:-1] + 1]), stop)

    def _learn(self, fresh: list[bytes]) -> None:
        """Bring distinct chunks that ``now`` lacks into it."""
        now, old, split, todo = self.seen.now, self.seen.old, [], set()
        back = list(map(old.get, fresh))
        now.update((c, got) for c, got in zip(fresh, back) if got is not None)
        plain = [c for c, got in zip(fresh, back) if got is None and c.isalpha()]
        for c in (c for c, got in zip(fresh, back) if got is None and not c.isalpha()):
            core = c.rstrip(self.MARKS)
            if len(core) < len(c) and core and _ends_word(core[-4:]):
                split.append((c, core, c[len(core):]))
                todo.add(core)
                todo.add(c[len(core):])
            else:
                todo.add(c)
        self._solve(plain, [c for c in todo.difference(now) if self.seen.recall(c) is None])
        for c, core, tail in split:
            now[c] = now[core] + now[tail]

    def _chunks(self, data: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Chunks of the folded texts in order, and how many come before each text; one
        mark that ends a word is a chunk of its own."""
        solid = self.SOLID[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:-1]
        end[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        size = end - start
        tail = (size > 1) & self.STOP[data[end - 1]] & self.BEFORE[data[end - 2]]
        upto = np.cumsum(1 + tail)
        sizes = np.repeat(size, 1 + tail)
        sizes[upto[tail] - 1] = 1
        sizes[upto[tail] - 2] -= 1
        places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(data[solid])])
        return chunks.dictionary_encode(), np.concatenate([[0], upto])[np.searchsorted(start, offs)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts that lie end to end at ``offs``, and the number of each text's."""
        raw = data.tobytes()
        folded = np.frombuffer(raw.translate(self.FOLD), np.uint8)
        whole = np.unique(np.searchsorted(offs, [m.start() for m in self.mark.finditer(raw)], side="right") - 1)
        if len(whole):
            folded = folded.copy()
            for i in whole:
                folded[offs[i]:offs[i + 1]] = 32
        chunks, before = self._chunks(folded, offs)
        self.seen.turn()
        get, distinct = self.seen.now.get, chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(get, distinct))
        if None in found:
            holes = [i for i, v in enumerate(found) if v is None]
            self._learn([distinct[i] for i in holes])
            for i in holes:
                found[i] = get(distinct[i])
        pool = np.frombuffer(b"".join(found), self.kind)
        long = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        which = chunks.indices.to_numpy()
        n = long[which]
        stop = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        place = (np.cumsum(long, dtype=np.int64) - long)[which] - stop[:-1]
        ids = pool[np.repeat(place.astype(np.int32), n) + np.arange(stop[-1], dtype=np.int32)]
        n = np.diff(stop[before])
        if len(whole):
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in whole:
                parts[i] = self.whole(raw[offs[i]:offs[i + 1]].decode())
            ids, n = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, n

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text column, ``end_id`` after each text, and the number of each text's with it."""
        ids, n = self.encode(*H.text_buffer(texts))
        return np.insert(ids.astype("<i4"), np.cumsum(n), end_id), n + 1

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        offs = np.cumsum([0, *map(len, texts)])
        ids, n = self.encode(np.frombuffer(b"".join(texts), np.uint8), offs)
        return np.split(ids, np.cumsum(n)[:-1])[:len(texts)]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        gc.disable()                             # millions of chunks, no reference cycles
        encode = kept(f"chunks {path}", lambda: ChunkEncoder(path))
        before = 0
        for b in H.slices(batches, limit=4 * H.SLICE_BYTES):
            flat, n = encode.ended(b.column("text"), end_id)
            stop = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(before + stop - n), lists],
                                             ["id", "n_tokens", "local_start", "ids"])
            before += int(stop[-1])
        gc.enable()
    return run


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every whole text and write the folder ``out`` (must not exist)."""
    text_batches(docs)
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = base.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), "text")
    coded = ordered.mapInArrow(_encode(tokenizer_path, end_id), "id long, n_tokens long, local_start long, ids array<int>")
    coded.write.options(**FORMAT).parquet(out)


def read_documents(spark: SparkSession, path: str, columns: list[str] | None = None,
                   low: int | None = None, high: int | None = None) -> DataFrame:
    """Selective read: only ``columns``, only documents with low <= id <= high
    (row groups and pages outside the range are skipped by their indexes)."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col("id") >= low)
    if high is not None:
        df = df.where(F.col("id") <= high)
    return df.select(*columns) if columns else df


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column("ids")
        flat = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        offs = np.asarray(col.offsets) - col.offsets[0].as_py()
        crc = [zlib.crc32(flat[s:e]) for s, e in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_tokens"), b.column("local_start"), b.column("file"),
                                          pa.array(crc, pa.int64())], ["id", "n_tokens", "local_start", "file", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: ``id, start, n_tokens, ids_crc32`` per document.

    ``start`` adds the total of all earlier files, found from the metadata columns
    alone and summed over one row per file.
    """
    df = spark.read.parquet(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1))
    per_file = df.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("id").alias("lo"),
                                      F.max(F.col("id").isNull()).alias("nulls"))
    order = Window.orderBy(F.col("nulls").desc(), F.col("lo").asc_nulls_first(), "file")
    before = per_file.withColumn("before", F.sum("n").over(order) - F.col("n")).select("file", "before")
    crc = df.select("id", "n_tokens", "local_start", "file", "ids").mapInArrow(
        _checksum, "id long, n_tokens long, local_start long, file string, ids_crc32 long")
    return crc.join(before, "file").select("id", (F.col("before") + F.col("local_start")).alias("start"),
                                           "n_tokens", "ids_crc32")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
