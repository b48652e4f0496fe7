"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces lie in a double-array trie over UTF-8 bytes (base and check arrays): the
children of node s by byte c stand at base[s] + c and are valid if check says s.
The best path maximises the sum of log scores; a later candidate replaces an
earlier one only if strictly better, with starts taken left to right (of equally
good paths the one whose last piece is longest).  A character that is no piece is
an unknown of fixed cost and becomes one byte piece per UTF-8 byte.  Decoding joins
pieces, turns runs of byte pieces into characters, markers into spaces, and drops
the marker put before the text.

Distinct segments (see ``unigram``) are solved once per worker, which keeps the
last ``CACHE`` or so.  The trie is built once and broadcast; its size is
that of the vocabulary.

Defined cases: null and empty texts have no ids and decode to the empty text;
a text that itself holds the marker character decodes to a space there
(``round_trip`` false), as in the format; repeated rows are repeated; other columns
travel in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches
from riskframe.llm.recent import Recent, kept
from riskframe.llm.unigram import MARK, Unigram, load_unigram

CACHE, LONG = 250_000, 64


class DoubleArray:
    """Static trie over byte strings; ``value`` is the key's number or -1."""

    def __init__(self, keys: list[bytes]):
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, key in enumerate(keys):
            node = 0
            for c in key:
                nxt = trie[node].get(c)
                if nxt is None:
                    nxt = trie[node][c] = len(trie)
                    trie.append({})
                node = nxt
            ends[node] = number
        size = 2 * len(trie) + 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free, wide, todo = 257, 257, [(0, 0)]     # every code reaches cell 257
        while todo:
            node, at = todo.pop()
            self.value[at] = ends.get(node, -1)
            codes = sorted(trie[node])
            if not codes:
                continue
            # single children fill the holes; larger families look further on
            # from where the last long search ended
            while self.check[free] >= 0:
                free += 1
            b = first = (free if len(codes) == 1 else max(free, wide)) - codes[0]
            while True:
                if b + 256 >= len(self.check):
                    for a, blank in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        a.extend([blank] * len(a))
                if all(self.check[b + c] < 0 for c in codes):
                    break
                b += 1
            if b - first > 32:
                wide = b + codes[0]
            self.base[at] = b
            for c in codes:
                self.check[b + c] = at
                todo.append((trie[node][c], b + c))


class Codec:
    def __init__(self, vocab: Unigram):
        keys = sorted(vocab.score, key=lambda p: p.encode())
        self.vocab = vocab
        self.ids = [vocab.ids[k] for k in keys]
        self.scores = [vocab.score[k] for k in keys]
        self.trie = DoubleArray([k.encode() for k in keys])
        self.seen = Recent(CACHE)                # segment -> ids as int32 bytes
        # what each id decodes to: raw bytes, the marker as a space
        said = [p.replace(MARK, " ").encode() for p in vocab.pieces]
        for byte, i in enumerate(vocab.byte_id):
            said[i] = bytes((byte,))
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.length = np.array([len(x) for x in said])
        self.place = np.cumsum(self.length) - self.length

    def __getstate__(self):
        return {**self.__dict__, "seen": Recent(CACHE)}

    def best_path(self, text: str) -> list[int]:
        """Viterbi over one stretch of text."""
        data = text.encode()
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, top = len(data), len(check)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        last = [(0, -1)] * (n + 1)
        start = 0
        while start < n:
            lead = data[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, single = best[start], 0, False
            for i in range(start, n):
                nxt = base[node] + data[i]
                if nxt >= top or check[nxt] != node:
                    break
                node = nxt
                v = value[node]
                if v >= 0:
                    new, old = here + scores[v], best[i + 1]
                    if old is None or new > old:
                        best[i + 1], last[i + 1] = new, (start, v)
                    single = single or i + 1 == start + width
            if not single:
                end = start + width
                new, old = here + self.vocab.unknown, best[end]
                if old is None or new > old:
                    best[end], last[end] = new, (start, -1)
            start += width
        out: list[int] = []
        end = n
        while end > 0:
            start, v = last[end]
            if v >= 0:
                out.append(self.ids[v])
            else:
                out.extend(self.vocab.byte_id[c] for c in reversed(data[start:end]))
            end = start
        return out[::-1]

    def _solve(self, segment: str) -> bytes:
        seen = self.seen
        if (out := seen.recall(segment)) is not None:
            return out
        parts = []
        for part in self.vocab.split(segment):
            got = seen.now.get(part) or seen.recall(part)
            if got is None:
                got = np.array(self.best_path(part), np.int32).tobytes()
                if len(part) <= LONG:
                    seen.now[part] = got
            parts.append(got)
        out = b"".join(parts)
        if len(segment) <= LONG:
            seen.now[segment] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        self.seen.turn()
        get, solve = self.seen.now.get, self._solve
        return np.frombuffer(b"".join([get(s) or solve(s) for s in self.vocab.segments(text)]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        n = self.length[ids]
        if len(ids) == 0:
            return ""
        at = np.repeat(self.place[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        raw = self.said[at].tobytes()
        return raw[1:].decode("utf-8", "replace") if self.vocab.pieces[ids[0]].startswith(MARK) else raw.decode("utf-8", "replace")


def _run(codec_bc, key: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = kept(f"codec {key}", lambda: codec_bc.value)
        for b in H.slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [codec.encode(t) for t in texts]
            back = [codec.decode(x) for x in ids]
            offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            low, high = min(codec.vocab.byte_id), max(codec.vocab.byte_id)
            is_byte = np.concatenate([[0], np.cumsum((flat >= low) & (flat <= high))])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)),
                 pa.array((is_byte[offs[1:]] - is_byte[offs[:-1]]).astype(np.int32)),
                 pa.array([x == t for x, t in zip(back, texts)]),
                 pa.array(back if with_text else [None] * len(back), pa.string())],
                ["row", "ids", "n_byte_pieces", "round_trip", "decoded"])
    return run


def encode_texts(docs: DataFrame, model_path: str, carry: list[str], text_col: str = "text",
                 with_text: bool = True) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``ids``,
    ``n_byte_pieces``, ``round_trip`` and ``decoded``, the text rebuilt from ``ids``
    (null without ``with_text``)."""
    text_batches(docs)
    bc = docs.sparkSession.sparkContext.broadcast(Codec(load_unigram(model_path)))
    base = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"))
    row_type = base.schema["row"].dataType.simpleString()
    return base.mapInArrow(_run(bc, model_path, with_text),
                           f"row {row_type}, ids array<int>, n_byte_pieces int, round_trip boolean, decoded string")
