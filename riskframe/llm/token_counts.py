"""Token counts without tokens: count-only unigram Viterbi.

An Aho-Corasick automaton over the vocabulary reports, at each end position, every
piece that ends there, longest first.  The dynamic programme carries two numbers
per position - best score and pieces on that path - and no back pointers.  A later
candidate wins only if strictly better; longest first is the tokenizer's order of
starts from left to right, so equal paths resolve exactly as in encoding.  A
character that is no piece costs the unknown score and counts one piece per UTF-8
byte (byte fallback).

Distinct segments are solved once per worker (in a bounded table), so a text costs
one look-up per segment.

Defined cases: null and empty texts count 0; repeated rows are counted each; null
ids are kept; other columns are not read.
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
from riskframe.llm.unigram import Unigram, load_unigram

CACHE, LONG = 250_000, 64


class Counter:
    def __init__(self, vocab: Unigram):
        import ahocorasick
        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab.score.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.seen = Recent(CACHE)             # (pieces, 16 x score) as two int32

    def best(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path of one stretch."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for at, hit in self.automaton.iter(text):
            ends[at].append(hit)
        for at in range(n):
            best, pieces, single = None, 0, False
            for size, s in ends[at]:                  # longest first
                start = at + 1 - size
                new = score[start] + s
                if best is None or new > best:
                    best, pieces = new, count[start] + 1
                single = single or size == 1
            if not single:
                new = score[at] + self.vocab.unknown
                if best is None or new > best:
                    best, pieces = new, count[at] + len(text[at].encode())
            score[at + 1], count[at + 1] = best, pieces
        return count[n], score[n]

    def _solve(self, segment: str) -> bytes:
        seen = self.seen
        if (out := seen.recall(segment)) is not None:
            return out
        parts = []
        for part in self.vocab.split(segment):
            got = seen.now.get(part) or seen.recall(part)
            if got is None:
                pieces, score = self.best(part)
                got = np.array([pieces, round(16 * score)], np.int32).tobytes()
                if len(part) <= LONG:
                    seen.now[part] = got
            parts.append(got)
        if len(parts) == 1:
            return parts[0]
        out = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2).sum(axis=0, dtype=np.int32).tobytes()
        if len(segment) <= LONG:
            seen.now[segment] = out
        return out

    def __call__(self, text: str | None) -> tuple[int, float]:
        self.seen.turn()
        get, solve = self.seen.now.get, self._solve
        found = np.frombuffer(b"".join([get(s) or solve(s) for s in self.vocab.segments(text)]), np.int32)
        pieces, score = found.reshape(-1, 2).sum(axis=0, dtype=np.int64)
        return int(pieces), float(score) / 16


def _run(vocab_bc, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = kept(f"counts {key}", lambda: Counter(vocab_bc.value))
        for b in H.slices(batches):
            got = [counter(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([n for n, _ in got], pa.int64()), pa.array(np.array([s for _, s in got], float))],
                ["id", "n_tokens", "best_score"])
    return run


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_tokens, best_score``."""
    text_batches(docs)
    bc = docs.sparkSession.sparkContext.broadcast(load_unigram(model_path))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_run(bc, model_path), "id long, n_tokens long, best_score double")
