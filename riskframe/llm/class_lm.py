"""LM scoring: Brown class-based bigrams, clustered by exchange.

P(text) = product over tokens of P(class | class before) x P(word | class); tokens
are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token.

1. **Counts.**  Word counts of all training texts, summed per task, then by one
   aggregation.
2. **Sequences.**  Texts are cut once into numbers of the ``LOOKUP`` most frequent words (a
   broadcast of fixed size); every other ("far") word stays as its hash.
3. **Exchange clustering**, distributed as in Uszkoreit and Brants (2008), of the V^(2/3) most
   frequent of V distinct words, into as many classes as the square root of their
   number, so both grow with the corpus: item bigrams of all training texts are kept as one
   row per item; in each round tasks find, for their items, the class that raises the
   class-bigram likelihood most under the current classes, every second item moves, and
   class counts are recomputed.  Meanwhile every other word is in one of six classes by its
   shape (last byte '.', ',' or other; ASCII or not); the end token has its own class,
   which also stands before the first word.  Words of equal count are taken in the
   order of their hashes.  A round that does not raise the likelihood is undone; two
   rounds that raise it by less than ``LEAST_GAIN`` of itself are the last.
4. **Placing** of every other word of the training texts, down to those that occur once:
   its classes before and after, gathered in one row set per word, decide for the
   class under which its occurrences are likeliest.  Class bigrams are then counted again over
   all tokens; far words are joined to their class, so no word is cut off.  The driver
   sees one class number per looked-up word and a classes x classes table.
5. **Probabilities.**  Transitions are interpolated with the class unigram; a word has its
   share of its class.  A word unseen in training has a class by its shape, which follows
   and precedes any class at the rate of words of that shape that occur once.
6. **Scoring** every text from its sequence; bigrams with a far word are summed apart.

Defined cases: null and empty texts are one end token; rows with a null id are
training rows; repeated rows count and are scored each; with no training row at
all every count is 0; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches
from riskframe.session import cut_lineage

LOOKUP = 1 << 18
SHAPES = 6
END = np.uint64(0)          # stands for the end token; a word's hash is never 0
ROUNDS, LEAST_GAIN = 16, 1e-3
PRIOR = 10.0                # pseudo-count of the class unigram in a transition


def _tokens(b: pa.RecordBatch):
    """(hash, shape, document, documents) of the words of a slice."""
    data, offs = H.text_buffer(b.column("text"))
    data = H.fold_case(data)
    w = H.cut_words(data, offs)
    if len(w.hash) == 0:
        return w.hash, np.zeros(0, np.int64), w.doc, b.num_rows
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    last = data[w.end - 1]
    shape = np.where(last == 46, 0, np.where(last == 44, 1, 2)) + 3 * (high[w.end] > high[w.start])
    return np.maximum(w.hash, np.uint64(1)), shape.astype(np.int64), w.doc, b.num_rows


def _tally(parts: list[tuple], limit: int | None) -> list[tuple]:
    """Merge (key, extra, count) lanes once they exceed ``limit`` rows."""
    if limit is not None and sum(len(p[0]) for p in parts) <= limit:
        return parts
    key, extra, n = (np.concatenate(x) for x in zip(*parts))
    uniq, first, at = np.unique(key, return_index=True, return_inverse=True)
    return [(uniq, extra[first], np.bincount(at, weights=n).astype(np.int64))]


#: Distinct counts that a task holds; beyond half of them it sends what it has.
HELD = 1_000_000


def _is_full(parts: list[tuple]) -> bool:
    """Whether merging has not made the counts few enough."""
    return len(parts) == 1 and len(parts[0][0]) > HELD // 2


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, docs = [], 0

    def row() -> pa.RecordBatch:
        key, shape, n = parts[0]
        return pa.RecordBatch.from_arrays([H.as_long(key), pa.array(shape.astype(np.int32)), pa.array(n)], ["h", "shape", "n"])

    for b in H.slices(batches):
        h, shape, _, n = _tokens(b)
        docs += n
        if len(h):
            uniq, first, count = np.unique(h, return_index=True, return_counts=True)
            parts = _tally([*parts, (uniq, shape[first], count)], HELD)
            if _is_full(parts):
                yield row()
                parts = []
    if docs:
        parts = _tally([*parts, (np.array([END]), np.zeros(1, np.int8), np.array([docs]))], None)
        yield row()


class Vocabulary:
    """The most frequent words by hash: counts, and numbers of clustered words.

    Items 0 .. n_items-1 are clustered words, then the shapes, then the end.  ``rank`` is the
    place of each row among the words as given.
    """

    def __init__(self, h: np.ndarray, n: np.ndarray, n_items: int, shape: np.ndarray | None = None):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]
        item = np.arange(len(h))
        item[item >= n_items] = -1
        self.item, self.rank, self.h_of = item[order], order, h
        self.n_items = n_items
        self.end_item = n_items + SHAPES
        if shape is not None:                    # item or shape of the word of each rank
            self.item_of = np.where(item >= 0, item, n_items + shape)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each word, or -1."""
        if len(self.h) == 0:
            return np.full(len(h), -1)
        k = np.searchsorted(self.h, h)
        k[k == len(self.h)] = 0
        return np.where(self.h[k] == h, k, -1)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word, or -1."""
        row = self.find(h)
        return np.where(row >= 0, self.rank[row], -1) if len(self.h) else row


SEQUENCE_SQL = "rid long, id long, held_out boolean, seq array<int>, far array<long>, far_shape array<int>, far_n array<int>"


def _encode(vocab_bc):
    """Texts -> sequences: a rank per looked-up word, -1 - k for the k-th of the document's far words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab_bc.value
        for b in H.slices(batches):
            h, shape, doc, docs = _tokens(b)
            code = v.ranks(h)
            far = np.flatnonzero(code < 0)
            far = far[np.lexsort((h[far], doc[far]))]
            new = np.ones(len(far), bool)
            new[1:] = (doc[far][1:] != doc[far][:-1]) | (h[far][1:] != h[far][:-1])
            lead = np.flatnonzero(new)
            cut = np.searchsorted(doc[far[lead]], np.arange(docs + 1)).astype(np.int32)
            code[far] = -(np.cumsum(new) - cut[doc[far]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]).astype(np.int32)
            times = np.diff(np.append(lead, len(far))).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), x)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("id"), b.column("held_out"), pa.ListArray.from_arrays(pa.array(ends), pa.array(code.astype(np.int32))),
                 lists(H.as_long(h[far[lead]])), lists(pa.array(shape[far[lead]].astype(np.int32))), lists(pa.array(times))],
                ["rid", "id", "held_out", "seq", "far", "far_shape", "far_n"])
    return run


#: Words of the sequences that a task works on at once.
SLICE_WORDS = 1 << 19


def _flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each row) of a list column."""
    return x.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Sequences:
    """Words of a slice of encoded documents, in order."""

    def __init__(self, b: pa.RecordBatch):
        self.code, self.length = _flat(b.column("seq"))
        self.docs = b.num_rows
        self.doc = np.repeat(np.arange(self.docs), self.length)
        self.near = self.code >= 0
        self.far_shape, n = _flat(b.column("far_shape"))
        first = np.cumsum(n) - n
        self.far = first[self.doc[~self.near]] - self.code[~self.near] - 1       # places in the far words of the slice

    def numbers(self, near: np.ndarray, far: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word and end token in order, from the numbers by rank and by far word, and its document."""
        out = np.empty(len(self.code), np.int64)
        out[self.near] = near[self.code[self.near]]
        out[~self.near] = far[self.far]
        return _with_ends(out, self.doc, self.docs, end)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches of sequences into runs of whole documents of about ``SLICE_WORDS`` words."""
    for b in batches:
        if b.num_rows:
            n = _flat(b.column("seq"))[1]
            cut = (np.cumsum(n) - n) // SLICE_WORDS
            starts = np.flatnonzero(np.diff(cut, prepend=-1))
            for x, y in zip(starts, [*starts[1:], b.num_rows]):
                yield b.slice(int(x), int(y - x))
    H.release()


def _with_ends(item: np.ndarray, doc: np.ndarray, docs: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Item sequence of a slice with the end item after each document, and the
    document of each place."""
    n = np.bincount(doc, minlength=docs)
    out = np.full(len(item) + docs, end, np.int64)
    of = np.repeat(np.arange(docs), n + 1)
    out[np.arange(len(item)) + doc] = item
    return out, of


def _count_bigrams(vocab_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab_bc.value
        size = v.end_item + 1
        parts = []

        def row() -> pa.RecordBatch:
            pair, _, n = parts[0]
            return pa.RecordBatch.from_arrays([pa.array((pair // size).astype(np.int32)),
                                               pa.array((pair % size).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for b in _slices(batches):
            s = Sequences(b)
            seq, _ = s.numbers(v.item_of, v.n_items + s.far_shape, v.end_item)
            # the end of a document stands before the first word of the next
            pair = np.concatenate([[v.end_item], seq[:-1]]) * size + seq
            uniq, count = np.unique(pair, return_counts=True)
            parts = _tally([*parts, (uniq, np.zeros(len(uniq), np.int8), count)], HELD)
            if _is_full(parts):
                yield row()
                parts = []
        if parts:
            parts = _tally(parts, None)
            yield row()
    return run


def _contexts(state_bc):
    """Occurrences of the words that are not items: (h, class before x classes + class after, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cls, size = state_bc.value
        parts = []

        def out(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([H.as_long(h), pa.array(code.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "code", "n"])

        def row() -> pa.RecordBatch:
            key, _, n = parts[0]
            return out(v.h_of[key // size ** 2], key % size ** 2, n)

        for b in _slices(batches):
            s = Sequences(b)
            seq, of = s.numbers(cls[v.item_of], cls[v.n_items + s.far_shape], cls[v.end_item])
            at = np.arange(len(s.code)) + s.doc                  # places of the words among the end tokens
            before = np.concatenate([[cls[v.end_item]], seq[:-1]])[at]
            code = before * size + seq[at + 1]
            far = ~s.near
            if far.any():
                yield out(_flat(b.column("far"))[0].view(np.uint64)[s.far], code[far], np.ones(len(s.far)))
            rest = s.code >= v.n_items
            if rest.any():
                uniq, count = np.unique(s.code[rest].astype(np.int64) * size ** 2 + code[rest], return_counts=True)
                parts = _tally([*parts, (uniq, np.zeros(len(uniq), np.int8), count)], HELD)
                if _is_full(parts):
                    yield row()
                    parts = []
        if parts:
            parts = _tally(parts, None)
            yield row()
    return run


#: Occurrence rows, and words, that are placed at once.
PLACED_ROWS, PLACED_WORDS = 1 << 16, 1 << 12


def _place(state_bc):
    """Rows of ``_contexts`` in the order of h -> the likeliest class of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, step, total, free = state_bc.value
        size = len(step)
        both = np.concatenate([step[:, :free], step[:free].T])   # log probability of a class before, after

        def best(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
            ends, word = np.append(start[1:], len(h)), h[start]
            for a in range(0, len(start), PLACED_WORDS):
                e = min(a + PLACED_WORDS, len(start))
                x, y = start[a], ends[e - 1]
                of = np.repeat(np.arange(e - a), ends[a:e] - start[a:e]) * 2 * size
                counts = np.bincount(np.concatenate([of + code[x:y] // size, of + size + code[x:y] % size]), np.tile(n[x:y], 2), (e - a) * 2 * size)
                counts = counts.reshape(e - a, 2 * size)
                times = counts[:, :size].sum(axis=1)
                k = (counts @ both - times[:, None] * np.log(total[None] + times[:, None])).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(word[a:e]), pa.array(v.ranks(word[a:e].view(np.uint64)).astype(np.int32)),
                                                  pa.array(k.astype(np.int32)), pa.array(times.astype(np.int64))], ["h", "rank", "k", "n"])

        held, rows = [], 0
        for b in batches:
            held.append(tuple(b.column(c).to_numpy() for c in ("h", "code", "n")))
            rows += b.num_rows
            if rows >= PLACED_ROWS:
                h, code, n = (np.concatenate(x) for x in zip(*held))
                whole = np.searchsorted(h, h[-1])                # the last word may go on
                if whole:
                    yield from best(h[:whole], code[:whole], n[:whole])
                held, rows = [(h[whole:], code[whole:], n[whole:])], len(h) - whole
        if rows:
            yield from best(*(np.concatenate(x) for x in zip(*held)))
    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(t: np.ndarray) -> float:
    """Class-bigram log likelihood up to terms that do not depend on the classes."""
    return float(_xlogx(t).sum() - _xlogx(t.sum(axis=1)).sum() - _xlogx(t.sum(axis=0)).sum())


def best_class(t: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, loop: float, free: int) -> tuple[int, float]:
    """Best of the first ``free`` classes for an item and the gain over ``own``.

    ``right``/``left``: the item's bigram counts by the class after/before it,
    without the ``loop`` bigrams of the item with itself.
    """
    base = t.copy()
    base[own] -= right
    base[:, own] -= left
    base[own, own] -= loop
    # sizes of the other classes hold their bigrams with the item, wherever it goes
    rows, cols = base.sum(axis=1) + left, base.sum(axis=0) + right
    r_all, l_all = right.sum() + loop, left.sum() + loop
    c = np.arange(free)
    # row c gains right, column c gains left, where there is any; their crossing cell gains both
    after, before = np.flatnonzero(right), np.flatnonzero(left)
    rise = lambda x, more: _xlogx(x + more) - _xlogx(x)
    cross = base[c, c]
    gain = rise(base[:free, after], right[after]).sum(axis=1) + rise(base[before, :free].T, left[before]).sum(axis=1)
    gain += rise(cross, right[:free] + left[:free] + loop) - rise(cross, right[:free]) - rise(cross, left[:free])
    gain -= _xlogx(rows[:free] + r_all) - _xlogx(rows[:free]) + _xlogx(cols[:free] + l_all) - _xlogx(cols[:free])
    k = int(np.argmax(gain))
    return k, float(gain[k] - gain[own])


def _propose(state_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, t, free, turn = state_bc.value
        for b in batches:
            out = []
            for w, ids, ns, ids2, ns2 in zip(*(b.column(c).to_pylist() for c in ("w", "right", "right_n", "left", "left_n"))):
                if w % 2 != turn:
                    continue
                ids, ns = np.array(ids or [], np.int64), np.array(ns or [], float)
                ids2, ns2 = np.array(ids2 or [], np.int64), np.array(ns2 or [], float)
                loop = float(ns[ids == w].sum())
                right = np.bincount(cls[ids[ids != w]], weights=ns[ids != w], minlength=len(t))
                left = np.bincount(cls[ids2[ids2 != w]], weights=ns2[ids2 != w], minlength=len(t))
                k, gain = best_class(t, int(cls[w]), right, left, loop, free)
                if gain > 1e-6 and k != cls[w]:
                    out.append((w, k))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()),
                                              pa.array([x[1] for x in out], pa.int32())], ["w", "k"])
    return run


def _cells(t: np.ndarray) -> pa.RecordBatch:
    cell = np.flatnonzero(t)
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(t[cell].astype(np.int64))], ["cell", "n"])


def _class_table(state_bc, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = state_bc.value
        t = np.zeros(size * size)
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            t += np.bincount(cls[a] * size + cls[c], weights=b.column("n").to_numpy(), minlength=size * size)
        yield _cells(t)
    return run


def _gathered(cells: DataFrame, size: int) -> np.ndarray:
    """Sums of ``cell, n`` rows as a table."""
    t = np.zeros(size * size)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():      # at most size x size rows
        t[r.cell] = r.n
    return t.reshape(size, size)


def _near_pairs(s: Sequences, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """Classes of every two neighbours of a slice, far words as -1 - k, and the document of the second."""
    code = np.where(s.near, cls[np.maximum(s.code, 0)], s.code) if len(cls) > SHAPES + 1 else s.code.astype(np.int64)
    seq, of = _with_ends(code, s.doc, s.docs, cls[-1])
    before = np.concatenate([[cls[-1]], seq[:-1]])
    return before, seq, of


def _class_pairs(cls_bc, size: int):
    """Class bigrams of looked-up words, summed over the sequences of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(size * size)
        for b in _slices(batches):
            a, c, _ = _near_pairs(Sequences(b), cls_bc.value)
            near = (a >= 0) & (c >= 0)
            t += np.bincount(a[near] * size + c[near], minlength=size * size)
        yield _cells(t)
    return run


def _far_pairs(cls_bc):
    """Bigrams with a far word, of every document that has one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            a, c, of = _near_pairs(Sequences(b), cls_bc.value)
            far = (a < 0) | (c < 0)
            cut = np.searchsorted(of[far], np.arange(b.num_rows + 1)).astype(np.int32)
            some = pa.array(np.diff(cut) > 0)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[far].astype(np.int32))) for x in (a, c)]
            names = ["rid", "held_out", "far", "far_shape", "far_n"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *lists], [*names, "a", "b"]).filter(some)
    return run


def _resolve(total_bc):
    """Classes of the bigrams of ``_far_pairs`` and sums over the far words, from what was joined to them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, free = total_bc.value
        for b in batches:
            shape, n = _flat(b.column("far_shape"))
            times = _flat(b.column("far_n"))[0]
            first = np.cumsum(n) - n
            cls, count = free + shape.astype(np.int64), np.zeros(len(shape))
            (pos, found), (k, _), (c, _) = (_flat(b.column(x)) for x in ("pos", "k", "n"))
            at = np.repeat(first, found) + pos
            cls[at], count[at] = k, c
            known = count > 0
            doc = np.repeat(np.arange(b.num_rows), n)
            add = lambda x: pa.array(np.bincount(doc, np.where(known, times * x, 0), b.num_rows))
            share = np.log10(np.maximum(count, 1)) - np.log10(np.maximum(total[np.minimum(cls, free - 1)], 1))
            lists = []
            for name in ("a", "b"):
                x, m = _flat(b.column(name))
                out, far = x.astype(np.int64), x < 0
                out[far] = cls[np.repeat(first, m)[far] - x[far] - 1]
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)), pa.array(out.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("held_out"), add(np.log10(count + 1)), add(share), add(np.ones(len(count))), *lists],
                ["rid", "held_out", "far_base", "far_emit", "seen", "a", "b"])
    return run


def _pair_table(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(size * size)
        for b in batches:
            t += np.bincount(_flat(b.column("a"))[0].astype(np.int64) * size + _flat(b.column("b"))[0], minlength=size * size)
        yield _cells(t)
    return run


def _far_steps(step_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = step_bc.value
        for b in batches:
            (a, n), (c, _) = _flat(b.column("a")), _flat(b.column("b"))
            s = np.bincount(np.repeat(np.arange(b.num_rows), n), step[a, c], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("far_base"), pa.array(s + b.column("far_emit").to_numpy()), b.column("seen")],
                                             ["rid", "far_base", "far_score", "seen"])
    return run


def exchange(bigrams: DataFrame, n_items: int, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of every item, class bigram table) for item bigrams ``a, b, n``."""
    sc = bigrams.sparkSession.sparkContext
    free = max(1, min(classes, n_items))
    size = free + SHAPES + 1
    cls = np.concatenate([np.arange(n_items) % free, free + np.arange(SHAPES + 1)]).astype(np.int64)

    def table(cls: np.ndarray) -> np.ndarray:
        # a task sends at most size x size cells, so few tasks read the counts
        return _gathered(bigrams.coalesce(16).mapInArrow(_class_table(sc.broadcast(cls), size), "cell int, n long"), size)

    lists = lambda x, y: [F.collect_list(y).alias(x), F.collect_list("n").alias(f"{x}_n")]
    right = bigrams.where(F.col("a") < n_items).groupBy(F.col("a").alias("w")).agg(*lists("right", "b"))
    left = bigrams.where(F.col("b") < n_items).groupBy(F.col("b").alias("w")).agg(*lists("left", "a"))
    rows = cut_lineage(right.join(left, "w", "full"))         # an item has at most n_items neighbours
    t = table(cls)
    value, idle = likelihood(t), 0
    for turn in range(rounds):
        state = sc.broadcast((cls, t, free, turn % 2))
        moves = rows.mapInArrow(_propose(state), "w int, k int").collect()    # at most n_items rows
        new = cls.copy()
        for m in moves:
            new[m.w] = m.k
        t2 = table(new) if moves else t
        rise = likelihood(t2) - value if moves else 0.0
        idle = 0 if rise > LEAST_GAIN * abs(value) else idle + 1
        if rise > 0:
            cls, t, value = new, t2, value + rise
        if idle == 2:                            # neither half of the items has much to gain
            break
    return cls, t


def transitions(t: np.ndarray) -> np.ndarray:
    """Log10 probabilities of the class after (columns) each class, from the class bigrams."""
    prior = (t.sum(axis=0) + 1) / (t.sum() + len(t))
    return np.log10((t + PRIOR * prior) / (t.sum(axis=1, keepdims=True) + PRIOR))


class ClassModel:
    """Log10 probabilities of transitions and emissions; ``more``: counts of each class's words beyond the vocabulary."""

    def __init__(self, vocab: Vocabulary, cls: np.ndarray, t: np.ndarray, rare_n: np.ndarray, rare_v: np.ndarray, more: np.ndarray | float = 0.0):
        self.vocab, self.cls = vocab, cls
        self.step = transitions(t)
        free = len(t) - SHAPES - 1
        of = np.where(vocab.item >= 0, cls[np.maximum(vocab.item, 0)], -1)
        self.total = np.bincount(of[of >= 0], weights=vocab.n[of >= 0], minlength=free) + more
        self.rare = np.log10(rare_n + rare_v + 1.0)
        # clustered words: log share of the class; others: log of count + 1
        self.emit = np.where(of >= 0, np.log10(vocab.n / np.maximum(self.total[np.maximum(of, 0)], 1)), np.log10(vocab.n + 1.0))


def _score(model_bc, n_total: int, v_total: int, n_ends: int):
    """Scores of the sequences but for what far words add."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = model_bc.value
        v = m.vocab
        lot = np.log10(n_total + v_total + 1.0)
        count, emit = np.empty(len(v.h)), np.empty(len(v.h))     # by rank
        count[v.rank], emit[v.rank] = np.log10(v.n + 1.0), m.emit
        for b in _slices(batches):
            s = Sequences(b)
            before, cls, of = _near_pairs(s, m.cls)
            near = (before >= 0) & (cls >= 0)
            steps = np.bincount(of[near], weights=m.step[before[near], cls[near]], minlength=s.docs)
            doc, rank = s.doc[s.near], s.code[s.near]
            base = np.bincount(doc, weights=count[rank], minlength=s.docs) - lot * s.length
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("id"), b.column("held_out"), pa.array(s.length + 1),
                 pa.array(np.bincount(doc, minlength=s.docs) + int(n_ends > 0)), pa.array(base + np.log10(n_ends + 1.0) - lot),
                 pa.array(steps + np.bincount(doc, weights=emit[rank], minlength=s.docs))],
                ["rid", "id", "held_out", "n_tokens", "n_known", "base", "score"])
    return run


def _most_frequent(counts: DataFrame, limit: int):
    """About ``limit`` most frequent words, never more, as a pandas table, most frequent first.

    Whole bins of log2(count) from the top while they fit, then, of the next, whole counts,
    and of the words of the next count those whose hash is low enough: only these
    are sent, not a sorted head of every partition.
    """
    words = counts.where("h <> 0")
    binned = words.withColumn("bin", F.floor(F.log2("n") * 16).cast("int"))

    def taken(groups: list, room: int) -> tuple:
        """First group that does not fit, its size, and the room left for it."""
        for key, size in groups:
            if size > room:
                return key, size, room
            room -= size
        return None, 0, room

    bins = sorted(((r["bin"], r["count"]) for r in binned.groupBy("bin").count().collect()), reverse=True)     # at most 64 x 16 rows
    cut, _, room = taken(bins, limit)
    keep = F.lit(True)
    if cut is not None:
        inside = binned.where(F.col("bin") == cut).groupBy("n").count()
        # a bin spans 4.4 % of its counts; of large counts few words share one, so whole counts are
        # found from the bin's upper part
        n, size, room = taken([(r["n"], r["count"]) for r in inside.orderBy(F.col("n").desc()).limit(room + 1).collect()], room)
        share = int((room - 6 * room ** 0.5) / size * (1 << 40)) if size else 0
        low = F.shiftrightunsigned(F.xxhash64("h"), 24) < max(0, share)
        keep = (F.col("bin") > cut) | ((F.col("bin") == cut) & ((F.col("n") > n) | ((F.col("n") == n) & low)))
    top = binned.where(keep).select("h", "n", "shape").toPandas()
    return top.sort_values(["n", "h"], ascending=[False, True], ignore_index=True).iloc[:limit]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                items: int | None = None, classes: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``; learned from the rows that are not ``held_out``.  ``items`` and
    ``classes`` override the numbers that follow from the vocabulary."""
    text_batches(docs)
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    train = base.where("NOT held_out").select("text")

    counts = train.mapInArrow(_count_words, "h long, shape int, n long").groupBy("h").agg(
        F.sum("n").alias("n"), F.min("shape").alias("shape"))
    counts = cut_lineage(counts)
    per_shape = counts.groupBy((F.col("h") == 0).alias("is_end"), "shape").agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).collect()
    n_total, v_total = sum(r.n for r in per_shape), sum(r.v for r in per_shape)
    n_ends = sum(r.n for r in per_shape if r.is_end)
    top = _most_frequent(counts, LOOKUP)
    n_items = min(items or math.ceil(v_total ** (2 / 3)), len(top))
    classes = classes or max(16, math.ceil(math.sqrt(n_items)))
    hashes, times = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy()
    vocab = Vocabulary(hashes, times, n_items, top["shape"].to_numpy().astype(np.int64))
    vocab_bc = sc.broadcast(vocab)

    seqs = cut_lineage(base.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_encode(vocab_bc), SEQUENCE_SQL))
    learned = seqs.where("NOT held_out")
    bigrams = cut_lineage(learned.mapInArrow(_count_bigrams(vocab_bc), "a int, b int, n long").groupBy("a", "b").agg(
        F.sum("n").alias("n")))
    cls, t = exchange(bigrams, n_items, classes, rounds)
    size, free = len(t), len(t) - SHAPES - 1

    # every word that is no item, by its contexts
    contexts = learned.mapInArrow(_contexts(sc.broadcast((vocab, cls, size))), "h long, code int, n int")
    state = sc.broadcast((vocab, transitions(t) * math.log(10), t.sum(axis=0)[:free], free))
    placed = cut_lineage(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_place(state), "h long, rank int, k int, n long"))
    near = placed.where("rank >= 0").select("rank", "k").toPandas()             # at most LOOKUP rows
    beyond = placed.where("rank < 0").select("h", "k", "n")
    cls_of = np.concatenate([cls[:n_items], np.zeros(len(top) - n_items, np.int64), cls[n_items:]])
    cls_of[near["rank"].to_numpy()] = near["k"].to_numpy()
    more = np.zeros(free)
    for r in beyond.groupBy("k").agg(F.sum("n").alias("n")).collect():          # one row per class
        more[r.k] = r.n
    total = np.bincount(cls_of[:len(top)], weights=times, minlength=free) + more

    # far words by their joined classes, then the class bigrams of all tokens
    cls_bc = sc.broadcast(cls_of)
    far = cut_lineage(seqs.mapInArrow(_far_pairs(cls_bc), "rid long, held_out boolean, far array<long>, far_shape array<int>, far_n array<int>, "
                                                          "a array<int>, b array<int>"))
    found = far.select("rid", F.posexplode("far").alias("pos", "h")).join(beyond, "h").groupBy("rid").agg(
        *[F.collect_list(c).alias(c) for c in ("pos", "k", "n")])
    resolved = cut_lineage(far.drop("far").join(found, "rid", "left").mapInArrow(
        _resolve(sc.broadcast((total, free))), "rid long, held_out boolean, far_base double, far_emit double, seen double, a array<int>, b array<int>"))
    t = _gathered(learned.coalesce(64).mapInArrow(_class_pairs(cls_bc, size), "cell int, n long").union(
        resolved.where("NOT held_out").coalesce(16).mapInArrow(_pair_table(size), "cell int, n long")), size)
    unseen = np.zeros(SHAPES)
    for r in per_shape:
        if not r.is_end:
            unseen[r.shape] = r.once / n_total
    t[:, free:free + SHAPES] = t.sum(axis=1)[:, None] * unseen
    t[free:free + SHAPES] = unseen[:, None] * t.sum(axis=0)

    none = np.zeros(SHAPES)
    model = ClassModel(Vocabulary(hashes, times, len(top)), cls_of, t, none, none, more)
    first = seqs.mapInArrow(_score(sc.broadcast(model), n_total, v_total, n_ends),
                            "rid long, id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    out = first.join(resolved.mapInArrow(_far_steps(sc.broadcast(model.step)), "rid long, far_base double, far_score double, seen double"), "rid", "left")
    extra = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("id", "held_out", "n_tokens", (F.col("n_known") + extra("seen").cast("long")).alias("n_known"),
                      F.lit(n_total).cast("long").alias("train_tokens"), (F.col("base") + extra("far_base")).alias("base_score"),
                      (F.col("score") + extra("far_score")).alias("score"))
