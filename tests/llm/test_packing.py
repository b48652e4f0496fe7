"""Pattern packing: whole and gapless, near the lower bound, ids of the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskframe.llm import packing as P
from riskframe.llm.queries import QUERIES
from tests.llm.helpers import SF, empty, messy, messy_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


@pytest.mark.parametrize("seed", range(8))
def test_fillings_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([1, 2, 7, 64, 300]))
    hist = histogram(rng.integers(1, capacity + 1, int(rng.integers(0, 2000))), capacity)
    hist[rng.integers(0, capacity + 1, capacity // 2)] = 0
    hist[0] = 0
    used, plan = np.zeros_like(hist), P.fillings(hist, capacity)
    for pick, times in plan:
        assert times > 0 and sum(n * often for n, often in pick) <= capacity
        for n, often in pick:
            used[n] += often * times
    assert (used == hist).all()


def test_packs_close_to_the_lower_bound():
    rng = np.random.default_rng(1)
    uniform, short = rng.integers(1, 2049, 20_000), np.clip(rng.lognormal(6.3, 0.9, 20_000).astype(int), 1, 2048)
    for lengths, excess in ((uniform, 0.015), (short, 0.001)):
        hist = histogram(lengths, 2048)
        sequences = sum(times for _, times in P.fillings(hist, 2048))
        bound = max(-(-int(lengths.sum()) // 2048), int(hist[1025:].sum()))
        assert sequences <= (1 + excess) * bound + 1


def test_least_squares_against_its_conditions():
    """At the optimum the gradient is zero where x > 0 and nowhere negative."""
    rng = np.random.default_rng(2)
    capacity = 60
    hist = histogram(rng.integers(1, capacity, 3000), capacity)
    patterns = P.length_patterns(hist, capacity)
    assert (patterns.sum(axis=1) == capacity).all() and (hist[patterns[patterns > 0]] > 0).all()
    x = P.fit_repeats(patterns, hist, capacity)
    rest = np.bincount(patterns.ravel(), np.repeat(x, 3), capacity + 1) - hist
    slope = (np.arange(capacity + 1) / capacity * rest)[patterns].sum(axis=1)
    assert (x >= 0).all() and slope.min() > -0.05 * hist.max() and np.abs(slope[x > 0.5]).max() < 0.05 * hist.max()


def check(rows, docs, capacity, end_id, texts_of):
    """Rows are the pieces of all documents, gapless and whole."""
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r[texts_of], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_query_on_data(spark):
    rows = QUERIES["op12_best_fit_packing"](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sequences = check(rows, docs, 2048, 0, "doc_id")
    assert sequences <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("capacity", [16, 2048])
def test_awkward_rows(spark, capacity):
    rows = P.packed_sequences(messy(spark), PATH, capacity=capacity, end_id=7).collect()
    check(rows, [(r[0], r[1]) for r in messy_rows()], capacity, 7, "id")
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_empty_table(spark):
    assert P.packed_sequences(empty(spark), PATH).count() == 0


def test_texts_reach_python_in_small_batches(spark):
    """Packing lowers the session's batch rows, as the other operators on whole texts do."""
    from riskframe.llm.batches import KEY, TEXT_ROWS
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    try:
        P.packed_sequences(empty(spark), PATH)
        assert spark.conf.get(KEY) == TEXT_ROWS
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)
