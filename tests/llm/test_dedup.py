"""Substring, near-duplicate and embedding dedup against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from riskframe.llm import embedding_dedup as E
from riskframe.llm import hashing as H
from riskframe.llm import minhash_dedup as M
from riskframe.llm.embedding_dedup import embedding_near_duplicates
from riskframe.llm.graph import components
from riskframe.llm.queries import QUERIES
from riskframe.llm.substring_dedup import substring_dedup
from riskframe.llm.toxicity import SAMPLE_TASKS
from riskframe.session import tasks_for
from tests.llm.helpers import PARK, SF, classes, empty, messy, messy_rows, overlap, sample, shingles


def cut_by_hand(rows, window):
    """(id, text) -> kept words, by every window of every document."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s:s + window])
                first[k] = min(i, first.get(k, i))
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s:s + window])] < i:
                    gone[s:s + window] = b"\1" * window
        out.setdefault((i, t), [x for x, g in zip(w, gone) if not g])
    return out


def check_substring(rows, got, window):
    want = cut_by_hand(rows, window)
    assert len(got) == len(rows)
    for r in got:
        kept = b" ".join(want[r["row"]["doc_id"], r["row"]["text"]]).decode()
        assert r["kept_text"] == kept and r["n_words"] - r["n_removed"] == len(kept.split(" ")) - (kept == "")
        assert sum(x["e"] - x["s"] for x in r["removed"]) == r["n_removed"]


def test_substring_on_data(spark):
    got = {r.doc_id: r for r in QUERIES["op1_substring_dedup"](spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()]
    for (i, t), kept in cut_by_hand(rows, 50).items():
        n = len(t.encode().split())
        assert (got[i].n_words, got[i].n_removed) == (n, n - len(kept))
        assert got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert sum(r.n_removed for r in got.values()) > 0


def test_substring_messy(spark):
    rows = [(r[0], r[1]) for r in messy_rows()]
    check_substring(rows, substring_dedup(messy(spark), carry=["doc_id", "text", "row", "id"]).collect(), 50)
    assert substring_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("window", [3, 8, 20])
def test_substring_small_alphabet(spark, window):
    """Many ties, periodic texts, repeats inside a document, varied blocks."""
    rng = random.Random(window)
    rows = [(i % 25, " ".join(rng.choice("ab") * (1 + rng.randrange(2)) for _ in range(rng.randrange(90)))) for i in range(30)]
    rows += [(100, "a " * 70), (101, "a " * 70), (102, "b " + "a " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_substring(rows, substring_dedup(df, window=window, carry=["doc_id", "text"]).collect(), window)


def test_keep_whole_leaves_untouched_text(spark):
    rows = [(1, "a  b\n" + PARK), (2, "q\t" + PARK + "\nend  x")]
    got = {r.id: r.kept_text for r in substring_dedup(
        spark.createDataFrame(rows, "doc_id long, text string"), keep_whole=True).collect()}
    assert got == {1: rows[0][1], 2: "q end x"}


def test_signature_is_unbiased():
    """Agreement of signatures estimates multiset Jaccard, also for large counts."""
    rng = np.random.default_rng(1)
    m = 2048
    for top in (1, 3, 40):
        n = 300
        h = np.sort(rng.integers(1, 2 ** 62, n).astype(np.uint64))
        a, b = rng.integers(0, top + 1, n), rng.integers(0, top + 1, n)
        sig = []
        for c in (a, b):
            keep = c > 0
            sig.append(M.signatures(h[keep], c[keep], np.zeros(keep.sum(), np.int64), 1, m)[0])
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4.5 * math.sqrt(want * (1 - want) / m)


def test_signature_does_not_depend_on_the_slice():
    texts = ["a b c d e f g", "", "one", "a a a a a a a a a a", "x y " * 400]
    import pyarrow as pa
    whole = M.signatures(*M.shingle_counts(*H.text_buffer(pa.array(texts))), len(texts), 252)
    for i, t in enumerate(texts):
        one = M.signatures(*M.shingle_counts(*H.text_buffer(pa.array([t]))), 1, 252)
        assert (one[0] == whole[i]).all()


def near_by_hand(rows, similarity=0.8):
    bags = {}
    for i, t in rows:
        if i is not None and shingles(t):
            bags[i] = shingles(t)
    ids = sorted(bags)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if min(map(lambda x: sum(bags[x].values()), (a, b))) >= similarity * max(sum(bags[x].values()) for x in (a, b))
             and overlap(bags[a], bags[b]) >= similarity]
    return classes([i for i, _ in rows if i is not None], links)


def test_near_duplicates_on_data(spark):
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()]
    want = near_by_hand(rows)
    got = {r.doc_id: r for r in QUERIES["op9_bagminhash_dedup"](spark, SF).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def test_near_duplicates_messy(spark):
    rows = [(r[0], r[1]) for r in messy_rows()]
    got = M.near_duplicates(messy(spark)).collect()
    assert len(got) == len(rows)
    want = near_by_hand(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((None, True) if r.id is None else (want[r.id], want[r.id] == r.id))
    assert want[2] == 1 and want[3] == 1 and want[8] == 7 and want[5] == 5
    assert M.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_across_components(spark):
    """A chain of edits whose ends are far apart, and a hub bucket of many copies:
    links that no star holds are found by the block comparison."""
    rng = random.Random(2)
    words = [f"t{i}" for i in range(200)]
    rows, now = [], list(words)
    for i in range(60):
        rows.append((i, " ".join(now)))
        now = list(now)
        for _ in range(rng.randrange(1, 5)):
            now[rng.randrange(200)] = f"n{rng.random()}"
    rng.shuffle(rows)
    got = {r.id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_by_hand(rows)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    """Both texts of id 1 link with their own copies, and no distinct text goes."""
    from corpus_pipeline import drop_near_duplicates
    one, two, three = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, three), (4, three), (4, three + " end"), (5, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_duplicates(df).collect()
    assert {(r.id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1)}
    left = [(r.doc_id, r.text) for r in drop_near_duplicates(spark, df, SF).collect()]
    assert {(1, one), (1, two)} <= set(left) and [i for i, _ in left].count(4) == 1 and len(left) == 3


def test_shared_counts_both_ways():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    every = np.ones(want.shape, bool)
    assert (M._shared_counts(sets, sets, every) == want).all()
    few = np.zeros(want.shape, bool)
    few[3, 7] = True
    assert M._shared_counts(sets, sets, few)[3, 7] == want[3, 7]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1070)]
    links += [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None]
    nodes = {x for p in real for x in p}
    assert got == classes(nodes, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def embeddings_by_hand(rows, similarity):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    links, n = [], {i: 0 for i, _ in rows}
    for a in ids:
        for b in ids:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= similarity:
                links.append((a, b))
                n[a] += 1
    return n, classes([i for i, _ in rows if i is not None], links)


def test_embeddings_on_data(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, comp = embeddings_by_hand(rows, 0.95)
    for r in QUERIES["op8_embedding_dedup"](spark, SF).collect():
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)


def test_embeddings_messy(spark, monkeypatch):
    from riskframe.llm import embedding_dedup as D
    for name, value in (("CELL_ROWS", 40), ("SLICE", 20), ("BLOCK", 70)):
        monkeypatch.setattr(D, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        v = rng.normal(size=8)
        rows += [(3 * i + j, (v + 0.12 * j * rng.normal(size=8)).tolist()) for j in range(3)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8),
             (2004, [None] + [1.0] * 7), (2005, [float("inf")] * 8), (2006, [1e308] * 8), (2007, [1e-300] * 8), (2008, [1.0, 2.0]),
             (2009, [2.0, 4.0]), (None, [1.0] * 8), (2010, rows[0][1])]
    n, comp = embeddings_by_hand([(i, None if v is None else [x if x is None else x / (1e300 if i == 2006 else 1e-300 if i == 2007 else 1)
                                                              for x in v]) for i, v in rows], 0.95)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + [(2010, rows[0][1])]],
                               "vec_id long, embedding array<double>, n int, home string")
    got = embedding_near_duplicates(df, reach=8.0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == ((0, None) if r.id is None else (n[r.id], comp[r.id]))
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_low_rank_over_many_cells(spark, monkeypatch):
    """Pairs near the threshold across cells, in few intrinsic dimensions: links as by brute force."""
    for name, value in (("CELL_ROWS", 100), ("SLICE", 64), ("BLOCK", 300)):      # blocks of three cells
        monkeypatch.setattr(E, name, value)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = rng.uniform(0.951, 0.97, (len(x), 1))
    v = np.vstack([x, s * x + np.sqrt(1 - s * s) * u]) @ np.linalg.qr(rng.standard_normal((256, 12)))[0].T
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in embedding_near_duplicates(df).collect()}
    want = (v @ v.T >= 0.95).sum(axis=1) - 1
    assert [got[i] for i in range(len(v))] == want.tolist() and want.min() >= 1


def test_embedding_group_larger_than_a_block(spark, monkeypatch):
    """A group of different near copies that fills several blocks: every link counted once, one kept."""
    for name, value in (("CELL_ROWS", 50), ("SLICE", 30), ("BLOCK", 60)):
        monkeypatch.setattr(E, name, value)
    rng = np.random.default_rng(8)
    hot, rest = rng.standard_normal(16), rng.standard_normal((200, 16))
    v = np.vstack([hot + 0.01 * rng.standard_normal((300, 16)), rest])
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, v)], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(df).collect()}
    n, comp = embeddings_by_hand([(int(i), r.tolist()) for i, r in zip(ids, v)], 0.95)
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in got} and len(got) == len(v)
    assert max(k for k, _, _ in got.values()) >= 299


def test_small_tables_go_to_few_files(spark, monkeypatch, tmp_path):
    """However many files and shuffle partitions a small corpus is spread over, a stage
    writes and checkpoints few."""
    had = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    docs = messy(spark).repartition(40)
    checkpoint, files = type(docs).checkpoint, []

    def counted(df, *args, **kw):
        out = checkpoint(df, *args, **kw)
        files.append(out._jdf.rdd().getNumPartitions())
        return out

    monkeypatch.setattr(type(docs), "checkpoint", counted)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for name, stage in corpus_pipeline.STAGES:
            if name != "sentencepiece":
                stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
                assert 0 < len(list((tmp_path / name).glob("part-*"))) <= SAMPLE_TASKS, name
                got = spark.read.parquet(path)
                assert got.columns == docs.columns and got.count() > 0, name
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert files and max(files) <= SAMPLE_TASKS, files


def test_tasks_grow_with_the_rows():
    assert [tasks_for(n) for n in (0, 3_999, 4_000, 40_000_000)] == [1, 1, 2, 10_001]
