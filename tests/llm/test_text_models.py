"""Decontamination, toxicity, quality and language-model scoring."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import class_lm as L
from riskframe.llm import decontaminate as D
from riskframe.llm import quality as Q
from riskframe.llm import toxicity as X
from riskframe.llm.queries import QUERIES
from tests.llm.helpers import SF, TOXIC, empty, messy, messy_rows, sample


def edits(item, doc):
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(item, 1):
        new = [i] + [0] * len(doc)
        for j, x in enumerate(doc, 1):
            new[j] = min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def planted(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng, rows = random.Random(7), []
    for n in range(24):
        k, text = rng.choice(items)
        s = list(text)
        for _ in range(rng.randint(0, int(0.1 * len(text)))):
            at, kind = rng.randrange(len(s)), rng.random()
            if kind < 0.4:
                s[at] = rng.choice("abc XYZ")
            elif kind < 0.7:
                del s[at]
            else:
                s.insert(at, rng.choice("abc "))
        rows.append((n, "lead words here " + "".join(s) + " and  a tail"))
    return items, rows


def test_decontamination_equals_edit_distance(spark):
    items, rows = planted(spark)
    got = {(r.id, r.item_id): r.edits for r in D.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for n, t in rows:
        for k, text in items:
            a, b = D.normalise(text), D.normalise(t)
            if len({a[i:i + 12] for i in range(len(a) - 11)} & {b[i:i + 12] for i in range(len(b) - 11)}) > 3:
                d = edits(a, b)
                if d <= int(0.06 * len(a)):
                    want[n, k] = d
    assert got == want and 0 < len(want) < len(rows)


def test_decontamination_in_blocks(spark, monkeypatch):
    """Items in many blocks give the same rows as in one."""
    docs, items = sample(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, D.contaminated(docs, items).collect()))
    blocks = list(D.item_blocks(items.selectExpr("item_id id", "text"), 2000))
    assert len(blocks) > 2 and all(sum(len(t) for _, t in b) <= 2000 for b in blocks)
    monkeypatch.setattr(D, "item_blocks", lambda df: iter(blocks))
    assert sorted(map(tuple, D.contaminated(docs, items).collect())) == one
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if D.normalise(i.text) in D.normalise(d.text)}
    assert exact and exact <= {(r[0], r[2]) for r in one}


def test_decontamination_messy(spark):
    items = spark.createDataFrame([(1, "W3 w4\n w5 w6 w7 w8 w9 w10 w11"), (2, None), (3, ""), (4, "short"), (None, "one"), (1, "w3 w4 w5 w6 w7 w8 w9 w10 w11")],
                                  "item_id long, text string")
    got = D.contaminated(messy(spark), items).collect()
    assert sorted(((r.id, r.item_id) for r in got), key=str) == sorted([(i, 1) for i in (9, 10, 10, None, 15)] * 2, key=str)
    assert D.contaminated(empty(spark), items).count() == 0
    assert D.contaminated(messy(spark), items.limit(0)).count() == 0


def test_grammar_scopes():
    s = X.Scorer({w[:6]: 2.0 for w in X.INSULTS})
    plain = s.clause("what an idiot")[0]
    assert plain == 2.0
    assert s.clause("you idiot")[0] == s.clause("idiot like you")[0] == plain * X.TARGETED
    assert s.clause("he is not an idiot")[0] == plain * X.TARGETED * X.NEGATED
    assert s.clause("critics said an idiot wrote it")[0] == plain * X.REPORTED
    assert s.clause('the word "idiot" here')[0] == plain * X.REPORTED
    assert s.clause("i will kill you")[0] == X.THREAT_WEIGHT
    assert s.clause("kill the process")[0] == X.THREAT_WEIGHT * X.LONE_THREAT
    assert s.clause("a quiet day") == (0.0, 0)
    one, two = X._negation(), X._reported()
    both = one.then(two)
    state, a, b = both.start, one.start, two.start
    for x in ["negation", "insult", "report", "other", "insult", "quote", "threat"]:
        state, _, w = both.table[state, x]
        a, y, w1 = one.table[a, x]
        b, _, w2 = two.table[b, y]
        assert w == w1 * w2 and state == (a, b)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].score, r.toxic) for r in labels if got[r.doc_id].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.75 and np.mean([s >= 0.3 for s in neg]) < 0.05


def test_toxicity_messy(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(12, 1), (12, 0), (None, 1), (1, None), (99, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = X.toxicity(messy(spark), labels, carry=["doc_id", "text", "score", "row"]).collect()
        assert len(got) == len(messy_rows())
        assert {r.row.text for r in got if r.predicted} == {TOXIC}
    assert X.toxicity(empty(spark), odd).count() == 0


def test_toxicity_scores_do_not_depend_on_the_sample_caps(spark, monkeypatch):
    """The mean score is the share of toxic rows, caps binding or not."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        hit = rng.random() < (0.7 if bad else 0.05)
        words = [f"w{rng.randrange(400)}" for _ in range(25)] + ["you", "idiot"] * hit
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    mean = lambda: np.mean([r.score for r in X.toxicity(docs, labels).collect()])
    assert abs(mean() - 0.1) < 0.02
    monkeypatch.setattr(X, "MAX_TOXIC", 150)
    monkeypatch.setattr(X, "MAX_OTHER", 300)
    assert abs(mean() - 0.1) < 0.02


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    pos = [got[r.doc_id].score for r in labels if r.quality]
    neg = [got[r.doc_id].score for r in labels if not r.quality]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.95
    assert np.mean([p >= 0.5 for p in pos]) > 0.97


def test_quality_messy(spark):
    got = Q.quality(messy(spark)).collect()
    assert len(got) == len(messy_rows()) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert Q.quality(empty(spark)).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    n, acc = 60_000, np.array([0.95, 0.85, 0.75, 0.9])
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, 4)) < acc, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((n, 4)) < 0.3] = Q.ABSTAIN
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    prior, table, _ = Q.expectation_maximisation(pattern, count.astype(float))
    assert abs(prior - 0.7) < 0.02
    share = table[1, :, Q.GOOD] / (table[1, :, Q.GOOD] + table[1, :, Q.BAD])
    assert np.abs(share - acc).max() < 0.03


def lm_by_hand(rows):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    toks = [(t or "").encode().translate(low).split() + [None] for _, t in rows]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for (i, _), h, ws in zip(rows, held, toks)]


def check_lm(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r[0], r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_class_lm_on_data(spark, monkeypatch):
    got = QUERIES["op10_class_lm"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()]
    check_lm(got, lm_by_hand(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # words beyond the look-up table are joined: same result
    monkeypatch.setattr(L, "LOOKUP", 300)
    monkeypatch.setattr(L, "HELD", 1000)         # tasks send their counts early
    small = L.score_texts(sample(spark), X.held_out("doc_id", 7, 2), items=200, classes=16, rounds=3).collect()
    check_lm(small, lm_by_hand(rows))


def test_class_lm_messy(spark):
    out = L.score_texts(messy(spark), X.held_out("doc_id", 7, 2), items=50, classes=4, rounds=2).collect()
    check_lm(out, lm_by_hand([(r[0], r[1]) for r in messy_rows()]))
    assert L.score_texts(empty(spark), X.held_out("doc_id", 7, 2)).count() == 0
    lone = spark.createDataFrame([(1, None), (3, "")], "doc_id long, text string")
    assert L.score_texts(lone, X.held_out("doc_id", 1, 0)).count() == 2


def test_most_frequent_has_no_cliff(spark):
    """Words of one count are taken up to the room there is, however many share it."""
    for n, size in (("5", 1000), ("CAST(id % 3 + 1 AS LONG)", 3000), ("id + 1", 400)):
        counts = spark.range(size).selectExpr("id * 7919 + 1 AS h", f"{n} AS n", "0 AS shape").selectExpr("h", "CAST(n AS LONG) AS n", "shape")
        every = sorted((r.n for r in counts.collect()), reverse=True)
        for limit in (1, 50, 350, 900, 10_000):
            got = L._most_frequent(counts, limit)
            assert len(got) <= limit and len(got) >= min(limit, size) - 8 * limit ** 0.5
            assert got["n"].tolist() == every[:len(got)] and got["h"].is_unique


def test_clustered_vocabulary_grows(spark):
    """All words equally frequent, and a table twice as large: items follow the vocabulary."""
    seen = []
    old = L.exchange
    try:
        L.exchange = lambda b, n, c, r: (seen.append((n, c)), old(b, n, c, 2))[1]
        for size in (300, 2400):
            docs = spark.range(size).selectExpr("id AS doc_id", "concat('w', id, ' v', id) AS text")
            out = L.score_texts(docs, X.held_out("doc_id", 7, 2)).collect()
            assert len(out) == size and all(math.isfinite(r.score) for r in out)
    finally:
        L.exchange = old
    assert 3.5 < seen[1][0] / seen[0][0] < 4.5 and seen[1][1] >= seen[0][1]


def test_score_by_hand(spark):
    """The score of every document from the classes and counts, word by word."""
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()][:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}
    old = L._score
    try:
        L._score = lambda model, *a: (kept.setdefault("m", model.value), old(model, *a))[1]
        got = {r.id: r.score for r in L.score_texts(df, X.held_out("doc_id", 7, 2), rounds=3).collect()}
    finally:
        L._score = old
    m, v = kept["m"], kept["m"].vocab
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.encode().translate(low).split())
    from riskframe.llm import hashing as H
    words = sorted({w for _, t in rows for w in t.encode().translate(low).split()})
    data = b" ".join(words)
    h = np.maximum(H.cut_words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash, 1)
    shape = {w: (0 if w[-1:] == b"." else 1 if w[-1:] == b"," else 2) + 3 * any(x >= 128 for x in w) for w in words}
    item = {w: int(v.item[r]) if (r := v.find(np.array([x]))[0]) >= 0 and v.item[r] >= 0 else -1 for w, x in zip(words, h)}
    cls = {w: int(m.cls[i]) if i >= 0 else int(m.cls[v.n_items + shape[w]]) for w, i in item.items()}
    members, rare_n, rare_v = Counter(), Counter(), Counter()
    for w, n in counts.items():
        if item[w] >= 0:
            members[cls[w]] += n
        else:
            rare_n[shape[w]] += n
            rare_v[shape[w]] += 1
    end = int(m.cls[v.end_item])
    for i, t in rows:
        total, before = 0.0, end
        for w in t.encode().translate(low).split():
            total += m.step[before, cls[w]]
            total += (math.log10(counts[w] / members[cls[w]]) if item[w] >= 0
                      else math.log10((counts[w] + 1) / (rare_n[shape[w]] + rare_v[shape[w]] + 1)))
            before = cls[w]
        assert math.isclose(got[i], total + m.step[before, end], rel_tol=1e-9)


def test_every_word_is_in_a_class(spark, monkeypatch):
    """Words outside the exchange, those that occur once among them, are placed in its classes; words
    beyond the look-up table are scored as if they were in it."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(45) for _ in range(95 - 2 * i)] + [f"r{i}." for i in range(150)]
    texts = [" ".join(x) for x in np.array_split(rng.permutation(words), 40)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, "w1 new r3. w2"), (1001, "r1. r2. other, new")], "doc_id long, text string")
    models, got = [], []
    old = L._score
    monkeypatch.setattr(L, "_score", lambda model, *a: (models.append(model.value), old(model, *a))[1])
    for lookup in (1 << 18, 60):
        monkeypatch.setattr(L, "LOOKUP", lookup)
        out = L.score_texts(docs, F.col("doc_id") >= 1000, items=40, classes=5, rounds=3).collect()
        got.append({r.id: (r.n_known, r.base_score, r.score) for r in out})
    assert len(models[1].vocab.h) < len(models[0].vocab.h) == 195
    for m in models:
        assert (m.vocab.item >= 0).all() and m.total.sum() == len(words)
        assert np.allclose((10 ** m.step).sum(axis=1), 1)
        assert (m.cls[:len(m.vocab.h)] < 5).all()
    assert got[0].keys() == got[1].keys()
    for i, a in got[0].items():
        assert a[0] == got[1][i][0] and np.allclose(a, got[1][i], rtol=1e-9)


def test_class_lm_is_a_distribution():
    """Transitions sum to 1, and so do the words of every class (one unseen word
    included in the shape classes)."""
    rng = np.random.default_rng(1)
    n = rng.integers(1, 50, 40)
    v = L.Vocabulary(np.arange(1, 41).astype(np.uint64), n, 25)
    cls = np.concatenate([rng.integers(0, 4, 25), 4 + np.arange(L.SHAPES + 1)])
    t = rng.integers(0, 9, (4 + L.SHAPES + 1,) * 2).astype(float)
    rare_n, rare_v = np.zeros(L.SHAPES), np.zeros(L.SHAPES)
    rare_n[0], rare_v[0] = n[25:].sum(), 15
    m = L.ClassModel(v, cls, t, rare_n, rare_v)
    assert np.allclose((10 ** m.step).sum(axis=1), 1)
    for c in range(4):
        of = np.array([cls[i] if i >= 0 else -1 for i in v.item])
        assert not (of == c).any() or math.isclose((10 ** m.emit[of == c]).sum(), 1)
    assert math.isclose((10 ** (m.emit[v.item < 0] - m.rare[0])).sum() + 10 ** -m.rare[0], 1)


def test_exchange_gain_matches_likelihood():
    rng = np.random.default_rng(4)
    n, free = 20, 5
    pair = rng.integers(0, 6, (n, n)).astype(float)
    cls = rng.integers(0, free, n)
    table = lambda c: np.array([[pair[np.ix_(c == a, c == b)].sum() for b in range(free)] for a in range(free)])
    for w in range(n):
        others = np.arange(n) != w
        right = np.bincount(cls[others], weights=pair[w, others], minlength=free)
        left = np.bincount(cls[others], weights=pair[others, w], minlength=free)
        k, gain = L.best_class(table(cls), int(cls[w]), right, left, pair[w, w], free)
        value = []
        for c in range(free):
            new = cls.copy()
            new[w] = c
            value.append(L.likelihood(table(new)))
        assert math.isclose(value[k], max(value), rel_tol=1e-9)
        assert abs(gain - (value[k] - value[cls[w]])) < 1e-6
