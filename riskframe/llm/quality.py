"""Quality classifier: weak labellers, EM, and a hashed linear scorer.

1. **Labellers.**  Nine heuristics vote good, bad or abstain on every document
   (``LABELLERS``: symbols, capitals, repeated words, word variety, table marks,
   repeated lines, function words, exclamations, length).
2. **EM.**  The votes are conditionally independent given an unseen quality; EM
   estimates its prior and each labeller's accuracy as a table
   P(vote | quality).  Documents with equal votes count together, so all documents
   reach the driver as at most 3^9 (vote pattern, count) rows.
3. **Scorer.**  A logistic model over ``BUCKETS`` hashed features (shapes of words
   and of neighbouring words, repeats, binned document statistics) is trained on
   the posteriors of at most ``FIT_ROWS`` documents, those whose id hashes low.  Its score, not the votes, decides: it sees more than any labeller and
   also covers documents on which labellers abstain.

No labels are used.  Defined cases: null and empty texts have no words, are voted
bad by length and score low; null ids are scored and can be in the fit; repeated
rows count and are scored each; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import hash_sample, text_batches
from riskframe.session import cut_lineage

BUCKETS, FIT_ROWS = 1 << 12, 20_000
BAD, GOOD, ABSTAIN = 0, 1, 2
FUNCTION_WORDS = """the of and to in is that a for on with as be by it was der die und das den von zu mit ist im auf
für ein eine nicht le la les de des et un une que en du dans pour est sur par el los las y del se por con una para
no su al""".split()
#: name: (statistic, bad above, good below); negative bounds turn the comparison.
LABELLERS = {
    "symbols": ("symbols", 0.02, 0.004),
    "capitals": ("capitals", 0.3, 0.05),
    "repeats": ("repeats", 0.2, 0.05),
    "sameness": ("sameness", 0.75, 0.55),
    "table_marks": ("pipes", 0.15, 0.02),
    "repeated_lines": ("duplicate_lines", 0.4, 0.15),
    "no_function_words": ("strange", 0.98, 0.94),
    "exclamations": ("exclaims", 0.2, 0.02),
    "shortness": ("shortness", 0.2, 0.06),
}
STATS = ["symbols", "capitals", "repeats", "sameness", "pipes", "duplicate_lines", "strange", "exclaims", "shortness"]
U64 = np.uint64


def _word_hashes(words: list[str]) -> np.ndarray:
    data, offs = H.text_buffer(pa.array([" ".join(words)]))
    return np.sort(H.cut_words(data, offs).hash)


_BYTE_KIND = np.full(256, 2, np.uint8)            # letters, also bytes of other scripts
_BYTE_KIND[:128] = np.arange(128)                 # marks stand for themselves
_BYTE_KIND[48:58] = 48
_BYTE_KIND[65:91] = 65
_BYTE_KIND[97:123] = 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$&%*@^~\\<>{}[]=_+"]] = True


def _shapes(data: np.ndarray, w: H.Words) -> np.ndarray:
    """Hash of each word's shape: its byte kinds with runs collapsed."""
    kind = _BYTE_KIND[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[w.start] = True
    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    at = np.flatnonzero(fresh & (np.cumsum(solid[:-1]) > 0))
    lead = np.searchsorted(at, w.start)
    size = np.diff(np.append(lead, len(at)))
    place = np.arange(len(at)) - np.repeat(lead, size)
    return H.mix(np.add.reduceat(H._BYTE[kind[at]] * H._table("pos", int(size.max()))[place], lead))


def document_features(col: pa.Array):
    """(stats per document, bucket and value lanes with document offsets)."""
    data, offs = H.text_buffer(col)
    n_docs = len(offs) - 1
    w = H.cut_words(data, offs)
    n = w.counts
    many = np.maximum(n, 1)
    per = lambda v: np.bincount(w.doc, weights=v, minlength=n_docs) / many
    stats = np.zeros((n_docs, len(STATS)))
    if len(w.hash):
        def of_bytes(flag):
            c = np.concatenate([[0], np.cumsum(flag)])
            return c[offs[1:]] - c[offs[:-1]], c[w.end] - c[w.start]
        size = np.maximum(np.diff(offs), 1)
        stats[:, 0] = of_bytes(_SYMBOL[data])[0] / size
        upper = of_bytes((data >= 65) & (data <= 90))[1]
        lower = of_bytes((data >= 97) & (data <= 122))[1]
        stats[:, 1] = per((upper > 1) & (lower == 0))
        repeat = np.zeros(len(w.hash), bool)
        repeat[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        stats[:, 2] = per(repeat)
        h = w.hash.copy()
        for a, b in zip(w.first[:-1], w.first[1:]):
            h[a:b].sort()
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        # longer texts repeat words anyway: variety is judged against n^0.12
        stats[:, 3] = np.where(n >= 30, 1 - (1 - per(again)) * (many / 30.0) ** 0.12, 0)
        stats[:, 4] = per((data[w.start] == 124) & (w.end - w.start == 1))
        stats[:, 7] = of_bytes(data == 33)[0] / many
        words = _FUNCTION_HASHES
        k = np.minimum(np.searchsorted(words, w.hash), len(words) - 1)
        stats[:, 6] = np.where(n >= 15, 1 - per(words[k] == w.hash), 0)
    for i, t in enumerate(col.to_pylist()):
        lines = [x for x in (t or "").split("\n") if x.strip()]
        if len(lines) > 2:
            stats[i, 5] = 1 - len(set(lines)) / len(lines)
    stats[:, 8] = 1 / (n + 1.0)

    key, doc, val = [], [], []
    if len(w.hash):
        shape = _shapes(data, w)
        pair = np.concatenate([[U64(0)], shape[:-1]])
        pair[w.first[:-1][n > 0]] = U64(1)
        for lane, salt in ((shape, 11), (H.mix(pair) ^ shape, 13)):
            key.append(H.mix(lane + U64(salt)))
            doc.append(w.doc)
            val.append(1.0 / many[w.doc])
    for j in range(len(STATS)):
        bins = np.floor(np.log2(np.maximum(stats[:, j], 1e-3)) * 1.5).astype(np.int64) + 100
        key.append(H.mix(bins.astype(U64) * U64(64) + U64(j) + U64(1 << 40)))
        doc.append(np.arange(n_docs))
        val.append(np.full(n_docs, 0.3))
    slot = np.concatenate(doc) * BUCKETS + (np.concatenate(key) % U64(BUCKETS)).astype(np.int64)
    uniq, at = np.unique(slot, return_inverse=True)
    value = np.bincount(at, weights=np.concatenate(val)) if len(uniq) else np.zeros(0)
    cut = np.searchsorted(uniq, np.arange(n_docs + 1) * BUCKETS)
    return stats, (uniq % BUCKETS).astype(np.int32), np.sqrt(value).astype(np.float32), cut.astype(np.int32)


_FUNCTION_HASHES = _word_hashes(FUNCTION_WORDS)


def votes(stats: np.ndarray) -> np.ndarray:
    out = np.full(stats.shape, ABSTAIN)
    for j, (stat, bad, good) in enumerate(LABELLERS.values()):
        x = stats[:, STATS.index(stat)]
        out[x > bad, j] = BAD
        out[x < good, j] = GOOD
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in H.slices(batches):
        stats, bucket, value, cut = document_features(b.column("text"))
        pattern = votes(stats) @ (3 ** np.arange(len(LABELLERS)))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(pattern.astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket)),
             pa.ListArray.from_arrays(pa.array(cut), pa.array(value))], ["id", "pattern", "buckets", "weights"])


def expectation_maximisation(vote: np.ndarray, count: np.ndarray, rounds: int = 200):
    """(prior of good, P(vote | quality) per labeller, posterior per pattern).

    Starts from the share of good votes weighed against any bad one, which fixes
    which class is which.
    """
    bad, good = (vote == BAD).sum(axis=1), (vote == GOOD).sum(axis=1)
    post = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    for _ in range(rounds):
        prior = (count @ post + 1) / (count.sum() + 2)
        table = np.zeros((2, vote.shape[1], 3))
        for q, p in ((0, 1 - post), (1, post)):
            for v in range(3):
                table[q, :, v] = (count * p) @ (vote == v) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        at = np.arange(vote.shape[1])
        log = [np.log(table[q, at, vote]).sum(axis=1) for q in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] + np.log1p(-prior) - log[1] - np.log(prior), -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, table, post


def fit_scorer(rows: list, target: np.ndarray, rounds: int = 300, ridge: float = 1e-5) -> np.ndarray:
    """Logistic weights (bias last) on soft targets, by accelerated descent."""
    size = np.array([len(r.buckets) for r in rows])
    at = np.repeat(np.arange(len(rows)), size)
    col = np.concatenate([np.asarray(r.buckets, np.int64) for r in rows])
    val = np.concatenate([np.asarray(r.weights, float) for r in rows])
    w, v, t = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 1.0
    rate = 4.0 / (1.0 + np.bincount(at, weights=val ** 2).max())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=val * v[col], minlength=len(rows)) + v[-1], -30, 30)))
        d = (p - target) / len(rows)
        g = np.append(np.bincount(col, weights=val * d[at], minlength=BUCKETS), d.sum()) + ridge * v
        new, t2 = v - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t2 * (new - w), t2
    return w


def _apply(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, post = model_bc.value
        for b in batches:
            col, val = b.column("buckets"), b.column("weights").flatten().to_numpy()
            offs = np.asarray(col.offsets) - col.offsets[0].as_py()
            doc = np.repeat(np.arange(b.num_rows), np.diff(offs))
            x = np.bincount(doc, weights=val * w[col.flatten().to_numpy()], minlength=b.num_rows) + w[-1]
            weak = np.array([post[p] for p in b.column("pattern").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(weak, pa.float64()),
                                              pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))],
                                             ["id", "weak_posterior", "score"])
    return run


def quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, weak_posterior, score`` (higher: better) and
    ``kept`` (score >= threshold)."""
    text_batches(docs)
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = cut_lineage(base.mapInArrow(_observe, "id long, pattern int, buckets array<int>, weights array<float>"))
    tally = seen.groupBy("pattern").count().collect()           # at most 3^9 rows
    pattern = np.array([r.pattern for r in tally], np.int64)
    if not tally:
        return seen.select("id", *[F.lit(None).cast("double").alias(c) for c in ("weak_posterior", "score")],
                           F.lit(None).cast("boolean").alias("kept"))
    vote = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    _, _, post = expectation_maximisation(vote, np.array([r["count"] for r in tally], float))
    known = dict(zip(pattern.tolist(), post.tolist()))
    rows = hash_sample(seen, "id", sum(r["count"] for r in tally), FIT_ROWS).collect()
    w = fit_scorer(rows, np.array([known[r.pattern] for r in rows])) if rows else np.zeros(BUCKETS + 1)
    out = seen.mapInArrow(_apply(sc.broadcast((w, known))), "id long, weak_posterior double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)
