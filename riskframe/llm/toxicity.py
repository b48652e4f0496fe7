"""Toxicity: a weighted finite-state grammar over clauses, calibrated on labels.

**Grammar.**  Small deterministic transducers run over the words of a clause; the
scope machines are composed into one table:

* lexicon - a word becomes a symbol: insult (with the weight of its longest
  known stem), threat verb, target, negation, reporting verb, quotation mark,
  or other;
* negation - an insult or threat within three words after a negation is marked;
* reported speech - so is one after a reporting verb or inside quotation marks;
* target - one within four words after a personal target is strengthened; a
  threat counts in full only with a target.  This machine runs forwards and
  backwards and the stronger factor counts, so a target may also follow.

A clause runs between sentence marks.  Only clauses that hold an insult or a threat
are run; the score of a clause is the sum of the weights its path emits.  So a
single word does not decide: scope, target and its clause do.

**Learning.**  Insult stems (prefixes of four to six letters, or shorter whole
words) and their weights are log ratios of their rate in toxic and other labelled
documents, kept if their lower confidence bound is high; the seed stems below
hold where labels say nothing.  A logistic model over clause features turns
clause scores into a probability.  Both are fitted on at most ``MAX_TOXIC`` toxic
and ``MAX_OTHER`` other labelled training rows, taken by smallest hash.  The stems
come from all of them; the logistic model from features that each third has under
the stems of the other two, at any number of rows.  Its rows are weighted to the
share that toxic rows have among all labelled training rows, so a score means
the same whether or not the sample is full.  Labels, language, source and id
are never features.

Defined cases: null and empty texts score like any text without a match; null
ids count as training rows without labels; with no usable labels the seed
weights and default coefficients apply; repeated label rows of an id with
conflicting marks count as toxic; repeated documents are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import hashing as H
from riskframe.llm.batches import text_batches
from riskframe.session import cut_lineage, tasks_for

MAX_TOXIC, MAX_OTHER, MAX_STEMS = 3000, 6000, 2000
#: Tasks that share the bounded sample and what is counted in it.
SAMPLE_TASKS = 18
SEED_WEIGHT = 2.0
FOLDS = 3
REPEATS = 4
INSULTS = """idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool jerk imbecile
vermin filth""".split()
THREATS = """kill hurt beat destroy shoot stab burn crush hang""".split()
TARGETS = """you your yours yourself u he she they them him her du dich dir ihr euch tu te toi vous vosotros usted
ustedes""".split()
NEGATIONS = """not no never nobody nothing isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca
ningún""".split()
REPORTS = """said says say told tells claimed claims wrote writes reported reports quoted according sagte sagt dit
disait dijo dice""".split()
#: Scope factors of the grammar and the default model (intercept, then FEATURES).
NEGATED, REPORTED, TARGETED, LONE_THREAT, THREAT_WEIGHT = 0.3, 0.5, 1.5, 0.2, 4.0
FEATURES = ["log_sum", "top", "hit_rate", "clause_share", "log_hits"]
DEFAULT_MODEL = [-5.0, 1.5, 0.5, 0.1, 1.0, 1.0]
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[\"“”«»]|[^\W\d_]+(?:['’][^\W\d_]+)?")


class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, factor)."""

    def __init__(self, start, table):
        self.start, self.table = start, table

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: this machine's output is the other's input."""
        start, table, todo, done = (self.start, other.start), {}, [(self.start, other.start)], set()
        inputs = {x for _, x in self.table}
        while todo:
            s, t = todo.pop()
            if (s, t) in done:
                continue
            done.add((s, t))
            for x in inputs:
                s2, y, w1 = self.table[s, x]
                t2, z, w2 = other.table[t, y]
                table[(s, t), x] = ((s2, t2), z, w1 * w2)
                todo.append((s2, t2))
        return Transducer(start, table)


KINDS = "insult threat target negation report quote other".split()
_HOT = ("insult", "threat")


def _negation(reach: int = 3) -> Transducer:
    t = {}
    for left, x in product(range(reach + 1), KINDS):
        hit = left > 0 and x in _HOT
        t[left, x] = (reach if x == "negation" else max(0, left - 1), x, NEGATED if hit else 1.0)
    return Transducer(0, t)


def _reported() -> Transducer:
    t = {}
    for mode, x in product(("direct", "quoted", "told"), KINDS):
        new = mode
        if x == "quote":
            new = "direct" if mode == "quoted" else "quoted"
        elif x == "report" and mode == "direct":
            new = "told"
        t[mode, x] = (new, x, REPORTED if mode != "direct" and x in _HOT else 1.0)
    return Transducer("direct", t)


def _target(reach: int = 4) -> Transducer:
    t = {}
    for left, x in product(range(reach + 1), KINDS):
        factor = 1.0
        if x == "insult" and left:
            factor = TARGETED
        elif x == "threat":
            factor = 1.0 if left else LONE_THREAT
        t[left, x] = (reach if x == "target" else max(0, left - 1), x, factor)
    return Transducer(0, t)


def scopes() -> Transducer:
    """Negation and reported speech as one composed machine."""
    return _negation().then(_reported())


class Scorer:
    """Lexicon and composed grammar over one text."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick
        self.stems = stems
        self.scope, self.target = scopes(), _target()
        self.kind = {w: k for words, k in ((TARGETS, "target"), (NEGATIONS, "negation"), (REPORTS, "report"),
                                           (THREATS, "threat"), (['"', "“", "”", "«", "»"], "quote")) for w in words}
        self.search = ahocorasick.Automaton()
        for key in {*stems, *THREATS}:
            self.search.add_word(key, key)
        self.search.make_automaton()

    def weight(self, word: str) -> float:
        """Largest weight of the known stems that start the word; 0 if none."""
        get = self.stems.get
        if len(word) < 4:
            return get(word, 0.0)
        return max(get(word[:4], 0.0), get(word[:5], 0.0), get(word[:6], 0.0))

    def symbols(self, text: str) -> list[tuple[str, float]]:
        """The lexicon transducer: a symbol and a weight per word."""
        out = []
        for word in _WORD.findall(text):
            kind, w = self.kind.get(word, "other"), 0.0
            if kind == "threat":
                w = THREAT_WEIGHT
            elif kind == "other" and (w := self.weight(word)):
                kind = "insult"
            out.append((kind, w))
        return out

    def clause(self, text: str) -> tuple[float, int]:
        """(score, matches) of one lower-cased clause: per match the factor of its
        scopes, which bind forwards, and of the nearer target on either side."""
        read = self.symbols(text)
        hits = [i for i, (kind, _) in enumerate(read) if kind in _HOT]
        if not hits:
            return 0.0, 0
        ahead, back = self._run(self.scope, read), self._run(self.target, read)
        after = self._run(self.target, read[::-1])[::-1]
        return sum(read[i][1] * ahead[i] * max(back[i], after[i]) for i in hits), len(hits)

    @staticmethod
    def _run(machine: Transducer, read: list[tuple[str, float]]) -> list[float]:
        state, step, out = machine.start, machine.table, []
        for kind, _ in read:
            state, _, factor = step[state, kind]
            out.append(factor)
        return out

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = len(low.split())
        at = [i for i, _ in self.search.iter(low)] if len(self.search) else []
        scores, hits, n = [], 0, 0
        if at:
            cuts = [m.end() for m in _CLAUSE.finditer(low)]
            edges = np.array([0, *cuts, len(low)])
            n = len(edges) - 1
            for k in np.unique(np.searchsorted(edges, at, side="right") - 1).tolist():
                s, h = self.clause(low[edges[k]:edges[min(k + 1, n)]])
                if h:
                    scores.append(s)
                    hits += h
        total = sum(scores)
        return [math.log1p(max(total, 0.0)), max(scores, default=0.0), 100.0 * hits / max(words, 1),
                len(scores) / max(n, 1), math.log1p(hits)]


def stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: occurrences of every stem in toxic and other rows (at most
    ``REPEATS`` of a document count), and in how many documents; the word totals
    stand under the empty stem."""
    count: dict[tuple[str, int], list[int]] = {}
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = [w for w in _WORD.findall((text or "").lower()) if w[0].isalpha()]
            own = Counter()
            for w, n in Counter(words).items():
                for size in (4, 5, 6):
                    if len(w) >= size:
                        own[w[:size]] += n
                if len(w) < 4:
                    own[w] += n
            own[""] = len(words)          # no stem
            for stem, n in own.items():
                c = count.setdefault((stem, toxic), [0, 0])
                c[0] += min(n, REPEATS) if stem else n
                c[1] += 1
    if count:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in count]), pa.array([k[1] for k in count], pa.int32()),
             pa.array([v[0] for v in count.values()], pa.int64()), pa.array([v[1] for v in count.values()], pa.int64())],
            ["stem", "toxic", "n", "docs"])


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems whose rate in toxic rows is surely higher; at most ``MAX_STEMS``."""
    toxic = F.col("toxic") == 1
    c = sample.mapInArrow(stem_counts, "stem string, toxic int, n long, docs long").groupBy("stem").agg(
        *[F.sum(F.when(cond, F.col(col)).otherwise(0)).alias(name) for cond, col, name in (
            (toxic, "n", "t"), (~toxic, "n", "o"), (toxic, "docs", "td"), (~toxic, "docs", "od"))])
    c = cut_lineage(c, SAMPLE_TASKS)
    whole = c.where("stem = ''").first()
    if whole is None or not whole.t or not whole.o:
        return {}
    ratio = F.log((F.col("t") + 0.1) / F.lit(whole.t + 1.0)) - F.log((F.col("o") + 0.5) / F.lit(whole.o + 1.0))
    sure = ratio - 2 * F.sqrt(1 / F.col("td") + 1 / (F.col("od") + 1))
    least = max(4.0, 0.005 * whole.td)
    best = c.where("stem <> ''").where(F.col("td") >= least).select("stem", sure.alias("sure"))
    rows = best.where("sure > 0.8").orderBy(F.desc("sure"), "stem").limit(MAX_STEMS).collect()
    return {r.stem: float(min(r.sure, 6.0)) for r in rows}


def _featurise(stems_bc):
    """Features of every row under the stems learned without its fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(stems) for stems in stems_bc.value]
        for b in batches:
            rows = [scorers[k].features(t) for k, t in zip(b.column("fold").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])
    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression of weighted rows by damped Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + pen * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> tuple[dict[str, float], list[float]]:
    """(stems, model) from the bounded labelled training sample."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    marks = cut_lineage(marks, tasks_for(labels.count()))
    all_rows = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}     # two classes
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    chosen = marks.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).union(
        marks.where("toxic = 0").orderBy(*order).limit(MAX_OTHER))
    chosen = cut_lineage(chosen)          # at most MAX_TOXIC + MAX_OTHER ids: safe to broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = cut_lineage(sample.dropDuplicates(["text"]).withColumn("fold", F.crc32(F.md5(F.col("id").cast("string"))) % FOLDS), SAMPLE_TASKS)

    def learn(part: DataFrame) -> dict[str, float]:
        stems = {w[:6]: SEED_WEIGHT for w in INSULTS}
        for stem, w in learn_stems(part.select("text", "toxic")).items():
            stems[stem] = max(w, stems.get(stem, 0.0))
        return stems

    stems = learn(sample)
    bc = docs.sparkSession.sparkContext.broadcast([learn(sample.where(F.col("fold") != k)) for k in range(FOLDS)])
    got = sample.select("fold", "text", "toxic").mapInArrow(_featurise(bc), "toxic int, x array<double>").collect()
    if not got or len({r.toxic for r in got}) < 2:
        return stems, DEFAULT_MODEL
    y = np.array([r.toxic for r in got])
    share = all_rows[1] / (all_rows[0] + all_rows[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return stems, fit_logistic(np.array([r.x for r in got]), y.astype(float), weight).tolist()


def _score(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, w = model_bc.value
        scorer = Scorer(stems)
        for b in H.slices(batches):
            x = np.array([scorer.features(t) for t in b.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(p), pa.array(x[:, 1]), pa.array(np.rint(np.expm1(x[:, 4])).astype(np.int32))],
                ["row", "score", "top_clause", "n_matches"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``score`` in [0, 1],
    ``predicted`` (1 if score >= threshold), ``top_clause``, ``n_matches``."""
    text_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    base = docs.select(F.col(text_col).alias("text"), F.struct(*(carry or [id_col])).alias("row"))
    row_type = base.schema["row"].dataType.simpleString()
    out = base.mapInArrow(_score(model), f"row {row_type}, score double, top_clause double, n_matches int")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
