"""Small tables with every awkward row, and brute-force references."""

import random
from collections import Counter

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, row int, n int"
PARK = " ".join(f"w{i}" for i in range(80))
TOXIC = "You are a stupid idiot. You pathetic loser, worthless scum!"


def messy_rows():
    """Nulls in every column, empty and blank texts, copies, near copies, repeated
    rows, a null id twice, a very long text, and columns whose names clash with
    the operators' own."""
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(60_000))
    base = " ".join(f"k{i % 41}x{i}" for i in range(120))
    near = base.replace("k5x5", "changed")
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"),
        (9, "a b " + PARK + " c"), (10, "d e " + PARK + " f g"), (10, "d e " + PARK + " f g"),
        (11, long), (12, TOXIC), (None, PARK), (None, None), (13, "x" * 20_000), (14, "Ünïcode 日本 𝄞 ▁ <s>   end"),
        (15, PARK + " " + PARK),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if t is None else len(t), "id", 0.5, k, 1)
            for k, (i, t) in enumerate(texts)]


def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sample(spark, modulus: int = 1):
    return spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % modulus == 0)


def shingles(text: str | None) -> Counter:
    w = (text or "").encode().split()
    return Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(nodes, links):
    """node -> smallest node of its component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
