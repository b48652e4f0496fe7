"""Chunkers (R1-R4) and text audits (U5, F15, F16) on hand fixtures."""

import random

from pyspark.sql import functions as F

from riskframe.operators import text as TX


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fixed_chunks_rebuild_the_whole_text(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab cd\n") for _ in range(n)) for n in (0, 1, 799, 800, 801, 5000, 33000)]
    size, overlap = 800, 100
    rows = TX.chunk_fixed_overlap(_docs(spark, texts), size=size, overlap=overlap).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        parts = sorted(by_doc.get(i, []), key=lambda r: r["chunk_idx"])
        rebuilt = "".join(p["text"] if k == 0 else p["text"][overlap:] for k, p in enumerate(parts))
        assert rebuilt == t
        assert all(len(p["text"]) <= size for p in parts)
        assert all(p["chunk_id"] == f"{i}::p1::c{p['chunk_idx']}" for p in parts)


def test_recursive_split_respects_size_and_keeps_every_word():
    rnd = random.Random(5)
    words = ["w%d" % rnd.randint(0, 999) for _ in range(3000)]
    text = " ".join(words[:1000]) + "\n\n" + "\n".join(words[1000:2000]) + ". " + " ".join(words[2000:])
    chunks = TX.recursive_split(text, 200, 20, TX.DEFAULT_SEPARATORS)
    assert all(len(c) <= 200 for c in chunks)
    seen = set(" ".join(chunks).split())
    assert set(words) <= seen
    assert TX.recursive_split("", 200, 20, TX.DEFAULT_SEPARATORS) == []


def test_recursive_chunker_runs_on_whole_documents(spark):
    long_doc = ("lorem ipsum " * 5000).strip()
    rows = TX.chunk_recursive(_docs(spark, [long_doc, "short"]), size=300, overlap=30).collect()
    assert {r["doc_id"] for r in rows} == {0, 1}
    joined = " ".join(r["text"] for r in rows if r["doc_id"] == 0)
    assert joined.count("lorem") >= 5000


def test_keyword_chunker_slices_between_hits_and_falls_back(spark):
    t = ("Preamble text that is long enough to keep. Standard assets are those that perform as agreed. "
         "Doubtful assets are those with weaknesses that make collection in full highly questionable.")
    rows = TX.chunk_by_keywords(_docs(spark, [t, "no heading words at all in this one"]), min_len=10).collect()
    levels = sorted(r["class_level"] for r in rows if r["doc_id"] == 0)
    assert levels == ["doubtful", "standard"]
    assert [r["class_level"] for r in rows if r["doc_id"] == 1] == ["unknown"]


def test_invented_numbers_is_an_anti_join(spark):
    reports = spark.createDataFrame([(1, "AUC 0.97 and KS 0.45 with 12.5 percent"), (2, "nothing here")],
                                    "doc_id long, text string")
    allowed = spark.createDataFrame([("0.97",), ("12.5",)], "number string")
    got = {(r["doc_id"], r["number"]) for r in TX.invented_numbers(reports, allowed).collect()}
    assert got == {(1, "0.45")}
