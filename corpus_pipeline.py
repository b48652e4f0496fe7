"""Corpus pipeline: five stages over ``documents``, each written and read again.

Every stage works on all rows its predecessor kept and all but the last return the
columns of its input.  Defined cases: rows with a null doc_id pass the filtering
stages on their own merits (they are never near-duplicates of anything); null texts
are empty; of repeated rows with one doc_id and text the near-duplicate stage keeps one; extra
columns of any name are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.decontaminate import contaminated
from riskframe.llm.minhash_dedup import near_duplicates
from riskframe.llm.sentencepiece_codec import encode_texts
from riskframe.llm.substring_dedup import substring_dedup
from riskframe.llm.toxicity import toxicity
from riskframe.session import cut_lineage, scratch_path, tasks_for
from riskframe.sources.tables import table

#: A key list of up to this many rows (16 bytes each) is broadcast; a longer one
#: is joined by shuffle.
BROADCAST_KEYS = 1_000_000

#: The stages are iterative, so no single SQL statement gives run()'s rows.
ORACLE_SQL = None


def _gathered(docs: DataFrame) -> DataFrame:
    """``docs`` in no more partitions than its rows need, so that a table of many small
    files is not written, checkpointed and read as such by all stages."""
    return docs.coalesce(tasks_for(docs.count()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    labels = table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    scored = toxicity(_gathered(docs), labels, threshold=0.3, carry=docs.columns)
    return scored.where("predicted = 0").select("row.*")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (doc_id, text) is not among ``keys(id, text_hash)``."""
    keys = cut_lineage(keys.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), tasks_for(docs.count()))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(keys, same, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of smallest id."""
    docs = _gathered(docs)
    gone = near_duplicates(docs, similarity=0.8).where("NOT kept")
    kept = _without(docs, gone)
    # repeated rows of one id and text: only they are shuffled
    text_hash = F.xxhash64("text")
    again = cut_lineage(docs.where("doc_id IS NOT NULL").groupBy("doc_id", text_hash.alias("_hash")).count().where(
        "count > 1").select(F.col("doc_id").alias("_id"), "_hash"), tasks_for(docs.count()))
    many = again.count()
    if many == 0:
        return kept
    pick = F.broadcast(again) if many <= BROADCAST_KEYS else again
    same = (F.col("doc_id") == F.col("_id")) & (text_hash == F.col("_hash"))
    single = kept.join(pick, same, "left_anti")
    return single.union(kept.join(pick, same, "left_semi").dropDuplicates(["doc_id", "text"]).coalesce(tasks_for(many)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out."""
    rest = [c for c in docs.columns if c != "text"]
    out = substring_dedup(_gathered(docs), window=50, carry=rest, keep_whole=True)
    new = {c: F.col("row")[c] for c in rest} | {"text": F.col("kept_text")}
    if "n_chars" in rest:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(new["n_chars"]).cast(kind)
    return out.select(*[new[c].alias(c) for c in docs.columns]).coalesce(tasks_for(docs.count()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = _gathered(docs)
    hits = contaminated(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return _without(docs, hits)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Unigram ids of the kept texts; ``round_trip`` says they decode to the text."""
    rest = [c for c in docs.columns if c != "text"]
    out = encode_texts(_gathered(docs), public_tokenizers.path("piece_bpe_32k.model"), rest, with_text=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"),
                      "n_byte_pieces", "round_trip", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; every stage's rows are written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
