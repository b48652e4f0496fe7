"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import oracles as O
from riskframe.llm.class_lm import score_texts
from riskframe.llm.conversation_repair import damaged, repair
from riskframe.llm.decontaminate import contaminated
from riskframe.llm.embedding_dedup import embedding_near_duplicates
from riskframe.llm.hard_negatives import hard_negatives
from riskframe.llm.minhash_dedup import near_duplicates
from riskframe.llm.packing import packed_sequences
from riskframe.llm.quality import quality
from riskframe.llm.sentencepiece_codec import encode_texts
from riskframe.llm.substring_dedup import substring_dedup
from riskframe.llm.token_counts import count_tokens
from riskframe.llm.token_files import fresh_folder, token_index, write_token_files
from riskframe.llm.toxicity import held_out, toxicity
from riskframe.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op1_substring_dedup", O.SUBSTRING_DEDUP)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 50-word windows that a smaller doc_id holds are removed."""
    out = substring_dedup(table(spark, sf_dir, "documents", ["doc_id", "text"]), window=50)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"),
                      F.size("removed").alias("n_repeats"))


@query("op9_bagminhash_dedup", O.NEAR_DUPLICATES)
def op9_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingle multisets overlap by 0.8 or more."""
    out = near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]), similarity=0.8)
    return out.select(F.col("id").alias("doc_id"), "component_id", "kept")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and indexed."""
    out = fresh_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents", ["doc_id", "text"]), out,
                      public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_index(spark, out).withColumnRenamed("id", "doc_id")


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within 6 % character edits."""
    out = contaminated(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                       table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return out.drop("text_hash").withColumnRenamed("id", "doc_id")


@query("op8_embedding_dedup", O.EMBEDDING_DEDUP)
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at cosine 0.95 or more, their components and survivors."""
    out = embedding_near_duplicates(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), similarity=0.95)
    return out.withColumnRenamed("id", "vec_id")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the clause grammar."""
    out = toxicity(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return out.select("row.doc_id", held_out("row.doc_id", 4, 2).alias("held_out"), "score", "predicted",
                      "top_clause", "n_matches")


@query("op10_class_lm")
def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram and smoothed unigram log10 probabilities of every document."""
    out = score_texts(table(spark, sf_dir, "documents", ["doc_id", "text"]), held_out("doc_id", 7, 2))
    return out.withColumnRenamed("id", "doc_id").withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram ids of every document and whether they decode to its text."""
    out = encode_texts(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                       public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces",
                      F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document and its best score, without encoding it."""
    return count_tokens(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                        public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the weakly trained scorer."""
    return quality(table(spark, sf_dir, "documents", ["doc_id", "text"])).withColumnRenamed("id", "doc_id")


@query("op11_conversation_repair", O.CONVERSATION_REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after reproducible damage."""
    rows = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return repair(damaged(rows), dropped=F.col("dropped")).summary


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    out = packed_sequences(table(spark, sf_dir, "documents", ["doc_id", "text"]), public_tokenizers.path("word_bpe_49k.json"),
                           capacity=2048, end_id=0)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_hard_negatives", O.HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's best rows of its own."""
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"])
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, low=80, high=100)
