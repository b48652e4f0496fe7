"""Tokenizers against their libraries, token files, and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from riskframe.llm import unigram as U
from riskframe.llm.queries import QUERIES
from riskframe.llm.sentencepiece_codec import Codec, DoubleArray, encode_texts
from riskframe.llm.token_counts import Counter, count_tokens
from riskframe.llm.token_files import ChunkEncoder, fresh_folder, read_documents, token_index, write_token_files
from tests.llm.helpers import SF, TOXIC, empty, messy, messy_rows, sample

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "  a  b ", "\n\n x", "日本語テキスト𝄞😀", "áé", "<s> </s> <0x41>", "x" * 300, "aaaa bbbb " * 50, "123 456.78,9",
       "a<|endoftext|>b c\td", " x y's ΣΑΣ Σ", "<|start oftext|> <|StartOfText|>", "İstanbul̇ ǅ ﬁ $$$,",
       "it's. A.,b 3.5, x... é. don't., \x0b\x0c\x1c q", " nbsp x"]


@pytest.fixture(scope="module")
def vocab():
    return U.load_unigram(PIECES)


@pytest.fixture(scope="module")
def library():
    """The library's own unigram model over the same pieces and scores."""
    import sentencepiece
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = U.zipf_score(-p.score, len(m.pieces))
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def texts(spark):
    return ODD + [r.text for r in sample(spark).collect()]


def test_codec_equals_library(spark, vocab, library):
    codec = Codec(vocab)
    for t in texts(spark):
        ids = codec.encode(t)
        assert ids.tolist() == library.encode(t or "")
        assert codec.decode(ids) == library.decode(ids.tolist()) == (t or "")
    assert codec.decode(codec.encode("a ▁ b")) == library.decode(library.encode("a ▁ b")) != "a ▁ b"


def test_counter_equals_library(spark, vocab, library):
    counter = Counter(vocab)
    for t in texts(spark):
        assert counter(t)[0] == len(library.encode(t or ""))


def test_ties_and_cuts(vocab):
    """Few scores, so most paths tie: counter, codec and plain search agree."""
    pieces = ["a", "b", "aa", "ab", "ba", "aab", "▁", "▁a", "▁▁"]
    tiny = U.Unigram(pieces + [f"<{b}>" for b in range(256)], {p: -1.0 * len(p) for p in pieces},
                     {p: i for i, p in enumerate(pieces)}, [9 + b for b in range(256)])
    codec, counter = Codec(tiny), Counter(tiny)
    import itertools
    for n in range(1, 7):
        for word in map("".join, itertools.product("abé ", repeat=n)):
            ids = codec.encode(word)
            flat = codec.best_path("▁" + word.replace(" ", "▁"))
            assert ids.tolist() == flat and counter(word)[0] == len(ids) and codec.decode(ids) == word


def test_double_array_finds_exactly_its_keys():
    keys = sorted({bytes(k) for k in np.random.default_rng(1).integers(0, 256, (500, 3)).astype(np.uint8)} | {b"a", b"ab", b"\xff"})
    t = DoubleArray(keys)
    for i, k in enumerate(keys):
        node = 0
        for c in k:
            nxt = t.base[node] + c
            assert t.check[nxt] == node
            node = nxt
        assert t.value[node] == i


def test_codec_and_counter_messy(spark):
    rows = encode_texts(messy(spark), PIECES, ["doc_id", "text", "id", "row"]).collect()
    assert len(rows) == len(messy_rows())
    for r in rows:
        marked = "▁" in (r.row.text or "")
        assert r.round_trip == (not marked) and (marked or r.decoded == (r.row.text or ""))
    counts = sorted((str(r.id), r.n_tokens) for r in count_tokens(messy(spark), PIECES).collect())
    assert counts == sorted((str(r.row.doc_id), len(r.ids)) for r in rows)
    assert encode_texts(empty(spark), PIECES, ["doc_id"]).count() == count_tokens(empty(spark), PIECES).count() == 0


def test_chunks_equal_library(spark):
    from tokenizers import Tokenizer
    tok, mine = Tokenizer.from_file(WORDS), ChunkEncoder(WORDS)
    every = [t or "" for t in texts(spark)]
    for t, ids in zip(every, mine([t.encode() for t in every])):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_marks_and_words_are_kept_apart():
    """The table holds words and marks, not their pairs; odd runs of marks still equal the library's."""
    from tokenizers import Tokenizer
    tok, mine = Tokenizer.from_file(WORDS), ChunkEncoder(WORDS)
    words = [f"{a}{b}ing" for a in "abcdefgh" for b in "lmnopqrs"] + ["né", "über", "한"]
    every = [f"{w}{m} {w} x{m}{m}" for m in "!?;:,.)-%" for w in words]
    for t, ids in zip(every, mine([t.encode() for t in every])):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert len(mine.seen.now) < 2 * len(words) + 50
    odd = ["a\u0301. é., İ, \u0958. ﬁ! x\u0307, '., a' b's! ²) ⅷ; _x_ --- a-b- \x1c. .\x85, ٣%", "", " ", "<|x, y", "한. ᄒ\u1161, क़!"]
    for t, ids in zip(odd, mine([t.encode() for t in odd])):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def by_hand(rows):
    from tokenizers import Tokenizer
    tok, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_on_data(spark):
    got = sorted(map(tuple, QUERIES["op2_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == by_hand(sorted((r.doc_id, r.text) for r in sample(spark).collect()))


def test_token_files_messy_and_selective(spark):
    out = fresh_folder(spark, "t")
    write_token_files(messy(spark), out, WORDS, partitions=4)
    rows = sorted(((r[0], r[1]) for r in messy_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted((tuple(r) for r in token_index(spark, out).collect()), key=lambda r: r[1])
    assert got == by_hand(rows)
    some = read_documents(spark, out, ["id", "n_tokens"], low=9, high=11)
    assert sorted(r.id for r in some.collect()) == [9, 10, 10, 11]
    plan = some._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema:")[1].split("\n")[0] and "GreaterThanOrEqual(id,9)" in plan
    none = fresh_folder(spark, "t")
    write_token_files(empty(spark), none, WORDS)
    assert token_index(spark, none).count() == 0


def test_token_files_layout(spark):
    """Ids are dictionary encoded, pages indexed, files in ascending order."""
    import glob
    import pyarrow.parquet as pq
    out = fresh_folder(spark, "t")
    write_token_files(sample(spark), out, WORDS, partitions=3)
    last = -1
    for path in sorted(glob.glob(f"{out.removeprefix('file:')}/part-*")):
        meta = pq.ParquetFile(path).metadata
        col = next(c for g in range(meta.num_row_groups) for c in [meta.row_group(g).column(3)])
        assert "DICTIONARY" in "".join(col.encodings) and meta.row_group(0).column(0).has_column_index
        ids = pq.read_table(path, columns=["id"]).column(0).to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]


def labels_dir(spark, tmp, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string").write.parquet(
        f"{tmp}/benchmark.parquet")
    return str(tmp)


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stage_messy_and_empty(spark, tmp_path, step):
    sf = labels_dir(spark, tmp_path, [(12, 1, 1), (1, 1, 0)])
    name, stage = corpus_pipeline.STAGES[step]
    docs = messy(spark)
    out = stage(spark, docs, sf)
    rows = out.collect()
    if step < 4:
        assert out.dtypes == docs.dtypes
    want = {"toxicity": len(messy_rows()) - 1, "minhash_near_dedup": len(messy_rows()) - 5,
            "substring_dedup": len(messy_rows()), "benchmark_decontamination": len(messy_rows()) - 5, "sentencepiece": len(messy_rows())}
    assert len(rows) == want[name]
    if name == "toxicity":
        assert TOXIC not in {r.text for r in rows}
    if name == "minhash_near_dedup":
        assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15]
    assert stage(spark, empty(spark), sf).count() == 0


def test_pipeline_on_data(spark):
    """run() equals the stages applied by hand, in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        cols = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        n.append(docs.count())
        assert name == "sentencepiece" or docs.columns == cols
    assert n == sorted(n, reverse=True) and n[1] < n[0] and n[2] < n[1] and n[3] == n[2] and n[4] <= n[3] and n[5] == n[4]
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.ids) for r in docs.collect())
