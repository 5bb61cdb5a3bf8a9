"""Packing and SentencePiece against the libraries themselves."""

import hashlib
import struct
import zlib

import public_tokenizers as public
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers

from boxloom.llm import packing, pieces, queries

ODD = [None, "", " ", "  a  b ", "▁x▁▁y", "a<|endoftext|>b", "x" * 5000, " " * 300 + "z", "é\n\n\t☃𝒳 ퟿", "I'll 123 don'T", "a\u0000b", "</s> <s> <unk>", "ﬁ①½", "tail ", "\r\n a"]


@pytest.fixture(scope="module")
def byte_bpe():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def expect_pieces(rows, texts, tok, window=2048):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    fill = {}
    for d, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            at += r["length"]
        assert at == len(ids)
    for s, spans in fill.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or s == max(fill) and at <= window
    assert sorted(fill) == list(range(len(fill)))


def test_packing_of_a_table(spark, tiny, byte_bpe):
    texts = dict(zip(*(pq.read_table(f"{tiny}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    expect_pieces(queries.op1_packing(spark, tiny).collect(), texts, byte_bpe)


def test_packing_of_odd_rows(spark, byte_bpe):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, part int, ids string").repartition(4)
    expect_pieces(queries.pack_digest(packing.pack(docs, window=64)).collect(), dict(enumerate(ODD)), byte_bpe, 64)
    assert not packing.pack(docs.where("false")).collect()
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(twice).collect()) == 8


def test_sequences_hold_the_stream(spark, byte_bpe):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").repartition(3)
    seqs = packing.sequences(packing.pack(docs, window=50)).orderBy("sequence_id").collect()
    assert [r["length"] for r in seqs[:-1]] == [50] * (len(seqs) - 1)
    stream = b"".join(bytes(r["ids"]) for r in seqs)
    assert sorted(struct.unpack(f"<{len(stream) // 4}I", stream)) == sorted(i for t in ODD for i in [*byte_bpe.encode(t or "", add_special_tokens=False).ids, 1])


def test_sentencepiece_equals_the_library(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))

    def expected(text):
        ids = sp.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    table = pq.read_table(f"{small}/documents.parquet")
    texts = dict(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
    got = queries.op10_sentencepiece(spark, small).collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == expected(texts[r["doc_id"]]) for r in got)
    odd = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    for r in pieces.decode(pieces.encode(odd)).collect():
        assert r["ids"] == sp.encode(ODD[r["doc_id"]] or "", add_eos=True)
        assert r["text"] == sp.decode(r["ids"])
    assert not pieces.encode(odd.where("false")).collect()


def test_a_full_table_is_segmented_again(monkeypatch):
    sp = pieces.processor(public.path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "TABLE", 3)
    table = pieces.ChunkTable(sp)
    for texts in (["one two three four"], ["one five", ""], ["six seven eight nine two"]):
        ids, sizes = table.encode(texts)
        assert ids.tolist() == [i for t in texts for i in sp.encode(t)] and sizes.tolist() == [len(sp.encode(t)) for t in texts]
