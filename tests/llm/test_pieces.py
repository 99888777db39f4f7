from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from speakable.llm import queries
from speakable.llm.pieces import MARK, UNIGRAM, Pieces, coded_documents, decode_pieces, encode_pieces, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
LETTERS = st.text(st.sampled_from("abcdehinorstu éßñ中\n\t .,1🙂▁TH"), max_size=40)


@settings(max_examples=600, deadline=None)
@given(LETTERS)
def test_ids_equal_the_library(text):
    got = pieces(PATH).encode([text])[0].tolist()
    assert got == LIBRARY.encode(text)
    assert got == pieces(PATH).path(pieces(PATH).normalised(text))


def retyped(kind, **normal):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = kind
    for p in proto.pieces:
        if p.score < -1e8:
            p.score = -50_000.0
    for k, v in normal.items():
        setattr(proto.normalizer_spec, k, v)
    return proto.SerializeToString()


UNI = retyped(UNIGRAM)
UNI_OWN, UNI_LIBRARY = Pieces(UNI), sentencepiece.SentencePieceProcessor(model_proto=UNI)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcdehinorstu .,T"), max_size=25))
def test_unigram_path_costs_what_the_library_finds(text):
    """The same vocabulary read as a unigram model: paths of equal cost may differ in their ids."""
    cost = lambda ids: sum(UNI_OWN.scores[i] for i in ids)
    assert cost(UNI_OWN.encode([text])[0].tolist()) == pytest.approx(cost(UNI_LIBRARY.encode(text)), abs=0.5)


def test_extra_blanks_are_removed_where_the_model_says_so():
    model = retyped(2, remove_extra_whitespaces=True)
    own, library = Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in ("  a  b ", "", "   ", "x   y"):
        assert own.encode([text])[0].tolist() == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60).filter(lambda t: MARK not in t and not any("\ud800" <= c <= "\udfff" for c in t)))
def test_round_trip(text):
    own = pieces(PATH)
    assert own.decode(own.encode([text])[0]) == text


def test_character_maps_are_refused():
    with pytest.raises(ValueError, match="character map"):
        Pieces(retyped(2, precompiled_charsmap=b"x"))


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op10_pieces(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "")
        assert (got[d.doc_id].n_pieces, got[d.doc_id].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[d.doc_id].round_trip


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "  two  blanks  "), (6, "w" * 100_000), (7, "a b " * 50_000), (None, "a"), (8, "a"), (8, "a")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    out = docs.select("doc_id", "text", encode_pieces(F.col("text"), PATH).alias("got")).withColumn("back", decode_pieces(F.col("got"), PATH))
    for r in out.collect():
        assert r.back == (r.text or "") and list(r.got) == LIBRARY.encode(r.text or "")
    assert out.filter("false").count() == 0 and docs.limit(0).select(encode_pieces(F.col("text"), PATH)).count() == 0


def test_documents_are_coded_in_one_pass(spark):
    rows = [(1, "Hello there", None, "x"), (None, None, 2, "y"), (3, "", 3, "z"), (4, "long text " * 40_000, 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, decoded string")
    got = coded_documents(docs, PATH)
    assert got.columns == ["doc_id", "n_chars", "piece_ids", "n_pieces", "decoded"]
    want = [(i, n, LIBRARY.encode(t or ""), len(LIBRARY.encode(t or "")), " ".join((t or "").split())) for i, t, n, _ in rows]
    assert sorted((r.doc_id or 0, r.n_chars, r.piece_ids, r.n_pieces, " ".join(r.decoded.split())) for r in got.collect()) == sorted((i or 0, *x) for i, *x in want)
    assert coded_documents(docs.limit(0), PATH).collect() == []
