from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from speakable.llm import queries
from speakable.llm.token_store import encoder, open_segment, read_documents, read_store, with_crc, write_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab é'sdt1,.\x00\n\t  　\x1c\x85中<|>"), max_size=40))
def test_words_encode_as_the_whole_text(text):
    code = encoder(PATH)
    assert code([text])[0].tolist() == ids_of(text)


def test_special_string_is_encoded_as_the_library_does():
    code = encoder(PATH)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z"):
        assert code([text])[0].tolist() == ids_of(text)


def expected(rows, end):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*ids_of(text), end], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.op5_token_store(spark, sf).orderBy("doc_id").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == expected(rows, 2)


def test_odd_rows(spark, tmp_path):
    rows = [(5, "five words are in here"), (None, "no id"), (1, None), (2, ""), (7, "long " * 60_000), (3, "same"), (4, "same"), (9_007_199_254_740_993, " x ")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, payload string")
    write_store(docs, f"{tmp_path}/s", PATH, 2)
    got = [tuple(r) for r in with_crc(read_store(spark, f"{tmp_path}/s")).orderBy("start").collect()]
    assert got == expected(rows, 2)
    few = read_documents(spark, f"{tmp_path}/s", [3, 1, 999])
    assert few[3][0].tolist() == [*ids_of("same"), 2] and few[1][0].tolist() == [2] and few[999] == []
    twice = spark.createDataFrame([(1, "b c"), (1, "a"), (1, "a"), (0, "z")], "doc_id long, text string")
    write_store(twice, f"{tmp_path}/t", PATH, 2)
    back = read_store(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in back] == [0, 1, 1, 1] and [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back[:-1])]).tolist()
    write_store(docs.limit(0), f"{tmp_path}/e", PATH, 2)
    assert read_store(spark, f"{tmp_path}/e").count() == 0


def test_segment_refuses_another_dictionary(spark, tmp_path):
    write_store(spark.createDataFrame([(1, "text")], "doc_id long, text string"), f"{tmp_path}/s", PATH, 2)
    payload = bytes(spark.read.parquet(f"{tmp_path}/s/segments").first().payload)
    with pytest.raises(ValueError, match="another dictionary"):
        open_segment(payload, b"0" * 16)


def test_dictionary_helps_short_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("n_chars < 500")
    sizes = []
    for blocks in (4000, 0):
        path = f"{tmp_path}/{blocks}"
        write_store(docs, path, PATH, 2, sample_blocks=blocks)
        sizes.append(sum(len(r.payload) for r in spark.read.parquet(f"{path}/segments").collect()))
    assert sizes[0] < 0.9 * sizes[1]
