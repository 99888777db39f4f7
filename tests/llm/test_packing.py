from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from speakable.llm import queries
from speakable.llm.packing import Packer, packed, sequences, word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("abT éEÀß's1,.²\xad\xb5ªǅ\x00\x01\n\t\x1c\x85  　́ΣŉİK中<|>_"), max_size=40))
def test_words_encode_as_the_whole_text(text):
    assert [*word_encoder(PATH)([text])[0].tolist(), 1] == ids_of(text)


def test_special_strings_are_encoded_as_the_library_does():
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>Y  z's", "A<b|c> IT'S i'LL"):
        assert [*word_encoder(PATH)([text])[0].tolist(), 1] == ids_of(text)


def check(rows, want, window=2048):
    """Pieces cover every document once, sequences have no gaps, and what is left of them is a power of two."""
    pieces, filled, counts = defaultdict(list), defaultdict(list), defaultdict(int)
    for doc, start, length, crc, n, sequence, offset in rows:
        pieces[doc, n].append((start, length, crc))
        filled[sequence].append((offset, length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0
    for doc, ids in want:
        counts[doc, len(ids)] += 1
    assert {k: sum(length for _, length, _ in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in counts.items()}
    once = {doc: ids for doc, ids in want if counts[doc, len(ids)] == 1 and sum(d == doc for d, _ in want) == 1}
    for (doc, _), v in pieces.items():
        if doc in once:
            at = 0
            for start, length, crc in sorted(v):
                assert start == at and crc == zlib.crc32(np.array(once[doc][start : start + length], "<u4").tobytes())
                at += length


def test_query_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_packing(spark, sf)
    assert got.columns == COLUMNS
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [tuple(r) for r in got.collect()]
    check(rows, [(r.doc_id, ids_of(r.text)) for r in docs])
    cut = len(rows) - len({(r[0], r[4]) for r in rows})
    whole = sum(len(ids_of(r.text)) // 2048 for r in docs)
    # Closing an open window cuts one document at most.
    assert cut <= whole + len({r[5] for r in rows})


def test_odd_rows_and_whole_sequences(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (7, "long " * 30_000), (3, "same"), (3, "same"), (3, "other text"), (9_007_199_254_740_993, " X ")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, start string").repartition(3)
    found = packed(docs, PATH, 1)
    check([tuple(r) for r in found.drop("ids").collect()], [(i, ids_of(t)) for i, t in rows])
    assert packed(docs.limit(0), PATH, 1).collect() == []
    ids = {(r.doc_id, r.start, r.doc_tokens): np.frombuffer(r.ids, "<u4").tolist() for r in found.collect()}
    assert ids[2, 0, 1] == [1] and ids[1, 0, 1] == [1] and None in {k[0] for k in ids}
    short = spark.createDataFrame([(1, 0, 3, bytearray(np.array([5, 6, 7], "<u4").tobytes()), 0, 0)], "doc_id long, start long, length long, ids binary, sequence_id long, offset long")
    row = sequences(short, 9, 8).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [5, 6, 7, 9, 9, 9, 9, 9]
    for r in sequences(found, 0).collect():
        assert len(r.ids) == 4 * r.length


def plain_level(levels, size, window):
    """Sum of squares after each possible placement, the fullest level among the best."""
    best = None
    for h in [h for h in range(window - size + 1) if h == 0 or levels[h]]:
        after = levels.copy()
        after[h] -= h > 0
        if h + size < window:
            after[h + size] += 1
        total = sum(int(x) ** 2 for x in after)
        if best is None or total <= best[0]:
            best = (total, h)
    return best[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([3, 1000]))
def test_rule_and_cover_on_random_sizes(sizes, most_open):
    packer, window, rows = Packer(16, most_open), 16, []
    for k, size in enumerate(sizes):
        rest = size % window
        if rest:
            assert packer.best_level(rest) == plain_level(packer.levels, rest, window)
        packer.add(k, np.arange(size, dtype="<u4"))
        assert packer.n_open <= most_open and packer.n_open == packer.levels.sum()
    packer.finish()
    for s, pieces in enumerate(packer.full):
        at = 0
        for doc, start, ids, n in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, s, at))
            at += len(ids)
    check(rows, [(k, list(range(n))) for k, n in enumerate(sizes)], window)


def test_few_documents_are_cut_where_there_are_many():
    rng = np.random.default_rng(7)
    packer = Packer(64)
    for k, n in enumerate(rng.integers(1, 45, 20_000)):
        packer.add(k, np.zeros(n, "<u2"))
    packer.finish()
    assert sum(map(len, packer.full)) - 20_000 < 200
