from __future__ import annotations

import hashlib
import zlib

import pytest

from speakable.llm import merkle, queries


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return plain_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """All levels from the leaves to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([plain_hash(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append((level[run:at], level[at + 1 : run + 8]))
        at //= 8
    return out


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((mine, plain_tree([plain_leaf(r) for r in mine])))
    top = plain_tree([levels[-1][0] for _, levels in trees])
    out = []
    for k, (mine, levels) in enumerate(trees):
        for i, r in enumerate(mine):
            path = plain_siblings(levels, i) + plain_siblings(top, k)
            claimed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                claimed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            fold = plain_leaf(claimed)
            for left, right in path:
                fold = plain_hash(*left, fold, *right)
            proof = plain_hash(*(x for left, right in path for x in (*left, *right)))
            root = top[-1][0]
            out.append((r[0], plain_leaf(r), levels[-1][0], root, proof, fold, fold == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_equals_plain_trees(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_merkle(spark, sf)
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in got.collect()]
    assert order(got) == order(plain(rows))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 9, 600])
def test_trees_of_several_tiers(spark, n):
    """Blocks of one level, so that a few hundred rows have several tiers."""
    rows = [(i * 7 % n, "S", f"l{i % 11}" if i % 2 else "hot", i, f"Text {i} A") for i in range(n)]
    got = [tuple(r) for r in merkle.document_manifest(spark.createDataFrame(rows, SCHEMA), deep=1).collect()]
    assert order(got) == order(plain(rows))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", None, 1, "X"), (1, "", "", 0, ""), (2, None, "en", None, None), (3, "s", "é", 5, "ÄBC z"), (3, "s", "é", 5, "ÄBC z"), (3, "s", "é", 5, "other"), (5, "s", "en", 1, "LONG " * 200_000), (4, "1", "2:ab", 3, "-")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", leaf string, n string")
    got = [tuple(r) for r in merkle.document_manifest(docs).collect()]
    assert order(got) == order(plain(rows))
    empty = merkle.document_manifest(docs.limit(0))
    assert empty.columns == COLUMNS and empty.collect() == []


def test_a_fold_resumes_the_state_of_its_slot():
    children = [plain_hash(str(i)) for i in range(8)]
    parent = merkle.Parent(children)
    assert parent.digest == plain_hash(*children)
    for slot in range(8):
        assert parent.fold(slot, "new") == plain_hash(*children[:slot], "new", *children[slot + 1 :])
    assert merkle.height(1) == 0 and merkle.height(8) == 1 and merkle.height(9) == 2
