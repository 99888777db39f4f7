from __future__ import annotations

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from speakable.llm.common import table
from speakable.llm.toxicity import toxicity_score, train_toxicity

from .test_jaccard import survivors
from .test_leaked import plain_leaks
from .test_line_dedup import plain as plain_lines

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    """Each stage against a plain version on its own input."""
    docs = table(spark, SF, "documents")
    (_, toxic), (_, lines), (_, near), (_, leaks), (_, pieces) = corpus_pipeline.STAGES
    rows = docs.collect()

    labels = table(spark, SF, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs.select("doc_id", "text"), labels)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity_score(model, F.col("text")).alias("s")).collect()}
    one = toxic(spark, docs, SF).cache()
    assert one.columns == docs.columns
    assert sorted(one.collect()) == sorted(r for r in rows if scores[r.doc_id] < 0.5)

    rows = one.collect()
    two = lines(spark, one, SF).cache()
    assert two.columns == docs.columns
    want = plain_lines([(r.doc_id, r.source, r.text) for r in rows], 0.05, 3)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in two.collect()) == sorted((i, t, len(t)) for i, _, _, t in want)

    rows = two.collect()
    three = near(spark, two, SF).cache()
    left = survivors([(r.doc_id, r.text) for r in rows])
    assert three.columns == docs.columns and sorted(three.collect()) == sorted(r for r in rows if r.doc_id in left)

    rows = three.collect()
    bad = plain_leaks([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    four = leaks(spark, three, SF).cache()
    assert four.columns == docs.columns and sorted(four.collect()) == sorted(r for r in rows if r.doc_id not in bad)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in four.collect()}
    five = pieces(spark, four, SF).collect()
    assert {r.doc_id for r in five} == set(texts)
    assert all(r.decoded == texts[r.doc_id] and list(r.piece_ids) == library.encode(texts[r.doc_id]) for r in five)
    assert sorted(five) == sorted(corpus_pipeline.run(spark, SF).collect())


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(i in kept for i, t in toxic.items() if t == 0) > 0.97 * sum(t == 0 for t in toxic.values())
    assert sum(i not in kept for i, t in toxic.items() if t == 1) > 0.5 * sum(t == 1 for t in toxic.values())


def test_odd_documents_pass(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "plain text of a page\nwith lines", "en", "s", 32), (3, "plain text of a page\nwith lines", "en", "s", 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert sorted((r.doc_id, r.decoded) for r in now.collect()) == ([] if empty else [(1, ""), (3, rows[3][1])])
