from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speakable.llm.decontam import contaminated, without_contaminated

ITEM = "When Anna sells 12 apples to Robert and keeps 5 apples, how many apples had Anna before noon today?"
OTHER = "A train of 300 meters crosses the long wooden bridge in 20 seconds while the driver whistles a tune."
FILL = "unrelated words stand here before anything else happens in this plain story of ours"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, n_windows int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short"), (6, "what weighs a stone here")], "item_id long, text string")


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_hits_and_slots(spark, bench, broadcast_rows):
    same = ITEM.replace("Anna", "Maria").replace("Robert", "Tom").replace("12", "7").replace("5 ", "3 ")
    mixed = ITEM.replace("had Anna", "had Robert")
    texts = [
        f"{FILL}. {ITEM} {FILL}", f"{FILL}. {same}", ITEM.upper(), OTHER.replace("meters", "feet").replace("300", "1,250.5"),
        FILL, None, "", "what weighs a stone here", "too short", f"{FILL} what weighs a stone here {FILL}", mixed, "word " * 50_000 + ITEM,
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs_of(spark, texts), bench, broadcast_rows=broadcast_rows).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 2), (7, 6), (9, 6), (10, 1), (11, 1)}
    assert got[0, 1].n_reworded == 0 and got[0, 1].n_matched == got[0, 1].n_windows
    assert got[1, 1].n_reworded > 3 and got[1, 1].n_matched == got[1, 1].n_windows
    assert got[3, 2].n_reworded > 0 and got[3, 2].n_matched == got[3, 2].n_windows
    assert got[10, 1].n_matched <= got[10, 1].n_windows


def test_inconsistent_slots_do_not_count(spark):
    item = "so Anna gave Bob more coins than Anna gave Bob stamps or stones"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    good = item.replace("Anna", "Eve").replace("Bob", "Joe")
    bad = "so Eve gave Joe more coins than Joe gave Eve stamps or stones"
    out = {r.doc_id: r for r in contaminated(docs_of(spark, [good, bad]), bench).collect()}
    assert out[0].n_matched == out[0].n_windows and (1 not in out or out[1].n_matched < out[1].n_windows)


def test_clean_documents_stay(spark, bench):
    docs = docs_of(spark, [ITEM, FILL, None, FILL, ITEM]).unionAll(spark.createDataFrame([(None, ITEM, "x", 3), (None, FILL, "x", 3), (1, ITEM, "x", 3)], "a long, b string, c string, d int"))
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", FILL), ("2", None), ("3", FILL), ("None", FILL)], key=lambda x: (x[0], str(x[1])))
    assert without_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert contaminated(docs.filter(F.lit(False)), bench).count() == 0
