"""Segmentation and chapters against small sequential models."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from conftest import ARTICLE, BOOK
from speakable.functions import segmenting as G
from speakable.operators import blocks as B
from speakable.operators import segments as O
from speakable.plans import load_all
from speakable.plans import sql as q
from speakable.plans.registry import ORACLES, QUERIES

ABBR = re.compile(
    r"\b(Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|Inc|Ltd|Corp|Dept|No|Vol|Ch|Fig|Ave|Blvd|Rd|Mt|e\.g|i\.e)\.\Z", re.I
)


def packed(items, limit):
    """Greedy: each item joins the open pack if it fits."""
    packs = []
    for item in items:
        if packs and len(packs[-1]) + 1 + len(item) <= limit:
            packs[-1] = f"{packs[-1]} {item}"
        else:
            packs.append(item)
    return packs


def model_sentences(text):
    out, rest = [], False
    for piece in re.split(r"""(?<=[.!?])["')\]]?\s+(?=[A-Z"'(\[])""", text.strip()):
        if not piece:
            continue
        if rest:
            out[-1] += " " + piece
        else:
            out.append(piece)
        rest = bool(ABBR.search(piece))
    return out


def model_long(sentence, limit):
    clauses = packed(re.split(r"(?<=[,;:])\s+", sentence), limit)
    return [c[k : k + limit] for c in clauses for k in range(0, len(c), limit)]


def model_chunks(text, limit, small):
    groups, run = [], []
    for s in model_sentences(text):
        if len(s) > limit:
            groups += packed(run, limit) + model_long(s, limit)
            run = []
        else:
            run.append(s)
    groups += packed(run, limit)
    out = []
    for g in groups:
        if out and len(g) < small:
            out[-1] = f"{out[-1]} {g}".strip()
        else:
            out.append(g)
    return out


def random_text(rng):
    words = ["He", "went", "Dr.", "etc.", "home.", "Yes!", '"No."', "(ok).", "a,", "b;", "c:", "so", "é", "xxxxxxxxxxxxxxxxxxxxx",
             "End.\n", "Mr.", "I", "said.", "'Well'", "long-word,", "…", "no.", "St."]
    return rng.choice(["", " "]) + rng.choice([" ", " ", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))


def test_random_texts_match_models(spark):
    rng = random.Random(11)
    texts = sorted({random_text(rng) for _ in range(800)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    rows = df.select(
        "text", G.sentences(F.col("text")).alias("s"), G.chunks(F.col("text"), 60, 10).alias("c"),
        G.split_long(F.col("text"), 25).alias("l"),
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.s) == model_sentences(r.text), r.text
        assert list(r.c) == model_chunks(r.text, 60, 10), r.text
        if r.text.strip() == r.text and r.text:
            assert list(r.l) == model_long(r.text, 25), r.text


def model_speech(text, limit):
    text = " ".join(text.split())
    if len(text) <= limit:
        return [text] if text else []
    groups, run = [], []
    for s in (m.strip() for m in re.findall(r"[^.!?]*[.!?]+|\S[^.!?]*$", text)):
        if len(s) > limit:
            groups += packed(run, limit) + packed(s.split(), limit)
            run = []
        elif s:
            run.append(s)
    return groups + packed(run, limit)


def test_speech_chunks_match_model(spark):
    rng = random.Random(3)
    texts = sorted({random_text(rng) for _ in range(500)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for r in df.select("text", G.speech_chunks(F.col("text"), 30).alias("c")).collect():
        assert list(r.c) == model_speech(r.text, 30), r.text


def test_chunks_keep_size_and_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("text", G.chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert all(len(c) <= 480 + 41 for c in r.c)
        bare = [re.sub(r"[\s\"')\]]", "", x) for x in (r.text, "".join(r.c))]
        assert bare[0] == bare[1]


def test_kinds(spark):
    cases = [
        ("", "skippable"), (" Page 12 ", "skippable"), ("37", "skippable"), ("Table of Contents", "skippable"),
        ("copyright 2020 by", "skippable"), ("The Visitor", "heading"), ("The Clockmaker's Ledger", "narration"),
        ("USA", "heading"), ("12 A", "heading"), ("Part of it", "heading"), ("Party time", "narration"),
        ('"Go," he said. "Now."', "dialogue"), ('"Go away', "narration"), ("“Go away”", "dialogue"), ("It ended.", "narration"),
    ]
    df = spark.createDataFrame(cases, "t string, k string").withColumn("got", G.classify(F.col("t")))
    assert [(r.t, r.got) for r in df.collect()] == cases


def model_book(blocks):
    """Blocks are (possible start, number of segments): chapter and order of each segment."""
    out, chapter, order = [], 0, 0
    for start, n in blocks:
        if start and order:
            chapter, order = chapter + 1, 0
        out += [(chapter, order + k) for k in range(n)]
        order += n
    return out


def test_chapters_match_model_for_any_bucket(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for doc in range(60):
        blocks = [(rng.random() < 0.4, rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randint(1, 25))]
        rows += [(doc, p, s, n) for p, (s, n) in enumerate(blocks)]
        expected[doc] = model_book(blocks)
    df = spark.createDataFrame(rows, "doc int, pos int, start boolean, n int")
    for bucket in (1, 3, 7, 100_000):
        got = {}
        placed = O.assign_chapters(df, "doc", "pos", "n", "start", bucket)
        for r in placed.orderBy("doc", "pos").collect():
            got.setdefault(r.doc, []).extend((r.chapter_index, r.first_order + k) for k in range(r.n))
        assert got == expected


def test_sample_book(spark):
    df = spark.createDataFrame([(1, BOOK)], "doc_id int, text string")
    segs = O.segments(df, B.text_blocks(F.col("text")), "doc_id").collect()
    assert [(s.chapter_index, s.seg_order, s.kind) for s in segs] == [
        (0, 0, "narration"), (1, 0, "heading"), (1, 1, "narration"), (1, 2, "narration"),
        (2, 0, "heading"), (2, 1, "narration"), (2, 2, "narration"),
    ]
    titles = [c.title for c in O.chapters(df, B.text_blocks(F.col("text")), "doc_id").collect()]
    assert titles == ["Chapter 1", "Chapter 1: The Ferry", "Chapter 2: The Guest"]


def test_both_routes_agree(spark):
    df = spark.createDataFrame([(1, BOOK), (2, ARTICLE), (3, " \n ")], "doc_id int, text string")
    blocks = B.markdown_blocks(F.col("text"))
    inside = {tuple(r) for r in O.segments(df, blocks, "doc_id").collect()}
    rows = B.explode_blocks(df, blocks, "doc_id")
    for bucket in (2, 100_000):
        assert {tuple(r) for r in O.segments_of_rows(rows, bucket_rows=bucket).collect()} == inside
    inside_titles = {tuple(r) for r in O.chapters(df, blocks, "doc_id").collect()} - {(3, 0, "Chapter 1", 0)}
    assert {tuple(r) for r in O.chapters_of_rows(rows).collect()} == inside_titles


def test_segments_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, BOOK)], "doc_id int, text string")
    plan = O.segments(df, B.text_blocks(F.col("text")), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pasted_and_markdown(spark):
    df = spark.createDataFrame([(" \n ",), ("# A\n\n**b** c",), ("# A\nb",)], "t string")
    got = [[(b.text, b.is_heading) for b in r[0]] for r in df.select(B.markdown_blocks(F.col("t"))).collect()]
    assert got == [[], [("A", True), ("b c", False)], [(" A\nb", False)]]
    assert [len(r[0]) for r in df.select(B.pasted_blocks(F.col("t"))).collect()] == [1, 2, 1]


def test_html(spark):
    page = (
        "<!-- <p>no</p> --><h1>A &amp; <b>B</b></h1><script>var t='<p>no</p>'</script>"
        "<blockquote>q <p>in &eacute;&#233;&#x41;&bogus;</p> t</blockquote><P class=x>open<p>two<br>x<div>no</div><pre>no</pre>"
    )
    df = spark.createDataFrame([(page,)], "h string")
    got = [(b.text, b.is_heading) for b in df.select(B.html_blocks(F.col("h"))).first()[0]]
    assert got == [("A & B", True), ("q in ééA&bogus; t", False), ("in ééA&bogus;", False), ("open", False), ("two x", False)]


def test_long_character_references(spark):
    df = spark.createDataFrame([("&#00000065;&#x000000042;&#99999999999;&#0;",)], "h string")
    assert df.select(B.unescape(F.col("h"))).first()[0] == "AB\ufffd\ufffd"


def test_layout_upper_median(spark):
    lines = [(1, k, "line", s) for k, s in enumerate([10.0, 10.0, 12.0, 12.0])] + [(1, 9, "x", 99.0), (2, 0, "Big", 20.0)]
    df = spark.createDataFrame(lines + [(1, 10, "Head", 15.0)], "doc_id int, line_pos int, text string, size double")
    got = {(r.doc_id, r.line_pos): r.is_heading for r in B.layout_blocks(df).collect()}
    assert (1, 9) not in got and got[(1, 10)] and not got[(1, 3)] and not got[(2, 0)]


def test_sql_of_sentences_and_chunks_matches_models():
    """Abbreviations in a row: the word edge of the second is the mark behind the first."""
    rng = random.Random(13)
    texts = ["By st. St. He went. Mr. Dr. Vol. Fig. Low. End.", *sorted({random_text(rng) for _ in range(400)})]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?)", [(t,) for t in texts])
    for text, said, cut in con.sql(f"SELECT text, {q.sentences('text')}, {q.chunks('text', 60, 10)} FROM d").fetchall():
        assert said == model_sentences(text), text
        assert cut == model_chunks(text, 60, 10), text


def test_sql_of_segments_matches_query(spark, tmp_path):
    text = " ".join(["By st. St. He went home and saw that all of it was well, more or less."] * 30)
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    load_all()
    got = sorted(tuple(r) for r in QUERIES["op_segments"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLES["op_segments"]).fetchall()) and len(got) > 4
