"""Files in and out, and streams against batch."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from conftest import ARTICLE, BOOK
from speakable.operators import monitor as M
from speakable.operators import pairs as P
from speakable.operators import segments as O
from speakable.operators import timeline as T
from speakable.plans.inputs import LINE, jobs
from speakable.functions.scanning import normalize
from speakable.operators import blocks as B
from speakable.sources import readers as R
from speakable.sources.files import OneFileWriter, file_fingerprints, read_files, rows_fingerprint, write_files
from speakable.sources import sinks as S
from speakable.streaming import jobs as ST


def test_read_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "book.txt").write_text(BOOK, encoding="utf-8")
    (tmp_path / "sub" / "art.MD").write_text(ARTICLE, encoding="utf-8")
    (tmp_path / "raw.dat").write_bytes("café one\n\ntwo".encode("latin-1"))
    (tmp_path / "page.html").write_text("<h1>T</h1><p>x</p>", encoding="utf-8")
    (tmp_path / "bom.text").write_bytes(b"\xef\xbb\xbfhi")
    got = {r.title: r for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert got["book"].text == BOOK and got["book"].source_format == "txt"
    assert got["art"].source_format == "md" and got["art"].blocks[0].is_heading
    assert got["raw"].source_format == "txt" and [b.text for b in got["raw"].blocks] == ["café one", "two"]
    assert [b.is_heading for b in got["page"].blocks] == [True, False]
    assert got["bom"].text == "﻿hi"
    docs = R.read_documents(spark, str(tmp_path))
    assert O.segments(docs, F.col("blocks"), "title").filter("title = 'book'").count() == 7


def test_jsonl_is_strict_and_log_is_lenient(spark, tmp_path):
    good = '{"before":"a","after":"b","classes":["X"],"hard":true}'
    (tmp_path / "p.jsonl").write_text(f"{good}\n\n{good}\n")
    assert R.read_jsonl(spark, str(tmp_path / "p.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text(f"{good}\n{{oops\n")
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "jobs.jsonl").write_text('{"status":"completed","n_segments":3}\n{broken\n\n{"status":"failed"}\n')
    assert R.read_log(spark, str(tmp_path / "jobs.jsonl")).count() == 2
    assert R.read_log(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_streams_over_folder_tables_equal_single_files(spark, tmp_path, small):
    """A table that is a folder of part files gives the rows of the single file."""
    from speakable.plans import jobs

    for name in ("events", "documents"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (jobs.stream_windows, jobs.stream_dedup, jobs.stream_alerts, jobs.stream_normalize):
        one, parts = query(spark, small), query(spark, str(tmp_path))
        # Means may differ in their last digit, as rows are added in another order.
        plain = [c for c, kind in one.dtypes if kind != "double"]
        one, parts = one.select(plain), parts.select(plain)
        assert one.count() > 0 and one.exceptAll(parts).isEmpty() and parts.exceptAll(one).isEmpty()


def test_blank_lines_with_tabs_are_skipped(spark, tmp_path):
    good = '{"before":"a","after":"b","classes":["X"],"hard":true}'
    (tmp_path / "t.jsonl").write_text(f"{good}\n \t\n{good}\n")
    assert R.read_jsonl(spark, str(tmp_path / "t.jsonl")).count() == 2


def test_splits_cache(spark, tmp_path):
    path, built = str(tmp_path / "c"), []
    schema = "before string, after string, classes array<string>, hard boolean, pair_id long, split string"

    def build():
        built.append(1)
        ids = spark.range(900)
        return P.build_splits(P.generate_pairs(ids, 300), P.generate_pairs(ids, 60, hard_only=True), 150, 60)

    sizes = {"n_val": 60, "n_test": 90, "n_hard": 60}
    first = S.cached_splits(spark, path, build, schema, 150, 42, **sizes).count()
    again = S.cached_splits(spark, path, build, schema, 150, 42, **{**sizes, "n_val": 1}).count()
    assert first == again and len(built) == 1
    S.cached_splits(spark, path, build, schema, 151, 42, **sizes)
    assert len(built) == 2


def test_reports_logs_and_manifests(spark, tmp_path):
    for k, ts in enumerate(["2024-01-01 00:00:00", "2024-01-02 00:00:00"]):
        S.write_report(spark.createDataFrame([(k,)], "n int"), str(tmp_path / "r"), "eval", ts)
    reports = spark.read.schema("ts timestamp, payload string, kind string").json(str(tmp_path / "r"))
    assert M.latest_reports(reports, ["eval", "tune"], ["ts"]).filter("kind = 'eval'").first()["payload"] == '{"n":1}'
    S.append_job_log(jobs(spark, "/root/testdata/sf0.001"), str(tmp_path / "log"))
    S.append_job_log(jobs(spark, "/root/testdata/sf0.001"), str(tmp_path / "log"))
    log = R.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 2 * jobs(spark, "/root/testdata/sf0.001").count()
    made = spark.createDataFrame([(1, "x"), (2, None)], "d int, s string")
    parts = spark.createDataFrame([(1, k, f'"{k}\n') for k in range(30)], "d int, k int, t string")
    for _ in range(2):  # a second run replaces the first
        S.write_manifests(made, parts, str(tmp_path / "m"), "d", ["k"])
    found = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "m").glob("part-*/*.json")}
    assert found["1"] == {"d": 1, "s": "x", "segments": [{"k": k, "t": f'"{k}\n'} for k in range(30)]}
    assert found["2"] == {"d": 2, "s": None, "segments": []} and len(found) == 2
    assert sum(1 for p in (tmp_path / "m").rglob("*.json")) == 2


def test_subtitle_files(spark, tmp_path):
    rows = [(d, 0, k, "narration", f"s{k}", 100) for d in (1, 2) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id int, chapter_index int, seg_order int, kind string, text string, duration_ms long")
    S.write_subtitles(T.cues(T.timeline(df)), str(tmp_path / "s"))
    for doc in (1, 2):
        (file,) = (tmp_path / "s").glob(f"part-*/{doc}.srt")
        text = file.read_text()
        assert text.startswith("1\n00:00:00,000 --> 00:00:00,100\ns0\n\n2\n") and text.count("-->") == 5
        assert [line for line in text.splitlines() if line.isdigit()] == ["1", "2", "3", "4", "5"]
    books = spark.createDataFrame([(1, "One", "A"), (2, "Two", None), (3, "No chapters", "B")], "doc_id int, title string, author string")
    spans = T.join_chapter_title(T.chapter_spans(T.timeline(df)), spark.createDataFrame([], "doc_id int, chapter_index int, title string"))
    S.write_chapter_metadata(books, T.chapter_markers(spans), str(tmp_path / "c"))
    files = {p.stem: p.read_text().splitlines() for p in (tmp_path / "c").glob("part-*/*.ffmeta")}
    assert files["1"] == [";FFMETADATA1", "title=One", "artist=A", "album=One", "[CHAPTER]", "TIMEBASE=1/1000", "START=0", "END=1500", "title=Chapter 1"]
    assert files["3"][0] == ";FFMETADATA1" and len(files["3"]) == 4 and len(files) == 3


def test_one_file_per_name(spark, tmp_path):
    """Odd names, many rows of one name, an abandoned job folder."""
    rows = [("a/b c", 1, "x"), ("a/b c", 0, "w"), (None, 0, "n"), ("", 0, "e"), ("_x.y", 0, "u"), ("5%25+1", 0, "p"), ("é", 0, ""), *(("big", k, str(k)) for k in range(5000))]
    df = spark.createDataFrame(rows, "name string, k int, t string").repartition(7)
    path = str(tmp_path / "f")
    write_files(df, path, ".txt", F.col("name"), F.col("k"), F.col("t"))
    got = {(r.name, r.content.decode()) for r in read_files(spark, path).collect()}
    assert got == {("a/b c", "w\nx\n"), (None, "n\n"), ("", "e\n"), ("_x.y", "u\n"), ("5%25+1", "p\n"), ("é", "\n"), ("big", "".join(f"{k}\n" for k in range(5000)))}
    assert not [p for p in (tmp_path / "f").iterdir() if p.name.startswith(".")]
    with pytest.raises(Exception):
        write_files(df.withColumn("t", F.expr("raise_error('stop')")), path, ".txt", F.col("name"), F.col("k"), F.col("t"))
    assert {(r.name, r.content.decode()) for r in read_files(spark, path).collect()} == got
    writer = OneFileWriter(path, ".txt", False)
    writer.abort([])
    writer.commit([None])
    assert read_files(spark, path).count() == 7


def test_lenient_lines_and_counts(spark, tmp_path):
    good = '{"before":"a","after":"b","classes":["X"],"hard":true}'
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.jsonl").write_text(f"{good}\n\n{{oops\n{good}\n[1]\n")
    (tmp_path / "p" / "two.jsonl").write_text(f"{good}\n")
    rows = R.read_jsonl_lenient(spark, str(tmp_path / "p"))
    assert sorted(r.corrupt for r in rows.filter("corrupt IS NOT NULL").collect()) == ["[1]", "{oops"]
    assert {r.file.rsplit("/", 1)[1]: (r.n_rows, r.n_corrupt) for r in R.file_counts(rows).collect()} == {"one.jsonl": (2, 2), "two.jsonl": (1, 0)}


def test_containers_have_a_format_and_no_text(spark, tmp_path):
    (tmp_path / "b.EPUB").write_bytes(b"PK\x03\x04\xff")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.title: r for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert {k: (r.source_format, r.text, r.blocks) for k, r in got.items()} == {"b": ("epub", None, []), "c": ("pdf", None, [])}


def test_fingerprints_do_not_depend_on_order_or_files(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(50)
    one = rows_fingerprint(docs).first()
    again = docs.orderBy(F.rand(3)).repartition(9).select(*reversed(docs.columns))
    again.write.parquet(str(tmp_path / "d"))
    assert rows_fingerprint(spark.read.parquet(str(tmp_path / "d"))).first() == one and one.n_rows == 50
    assert rows_fingerprint(docs.unionAll(docs.limit(1))).first().input_sha256 != one.input_sha256
    assert rows_fingerprint(docs.withColumn("n_chars", F.col("n_chars") + 1)).first().input_sha256 != one.input_sha256
    (tmp_path / "x.bin").write_bytes(b"\x00\xffbytes")
    assert file_fingerprints(spark, str(tmp_path / "x.bin")).first().input_sha256 == hashlib.sha256(b"\x00\xffbytes").hexdigest()


def _stream_copy(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_normalize_equals_batch(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60)
    stream = _stream_copy(spark, docs, tmp_path / "in")
    ST.store_stream(ST.normalize_documents(stream, sep=LINE), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = O.segments(spark.read.parquet(str(tmp_path / "in")), B.pasted_blocks(F.col("text"), LINE), "doc_id")
    assert got == {tuple(r) for r in batch.withColumn("normalized", normalize(F.col("text"))).collect()}


def test_stream_windows_and_late_rows(spark, tmp_path):
    base = "2024-01-0{} {}:00:00"
    days = [(base.format(d, h), "completed", 10, d) for d in (1, 2, 3) for h in ("01", "05")]
    schema = "ts string, status string, n_segments long, n_flagged long"
    folder = str(tmp_path / "in")

    def feed(rows):
        df = spark.createDataFrame(rows, schema).select(
            F.to_timestamp("ts").alias("ts"), F.lit("job").alias("event"), F.lit("f").alias("filename"), "status", "n_segments", "n_flagged",
            F.expr("named_struct('rtf', 1.0D, 'audio_qa', named_struct('pass', 1L, 'fail', 0L, 'resynth_attempts', 0L))").alias("metrics"),
        )
        df.coalesce(1).write.mode("append").parquet(folder)
        return df.schema

    kind = feed(days)
    windows = lambda: ST.job_windows(spark.readStream.schema(kind).parquet(folder))
    args = (str(tmp_path / "store"), str(tmp_path / "alerts"), str(tmp_path / "cp"))
    ST.alert_stream(windows(), *args).awaitTermination()
    # The state is one row per batch, whatever was stored before.
    assert all(spark.read.parquet(str(p)).count() <= 1 for p in (tmp_path / "store" / "last").glob("batch=*"))
    feed([("2024-01-01 02:00:00", "completed", 10, 9), ("2024-01-05 00:00:00", "completed", 10, 9)])
    ST.alert_stream(windows(), *args).awaitTermination()
    rows = spark.read.parquet(args[1]).orderBy("window_start").collect()
    assert [(str(r.window_start)[:10], r.n, r.delta_flag_rate, r.alert) for r in rows] == [
        ("2024-01-01", 2, None, False), ("2024-01-02", 2, 0.1, False), ("2024-01-03", 2, 0.1, False),
    ]


def test_stream_dedup(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "filename string, s int").select(
        "filename", F.timestamp_seconds("s").alias("ts")
    )
    stream = _stream_copy(spark, df, tmp_path / "in")
    ST.store_stream(ST.dedup_jobs(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_no_scratch_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from speakable.operators import prefix

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: "file:/tmp/warehouse" if "warehouse" in key else None)

    with pytest.raises(ValueError, match="checkpoint"):
        prefix.scratch_dir(Session())


def test_small_files_are_few_tasks_and_one_write(spark, tmp_path, monkeypatch):
    """Names have suffixes of their own in one write; a scan has no more tasks than a shuffle."""
    from speakable.plans import text
    from speakable.sources.readers import read_documents

    path, parts = str(tmp_path / "kinds"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 40 * (parts + 2)
    docs = spark.range(n).select(F.col("id").alias("name"), F.when(F.col("id") % 2 == 0, ".md").otherwise(".txt").alias("kind"))
    write_files(docs, path, F.col("kind"), F.col("name"), F.lit(0), F.col("name").cast("string"))
    found = read_files(spark, path)
    assert sorted((int(r.name), r.suffix, bytes(r.content).decode()) for r in found.collect()) == [(i, ".md" if i % 2 == 0 else ".txt", f"{i}\n") for i in range(n)]
    for df in (found, file_fingerprints(spark, path), read_documents(spark, path)):
        assert df.rdd.getNumPartitions() <= parts
    writes = []
    monkeypatch.setattr(text, "write_files", lambda *a: (writes.append(a), write_files(*a)))
    assert text.read_files(spark, "/root/testdata/sf0.001").count() and len(writes) == 1
