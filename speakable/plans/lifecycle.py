"""Queries over feedback, model versions, privacy and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import squash
from ..operators import feedback as B
from ..operators import privacy as P
from ..operators import quality as Q
from ..operators import score as C
from ..operators import versions as V
from ..operators.prefix import scratch_dir
from ..sources import files
from ..streaming import jobs as ST
from .inputs import scored, table
from .jobs import _DECIDED, _job_stream, _joined, _stored
from .registry import query


def _folder(spark, what):
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query(
    "op_feedback_harvest",
    f"""WITH {_DECIDED}, r AS (SELECT sha256(c.text) AS input_sha256, d.segment_id, c.text AS written, d.normalized AS spoken, d.confidence,
          CASE WHEN c.turn % 5 = 4 THEN c.text || ' (checked)' END AS correction, d.disagree, d.flagged, length(c.text) % 13 = 0 AS failed
          FROM decided d JOIN conversations c ON d.segment_id = c.conv_id || '-' || c.turn),
        k AS (SELECT * FROM r WHERE (correction IS NOT NULL OR disagree OR flagged OR failed)
          AND input_sha256 NOT IN (SELECT sha256(text) FROM conversations WHERE conv_id % 10 = 0)),
        w AS (SELECT *, row_number() OVER (PARTITION BY input_sha256 ORDER BY segment_id) AS nr, concat_ws(',',
          CASE WHEN bool_or(correction IS NOT NULL) OVER p THEN 'correction' END, CASE WHEN bool_or(disagree) OVER p THEN 'disagreement' END,
          CASE WHEN bool_or(flagged) OVER p THEN 'low_confidence' END, CASE WHEN bool_or(failed) OVER p THEN 'qa_failure' END) AS reasons
          FROM k WINDOW p AS (PARTITION BY input_sha256))
        SELECT input_sha256, segment_id, written, spoken, confidence, correction, reasons, 'v2' AS model FROM w WHERE nr = 1""",
)
def feedback_store(spark, sf):
    """Harvest, leave out known pairs, append a part, then everything, then everything again, and read the store."""
    talk = table(spark, sf, "conversations").withColumn("segment_id", F.concat_ws("-", "conv_id", "turn"))
    checks = talk.select("segment_id", (F.length("text") % 13 != 0).alias("passed"))
    corrected = talk.filter(F.col("turn") % 5 == 4).select("segment_id", F.concat("text", F.lit(" (checked)")).alias("correction"))
    found = B.harvest(Q.decide_normalization(_joined(spark, sf)), "v2", "2024-02-01 00:00:00", checks, corrected)
    found = B.without_known(found, talk.filter(F.col("conv_id") % 10 == 0), "text")
    store = _folder(spark, "feedback")
    for batch in (found.filter("input_sha256 < '8'"), found, found):
        B.append_feedback(batch, store)
    rows = B.read_feedback(spark, store)
    return rows.select("input_sha256", "segment_id", "written", "spoken", "confidence", "correction", F.array_join("reasons", ",").alias("reasons"), "model")


# Three versions of the length rule; the last one does not answer the rows of one class.
_LIMITS = [("v1", 900), ("v2", 700), ("v3", 500)]
_ANSWERS = """answers AS (SELECT v AS version, doc_id AS pair_id, lang AS slice, quality = (n_chars > t)::INT AS correct,
    CASE WHEN toxic = 1 THEN ['MONEY', 'PLAIN'] WHEN n_chars % 5 = 0 THEN ['PLAIN'] WHEN n_chars % 2 = 0 THEN ['CARDINAL'] ELSE ['ABBREV'] END AS classes
    FROM labels JOIN documents USING (doc_id), (VALUES ('v1', 900), ('v2', 700), ('v3', 500)) l(v, t) WHERE NOT (v = 'v3' AND toxic = 1)),
  flat AS (SELECT version, version[2:]::BIGINT AS nr, slice, pair_id, correct, unnest(classes) AS cls FROM answers)"""


def _answers(spark, sf):
    rows = scored(spark, sf)
    limits = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(t).alias("limit")) for v, t in _LIMITS))
    rows = rows.withColumn("l", F.explode(limits)).select("*", "l.*").drop("l")
    said = F.concat(F.lit("quality "), (F.col("before").cast("bigint") > F.col("limit")).cast("int").cast("string"))
    rows = rows.withColumn("correct", squash(F.col("after")) == said)
    return rows.filter(~((F.col("version") == "v3") & F.array_contains("classes", "MONEY"))).select("version", "pair_id", "slice", "classes", "correct")


@query(
    "op_golden_regression",
    f"""WITH {_ANSWERS}, moved AS (SELECT a.version, a.cls, count(*) FILTER (b.correct AND NOT a.correct) AS n_lost, count(*) FILTER (NOT b.correct AND a.correct) AS n_won
          FROM flat a JOIN flat b ON a.nr = b.nr + 1 AND a.pair_id = b.pair_id AND a.cls = b.cls GROUP BY ALL),
        per AS (SELECT version, nr, cls, count(*) AS n, round_even(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy FROM flat GROUP BY ALL),
        grid AS (SELECT version, nr, cls FROM per UNION SELECT 'v' || (nr + 1), nr + 1, cls FROM per WHERE nr < 3)
        SELECT g.version, g.cls, coalesce(p.n, 0) AS n, coalesce(o.n, 0) AS n_before, coalesce(n_lost, 0) AS n_lost, coalesce(n_won, 0) AS n_won,
          p.accuracy, o.accuracy AS accuracy_before, round_even(p.accuracy - o.accuracy, 4) AS delta,
          CASE WHEN g.nr = 1 THEN 'first' WHEN p.n IS NULL THEN 'missing' WHEN o.n IS NULL THEN 'new'
               WHEN round_even(p.accuracy - o.accuracy, 4) < 0 THEN 'regressed' ELSE 'held' END AS status
        FROM grid g LEFT JOIN per p USING (version, cls) LEFT JOIN per o ON o.nr = g.nr - 1 AND o.cls = g.cls LEFT JOIN moved m ON m.version = g.version AND m.cls = g.cls""",
)
def golden(spark, sf):
    return V.golden_regression(_answers(spark, sf))


@query(
    "op_promotion_gate",
    f"""WITH {_ANSWERS}, per AS (SELECT version, slice, cls, round_even(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy FROM flat GROUP BY ALL),
        long AS (SELECT version, slice, 'sentence_accuracy' AS metric, round_even(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS value FROM answers GROUP BY ALL
          UNION ALL SELECT version, slice, 'macro_class_accuracy', round_even(sum(accuracy) / count(*), 4) FROM per GROUP BY ALL
          UNION ALL SELECT version, slice, 'class:' || cls, accuracy FROM per),
        pairs AS (SELECT * FROM (VALUES ('v1', 'v1'), ('v2', 'v1'), ('v3', 'v2')) p(candidate, incumbent)),
        new AS (SELECT candidate AS version, slice, metric, value FROM pairs JOIN long ON candidate = version),
        old AS (SELECT candidate AS version, slice, metric, value FROM pairs JOIN long ON incumbent = version),
        checks AS (SELECT version, slice, metric, CASE WHEN n.value IS NULL THEN 'missing' WHEN metric LIKE 'class:%' THEN NULL WHEN o.value IS NULL THEN 'no incumbent value'
            WHEN metric = 'sentence_accuracy' AND n.value = o.value THEN 'tie' WHEN metric = 'sentence_accuracy' AND n.value < o.value THEN 'below incumbent'
            WHEN metric = 'macro_class_accuracy' AND n.value < o.value THEN 'macro fell' END AS reason
          FROM new n FULL JOIN old o USING (version, slice, metric))
        SELECT version, count(*) AS n_checks, count(reason) AS n_failed,
          coalesce(string_agg(slice || ': ' || metric || ' ' || reason, '; ' ORDER BY slice || ': ' || metric || ' ' || reason) FILTER (reason IS NOT NULL), '') AS reasons,
          count(reason) = 0 AS promoted FROM checks GROUP BY version""",
)
def gate(spark, sf):
    """Each version against the one before it, the first against itself, per language."""
    rows = _answers(spark, sf)
    long = V.metric_rows(C.score(rows, "version", "slice"), C.class_scores(rows, "version", "slice"), "version", "slice")
    before = F.when(F.col("version") == "v1", F.array(F.lit("v1"), F.lit("v2"))).when(F.col("version") == "v2", F.array(F.lit("v3")))
    old = long.withColumn("version", F.explode(before))
    return V.promotion_gate(V.gate_checks(long, old, "version", "slice"), "slice", "version")


@query(
    "op_confidence_histogram",
    """WITH c AS (SELECT role, conv_id % 2 AS side, CASE WHEN conv_id % 2 = 0 THEN (length(text) % 100)::DOUBLE / 100 ELSE (length(text) % 100)::DOUBLE / 125 END AS v FROM conversations),
        b AS (SELECT role, side, least(19, floor(v * 20))::BIGINT AS bin, count(*) AS n FROM c GROUP BY ALL),
        g AS (SELECT role, e AS bin, coalesce(sum(n) FILTER (side = 0), 0) AS n0, coalesce(sum(n) FILTER (side = 1), 0) AS n1,
            coalesce(sum(n) FILTER (side = 0 AND b.bin <= e), 0) AS c0, coalesce(sum(n) FILTER (side = 1 AND b.bin <= e), 0) AS c1 FROM b, range(20) r(e) GROUP BY role, e),
        d AS (SELECT *, CASE WHEN n0 > 0 AND n1 > 0 THEN round_even(c1::DOUBLE / n1 - c0::DOUBLE / n0, 4) END AS gap FROM g)
        SELECT role, n0::BIGINT AS n_base, n1::BIGINT AS n_recent, gap, CASE WHEN gap IS NOT NULL THEN (bin + 1)::DOUBLE / 20 END AS edge, coalesce(gap >= 0.1, FALSE) AS left_shift
        FROM d QUALIFY row_number() OVER (PARTITION BY role ORDER BY abs(gap) DESC NULLS LAST, bin) = 1""",
)
def confidence_shift(spark, sf):
    """Confidences by text length; those of odd conversations are lower by a fifth."""
    talk = table(spark, sf, "conversations")
    share = F.length("text") % 100
    even = F.col("conv_id") % 2 == 0
    rows = talk.select("role", even.alias("even"), F.when(even, share / 100.0).otherwise(share / 125.0).alias("confidence"))
    base, recent = (V.histogram(rows.filter(c), "confidence", "role") for c in ("even", "NOT even"))
    return V.histogram_shift(base, recent, "role")


@query(
    "stream_confidence_histogram",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, least(19, floor(((props->>'k')::BIGINT % 100)::DOUBLE / 100 * 20))::BIGINT AS bin, count(*) AS n
       FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
)
def confidence_stream(spark, sf):
    log = _job_stream(spark, sf, F.get_json_object("props", "$.k").cast("bigint") % 100 / 100.0)
    return _stored(spark, ST.confidence_windows(log)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "bin", "n")


# Customers as texts: a third holds a number and an address, a third is a number, a third has neither.
_PHONE = "'555-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')"
_MAIL = "'user' || c_custkey || '@host.example'"
_NOTES = f"""notes AS (SELECT c_custkey AS id, {_PHONE} AS phone, {_MAIL} AS mail, CASE c_custkey % 3
    WHEN 0 THEN 'Please call ' || phone || ' in the morning or write a long letter to ' || mail || ' about the late order ' || id || ' today.'
    WHEN 1 THEN 'Tel ' || phone ELSE 'Order ' || id || ' ships on time.' END AS text FROM customer)"""


def _notes(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    phone = F.concat(F.lit("555-"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0"))
    mail = F.concat(F.lit("user"), key.cast("string"), F.lit("@host.example"))
    both = F.concat(
        F.lit("Please call "), phone, F.lit(" in the morning or write a long letter to "), mail, F.lit(" about the late order "), key.cast("string"), F.lit(" today.")
    )
    text = F.when(key % 3 == 0, both).when(key % 3 == 1, F.concat(F.lit("Tel "), phone)).otherwise(F.concat(F.lit("Order "), key.cast("string"), F.lit(" ships on time.")))
    return c.select(key.alias("id"), text.alias("text"), F.lit("narration").alias("kind"))


@query(
    "op_redact_pii",
    f"""WITH {_NOTES}, r AS (SELECT id, text, replace(replace(text, phone, '[PHONE]'), mail, '[LINK]') AS redacted,
          CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_sensitive,
          CASE id % 3 WHEN 0 THEN 12 + length(mail) WHEN 1 THEN 12 ELSE 0 END AS covered, 'rder ' || id AS what FROM notes)
        SELECT id, CASE WHEN covered::DOUBLE / length(text) >= 0.5 THEN 'skippable' ELSE 'narration' END AS kind, redacted, n_sensitive,
          round_even(covered::DOUBLE / length(text), 4) AS sensitive_share,
          CASE WHEN id % 3 = 1 THEN '' ELSE (strpos(text, what) + 4) || '-' || (strpos(text, what) + 4 + length(id::VARCHAR)) || ':'
            || (strpos(redacted, what) + 4) || '-' || (strpos(redacted, what) + 4 + length(id::VARCHAR)) END AS rest FROM r""",
)
def redact(spark, sf):
    rows = P.redacted(_notes(spark, sf))
    places = F.transform("rest", lambda s: F.format_string("%d-%d:%d-%d", s["start"], s["stop"], s["new_start"], s["new_stop"]))
    return rows.select("id", "kind", "redacted", "n_sensitive", "sensitive_share", F.array_join(places, ",").alias("rest"))


@query(
    "op_log_without_text",
    f"""WITH {_NOTES}, s AS (SELECT id, 'TELEPHONE' AS cls, strpos(text, phone) - 1 AS start, start + 12 AS stop FROM notes WHERE id % 3 < 2
          UNION ALL SELECT id, 'ELECTRONIC', strpos(text, mail) - 1 AS start, start + length(mail) FROM notes WHERE id % 3 = 0
          UNION ALL SELECT id, 'CARDINAL', strpos(text, 'rder ' || id) + 4 AS start, start + length(id::VARCHAR) FROM notes WHERE id % 3 <> 1)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS span_no, start, stop, cls, cls <> 'CARDINAL' AS sensitive FROM s""",
)
def text_free_log(spark, sf):
    return P.span_log(_notes(spark, sf), "id")


@query(
    "op_input_fingerprint",
    "SELECT doc_id, strlen(text) + 1 AS length, sha256(text || chr(10)) AS input_sha256 FROM documents",
)
def fingerprints(spark, sf):
    """Write each document as a file and hash the files."""
    folder = _folder(spark, "inputs")
    files.write_files(table(spark, sf, "documents"), folder, ".txt", F.col("doc_id"), F.lit(0), F.col("text"))
    found = files.file_fingerprints(spark, folder)
    return found.select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), "length", "input_sha256")


_LANES = " || ',' || ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR" for i in range(4))


@query(
    "op_rows_fingerprint",
    f"""WITH h AS (SELECT lang, sha256(length(doc_id::VARCHAR) || ':' || doc_id || length(n_chars::VARCHAR) || ':' || n_chars || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(text) || ':' || text, '-')) AS d FROM documents)
        SELECT lang, count(*) AS n_rows, sha256(count(*) || ',' || {_LANES}) AS input_sha256 FROM h GROUP BY lang""",
)
def rows_fingerprint(spark, sf):
    return files.rows_fingerprint(table(spark, sf, "documents"), "lang")


@query(
    "sort_preferred_classes",
    f"""WITH {_ANSWERS}, per AS (SELECT version, slice, cls, round_even(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy FROM flat WHERE NOT (version = 'v2' AND slice = 'de') GROUP BY ALL)
        SELECT version, slice, cls, accuracy FROM per WHERE slice = CASE WHEN version = 'v2' THEN 'en' ELSE 'de' END ORDER BY accuracy, cls""",
)
def report_classes(spark, sf):
    """The report's class table: of the hard slice where a version has it, else of the test slice; one version lacks the former."""
    rows = _answers(spark, sf).filter("NOT (version = 'v2' AND slice = 'de')")
    per = C.class_scores(rows, "version", "slice")
    return C.worst_classes(C.preferred(per, "slice", ["de", "en"], "version")).select("version", "slice", "cls", "accuracy")


@query(
    "win_unrecoverable_examples",
    f"""WITH {_ANSWERS} SELECT version, slice, pair_id FROM answers WHERE NOT correct AND (list_contains(classes, 'MONEY') OR list_contains(classes, 'CARDINAL'))
        QUALIFY row_number() OVER (PARTITION BY version, slice ORDER BY pair_id) <= 12""",
)
def unrecoverable_examples(spark, sf):
    return C.unrecoverable_examples(_answers(spark, sf), 12, ["version", "slice"]).select("version", "slice", "pair_id")
