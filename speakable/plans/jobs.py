"""Queries over quality decisions, clips, timelines, job logs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from ..functions.scanning import normalize
from ..operators import clips as K
from ..operators import job as J
from ..operators import monitor as M
from ..operators import quality as Q
from ..operators import timeline as T
from ..operators.prefix import scratch_dir
from ..sources import readers, sinks
from ..sources.files import read_files
from ..streaming import jobs as ST
from . import sql as q
from .corpus import _SIZES, _SPLITS, _splits
from .inputs import LINE, clips, dealt, jobs, table, talk_segments
from .registry import query
from .text import _JOBS, segmented

_TALK = """talk AS (SELECT conv_id AS doc_id, turn // 3 AS chapter_index, turn % 3 AS seg_order, turn, text, role,
  CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'dialogue' ELSE 'narration' END AS kind,
  length(text) * 60 AS duration_ms FROM conversations)"""


@query(
    "op_route_voice",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'dialogue' ELSE 'narrator' END AS voice FROM conversations""",
)
def route_voice(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        Q.route_voice(F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "dialogue").otherwise("narration")).alias("voice"),
    )


@query(
    "agg_voice_counts",
    """WITH c AS (SELECT conv_id AS doc_id, CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'dialogue' ELSE 'narrator' END AS voice,
         count(*) AS n FROM conversations GROUP BY ALL)
       SELECT doc_id, CASE WHEN count(*) > 1 THEN 'multi' ELSE 'single' END AS branch,
         string_agg(voice || ':' || n, ', ' ORDER BY voice) AS detail FROM c GROUP BY doc_id""",
)
def voice_counts(spark, sf):
    return Q.voice_counts(talk_segments(spark, sf).withColumn("voice", Q.route_voice(F.col("kind"))))


@query(
    "op_retry_plan",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_linenumber - 1 WHEN 0 THEN 'reseed_jitter' WHEN 1 THEN 'split_and_pad'
       ELSE 'fallback_backend' END AS strategy FROM lineitem""",
)
def retry_plan(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", Q.retry_plan(F.col("l_linenumber") - 1).alias("strategy"))


# A model that answers for two turns of three, sure of itself by text length.
_MODEL = """m AS (SELECT conv_id AS doc_id, conv_id || '-' || turn AS segment_id, text AS baseline_text,
  CASE WHEN turn % 3 <> 2 THEN CASE WHEN turn % 2 = 0 THEN text ELSE text || ' indeed' END END AS model_text,
  CASE WHEN turn % 3 <> 2 THEN (length(text) % 100)::DOUBLE / 100 END AS model_confidence FROM conversations)"""
_DECIDED = f"""{_MODEL}, decided AS (SELECT doc_id, segment_id, model_text IS NULL AS none, coalesce(model_text, baseline_text) AS normalized,
  coalesce(model_confidence, 1.0) AS confidence, coalesce(model_confidence < 0.55, FALSE) AS flagged,
  CASE WHEN model_confidence < 0.55 THEN format('low confidence {{:.2f}}', model_confidence) ELSE '' END AS flag_reason,
  CASE WHEN model_text IS NULL THEN FALSE ELSE {q.squash('model_text')} <> {q.squash('baseline_text')} END AS disagree FROM m)"""


def _joined(spark, sf):
    c = table(spark, sf, "conversations")
    key = F.concat_ws("-", "conv_id", "turn").alias("segment_id")
    base = c.select(F.col("conv_id").alias("doc_id"), key, F.col("text").alias("baseline_text"))
    said = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" indeed")))
    model = c.filter(F.col("turn") % 3 != 2).select(
        key, said.alias("text"), (F.length("text") % 100 / 100.0).alias("confidence")
    )
    return Q.join_model_baseline(base, model)


@query("join_model_baseline", f"WITH {_MODEL} SELECT doc_id, segment_id, baseline_text, model_text, model_confidence FROM m")
def model_baseline(spark, sf):
    return _joined(spark, sf)


@query(
    "op_decide_normalization",
    f"""WITH {_DECIDED} SELECT segment_id, CASE WHEN none THEN 'rule' ELSE 'neural' END AS source, normalized, confidence, flagged,
        flagged AS escalate, flag_reason, disagree FROM decided""",
)
def decide(spark, sf):
    return Q.decide_normalization(_joined(spark, sf)).drop("doc_id", "baseline_text", "model_text", "model_confidence")


# An adviser that settles two of three unsure turns, and clips that fail by text length.
_SETTLED = f"""{_DECIDED}, settled AS (SELECT d.*, c.turn, d.flagged AND c.turn % 3 <> 0 AS escalated, length(c.text) % 11 = 0 AS failed
  FROM decided d JOIN conversations c ON d.segment_id = c.conv_id || '-' || c.turn)"""


def _advice(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("turn") % 3 != 0)
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("segment_id"), F.upper("text").alias("text"), F.lit("it reads better").alias("rationale"))


def _checks(spark, sf):
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("segment_id"), (F.length("text") % 11 != 0).alias("passed"))


def _settled(spark, sf):
    return J.escalate(Q.decide_normalization(_joined(spark, sf)), _advice(spark, sf))


@query(
    "op_escalate",
    f"""WITH {_SETTLED} SELECT segment_id, escalated, flagged AND NOT escalated AND NOT failed OR failed AS flagged, CASE WHEN escalated THEN 'llm' WHEN none THEN 'rule' ELSE 'neural' END AS source,
        trim(CASE WHEN escalated THEN 'llm: it reads better' ELSE flag_reason END || CASE WHEN failed THEN '; audio_qa_failed' ELSE '' END, '; ') AS flag_reason FROM settled""",
)
def escalated(spark, sf):
    """Decisions after the adviser and the clip checks."""
    rows = J.flag_failed_clips(_settled(spark, sf), _checks(spark, sf))
    return rows.select("segment_id", "escalated", "flagged", "source", "flag_reason")


@query(
    "agg_normalization_summary",
    f"""WITH {_SETTLED} SELECT doc_id, count(*) AS n, count(*) FILTER (flagged AND NOT escalated) AS n_flagged, count(*) FILTER (escalated) AS n_escalated,
        count(*) FILTER (disagree) AS n_disagree, round_even(avg(confidence), 4) AS mean_confidence,
        CASE WHEN n_escalated > 0 THEN 'escalated' WHEN n_flagged > 0 THEN 'flagged' ELSE 'confident' END AS branch FROM settled GROUP BY doc_id""",
)
def normalization_summary(spark, sf):
    return Q.normalization_summary(_settled(spark, sf))


@query(
    "agg_job_status",
    f"""WITH {_SETTLED}, f AS (SELECT doc_id, flagged AND NOT escalated OR failed AS bad FROM settled)
        SELECT d.doc_id, count(x.doc_id) AS n_segments, count(*) FILTER (bad) AS n_flagged,
        CASE WHEN count(x.doc_id) = 0 THEN 'failed' WHEN count(*) FILTER (bad) > 0 THEN 'needs_review' ELSE 'completed' END AS status,
        CASE WHEN count(x.doc_id) = 0 THEN 'failed' ELSE 'normalized' END AS text_status
        FROM documents d LEFT JOIN f x USING (doc_id) GROUP BY d.doc_id""",
)
def job_status(spark, sf):
    """With clips, where failed ones flag their segment, and as a job that ends with its texts."""
    docs, rows = table(spark, sf, "documents"), J.flag_failed_clips(_settled(spark, sf), _checks(spark, sf))
    text = Q.job_status(docs, rows, text_only=True).select("doc_id", F.col("status").alias("text_status"))
    return Q.job_status(docs, rows).join(text, "doc_id")


@query(
    "op_job",
    f"""WITH {_SETTLED}, s AS (SELECT t.*, c.text, CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'dialogue' ELSE 'narrator' END AS voice
          FROM settled t JOIN conversations c ON t.segment_id = c.conv_id || '-' || c.turn),
        j AS (SELECT doc_id, max(turn) // 3 + 1 AS n_chapters, count(*) AS n_segments, count(*) FILTER (flagged AND NOT escalated OR failed) AS n_flagged,
          count(*) FILTER (escalated) AS n_escalated, count(*) FILTER (NOT none AND turn % 2 = 1) AS n_disagree, round_even(sum(confidence::DECIMAL(20, 8))::DOUBLE / count(*), 4) AS mean_confidence,
          count(*) FILTER (NOT failed) AS n_pass, count(*) FILTER (failed) AS n_fail, count(*) FILTER (flagged AND NOT escalated) AS unsure,
          sum(length(text))::DOUBLE AS chars, sum(length(regexp_replace(text, '[^\\p{{L}}\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g')))::DOUBLE AS letters, bool_or(voice = 'heading') AS headed,
          concat_ws(', ', CASE WHEN count(*) FILTER (voice = 'dialogue') > 0 THEN 'dialogue:' || count(*) FILTER (voice = 'dialogue') END,
            CASE WHEN count(*) FILTER (voice = 'heading') > 0 THEN 'heading:' || count(*) FILTER (voice = 'heading') END,
            CASE WHEN count(*) FILTER (voice = 'narrator') > 0 THEN 'narrator:' || count(*) FILTER (voice = 'narrator') END) AS voices FROM s GROUP BY doc_id),
        p AS (SELECT *, CASE WHEN chars < 20 THEN 0.15::DOUBLE ELSE round_even(least(1.0::DOUBLE, 0.5::DOUBLE * (letters / chars) + 0.3::DOUBLE * CASE WHEN n_chapters > 1 OR headed THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END
          + 0.2::DOUBLE * CASE WHEN chars / n_segments BETWEEN 10 AND 2000 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 4) END AS parse_score FROM j)
        SELECT d.doc_id, coalesce(n_chapters, 0) AS n_chapters, coalesce(n_segments, 0) AS n_segments, coalesce(n_flagged, 0) AS n_flagged, coalesce(n_escalated, 0) AS n_escalated,
          coalesce(n_disagree, 0) AS n_disagree, mean_confidence, coalesce(n_pass, 0) AS n_pass, coalesce(n_fail, 0) AS n_fail, coalesce(parse_score, 0.0::DOUBLE) AS parse_score,
          CASE WHEN parse_score >= 0.85 THEN 'structured' WHEN parse_score >= 0.5 THEN 'assisted' ELSE 'degraded' END AS route,
          CASE WHEN n_escalated > 0 THEN 'escalated' WHEN unsure > 0 THEN 'flagged' ELSE 'confident' END AS normalization,
          CASE WHEN coalesce(n_fail, 0) = 0 THEN 'all_pass' ELSE 'some_failed' END AS clips, coalesce(voices, '') AS voices,
          CASE WHEN n_segments IS NULL THEN 'failed' WHEN n_flagged > 0 THEN 'needs_review' ELSE 'completed' END AS status
        FROM documents d LEFT JOIN p USING (doc_id)""",
)
def whole_job(spark, sf):
    """Documents whose segments are the turns of the conversation of their number, from text to state in one plan."""
    turn = F.col("chapter_index") * 3 + F.col("seg_order")
    segs = dealt(talk_segments(spark, sf)).withColumn("segment_id", F.concat_ws("-", "doc_id", turn.cast("string")))
    base = normalize(F.col("text"))
    said = F.when(turn % 2 == 0, base).otherwise(F.concat(base, F.lit(" indeed")))
    model = segs.filter(turn % 3 != 2).select("segment_id", said.alias("text"), (F.length("text") % 100 / 100.0).alias("confidence"))
    rows = J.job_rows(segs, model, _checks(spark, sf), _advice(spark, sf))
    return J.job_states(table(spark, sf, "documents"), rows)


# Embeddings as clips: 64 samples at 100 Hz, a text of 0 to 39 characters, the label as book.
_CLIPS = """clips AS (SELECT label::BIGINT AS doc_id, vec_id AS seg_id, vec_id % 40 AS chars, embedding::DOUBLE[] AS x FROM embeddings)"""
_QA = f"""{_CLIPS}, raw AS (SELECT *, 0.64 / greatest(chars * 0.06, 0.3) AS ratio, list_max(list_transform(x, lambda v: abs(v))) AS peak,
    sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS rms,
    len(list_filter(x, lambda v: abs(v) < power(10, -45.0 / 20)))::DOUBLE / 64 AS quiet FROM clips),
  qa AS (SELECT *, rms < 1e-5 AS empty, round_even(ratio, 3) AS duration_ratio, ratio BETWEEN 0.35 AND 3.0 AS duration_ok,
    round_even(20 * log10(peak + 1e-9), 2) AS peak_dbfs, peak >= power(10, -0.1 / 20) AS clipped,
    round_even(20 * log10(rms + 1e-9), 2) AS rms_dbfs, round_even(quiet, 3) AS silence_frac, quiet > 0.65 AS too_silent,
    NOT empty AND duration_ok AND NOT clipped AND NOT too_silent AS passed FROM raw)"""


@query(
    "op_clip_qa",
    f"""WITH {_QA} SELECT seg_id, 64::BIGINT AS n_samples, 0.64::DOUBLE AS duration, duration_ratio::DOUBLE AS duration_ratio, duration_ok, empty,
        peak_dbfs, clipped, rms_dbfs, silence_frac, too_silent, passed, CASE WHEN passed THEN 'accept' ELSE 'resynth' END AS action FROM qa""",
)
def clip_qa(spark, sf):
    return K.clip_qa(clips(spark, sf)).drop("doc_id", "sr", "text", "samples")


@query(
    "agg_clip_averages",
    f"""WITH {_QA} SELECT count(*) AS n_segments, round_even(count(*) FILTER (passed)::DOUBLE / count(*), 4) AS pass_rate,
        count(*) FILTER (NOT passed) AS n_fail, round_even(avg(duration_ratio::DOUBLE), 3) AS avg_duration_ratio, round_even(avg(peak_dbfs), 3) AS avg_peak_dbfs,
        round_even(avg(rms_dbfs), 3) AS avg_rms_dbfs, round_even(avg(silence_frac), 3) AS avg_silence_frac FROM qa""",
)
def clip_averages(spark, sf):
    return K.clip_report(K.clip_qa(clips(spark, sf)))


_TRIES = f"""{_QA}, tries AS (SELECT seg_id // 3 AS segment, seg_id % 3 AS attempt, passed, duration_ratio::DOUBLE AS dr, abs(duration_ratio::DOUBLE - 1) AS off FROM qa),
  wide AS (SELECT segment, bool_or(passed) FILTER (attempt = 0) AS p0, bool_or(passed) FILTER (attempt = 1) AS p1, bool_or(passed) FILTER (attempt = 2) AS p2,
    max(off) FILTER (attempt = 0) AS o0, max(off) FILTER (attempt = 1) AS o1, max(off) FILTER (attempt = 2) AS o2,
    max(dr) FILTER (attempt = 0) AS d0, max(dr) FILTER (attempt = 1) AS d1, max(dr) FILTER (attempt = 2) AS d2, count(*) AS k FROM tries GROUP BY segment),
  one AS (SELECT *, NOT p0 AND k > 1 AS tried1, tried1 AND (p1 OR o1 < o0) AS take1 FROM wide),
  two AS (SELECT *, CASE WHEN take1 THEN p1 ELSE p0 END AS pa, CASE WHEN take1 THEN o1 ELSE o0 END AS oa,
    NOT pa AND k > 2 AND NOT p0 AS tried2, tried2 AND (p2 OR o2 < oa) AS take2 FROM one),
  picked AS (SELECT segment, CASE WHEN take2 THEN 2 WHEN take1 THEN 1 ELSE 0 END::BIGINT AS attempt,
    CASE WHEN take2 THEN p2 ELSE pa END AS passed, CASE WHEN take2 THEN d2 WHEN take1 THEN d1 ELSE d0 END AS duration_ratio,
    (tried1::INT + tried2::INT)::BIGINT AS attempts FROM two)"""


def _picked(spark, sf):
    checked = K.clip_qa(clips(spark, sf))
    tries = checked.withColumn("segment", F.floor(F.col("seg_id") / 3)).withColumn("attempt", F.col("seg_id") % 3)
    return K.pick_attempt(tries, "segment")


@query("op_pick_retry", f"WITH {_TRIES} SELECT segment, attempt, passed, duration_ratio, attempts FROM picked")
def pick_retry(spark, sf):
    return _picked(spark, sf)


@query(
    "agg_clip_gate",
    f"""WITH {_TRIES} SELECT segment % 7 AS doc_id, count(*) FILTER (passed) AS n_pass, count(*) FILTER (NOT passed) AS n_fail,
        sum(attempts)::BIGINT AS resynth_attempts, CASE WHEN n_fail = 0 THEN 'all_pass' ELSE 'some_failed' END AS branch,
        round_even(n_pass::DOUBLE / greatest(1, n_pass + n_fail), 4) AS score FROM picked GROUP BY doc_id""",
)
def clip_gate(spark, sf):
    return Q.clip_gate(_picked(spark, sf).withColumn("doc_id", F.col("segment") % 7))


@query(
    "op_book_loudness",
    f"""WITH {_CLIPS}, sums AS (SELECT doc_id, sum(list_sum(list_transform(x, lambda v: v * v))) AS p, count(*) * (64 + 25) AS n,
          max(list_max(list_transform(x, lambda v: abs(v)))) AS peak FROM clips GROUP BY doc_id),
        g AS (SELECT doc_id, peak, power(10, -18.0 / 20) / sqrt(p / n) AS g0 FROM sums),
        gains AS (SELECT doc_id, CASE WHEN peak * g0 > power(10, -3.0 / 20) THEN power(10, -3.0 / 20) / peak ELSE g0 END AS gain FROM g)
        SELECT seg_id, round(gain, 6) AS gain, round(greatest(-1.0, least(1.0, x[1] * gain)), 4) AS first_sample,
          round(list_max(list_transform(x, lambda v: abs(greatest(-1.0, least(1.0, v * gain))))), 4) AS peak FROM clips JOIN gains USING (doc_id)""",
)
def book_loudness(spark, sf):
    louder = K.book_loudness(clips(spark, sf), silence=F.lit(25))
    return louder.select(
        "seg_id", F.round("gain", 6).alias("gain"),
        F.round(F.get("samples", F.lit(0)).cast("double"), 4).alias("first_sample"),
        F.round(K.peak(F.col("samples")), 4).alias("peak"),
    )


@query(
    "op_expected_duration",
    "SELECT doc_id, round(greatest(length(text) * 0.06::DOUBLE, 0.3::DOUBLE), 6) AS seconds FROM documents",
)
def expected_duration(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(K.expected_seconds(F.col("text")), 6).alias("seconds"))


@query(
    "agg_rtf",
    """SELECT event_id, CASE WHEN (props->>'k')::BIGINT % 5 > 0 THEN round_even(value / ((props->>'k')::BIGINT % 5 * 97), 4) END AS rtf FROM events""",
)
def rtf(spark, sf):
    seconds = F.get_json_object("props", "$.k").cast("bigint") % 5 * 97
    return table(spark, sf, "events").select("event_id", K.rtf(F.col("value"), seconds).alias("rtf"))


_TIMED = f"""{_TALK}, g AS (SELECT *, lead(seg_order) OVER (PARTITION BY doc_id, chapter_index ORDER BY seg_order) IS NULL AS last_seg,
    chapter_index = max(chapter_index) OVER (PARTITION BY doc_id) AS last_chapter FROM talk),
  timed AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY chapter_index) - 1 AS chapter_no,
    coalesce(sum(duration_ms + CASE WHEN NOT last_seg THEN CASE WHEN kind = 'heading' THEN 600 ELSE 250 END WHEN last_chapter THEN 0 ELSE 1200 END)
      OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms, start_ms + duration_ms AS end_ms FROM g)"""


def _timed(spark, sf):
    return T.timeline(talk_segments(spark, sf))


@query(
    "win_timeline",
    f"WITH {_TIMED} SELECT doc_id, chapter_index, seg_order, chapter_no, start_ms, end_ms FROM timed",
)
def timeline(spark, sf):
    return _timed(spark, sf).select("doc_id", "chapter_index", "seg_order", "chapter_no", "start_ms", "end_ms")


_SPANS = "(SELECT doc_id, chapter_index, min(chapter_no) AS chapter_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM timed GROUP BY doc_id, chapter_index)"


@query("win_chapter_spans", f"WITH {_TIMED} SELECT * FROM {_SPANS}")
def chapter_spans(spark, sf):
    return T.chapter_spans(_timed(spark, sf))


_TITLES = "(SELECT doc_id, chapter_index, left(text, 80) AS title FROM talk WHERE seg_order = 0 AND kind <> 'dialogue')"


def _titled(spark, sf):
    segs = talk_segments(spark, sf)
    titles = segs.filter((F.col("seg_order") == 0) & (F.col("kind") != "dialogue")).select(
        "doc_id", "chapter_index", F.substr("text", F.lit(1), F.lit(80)).alias("title")
    )
    return T.join_chapter_title(T.chapter_spans(_timed(spark, sf)), titles)


@query(
    "join_chapter_title",
    f"""WITH {_TIMED} SELECT doc_id, chapter_index, chapter_no, start_ms, end_ms, coalesce(title, 'Chapter ' || (chapter_index + 1)) AS title
        FROM {_SPANS} LEFT JOIN {_TITLES} USING (doc_id, chapter_index)""",
)
def chapter_title(spark, sf):
    return _titled(spark, sf)


_MARKERS = f"""SELECT doc_id, chapter_no, '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms
  || chr(10) || 'title=' || coalesce(title, 'Chapter ' || (chapter_index + 1)) AS marker FROM {_SPANS} LEFT JOIN {_TITLES} USING (doc_id, chapter_index)"""


@query(
    "sink_chapter_metadata",
    f"""WITH {_TIMED}, m AS ({_MARKERS}) SELECT doc_id, ';FFMETADATA1' || chr(10) || 'title=Talk ' || doc_id || chr(10) || 'artist=Various' || chr(10)
        || 'album=Talk ' || doc_id || chr(10) || string_agg(marker || chr(10), '' ORDER BY chapter_no) AS content FROM m GROUP BY doc_id""",
)
def chapter_metadata(spark, sf):
    """Write one marker file per document and read the files back."""
    books = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    books = books.select("doc_id", F.concat(F.lit("Talk "), F.col("doc_id").cast("string")).alias("title"), F.lit("Various").alias("author"))
    folder = _fresh(spark)
    sinks.write_chapter_metadata(books, T.chapter_markers(_titled(spark, sf)), folder)
    return _file_texts(spark, folder)


def _stamp(ms: str, sep: str) -> str:
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query("op_timestamp_text", f"SELECT event_id, {_stamp('(value * 100000)::BIGINT', ',')} AS srt, {_stamp('(value * 100000)::BIGINT', '.')} AS vtt FROM events")
def timestamp_text(spark, sf):
    ms = F.round(F.col("value") * 100_000).cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", T.timestamp_text(ms).alias("srt"), T.timestamp_text(ms, vtt=True).alias("vtt")
    )


_CUES = f"""cues AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS cue_no, {q.strip('text')} AS t, start_ms, end_ms
  FROM timed WHERE {q.strip('text')} <> '')"""


@query(
    "op_subtitles",
    f"""WITH {_TIMED}, {_CUES} SELECT doc_id, cue_no, cue_no || chr(10) || {_stamp('start_ms', ',')} || ' --> ' || {_stamp('end_ms', ',')}
        || chr(10) || t || chr(10) AS cue FROM cues""",
)
def subtitles(spark, sf):
    return T.cues(T.timeline(talk_segments(spark, sf), number_cues=True))


@query(
    "sink_subtitles",
    f"""WITH {_TIMED}, {_CUES} SELECT doc_id, string_agg(CASE WHEN cue_no = 1 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END
        || {_stamp('start_ms', '.')} || ' --> ' || {_stamp('end_ms', '.')} || chr(10) || t || chr(10) || chr(10), '' ORDER BY cue_no) AS content
        FROM cues GROUP BY doc_id""",
)
def subtitles_vtt(spark, sf):
    """Write one subtitle file per document and read the files back."""
    folder = _fresh(spark)
    sinks.write_subtitles(T.cues(T.timeline(talk_segments(spark, sf), number_cues=True), fmt="vtt"), folder, fmt="vtt")
    return _file_texts(spark, folder)


def _file_texts(spark, folder):
    """Document id and text of the files below a folder."""
    found = read_files(spark, folder)
    return found.select(F.col("name").cast("bigint").alias("doc_id"), F.decode("content", "UTF-8").alias("content"))


@query(
    "op_group_clips",
    f"""WITH {_TALK} SELECT doc_id, chapter_index, seg_order, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY seg_order) AS clip_no
        FROM talk WHERE role <> 'system'""",
)
def group_clips(spark, sf):
    segs = talk_segments(spark, sf).withColumn(
        "kind", F.when(F.col("kind") == "heading", "skippable").otherwise(F.col("kind"))
    )
    return T.group_clips(segs).select("doc_id", "chapter_index", "seg_order", "clip_no")


@query(
    "sink_manifest",
    f"""WITH {_DECIDED}, s AS (SELECT doc_id, flagged, split_part(segment_id, '-', 2)::BIGINT AS turn, '{{"segment_id":"' || segment_id || '","turn":'
          || split_part(segment_id, '-', 2) || ',"source":"' || CASE WHEN none THEN 'rule' ELSE 'neural' END || '","flagged":' || flagged || '}}' AS line FROM decided)
        SELECT doc_id, '{{"doc_id":' || doc_id || ',"n_segments":' || count(*) || ',"n_flagged":' || count(*) FILTER (flagged) || ',"status":"'
          || CASE WHEN count(*) FILTER (flagged) > 0 THEN 'needs_review' ELSE 'completed' END || '","segments":[' || chr(10)
          || string_agg(line, chr(10) || ',' ORDER BY turn) || chr(10) || ']}}' || chr(10) AS content FROM s GROUP BY doc_id""",
)
def manifests(spark, sf):
    """Write one nested manifest per document and read the files back."""
    decided = Q.decide_normalization(_joined(spark, sf))
    done = Q.job_status(decided.select("doc_id").distinct(), decided)
    segs = decided.select("doc_id", "segment_id", F.substring_index("segment_id", "-", -1).cast("bigint").alias("turn"), "source", "flagged")
    folder = _fresh(spark)
    sinks.write_manifests(done, segs, folder, "doc_id", ["turn"])
    return _file_texts(spark, folder)


@query("sink_job_log", f"SELECT ts, event, filename, status, n_segments, n_flagged, rtf FROM ({_JOBS})")
def job_log(spark, sf):
    """Append the log, read it back."""
    folder = _fresh(spark)
    sinks.append_job_log(jobs(spark, sf), folder)
    log = readers.read_log(spark, folder)
    return log.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event", "filename", "status", "n_segments", "n_flagged", F.col("metrics.rtf").alias("rtf"))


@query(
    "sink_report",
    """SELECT 'events' AS kind, TIMESTAMP '2024-02-01 00:00:00' AS ts, '{"event_type":"' || event_type || '","n":' || count(*) || '}' AS payload
       FROM events GROUP BY event_type""",
)
def report(spark, sf):
    """Append a report, read it back."""
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    folder = _fresh(spark)
    sinks.write_report(counts, folder, "events", "2024-02-01 00:00:00")
    rows = spark.read.schema("ts timestamp, payload string, kind string").json(folder)
    return rows.select("kind", F.col("ts").cast("timestamp_ntz").alias("ts"), "payload")


_MEASURES = f"""mj AS (SELECT *, n_flagged::DOUBLE / greatest(1, n_segments) AS flag_rate,
  CASE WHEN qa_pass + qa_fail > 0 THEN qa_fail::DOUBLE / (qa_pass + qa_fail) END AS qa_fail_rate FROM ({_JOBS}))"""


@query(
    "agg_window_stats",
    f"""WITH {_MEASURES}, c AS (SELECT date_trunc('day', ts) AS day, status, count(*) AS k FROM mj GROUP BY ALL),
        s AS (SELECT day, string_agg(status || '=' || k, ',' ORDER BY status) AS statuses FROM c GROUP BY day),
        w AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, round(avg(flag_rate), 4) AS flag_rate, round(coalesce(avg(qa_fail_rate), 0), 4) AS qa_fail_rate,
          round(avg(rtf), 4) AS mean_rtf, round(avg(n_segments), 1) AS mean_segments FROM mj GROUP BY 1)
        SELECT strftime(day, '%Y-%m-%d') AS day, n, statuses, flag_rate, qa_fail_rate, mean_rtf, mean_segments FROM w JOIN s USING (day)""",
)
def window_stats(spark, sf):
    measures = M.job_measures(jobs(spark, sf)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    entries = F.transform(
        F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return M.window_stats(measures, "day").withColumn("statuses", F.array_join(entries, ","))


_HALVES = f"""{_MEASURES}, r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS nr, count(*) OVER () AS total FROM mj),
  h AS (SELECT count(*) AS n_jobs, count(*) FILTER (nr <= total // 2) AS base_n, count(*) FILTER (nr > total // 2) AS recent_n,
    round(avg(flag_rate) FILTER (nr <= total // 2), 4) AS base_flag_rate, round(avg(flag_rate) FILTER (nr > total // 2), 4) AS recent_flag_rate,
    round(coalesce(avg(qa_fail_rate) FILTER (nr <= total // 2), 0), 4) AS base_qa_fail_rate, round(coalesce(avg(qa_fail_rate) FILTER (nr > total // 2), 0), 4) AS recent_qa_fail_rate,
    round(avg(rtf) FILTER (nr <= total // 2), 4) AS base_mean_rtf, round(avg(rtf) FILTER (nr > total // 2), 4) AS recent_mean_rtf FROM r)"""


@query(
    "win_drift_halves",
    f"""WITH {_HALVES} SELECT *, round(recent_flag_rate - base_flag_rate, 4) AS delta_flag_rate, round(recent_qa_fail_rate - base_qa_fail_rate, 4) AS delta_qa_fail_rate,
        round(recent_mean_rtf - base_mean_rtf, 4) AS delta_mean_rtf, delta_flag_rate > 0.1 OR delta_qa_fail_rate > 0.1 AS alert FROM h WHERE n_jobs >= 6""",
)
def drift(spark, sf):
    return M.drift(M.job_measures(jobs(spark, sf)), ["ts", "event_id"])


@query(
    "join_windows",
    f"WITH {_HALVES} SELECT round(recent_flag_rate - base_flag_rate, 4) AS delta_flag_rate, round(recent_mean_rtf - base_mean_rtf, 4) AS delta_mean_rtf FROM h",
)
def drift_deltas(spark, sf):
    return M.drift(M.job_measures(jobs(spark, sf)), ["ts", "event_id"]).select("delta_flag_rate", "delta_mean_rtf")


@query(
    "agg_latency",
    """SELECT count(*) AS n, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95,
       round(quantile_cont(value, 0.99), 2) AS p99, round(avg(value), 2) AS mean, round(1000 / greatest(0.01, avg(value)), 1) AS per_second FROM events""",
)
def latency(spark, sf):
    return M.latency(table(spark, sf, "events"), "value", "event_id")


@query(
    "op_sequence_confidence",
    """SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda v: -abs(v::DOUBLE))) / len(embedding)), 6) AS confidence FROM embeddings""",
)
def sequence_confidence(spark, sf):
    log_probs = F.concat(
        F.transform("embedding", lambda v: -F.abs(v.cast("double"))),
        F.array(F.lit(float("-inf")), F.lit(float("nan"))),
    )
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(Q.sequence_confidence(log_probs), 6).alias("confidence")
    )


@query(
    "hook_normalizer",
    "SELECT item_id AS segment_id, text || '!' AS text, round(1.0 / (1 + length(text) % 7), 4)::DOUBLE AS confidence FROM benchmark",
)
def model_hook(spark, sf):
    from ..operators.model import apply_model

    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("segment_id"), "text")
    return apply_model(rows, _shout)


def _shout(texts: list[str]) -> tuple[list[str], list[float]]:
    """A stand-in model: louder, and sure of itself by length."""
    return [t + "!" for t in texts], [round(1.0 / (1 + len(t) % 7), 4) for t in texts]


# Streams read the table's files to the end and append to the scratch folder.
def _stream(spark, sf, name):
    """A table as a stream: the folder of its part files, or the one file by name."""
    path, source = f"{sf}/{name}.parquet", spark.readStream.schema(table(spark, sf, name).schema)
    if readers.is_folder(spark, path):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _fresh(spark) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


def _job_stream(spark, sf, confidence=None):
    e = _stream(spark, sf, "events")
    more = [] if confidence is None else [confidence.alias("confidence")]
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("file"), F.col("user_id").cast("string")).alias("filename"),
        F.col("event_type").alias("status"),
        (k % 20).alias("n_segments"),
        (k % 7).alias("n_flagged"),
        F.struct(
            F.when(F.col("event_type") != "error", F.col("value")).alias("rtf"),
            F.struct((k % 5).alias("pass"), (F.col("event_id") % 3).alias("fail")).alias("audio_qa"),
        ).alias("metrics"),
        *more,
    )


def _stored(spark, df):
    folder = _fresh(spark)
    ST.store_stream(df, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_STATUS = ["click", "error", "purchase", "signup", "view"]
# A window is emitted once the watermark, one hour behind the newest record, has passed its end.
_DAYS = f"""{_MEASURES}, days AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (status = 'error') AS n_error,
    round(avg(flag_rate), 4) AS flag_rate, round(coalesce(avg(qa_fail_rate), 0), 4) AS qa_fail_rate, round(avg(rtf), 4) AS mean_rtf FROM mj GROUP BY 1
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))"""


def _windows(spark, sf):
    return ST.job_windows(_job_stream(spark, sf), statuses=_STATUS)


@query("stream_job_windows", f"WITH {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, n, n_error, flag_rate, qa_fail_rate, mean_rtf FROM days")
def stream_windows(spark, sf):
    return _stored(spark, _windows(spark, sf)).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "n_error", "flag_rate", "qa_fail_rate", "mean_rtf"
    )


@query("stream_dedup_jobs", "SELECT DISTINCT 'file' || user_id AS filename, ts FROM events")
def stream_dedup(spark, sf):
    twice = _job_stream(spark, sf).select("filename", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    kept = _stored(spark, ST.dedup_jobs(twice).select("filename", "ts"))
    return kept.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_drift_alert",
    f"""WITH {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, n, round(flag_rate - lag(flag_rate) OVER (ORDER BY day), 4) AS delta_flag_rate,
        round(qa_fail_rate - lag(qa_fail_rate) OVER (ORDER BY day), 4) AS delta_qa_fail_rate FROM days""",
)
def stream_alerts(spark, sf):
    folder = _fresh(spark)
    ST.alert_stream(_windows(spark, sf), f"{folder}/store", f"{folder}/alerts", f"{folder}/state").awaitTermination()
    alerts = spark.read.parquet(f"{folder}/alerts")
    return alerts.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "delta_flag_rate", "delta_qa_fail_rate"
    )


@query("stream_normalize")
def stream_normalize(spark, sf):
    docs = dealt(_stream(spark, sf, "documents").select("doc_id", "text"))
    return _stored(spark, ST.normalize_documents(docs, sep=LINE))


_ALL_SPLITS = _SPLITS + "SELECT * FROM splits"
_WRITTEN = "pair_id long, before string, after string, classes array<string>, hard boolean, split string"


@query("sink_splits", _ALL_SPLITS)
def written_splits(spark, sf):
    """Write the splits as JSON folders and read them back."""
    folder = f"{scratch_dir(spark)}/splits-{uuid.uuid4().hex}"
    sinks.write_splits(_splits(spark, sf), folder, n_test=0, n_hard=500, **_SIZES)
    return spark.read.schema(_WRITTEN).json(f"{folder}/splits").drop("classes")


@query("op_cached_splits", _ALL_SPLITS)
def cached_splits(spark, sf):
    """Build once, then take the written splits although the test size differs."""
    folder = f"{scratch_dir(spark)}/splits-{uuid.uuid4().hex}"
    rows = None
    for n_test in (0, 1):
        rows = sinks.cached_splits(
            spark, folder, lambda: _splits(spark, sf), _WRITTEN, seed=42, n_test=n_test, n_hard=500, **_SIZES
        )
    return rows.drop("classes")
