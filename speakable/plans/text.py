"""Queries over blocks, segmentation and text classification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import segmenting as seg
from ..functions.expr import squash
from ..operators import blocks as B
from ..operators import monitor, quality, score, segments, voices
from ..operators.pairs import load_pairs
from ..operators.prefix import scratch_dir
from ..schemas import JOB_LOG
from ..sources.files import write_files
from ..sources.readers import decode_text, file_counts, read_documents, read_jsonl, read_jsonl_lenient, read_log
from . import sql as q
from .inputs import LINE, dealt, jobs, table, talk
from .registry import query

_UNNEST = "SELECT {keys}, (pos - 1)::BIGINT AS {pos}, {cols} FROM (SELECT {keys}, unnest(l) AS b, generate_subscripts(l, 1) AS pos FROM ({src}))"


def _listed(src: str, keys: str = "doc_id", pos: str = "block_pos", cols: str = "b AS text") -> str:
    return _UNNEST.format(keys=keys, pos=pos, cols=cols, src=src)


_NOT_BLANK = f"lambda p: {q.strip('p')} <> ''"


@query(
    "op_blocks_text",
    _listed(f"SELECT doc_id, list_filter(string_split(text, chr(10)), {_NOT_BLANK}) AS l FROM documents"),
)
def blocks_text(spark, sf):
    docs = table(spark, sf, "documents")
    return B.explode_blocks(docs, B.text_blocks(F.col("text"), LINE), "doc_id").drop("is_heading")


@query(
    "op_blocks_pasted",
    _listed(
        f"""SELECT doc_id, CASE WHEN len(l) = 0 THEN [text] ELSE l END AS l FROM (SELECT doc_id, text,
        list_filter(string_split_regex(text, '\\n{q.S}*\\n'), {_NOT_BLANK}) AS l FROM (
          SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(10) ELSE text END AS text FROM documents))"""
    ),
)
def blocks_pasted(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "text", F.when(F.col("doc_id") % 5 == 0, " \n").otherwise(F.col("text"))
    )
    return B.explode_blocks(docs, B.pasted_blocks(F.col("text")), "doc_id").drop("is_heading")


@query(
    "op_blocks_markdown",
    _listed(
        f"""SELECT doc_id, list_filter(list_transform(string_split_regex(
            '# ' || replace(text, chr(10), chr(10) || chr(10) || '* '), '\\n{q.S}*\\n'),
            lambda p: {q.strip('p')}), lambda p: p <> '') AS l FROM documents""",
        cols=f"""CASE WHEN regexp_matches(b, '^#{{1,6}}{q.S}+[^\\n]*$')
            THEN {q.strip(f"regexp_extract(b, '^#{{1,6}}{q.S}+([^\\n]*)$', 1)")}
            ELSE regexp_replace(b, '[*_`>#]', '', 'g') END AS text,
            regexp_matches(b, '^#{{1,6}}{q.S}+[^\\n]*$') AS is_heading""",
    ),
)
def blocks_markdown(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "text", F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n\n* "))
    )
    return B.explode_blocks(docs, B.markdown_blocks(F.col("text")), "doc_id")


_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|div|dl|dt|dd|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main"
    "|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
_ENTITIES = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query(
    "op_blocks_html",
    f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'),
          '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS h FROM pages),
        c AS (SELECT page_id, string_split(regexp_replace(h, '(?i)(<(?:h[1-4]|p|blockquote)(?:\\s[^>]*)?>)',
          chr(1) || '\\1', 'g'), chr(1))[2:] AS l FROM a),
        d AS (SELECT page_id, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM c),
        e AS (SELECT page_id, pos, lower(regexp_extract(piece, '(?i)^<(h[1-4]|p|blockquote)', 1)) AS tag,
          regexp_extract(regexp_replace(piece, '^<[^>]*>', ''),
            '(?is)^(.*?)(?:</?(?:{_BLOCK_TAGS})(?:\\s[^>]*)?/?>|$)', 1) AS content FROM d),
        f AS (SELECT page_id, pos, tag, array_to_string(list_filter(list_transform(
          string_split_regex(content, '<[^>]*>'), lambda n: {q.strip(_ENTITIES.format(x='n'))}),
          lambda n: n <> ''), ' ') AS text FROM e)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS block_pos, text,
          tag LIKE 'h%' AS is_heading FROM f WHERE text <> ''""",
)
def blocks_html(spark, sf):
    pages = dealt(table(spark, sf, "pages").select("page_id", "html"))
    return B.explode_blocks(pages, B.html_blocks(F.col("html")), "page_id")


@query(
    "op_blocks_layout",
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_pos, l_partkey,
          repeat(l_returnflag, l_linenumber % 3 + 1) AS text, l_quantity AS size FROM lineitem),
        k AS (SELECT * FROM l WHERE length(text) >= 2),
        m AS (SELECT doc_id, list(size ORDER BY size)[count(*) // 2 + 1] AS body FROM k GROUP BY doc_id)
        SELECT doc_id, line_pos::BIGINT AS line_pos, l_partkey, text, size,
          size >= body * 1.25 AND length(text) <= 80 AS is_heading FROM k JOIN m USING (doc_id)""",
)
def blocks_layout(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("line_pos"),
        "l_partkey",
        F.expr("repeat(l_returnflag, l_linenumber % 3 + 1)").alias("text"),
        F.col("l_quantity").alias("size"),
    )
    return B.layout_blocks(lines)


@query(
    "op_blocks_pages_plain",
    _listed(
        f"SELECT conv_id, turn, list_filter(string_split(text, chr(10)), {_NOT_BLANK}) AS l FROM conversations",
        keys="conv_id, turn",
    ),
)
def blocks_pages_plain(spark, sf):
    pages = table(spark, sf, "conversations")
    return B.explode_blocks(pages, B.text_blocks(F.col("text"), LINE), "conv_id", "turn").drop("is_heading")


@query(
    "op_decode_text",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text
       ELSE regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || 'é' END AS text FROM documents""",
)
def decode(spark, sf):
    docs = table(spark, sf, "documents")
    latin = F.concat(F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", ""), "UTF-8"), F.unhex(F.lit("E9")))
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin)
    return docs.select("doc_id", decode_text(content).alias("text"))


_SUFFIXES = {0: ".txt", 1: ".md", 2: ".epub", 3: ".dat"}


@query(
    "op_read_files",
    f"""SELECT doc_id::VARCHAR AS title, CASE doc_id % 4 WHEN 1 THEN 'md' WHEN 2 THEN 'epub' ELSE 'txt' END AS source_format,
        CASE WHEN doc_id % 4 <> 2 THEN sha256(text || chr(10)) END AS text_sha256,
        CASE doc_id % 4 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE len(list_filter(string_split_regex(text || chr(10), '\n{q.S}*\n'), {_NOT_BLANK})) END AS n_blocks
        FROM documents""",
)
def read_files(spark, sf):
    """Write every document as a file of its own, of one of four kinds, and read the folder as documents."""
    folder = _folder(spark, "files")
    kind = F.element_at(F.array(*map(F.lit, _SUFFIXES.values())), (F.col("doc_id") % 4 + 1).cast("int"))
    write_files(table(spark, sf, "documents").filter(F.col("doc_id") % 4 >= 0), folder, kind, F.col("doc_id"), F.lit(0), F.col("text"))
    found = read_documents(spark, folder)
    blocks = F.when(F.col("source_format") != "md", F.size("blocks"))
    return found.select("title", "source_format", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), blocks.alias("n_blocks"))


def _folder(spark, what):
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _pair_lines(spark, sf):
    rows = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("before"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("after"),
        F.array(F.lit("PLAIN"), F.concat(F.lit("T"), F.col("toxic").cast("string"))).alias("classes"),
        (F.col("quality") == 1).alias("hard"),
    )
    return rows.select("before", F.explode(F.array(F.to_json(F.struct("*")), F.lit("  "))).alias("value"))


@query(
    "op_read_jsonl",
    "SELECT doc_id::VARCHAR AS before, 'q' || quality AS after, ['PLAIN', 'T' || toxic] AS classes, quality = 1 AS hard FROM labels",
)
def jsonl_files(spark, sf):
    """Write pair files with blank lines and read them strictly."""
    folder = _folder(spark, "pairs")
    _pair_lines(spark, sf).select("value").write.text(folder)
    return read_jsonl(spark, folder)


def _broken_pairs(spark, sf):
    folder = _folder(spark, "pairs")
    broken = F.when((F.col("before").cast("bigint") % 7 == 0) & (F.col("value") != "  "), F.concat(F.lit("{oops "), "before")).otherwise(F.col("value"))
    _pair_lines(spark, sf).select(broken.alias("value")).write.option("maxRecordsPerFile", 500).text(folder)
    return read_jsonl_lenient(spark, folder)


@query(
    "op_read_jsonl_lenient",
    """SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id::VARCHAR END AS before, CASE WHEN doc_id % 7 <> 0 THEN 'q' || quality END AS after,
       CASE WHEN doc_id % 7 = 0 THEN '{oops ' || doc_id END AS corrupt FROM labels""",
)
def jsonl_lenient(spark, sf):
    """Pair files in which every seventh line is broken."""
    return _broken_pairs(spark, sf).select("before", "after", "corrupt")


@query("op_read_jsonl_counts", "SELECT count(*) FILTER (doc_id % 7 <> 0) AS n_rows, count(*) FILTER (doc_id % 7 = 0) AS n_corrupt FROM labels")
def jsonl_counts(spark, sf):
    """Good and bad lines, counted per file and added up."""
    counts = file_counts(_broken_pairs(spark, sf))
    return counts.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_corrupt").alias("n_corrupt"))


_JOBS = """SELECT event_id, ts, 'job' AS event, 'file' || user_id AS filename, event_type AS status,
  (props->>'k')::BIGINT % 20 AS n_segments, (props->>'k')::BIGINT % 7 AS n_flagged,
  CASE WHEN event_type <> 'error' THEN value END AS rtf,
  (props->>'k')::BIGINT % 5 AS qa_pass, event_id % 3 AS qa_fail FROM events"""


@query(
    "op_read_log",
    f"""SELECT ts, filename, status, n_segments, n_flagged, rtf, qa_pass, qa_fail
        FROM ({_JOBS}) WHERE event_id % 10 <> 0 AND event_id % 11 <> 0""",
)
def log_files(spark, sf):
    """Write a log in which some lines are cut short or empty and read it."""
    log = jobs(spark, sf)
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    line = F.to_json(
        F.struct(*[f.name for f in JOB_LOG.fields]), {"timestampFormat": stamp, "timestampNTZFormat": stamp}
    )
    broken = (
        F.when(F.col("event_id") % 10 == 0, F.expr("substring(line, 1, length(line) - 1)"))
        .when(F.col("event_id") % 11 == 0, F.lit(""))
        .otherwise(F.col("line"))
    )
    folder = _folder(spark, "log")
    log.withColumn("line", line).select(broken.alias("value")).write.text(folder)
    return read_log(spark, folder).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "filename", "status", "n_segments", "n_flagged",
        F.col("metrics.rtf").alias("rtf"),
        F.col("metrics.audio_qa.pass").alias("qa_pass"), F.col("metrics.audio_qa.fail").alias("qa_fail"),
    )


@query(
    "op_load_real_pairs",
    """SELECT p_partkey AS pair_id, p_name AS before, p_type AS after, ['REAL'] AS classes, FALSE AS hard
       FROM part WHERE p_size % 7 <> 0""",
)
def real_pairs(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("\t "), "p_name", F.lit(" ")).alias("written"),
        F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.col("p_type")).alias("said"),
    )
    return load_pairs(parts, "written", "said", "p_partkey")


_VOICES = {"narrator": 7, "dialogue": 999_999_999, "heading": 50}


@query(
    "op_voice_vectors",
    """WITH v AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'dialogue' WHEN 'assistant' THEN 'narrator' ELSE role END AS voice
          FROM conversations),
        i AS (SELECT *, least(CASE voice WHEN 'dialogue' THEN 999999999 WHEN 'heading' THEN 50 ELSE 7 END,
          (SELECT count(*) - 1 FROM embeddings)) AS vec_id FROM v)
        SELECT conv_id, turn, voice, vec_id::BIGINT AS vec_id, embedding[1]::DOUBLE AS first_value,
          round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total, len(embedding)::BIGINT AS width FROM i JOIN embeddings USING (vec_id)""",
)
def voice_vectors(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "dialogue")
        .when(F.col("role") == "assistant", "narrator")
        .otherwise(F.col("role"))
        .alias("voice"),
    )
    joined = voices.join_voice_vector(rows, table(spark, sf, "embeddings"), _VOICES)
    return joined.select(
        "conv_id", "turn", "voice", "vec_id",
        F.get("vector", F.lit(0)).alias("first_value"), F.size("vector").alias("width"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"),
    )


@query(
    "join_voice_vector",
    """SELECT role, count(*) AS n, round(sum(e.embedding[2]::DOUBLE), 4) AS total FROM (
          SELECT role, CASE role WHEN 'assistant' THEN 3 WHEN 'user' THEN 4 ELSE 3 END AS vec_id FROM conversations) c
        JOIN embeddings e USING (vec_id) GROUP BY role""",
)
def voice_totals(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("role"), F.col("role").alias("voice"))
    joined = voices.join_voice_vector(rows, table(spark, sf, "embeddings"), {"narrator": 3, "assistant": 3, "user": 4})
    return joined.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("vector", F.lit(1)).cast("double")), 4).alias("total")
    )


@query(
    "op_load_reports",
    """SELECT k AS kind, payload FROM (SELECT unnest(['click', 'error', 'tune', 'view']) AS k)
       LEFT JOIN (SELECT event_type, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY event_type) ON event_type = k""",
)
def load_reports(spark, sf):
    reports = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), "ts", "event_id", F.col("props").alias("payload")
    )
    return monitor.latest_reports(reports, ["click", "error", "tune", "view"], ["ts", "event_id"])


# Lines of documents, short names and upper-case words: every kind occurs.
_TEXTS = """SELECT 'd' || doc_id AS key, unnest(string_split(text, chr(10))) AS text FROM documents
  UNION ALL SELECT 'p' || p_partkey, p_name FROM part UNION ALL SELECT 't' || p_partkey, p_type FROM part
  UNION ALL SELECT 'c' || c_custkey, 'Page ' || c_custkey FROM customer
  UNION ALL SELECT 'q' || c_custkey, '"' || c_name || '," they said. "Yes."' FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'Part ' || n_name || ' two' FROM nation"""


def _texts(spark, sf):
    def named(prefix, key):
        return F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key")

    docs = table(spark, sf, "documents").select(named("d", "doc_id"), F.explode(F.split("text", "\n", -1)).alias("text"))
    part, customer, nation = (table(spark, sf, t) for t in ("part", "customer", "nation"))
    return (
        docs.unionByName(part.select(named("p", "p_partkey"), F.col("p_name").alias("text")))
        .unionByName(part.select(named("t", "p_partkey"), F.col("p_type").alias("text")))
        .unionByName(
            customer.select(named("c", "c_custkey"), F.concat(F.lit("Page "), F.col("c_custkey").cast("string")).alias("text"))
        )
        .unionByName(
            customer.select(
                named("q", "c_custkey"), F.concat(F.lit('"'), "c_name", F.lit('," they said. "Yes."')).alias("text")
            )
        )
        .unionByName(
            nation.select(named("n", "n_nationkey"), F.concat(F.lit("Part "), "n_name", F.lit(" two")).alias("text"))
        )
    )


@query(
    "op_classify",
    f"""SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text, {q.kind('t')} AS kind
        FROM (SELECT text, {q.strip('text')} AS t FROM ({_TEXTS}))) GROUP BY kind""",
)
def classify(spark, sf):
    kinds = _texts(spark, sf).withColumn("kind", seg.classify(F.col("text")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "op_drop_boilerplate",
    f"SELECT key, text FROM (SELECT key, text, {q.strip('text')} AS t FROM ({_TEXTS})) WHERE NOT {q.boilerplate('t')}",
)
def drop_boilerplate(spark, sf):
    return _texts(spark, sf).filter(~seg.is_boilerplate(F.col("text")))


@query(
    "op_spoken_only",
    f"SELECT key, kind FROM (SELECT key, {q.kind('t')} AS kind FROM (SELECT key, {q.strip('text')} AS t FROM ({_TEXTS}))) WHERE kind <> 'skippable'",
)
def spoken_only(spark, sf):
    return quality.spoken_only(_texts(spark, sf).withColumn("kind", seg.classify(F.col("text")))).select("key", "kind")


@query("op_squash_ws", f"SELECT doc_id, {q.squash('text')} AS text FROM documents")
def squash_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", squash(F.col("text")).alias("text"))


@query(
    "op_slug",
    """SELECT doc_id, coalesce(nullif(left(lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_')), 48), ''), 'untitled') AS slug
       FROM documents""",
)
def slugs(spark, sf):
    from ..functions.text import slug

    return table(spark, sf, "documents").select("doc_id", slug(F.col("text"), "untitled").alias("slug"))


@query("op_prefix_input", "SELECT item_id, 'normalize: ' || text AS text FROM benchmark")
def prefix_input(spark, sf):
    from ..functions.text import model_input

    return table(spark, sf, "benchmark").select("item_id", model_input(F.col("text")).alias("text"))


@query(
    "op_limit_rows",
    """SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 25""",
)
def limit_rows(spark, sf):
    return score.first_rows(table(spark, sf, "documents").select("lang", "doc_id"), 25, ["lang"], ["doc_id"])


@query(
    "op_sentences",
    f"""SELECT doc_id, (pos - 1)::BIGINT AS sentence_no, s AS sentence FROM (SELECT doc_id, unnest(l) AS s,
        generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {q.sentences('text')} AS l FROM documents))""",
)
def sentences(spark, sf):
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(seg.sentences(F.col("text"))).alias("sentence_no", "sentence")
    )


@query(
    "op_chunk",
    f"""SELECT doc_id, (pos - 1)::BIGINT AS chunk_no, c AS chunk FROM (SELECT doc_id, unnest(l) AS c,
        generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {q.chunks('text')} AS l FROM documents))""",
)
def chunk(spark, sf):
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(seg.chunks(F.col("text"))).alias("chunk_no", "chunk")
    )


@query(
    "op_split_long",
    f"""SELECT doc_id, (pos - 1)::BIGINT AS piece_no, p AS piece FROM (SELECT doc_id, unnest(l) AS p,
        generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {q.split_long('t', 120)} AS l FROM (
        SELECT doc_id, {q.strip('text')} AS t FROM documents) WHERE t <> ''))""",
)
def split_long(spark, sf):
    from ..functions.expr import strip

    docs = dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", strip(F.col("text")).alias("t"))
    return docs.select("doc_id", F.posexplode(seg.split_long(F.col("t"), 120)).alias("piece_no", "piece"))


@query(
    "op_chunk_tts",
    f"""SELECT doc_id, (pos - 1)::BIGINT AS chunk_no, c AS chunk FROM (SELECT doc_id, unnest(l) AS c,
        generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {q.speech_chunks('text')} AS l FROM documents))""",
)
def chunk_tts(spark, sf):
    return dealt(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(seg.speech_chunks(F.col("text"))).alias("chunk_no", "chunk")
    )


_TALK = "SELECT conv_id AS doc_id, turn AS pos, text, role = 'system' OR turn = 0 AS is_heading FROM conversations"
_LINES = """SELECT doc_id, pos, text, FALSE AS is_heading FROM (SELECT doc_id, unnest(l) AS text,
  generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query(
    "op_chapters",
    f"""WITH {q.book_ctes(_TALK)} SELECT doc_id, pos AS block_pos, n AS n_pieces, opening AS opens, chapter_index,
        first_order FROM b6""",
)
def chapters(spark, sf):
    return segments.block_rows(talk(spark, sf)).select(
        "doc_id", "block_pos", "n_pieces", "opens", "chapter_index", "first_order"
    )


@query(
    "op_chapter_titles",
    f"""WITH {q.book_ctes(_TALK)}, c AS (SELECT doc_id, chapter_index,
          coalesce(max(CASE WHEN opening THEN left(t, 80) END), 'Chapter 1') AS opener,
          max(CASE WHEN first_order = 0 AND kind = 'heading' THEN left(t, 80) END) AS renamed,
          sum(n)::BIGINT AS n_segments FROM b6 GROUP BY doc_id, chapter_index HAVING sum(n) > 0)
        SELECT d.doc_id, coalesce(chapter_index, 0) AS chapter_index,
          coalesce(CASE WHEN opener LIKE 'Chapter %' THEN coalesce(renamed, opener) ELSE opener END, 'Chapter 1') AS title,
          coalesce(n_segments, 0) AS n_segments FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) d LEFT JOIN c USING (doc_id)""",
)
def chapter_titles(spark, sf):
    return segments.chapters_of_rows(talk(spark, sf))


_SEGMENTS = f"""SELECT doc_id, chapter_index, (first_order + nr - 1)::BIGINT AS seg_order,
  CASE WHEN kind = 'heading' THEN 'heading' ELSE {q.kind('p')} END AS kind, p AS text
  FROM (SELECT *, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS nr FROM b6)"""


@query("op_segments", f"WITH {q.book_ctes(_LINES, undo=2)} {_SEGMENTS}")
def segment_documents(spark, sf):
    return segmented(spark, sf)


def segmented(spark, sf):
    """Segments of all documents, a line being a block."""
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text"))
    return segments.segments(docs, B.text_blocks(F.col("text"), LINE), "doc_id")


DOC_SEGMENTS = f"WITH {q.book_ctes(_LINES)}, segs AS ({_SEGMENTS}) "


@query(
    "agg_doc_stats",
    DOC_SEGMENTS
    + """SELECT doc_id, max(chapter_index) + 1 AS n_chapters, count(*) AS n_segments,
        count(*) FILTER (kind <> 'skippable') AS n_spoken, sum(length(text))::BIGINT AS total_chars FROM segs GROUP BY doc_id""",
)
def doc_stats(spark, sf):
    return quality.doc_stats(segmented(spark, sf))


_SCORE = (
    DOC_SEGMENTS
    + f""", sums AS (SELECT doc_id, count(*) FILTER (kind <> 'skippable') AS n,
        sum(length(text)) FILTER (kind <> 'skippable') AS chars,
        sum(length(regexp_replace(text, '[^\\p{{L}}\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g'))) FILTER (kind <> 'skippable') AS letters,
        max(chapter_index) AS last, bool_or(kind = 'heading') AS headed FROM segs GROUP BY doc_id),
      scores AS (SELECT d.doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE WHEN chars < 20 THEN 0.15::DOUBLE ELSE
        round_even(least(1.0::DOUBLE, 0.5::DOUBLE * (letters::DOUBLE / chars::DOUBLE)
          + 0.3::DOUBLE * CASE WHEN last > 0 OR headed THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END
          + 0.2::DOUBLE * CASE WHEN chars::DOUBLE / n BETWEEN 10 AND 2000 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 4) END AS parse_score
        FROM documents d LEFT JOIN sums USING (doc_id)) """
)
_ROUTE = "CASE WHEN parse_score >= 0.85 THEN 'structured' WHEN parse_score >= 0.5 THEN 'assisted' ELSE 'degraded' END"


def _parse_scores(spark, sf):
    return quality.parse_score(segmented(spark, sf), table(spark, sf, "documents"))


@query("agg_parse_score", _SCORE + "SELECT doc_id, parse_score FROM scores")
def parse_score(spark, sf):
    return _parse_scores(spark, sf).select("doc_id", "parse_score")


@query("op_parse_route", _SCORE + f"SELECT {_ROUTE} AS route, count(*) AS n FROM scores GROUP BY ALL")
def parse_route(spark, sf):
    return _parse_scores(spark, sf).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
