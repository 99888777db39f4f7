"""Documents to blocks: plain, pasted, markdown, HTML and laid-out text.

The blocks of one text cell are built as an array inside the row, so cutting
needs no shuffle; ``explode_blocks`` turns them into rows.
"""

from __future__ import annotations

import html
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import SPACE, let, strip
from ..schemas import BLOCK
from .prefix import running_sum

BLANK_LINE = rf"\n[{SPACE}]*\n"

# Elements that become blocks, and tags that end an open one.
_OPEN = r"<(h[1-4]|p|blockquote)(?:\s[^>]*)?>"
_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|div|dl|dt|dd|fieldset|figure|footer|form|h[1-6]|header|hr|html"
    "|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
_INVISIBLE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_COMMON_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _block(text: Column, heading: Column | bool = False) -> Column:
    flag = heading if isinstance(heading, Column) else F.lit(heading)
    return F.struct(text.alias("text"), flag.alias("is_heading"))


def _not_blank(text: Column) -> Column:
    return strip(text) != ""


def text_blocks(text: Column, sep: str = BLANK_LINE) -> Column:
    """Paragraphs between separators; blank ones are dropped, others keep their outer blanks."""
    return F.transform(F.filter(F.split(text, sep, -1), _not_blank), lambda p: _block(p))


def pasted_blocks(text: Column, sep: str = BLANK_LINE) -> Column:
    """As plain text, but a text without any block is one block by itself."""
    return let(
        text_blocks(text, sep),
        lambda found: F.when(F.size(found) == 0, F.array(_block(text))).otherwise(found),
    )


def markdown_blocks(text: Column, sep: str = BLANK_LINE) -> Column:
    """Heading marks make headings; other blocks lose their emphasis marks."""
    heading = rf"(?d)\A(#{{1,6}})[{SPACE}]+(.*)$"

    def block(para: Column) -> Column:
        marked = F.rlike(para, F.lit(heading))
        return _block(
            F.when(marked, strip(F.regexp_extract(para, heading, 2))).otherwise(
                F.regexp_replace(para, "[*_`>#]", "")
            ),
            marked,
        )

    paras = F.filter(F.transform(F.split(text, sep, -1), strip), lambda p: p != "")
    return F.transform(paras, block)


@lru_cache(maxsize=1)
def _named_entities() -> str:
    named = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}
    return json.dumps(named)


def unescape(text: Column) -> Column:
    """Replace character references; unknown names stay."""
    entity = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});"

    def number(value: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")

    def replace(ref: Column) -> Column:
        name = F.substr(ref, F.lit(2), F.length(ref) - 2)
        out = F.when(F.lit(False), ref)
        for key, char in _COMMON_ENTITIES.items():
            out = out.when(name == key, char)
        # Leading zeros say nothing; more than seven digits behind them are out of range.
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        short = F.when(F.length(digits).between(1, 7), digits).otherwise("0")
        code = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(short, 16, 10)).otherwise(short)
        named = F.from_json(F.lit(_named_entities()), "map<string,string>")
        return out.when(
            F.startswith(name, F.lit("#")),
            let(
                code.cast("int"),
                lambda c: F.when(
                    ((c > 0) & (c < 55296)) | ((c > 57343) & (c < 1114112)), number(c.cast("bigint"))
                ).otherwise("�"),
            ),
        ).otherwise(F.coalesce(F.try_element_at(named, name), ref))

    refs = F.regexp_extract_all(text, F.lit(entity), F.lit(0))
    parts = F.zip_with(
        F.split(text, entity, -1),
        F.transform(refs, replace),
        lambda gap, ref: F.concat(gap, F.coalesce(ref, F.lit(""))),
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def html_blocks(page: Column) -> Column:
    """Headings, paragraphs and block quotes of a page in document order.

    Only the opening tag is consumed; its content is captured by a look-ahead,
    so a paragraph inside a quote is found as well. A quote runs to its end
    tag, anything else to the next block-level tag.
    """
    tag_end = rf"(?:</?(?:{_BLOCK_TAGS})(?:\s[^>]*)?/?>|\z)"
    short = rf"(?is){_OPEN}(?=(.*?){tag_end})"
    quote = r"(?is)<blockquote(?:\s[^>]*)?>(?=(.*?)(?:</blockquote\s*>|\z))|<(?:h[1-4]|p)(?:\s[^>]*)?>"

    def text_of(content: Column) -> Column:
        nodes = F.transform(F.split(content, "<[^>]*>", -1), lambda n: strip(unescape(n)))
        return F.array_join(F.filter(nodes, lambda n: n != ""), " ")

    def build(body: Column) -> Column:
        tags = F.transform(F.regexp_extract_all(body, F.lit(f"(?i){_OPEN}"), F.lit(1)), F.lower)
        contents = F.regexp_extract_all(body, F.lit(short), F.lit(2))
        quotes = F.when(
            F.rlike(body, F.lit("(?i)<blockquote")), F.regexp_extract_all(body, F.lit(quote), F.lit(1))
        ).otherwise(contents)
        found = F.transform(
            F.arrays_zip(tags.alias("tag"), contents.alias("content"), quotes.alias("quote")),
            lambda e: _block(
                text_of(F.when(e["tag"] == "blockquote", e["quote"]).otherwise(e["content"])),
                F.startswith(e["tag"], F.lit("h")),
            ),
        )
        return F.filter(found, lambda b: b["text"] != "")

    return let(F.regexp_replace(page, _INVISIBLE, ""), build)


def explode_blocks(df: DataFrame, blocks: Column, *keys: str) -> DataFrame:
    """One row per block with its position."""
    return df.select(*keys, F.posexplode(blocks).alias("block_pos", "block")).select(
        *keys, "block_pos", "block.text", "block.is_heading"
    )


def layout_blocks(
    lines: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    size: str = "size",
    min_chars: int = 2,
    ratio: float = 1.25,
    max_heading: int = 80,
) -> DataFrame:
    """Mark laid-out lines as headings by their font size.

    The body size is the upper median of a document's lines: the least size that
    more than half of them do not exceed. Lines are counted per size before
    the shuffle, and the counts accumulated by ranges of whole sizes; no
    buffer holds a document's sizes. Lines without a size are no part of it. The
    sizes are then joined back, a join whose hot keys can be split.
    """
    kept = lines.withColumn(text, strip(F.col(text))).filter(F.length(text) >= min_chars)
    counts = kept.filter(F.col(size).isNotNull()).groupBy(doc, size).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(doc).agg(F.sum("_n").alias("_all"))
    summed = running_sum(counts, [doc], [size], F.col("_n"), "_below", bucket=F.floor(size), inclusive=True)
    body = summed.join(totals, doc).filter(F.col("_below") > F.floor(F.col("_all") / 2)).groupBy(doc).agg(F.min(size).alias("_body"))
    return (
        kept.join(body, doc, "left")
        .withColumn("is_heading", (F.col(size) >= F.col("_body") * ratio) & (F.length(text) <= max_heading))
        .drop("_body")
    )


def document_blocks(text: Column, fmt: Column) -> Column:
    """Blocks by format name; unknown formats are read as plain text."""
    return (
        F.when(fmt.isin("md", "markdown"), markdown_blocks(text).cast(BLOCK))
        .when(fmt.isin("html", "htm", "xhtml"), html_blocks(text).cast(BLOCK))
        .otherwise(text_blocks(text).cast(BLOCK))
    )
