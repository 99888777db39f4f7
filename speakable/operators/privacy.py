"""Telephone numbers and addresses: taken out of texts, kept out of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import lookup
from ..functions.scanning import scan, splice

#: Classes that are taken out, and what stands in their place.
MARKS = {"TELEPHONE": "[PHONE]", "ELECTRONIC": "[LINK]"}
DOMINATED = 0.5


def union_length(spans: Column) -> Column:
    """Characters that an array of spans covers; overlaps count once."""
    start = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def step(acc: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["stop"] - F.greatest(span["start"], acc["stop"]))
        return F.struct(F.greatest(acc["stop"], span["stop"]).alias("stop"), (acc["n"] + new).alias("n"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"))))
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def redacted(segments: DataFrame, text: str = "text", kind: str = "kind", dominated: float = DOMINATED) -> DataFrame:
    """Adds the redacted text, what was taken out, and where everything else now is.

    ``sensitive_share`` is the part of the text that sensitive spans cover; from
    ``dominated`` on the segment becomes skippable. ``rest`` holds the other
    spans with their old and new offsets. Null texts stay null and have no spans.
    """
    found = scan(F.col(text))
    is_sensitive = lambda s: s["cls"].isin(*MARKS)
    mark = lambda s: lookup(MARKS, s["cls"])
    rows = segments.withColumn("_all", F.coalesce(found, F.expr("filter(array(struct(0 AS start, 0 AS stop, '' AS cls, '' AS surface)), s -> false)")))
    rows = rows.withColumn("_bad", F.filter("_all", is_sensitive)).withColumn("_rest", F.filter("_all", lambda s: ~is_sensitive(s)))

    def moved(span: Column) -> Column:
        earlier = F.filter("_bad", lambda b: b["stop"] <= span["start"])
        return F.aggregate(earlier, F.lit(0), lambda a, b: a + F.length(mark(b)) - (b["stop"] - b["start"]))

    rest = F.transform(
        "_rest",
        lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), s["cls"].alias("cls"),
            (s["start"] + moved(s)).alias("new_start"), (s["stop"] + moved(s)).alias("new_stop"),
        ),
    )
    share = union_length(F.col("_bad")) / F.greatest(F.lit(1), F.coalesce(F.length(text), F.lit(0)))
    rows = rows.withColumn("sensitive_share", F.bround(share, 4)).withColumn("n_sensitive", F.size("_bad"))
    rows = rows.withColumn("redacted", splice(F.col(text), F.col("_bad"), mark)).withColumn("rest", rest)
    return rows.withColumn(kind, F.when(share >= dominated, "skippable").otherwise(F.col(kind))).drop("_all", "_bad", "_rest")


def check_text_free(schema: T.StructType, allowed: tuple[str, ...]) -> None:
    """Raise if a column outside ``allowed`` can hold text, at any depth."""

    def holds_text(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return holds_text(kind.elementType)
        if isinstance(kind, T.MapType):
            return holds_text(kind.keyType) or holds_text(kind.valueType)
        if isinstance(kind, T.StructType):
            return any(holds_text(f.dataType) for f in kind.fields)
        return isinstance(kind, (T.StringType, T.BinaryType, T.VariantType))

    bad = [f.name for f in schema.fields if f.name not in allowed and holds_text(f.dataType)]
    if bad:
        raise ValueError(f"columns that can hold text: {', '.join(bad)}")


def span_log(segments: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """A log row per span: keys, place and class, nothing of the text.

    Keys that could hold text are refused; classes are names of rules. The
    expression hands on the places only, so no surface leaves the scan.
    """
    places = F.transform(scan(F.col(text)), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["cls"].alias("cls")))
    out = segments.select(*keys, F.posexplode(places).alias("span_no", "s")).select(*keys, "span_no", "s.start", "s.stop", "s.cls")
    out = out.withColumn("sensitive", F.col("cls").isin(*MARKS))
    check_text_free(out.schema, ("cls",))
    return out
