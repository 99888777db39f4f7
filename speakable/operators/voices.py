"""Voice names to vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import lookup
from ..schemas import VOICE_INDEX

WIDTH = 512


def voice_index(voice: Column, table: dict[str, int] | None = None, default: str = "narrator") -> Column:
    """Index of a voice; unknown voices take the narrator's."""
    table = table or VOICE_INDEX
    return F.coalesce(lookup(table, voice), F.lit(table[default]))


def join_voice_vector(voices: DataFrame, vectors: DataFrame, table: dict[str, int] | None = None) -> DataFrame:
    """Vector of each voice row, the index clamped to the last vector.

    Only vectors of configured voices can be hit: at most one per name, so
    that side is bounded by the configuration.
    """
    table = table or VOICE_INDEX
    last = vectors.agg((F.count(F.lit(1)) - 1).alias("_last"))
    wanted = voices.sparkSession.createDataFrame(
        [(i,) for i in sorted(set(table.values()))], "idx int"
    ).join(F.broadcast(last), F.lit(True))
    wanted = wanted.select("idx", F.least(F.col("idx"), F.col("_last")).alias("vec_id"))
    small = vectors.join(F.broadcast(wanted), "vec_id").select("idx", "vec_id", F.col("embedding").alias("vector"))
    return voices.withColumn("idx", voice_index(F.col("voice"), table)).join(F.broadcast(small), "idx", "left").drop("idx")


def pseudo_vector(voice: Column, width: int = WIDTH) -> Column:
    """Deterministic stand-in vector derived from the voice name."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda k: ((F.pmod(F.xxhash64(voice, k), F.lit(20001)) - 10000) / 10000.0 * 0.05).cast("float"),
    )
