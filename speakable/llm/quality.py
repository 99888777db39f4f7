"""Quality classifier by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built, one from blocks of good labelled texts
and one from blocks of bad ones. A text is cut into blocks, each block is
compressed with either dictionary, and the difference of the summed sizes per
byte says which kind of text it resembles. A logistic curve fitted on other
labelled texts turns the difference into a probability; short texts stay
near the share of good texts.

Bounds of the fit, all parameters: ``dictionary_blocks`` blocks of
``block_bytes`` bytes per label, and ``calibration_rows`` texts per label, of
which only two numbers reach the driver. Blocks and rows are picked by the hash of
their ids. Scoring reads every block of every text.

Defined cases: a null or empty text gets the share of good texts; a text shorter than a block is one block; a text of any length
is scored whole; equal texts get equal scores; without labelled rows of both
kinds every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_text_each, sample_ids

BLOCK_BYTES = 2048
LEVEL = 3
#: A text of this many bytes weighs half of what a very long one does.
HALF_BYTES = 64


def blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


class Sizer:
    """Compressed size of a text, block by block, under one dictionary."""

    def __init__(self, dictionary: bytes, block_bytes: int):
        self.block_bytes = block_bytes
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False)

    def __call__(self, data: bytes) -> int:
        pack = self.packer.compress
        return sum(len(pack(b)) for b in blocks(data, self.block_bytes))


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    prior: float = 0.0  # log odds of a good text
    offset: float = 0.0
    slope: float = 0.0
    block_bytes: int = BLOCK_BYTES

    def evidence(self, texts: pd.Series) -> pd.DataFrame:
        """``x``: bytes that the good dictionary saves over the bad one, per byte of text.

        ``w``: how far the text is long enough to tell, from 0 (empty) to 1.
        """
        out = np.zeros((len(texts), 2))
        if self.good and self.bad:
            by_good, by_bad = Sizer(self.good, self.block_bytes), Sizer(self.bad, self.block_bytes)
            for i, text in enumerate(texts):
                data = text.encode() if isinstance(text, str) else b""
                if data:
                    out[i] = (by_bad(data) - by_good(data)) / len(data), len(data) / (len(data) + HALF_BYTES)
        return pd.DataFrame(out, columns=["x", "w"])

    def score(self, texts: pd.Series) -> pd.Series:
        e = self.evidence(texts)
        return 1 / (1 + np.exp(-np.clip(self.prior + e["w"] * (self.offset + self.slope * e["x"]), -40, 40)))


def _dictionary(rows: DataFrame, n_blocks: int, block_bytes: int, dict_bytes: int) -> bytes:
    """A dictionary from at most ``n_blocks`` blocks of at most ``block_bytes`` bytes."""

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: blocks(t.encode(), block_bytes) if isinstance(t, str) else [])

    pieces = rows.select("doc_id", F.posexplode(cut("text")).alias("pos", "block"))
    picked = pieces.orderBy(F.xxhash64("doc_id", "pos"), "doc_id", "pos").limit(n_blocks)
    samples = [bytes(r.block) for r in picked.select("block").collect()]
    size = min(dict_bytes, sum(map(len, samples)) // 4)
    if len(samples) < 8 or size < 1024:
        return b"".join(samples)[:dict_bytes]
    return zstandard.train_dictionary(size, samples).as_bytes()


def fit_curve(x: np.ndarray, w: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[float, float]:
    """Offset and slope of ``prior + w * (offset + slope * x)`` by Newton steps with a small ridge."""
    scale = max(x.std(), 1e-9)
    z = np.c_[w, w * x / scale]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(prior + z @ beta, -40, 40)))
        grad = z.T @ (weight * (y - p)) - 0.5 * beta
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + 0.5 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def train_quality(
    docs: DataFrame,
    labelled: DataFrame,
    dictionary_rows: int = 1500,
    dictionary_blocks: int = 1500,
    calibration_rows: int = 1500,
    block_bytes: int = BLOCK_BYTES,
    dict_bytes: int = 64_000,
) -> QualityModel:
    """Build both dictionaries and the curve.

    ``docs`` has doc_id and text, ``labelled`` has doc_id and label (0 or 1)
    for the rows that may be learned from.
    """
    labelled = labelled.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    # The two uses are kept apart: a dictionary packs the texts it was built from too well.
    half = F.pmod(F.xxhash64("doc_id", F.lit("use")), F.lit(2))
    parts = []
    for label in (0, 1):
        rows = labelled.filter(F.col("label") == label)
        for use, n in ((0, dictionary_rows), (1, calibration_rows)):
            parts.append(sample_ids(rows.filter(half == use), "doc_id", n).withColumn("use", F.lit(use)))
    picked = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # At most 2 * (dictionary_rows + calibration_rows) ids: a proven bound for the broadcast.
    rows = one_text_each(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "doc_id", "label", "use").persist()
    try:
        made = [
            _dictionary(rows.filter((F.col("use") == 0) & (F.col("label") == label)), dictionary_blocks, block_bytes, dict_bytes)
            for label in (0, 1)
        ]
        model = QualityModel(made[1], made[0], block_bytes=block_bytes)
        look = F.pandas_udf(model.evidence, "x double, w double")
        seen = rows.filter(F.col("use") == 1).select("label", look("text").alias("e")).select("label", "e.*").orderBy("x", "w", "label").toPandas()
        if seen["label"].nunique() == 2:
            y = seen["label"].to_numpy(float)
            # The sample holds both labels alike; weights give each its share among all labelled rows.
            all_ = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
            weight = np.where(y == 1, all_[1] / y.sum(), all_[0] / (1 - y).sum()) * len(y) / (all_[0] + all_[1])
            model.prior = float(np.log(all_[1] / all_[0]))
            model.offset, model.slope = fit_curve(seen["x"].to_numpy(), seen["w"].to_numpy(), y, weight, model.prior)
    finally:
        rows.unpersist()
    return model


def quality_score(model: QualityModel, text: Column) -> Column:
    return F.pandas_udf(model.score, "double")(text)
