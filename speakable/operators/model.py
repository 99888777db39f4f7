"""Hook for a normalizing model: the only Python that runs on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .quality import decide_normalization, join_model_baseline

BATCH = 32
Model = Callable[[list[str]], tuple[list[str], list[float]]]


def apply_model(df: DataFrame, model: Model, key: str = "segment_id", text: str = "text", batch: int = BATCH) -> DataFrame:
    """Run a batch model over a text column in Arrow batches; no shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            said: list[str] = []
            sure: list[float] = []
            texts = pdf[text].tolist()
            for start in range(0, len(texts), batch):
                out, conf = model(texts[start : start + batch])
                said += out
                sure += conf
            yield pd.DataFrame({key: pdf[key], "text": said, "confidence": pd.Series(sure, dtype="float64", index=pdf.index)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, text string, confidence double")


def normalize_with_model(baseline: DataFrame, model: Model, key: str = "segment_id", text: str = "text") -> DataFrame:
    """Model text where it is given, rule text otherwise, with the decision columns."""
    predicted = apply_model(baseline, model, key, text)
    return decide_normalization(join_model_baseline(baseline, predicted, key))
