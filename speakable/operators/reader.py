"""Context reader: which of two readings an ambiguous span takes, learned with Spark ML.

The rules always take the first reading. Here each ambiguous span offers its
first and its second reading; a logistic regression over hashed neighbour
words decides. Its probability is the confidence of the decision.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ENDS_WORD, STARTS_WORD, lookup, squash
from ..functions.readings import spoken
from ..functions.scanning import RULES, Rule, scan, splice
from ..functions.words import cardinal, decade, ordinal, roman_words
from .prefix import durable

FEATURES = 1 << 16

# Second readings of short words, and months before a day.
PLACE_READINGS = {
    "st": "Street", "dr": "Drive", "ln": "Lane", "ave": "Avenue", "rd": "Road", "blvd": "Boulevard",
}
TITLE_READINGS = {"st": "Saint", "dr": "Doctor", "mr": "Mister", "mrs": "Missus", "prof": "Professor"}
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)

READER_RULES = [
    Rule("DAY", rf"(?<=(?:{MONTHS}) )[0-9]{{1,2}}{ENDS_WORD}", digit=True),
    *RULES,
    Rule("DECADE", rf"(?=[12]){STARTS_WORD}[12][0-9]{{2}}0s{ENDS_WORD}", digit=True),
    Rule("NUMERAL", rf"(?=[A-Z]){STARTS_WORD}[A-Z][a-z]+ [IVX]{{1,5}}{ENDS_WORD}", digit=False),
]


def _second(cls: Column, surface: Column) -> Column:
    """Second reading of a span, null where it has only one."""
    key = F.rtrim(F.lower(surface), F.lit("."))
    stop = F.when(F.endswith(surface, F.lit(".")), ".").otherwise("")
    word = F.substring_index(surface, " ", 1)
    return (
        F.when(cls == "DAY", ordinal(surface))
        .when((cls == "CARDINAL") & (F.length(surface) == 4) & surface.between("1500", "2099"), cardinal(surface))
        .when(cls == "DECADE", decade(F.rtrim(surface, F.lit("s"))))
        .when(cls == "NUMERAL", F.concat(word, F.lit(" "), roman_words(F.substring_index(surface, " ", -1))))
        .when(cls == "ABBREV", F.concat(lookup(PLACE_READINGS, key), stop))
    )


def _first(cls: Column, surface: Column) -> Column:
    key = F.rtrim(F.lower(surface), F.lit("."))
    return (
        F.when(cls == "DAY", cardinal(surface))
        .when(cls.isin("DECADE", "NUMERAL"), surface)
        .when((cls == "ABBREV") & lookup(TITLE_READINGS, key).isNotNull(), lookup(TITLE_READINGS, key))
        .otherwise(spoken(cls, surface))
    )


def candidates(df: DataFrame, text: str, key: str, *more: str) -> DataFrame:
    """One row per span with both readings and hashed-feature words of its context, and ``more`` columns of its row."""
    spans = df.select(
        key, text, *more, F.posexplode(scan(F.col(text), rules=READER_RULES)).alias("span_no", "s")
    ).select(key, text, *more, "span_no", "s.*")
    before = F.substr(F.col(text), F.lit(1), F.col("start"))
    after = F.substr(F.col(text), F.col("stop") + 1)
    left = F.regexp_extract(before, r"(\S+)\s*$", 1)
    right = F.regexp_extract(after, r"^\s*(\S+)", 1)
    cls = F.col("cls")
    named = {
        "left": left,
        "right": right,
        "left_big": F.rlike(left, F.lit("^[A-Z]")).cast("string"),
        "right_big": F.rlike(right, F.lit("^[A-Z]")).cast("string"),
        "at_start": (F.col("start") == 0).cast("string"),
        "word": F.when(cls.isin("ABBREV", "NUMERAL"), F.substring_index("surface", " ", 1)).otherwise(""),
    }
    words = F.array(*[F.concat(cls, F.lit(f"|{n}="), F.lower(v)) for n, v in named.items()])
    return spans.select(
        key,
        "span_no",
        "start",
        "stop",
        _first(cls, F.col("surface")).alias("first"),
        _second(cls, F.col("surface")).alias("second"),
        words.alias("words"),
        *more,
    )


def training_rows(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Ambiguous spans of pairs whose spoken side shows exactly one of the readings."""
    gold = candidates(pairs, "before", key, "after").filter(F.col("second").isNotNull())
    says_first = F.contains("after", F.col("first"))
    says_second = F.contains("after", F.rtrim("second", F.lit(".")))
    return gold.filter(says_first != says_second).select("words", says_second.cast("double").alias("label"))


def _pipeline() -> tuple[Pipeline, LogisticRegression]:
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True)
    regression = LogisticRegression(maxIter=30, regParam=0.001)
    return Pipeline(stages=[hashing, regression]), regression


def fit_reader(pairs: DataFrame) -> PipelineModel:
    return _pipeline()[0].fit(training_rows(pairs))


def tune_reader(pairs: DataFrame, strengths: list[float], seed: int = 42) -> DataFrame:
    """Validation accuracy of each regularization strength; the best one is marked."""
    pipeline, regression = _pipeline()
    grid = ParamGridBuilder().addGrid(regression.regParam, strengths).build()
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    search = TrainValidationSplit(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, trainRatio=0.8, seed=seed)
    # Both sides of the split read the rows, so the texts are scanned once before it.
    scores = search.fit(durable(training_rows(pairs))).validationMetrics
    best = max(range(len(scores)), key=lambda k: scores[k])
    rows = [(s, round(m, 4), k == best) for k, (s, m) in enumerate(zip(strengths, scores))]
    return pairs.sparkSession.createDataFrame(rows, "strength double, score double, best boolean")


def read_in_context(model: PipelineModel, df: DataFrame, text: str = "before", key: str = "pair_id") -> DataFrame:
    """Text and confidence per row, in the form the model hook expects.

    Spans are regrouped per segment, whose length bounds their number.
    """
    from pyspark.ml.functions import vector_to_array

    judged = model.transform(candidates(df, text, key))
    p = F.get(vector_to_array("probability"), F.lit(1))
    choose = F.col("second").isNotNull() & (p >= 0.5)
    sure = F.when(F.col("second").isNull(), 1.0).otherwise(F.greatest(p, 1 - p))
    span = F.struct("start", "stop", F.when(choose, F.col("second")).otherwise(F.col("first")).alias("said"))
    grouped = judged.groupBy(key).agg(
        F.array_sort(F.collect_list(span)).alias("spans"), F.min(sure).alias("confidence")
    )
    joined = df.join(grouped, key, "left")
    said = squash(splice(F.col(text), F.col("spans"), lambda s: s["said"]))
    return joined.select(
        key,
        F.when(F.col("spans").isNull(), squash(F.col(text))).otherwise(said).alias("text"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
