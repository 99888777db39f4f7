from __future__ import annotations

import random

import numpy as np
import pandas as pd

from speakable.llm.toxicity import train_toxicity

STRONG, WEAK = ["zorblax", "quimfer", "vextrop"], "hudgy"


def corpus(n, share, seed):
    """Toxic texts hold a strong word in a fifth of the cases each, and the weak one five times as often as clean ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rng.random() < share
        words = [f"{rng.choice('abcdefghij') * 2}{rng.randrange(30)}" for _ in range(12)]
        words += [w for w in STRONG if rng.random() < (0.2 if toxic else 0.002)]
        words += [WEAK] if rng.random() < (0.4 if toxic else 0.08) else []
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_share_of_the_table_holds_beyond_the_sample(spark):
    """Both labels exceed the sample of 3000 in the large table only; the scores stay those of the small one."""
    models = []
    for n in (2_500, 26_000):
        rows = corpus(n, 0.13, 1)
        frame = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "label"]))
        models.append(train_toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "label")))
        share = sum(r[2] for r in rows) / n
        assert abs(models[-1].label_model.prior - share) < 1e-9
    assert sum(r[2] for r in rows) > 3000
    texts = pd.Series(["aa1 bb2", f"aa1 {WEAK} bb2", f"aa1 {STRONG[0]} bb2", f"{STRONG[1]} {WEAK} cc3", f"{STRONG[0]} {STRONG[2]}"])
    small, large = (m.score(texts).to_numpy() for m in models)
    assert (small >= 0.5).tolist() == (large >= 0.5).tolist() == [False, False, True, True, True]
    assert np.abs(np.log(small / (1 - small)) - np.log(large / (1 - large)))[:2].max() < 1.0
