"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled good text is preferred to a labelled bad one. Logistic loss on the difference of their
features gives each document a strength; the cut is that quantile of the strengths which separates the
labels best, and a logistic curve around the cut turns strengths into scores between 0 and 1.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import crc_fold, few_at_a_time, labelled_sample, sparing

#: Scores at the cut; documents below are rejected.
CUT = 0.3
SYMBOLS = "#$%&*|!~^=<>{}[]@_"
FEATURES = (
    "words", "mean word", "symbols", "bars", "shouts", "upper words", "digits", "sentence ends", "commas",
    "echoes", "repeated triples", "repeated lines", "distinct words", "title words", "plain words",
)


def features(text: str) -> list[float]:
    """What a text looks like, in any language: lengths, symbols, letter case and repetition; zeros if empty."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    lines = [x for x in text.split("\n") if x]
    triples = n - 2
    return [
        np.log1p(n),
        min(size / n, 40.0) / 10,
        sum(map(text.count, SYMBOLS)) / size,
        text.count("|") / n,
        (text.count("!!") + text.count("??")) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, "0123456789")) / size,
        (text.count(".") + text.count("?") + text.count("!")) / n,
        text.count(",") / n,
        sum(map(operator.eq, words, islice(words, 1, None))) / n,
        1 - len(set(zip(words, islice(words, 1, None), islice(words, 2, None), strict=False))) / triples if triples > 0 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(len(set(words)) / n, 1.0) * min(1.0, np.log1p(n) / 8),
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
    ]


def matrix(texts) -> np.ndarray:
    """Features of many texts; shares also on a log scale, where the first percent matters most."""
    raw = np.array([features(t or "") for t in texts], dtype=float).reshape(-1, len(FEATURES))
    return np.hstack([raw, np.log(raw[:, 2:] + 0.002)])


def fit(x: np.ndarray, label: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, rounds: int = 60) -> dict:
    """Strength weights from preference pairs, the cut and the slope; without both labels all score alike."""
    label = np.asarray(label)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if not len(good) or not len(bad):
        return {"mean": mean, "spread": spread, "w": np.zeros(x.shape[1]), "cut": -1.0 if not len(bad) else 1.0, "slope": 1.0}
    z = (x - mean) / spread
    pick = np.random.default_rng(7)
    most = max(pairs, len(good), len(bad))  # each row takes part at least once
    winner, loser = (np.concatenate([own, pick.choice(own, most - len(own))]) for own in (good, bad))
    pick.shuffle(winner)
    d = z[winner] - z[loser]
    w, unit = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 0.02)
        w += np.linalg.solve((d * curve[:, None]).T @ d / most + ridge * unit, d.T @ (1 - p) / most - ridge * w)
    strength = z @ w
    return {"mean": mean, "spread": spread, "w": w, **_cut(strength, label)}


def _cut(strength: np.ndarray, label: np.ndarray) -> dict:
    """The quantile of the strengths at which rejecting what lies below errs least, and the curve's slope there."""
    order = np.argsort(strength, kind="stable")
    s, y = strength[order], label[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    errors[1:-1][s[1:] == s[:-1]] = len(y) + 1
    k = int(np.argmin(errors))
    cut = float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else np.quantile(s, (k - 0.5) / (len(s) - 1)))
    base, slope = np.log(CUT / (1 - CUT)), 1.0
    off = s - cut
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(base + slope * off, -30, 30)))
        slope += (off @ (y - p)) / max(off @ off / 4, 1e-9)
        slope = float(np.clip(slope, 0.05, 20.0))
    return {"cut": cut, "slope": slope}


def strengths(model: dict, texts) -> np.ndarray:
    return (matrix(texts) - model["mean"]) / model["spread"] @ model["w"]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_labelled: int = 10_000) -> dict:
    """Fits on at most max_labelled labelled rows outside the held-out fold; only their features reach the driver."""
    sample = labelled_sample(few_at_a_time(docs), labels, "quality", crc_fold("doc_id", folds) != held_out, max_labelled)

    @sparing
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": list(matrix(batch["text"])), "label": batch["label"]})

    got = sample.mapInPandas(measured, "x array<double>, label int").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), 2 * len(FEATURES) - 2)
    order = np.lexsort([*x.T, got["label"].to_numpy()])  # rows arrive in any order
    return fit(x[order], got["label"].to_numpy()[order])


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of docs, and each whole text's score; null texts count as empty, and a column named `out` is replaced."""
    base = np.log(CUT / (1 - CUT))

    @F.pandas_udf("double")
    @sparing
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            off = model["slope"] * (strengths(model, texts) - model["cut"])
            yield pd.Series(1 / (1 + np.exp(-np.clip(base + off, -30, 30))))

    return few_at_a_time(docs).withColumn(out, scored(F.col(text_col)))


def keep_above(scored: DataFrame, quantile: float, score_col: str = "score") -> DataFrame:
    """The rows at or above a quantile of all their scores, such as 0.2 to drop the lowest fifth; ties stay."""
    cut = scored.agg(F.percentile_approx(score_col, quantile, 100_000)).first()[0]
    return scored.where(F.col(score_col) >= cut) if cut is not None else scored
