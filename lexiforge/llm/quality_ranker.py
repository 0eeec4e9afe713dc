"""Quality classifier by Bradley-Terry ranking.

A document's strength is a sum of step functions of text features. Preference
pairs (a document labelled 1, one labelled 0) teach it by logistic loss on the
difference of their features, so only order matters. A quantile of the training
scores, the one at which a cut is right most often, becomes the threshold.
"""

from __future__ import annotations

from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import id_text, sized_slices

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPER, DIGITS, ENDS = bytes(range(65, 91)), b"0123456789", b".,;:?"
SIGNS = b"#$%&*+/<=>@[\\]^_`{|}~"
NAMES = ["chars", "words", "word_length", "letters", "upper", "digits", "ends", "signs", "shouts", "blanks", "other_bytes",
         "upper_words", "sign_words", "distinct_words", "repeated_neighbours", "top_word", "distinct_pairs", "long_words",
         "lines", "line_length", "distinct_lines", "short_lines", "entropy", "distinct_letters"]


def features(text: bytes) -> list[float]:
    """Features of a text, in the order of NAMES; all defined, if only as 0, for an empty one."""
    n = max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = count / n
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    some = share[share > 0]

    def of(chars: bytes) -> float:
        return float(share[list(chars)].sum())

    return [np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / m, of(LETTERS), of(UPPER), of(DIGITS), of(ENDS),
            of(SIGNS), of(b"!"), of(b" \t\r\n"), float(share[128:].sum()), sum(map(bytes.isupper, words)) / m,
            sum(1 for w in seen if w.strip(SIGNS) != w) / max(1, len(seen)), len(seen) / m, sum(map(eq, words, words[1:])) / m,
            max(seen.values(), default=0) / m, pairs / m, sum(c for w, c in seen.items() if len(w) > 20) / m,
            np.log1p(len(lines)), np.log1p(n / k), len(set(lines)) / k, sum(1 for x in lines if len(x) < 20) / k,
            float(-(some * np.log2(some)).sum()), float((count > 0).sum()) / 64]


class Ranker(NamedTuple):
    """Cuts of each feature (rows) into steps, the strength of each step, and the threshold's strength."""

    cuts: np.ndarray
    strength: np.ndarray
    cut: float
    at: float

    def steps(self, x: np.ndarray) -> np.ndarray:
        """The step of every feature: columns of ``strength``, one after the other."""
        wide = self.cuts.shape[1] + 1
        return np.stack([np.searchsorted(c, x[:, j], "right") + j * wide for j, c in enumerate(self.cuts)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.strength[self.steps(x)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``at`` where the strength is that of the threshold."""
        z = np.clip(self.raw(x) - self.cut + np.log(self.at / (1 - self.at)), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_ranker(x: np.ndarray, y: np.ndarray, at: float = 0.5, steps: int = 8, partners: int = 4, ridge: float = 3.0,
               rounds: int = 12) -> Ranker:
    """Bradley-Terry fit on pairs of rows labelled 1 and 0, each row with ``partners`` of the other label at least.

    Newton's method on the ridge-penalised logistic loss. Without rows of both
    labels all strengths are 0 and every score is ``at``.
    """
    cuts = np.quantile(x, np.arange(1, steps) / steps, axis=0).T if len(x) else np.zeros((len(NAMES), steps - 1))
    model = Ranker(cuts, np.zeros(len(cuts) * steps), 0.0, at)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    n = partners * max(len(good), len(bad))
    k = np.arange(n)
    rng = np.random.default_rng(0)  # shuffles only; every row has its partners
    win = rng.permutation(good)[k % len(good)]
    lose = rng.permutation(bad)[(k + k // len(bad)) % len(bad)]
    at_step = model.steps(x)
    size = len(model.strength)
    w = np.zeros(size)
    for _ in range(rounds):
        margin = w[at_step[win]].sum(1) - w[at_step[lose]].sum(1)
        p = 1 / (1 + np.exp(np.clip(margin, -30, 30)))  # chance of the wrong order
        grad, hess = -ridge * w, ridge * np.eye(size)
        for lo in range(0, n, 20_000):
            rows = slice(lo, lo + 20_000)
            d = np.zeros((len(win[rows]), size), np.float32)
            r = np.arange(len(d))[:, None]
            np.add.at(d, (r, at_step[win[rows]]), 1)
            np.add.at(d, (r, at_step[lose[rows]]), -1)
            grad += d.T @ p[rows]
            hess += d.T @ (d * (p[rows] * (1 - p[rows]))[:, None].astype(np.float32))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-2:
            break
    model = model._replace(strength=w)
    raw = model.raw(x)
    tries = np.quantile(raw, np.arange(0, 0.9, 0.0025))
    order = np.sort(raw[good]), np.sort(raw[bad])
    right = len(good) - np.searchsorted(order[0], tries) + np.searchsorted(order[1], tries)
    best = np.flatnonzero(right == right.max())
    return model._replace(cut=float(tries[best[len(best) // 2]]))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: the features of each text, as an array. A null text is empty."""
    plain = id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for part in sized_slices(b, "text", 4_000_000):
                x = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return plain.mapInArrow(run, "doc_id long, x array<double>")


def learn_quality(docs: DataFrame, labels: DataFrame, at: float = 0.5, sample: int = 8_000, id_col: str = "doc_id",
                  text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> Ranker:
    """A ranker from the labelled rows of least id hash, ``sample`` at most: all that the driver ever gets.

    Null ids and labels are left out; an id with several labels has the smallest.
    """
    y = (labels.select(F.col(f"`{label_id}`").cast("long").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y"))
         .filter("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
         .orderBy(F.xxhash64("k"), "k").limit(sample))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    few = own.join(F.broadcast(y.select("k")), F.col("doc_id") == F.col("k"), "left_semi")  # ``sample`` ids at most
    rows = text_features(few).join(F.broadcast(y), F.col("doc_id") == F.col("k")).select("doc_id", "x", "y").collect()
    rows = sorted({(r["doc_id"], r["y"], tuple(r["x"])) for r in rows})
    x = np.array([r[2] for r in rows]).reshape(-1, len(NAMES))
    return fit_ranker(x, np.array([r[1] for r in rows], int), at)


def quality_score(ranker: Ranker, text: Column) -> Column:
    """The score of a text column, batch by batch; other columns of a row stay where they are."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.array([features(t) for t in texts]).reshape(-1, len(NAMES))))

    return score(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def score_quality(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, by its text alone. Null ids stay; a null text scores as an empty one."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), quality_score(ranker, F.col(f"`{text_col}`")).alias("score"))
