"""Quality by regularised quadratic discriminant analysis over document statistics.

Each text becomes a vector of transformed statistics. Each class has a mean
and a covariance, shrunk towards the pooled one and towards a multiple of the
identity; their Cholesky factors are computed once and shipped. A text's score
comes from the difference of the two Mahalanobis log-densities, through a
logistic curve fitted on the same sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, tune
from .labels import held_out, sample
from .toxicity import logistic

STATISTICS = (
    "chars", "words", "word length", "word length spread", "capitals", "capital words", "digits", "signs", "junk signs", "bars", "cries", "commas and stops",
    "distinct words", "longest word", "repeated lines", "line length", "entropy", "short words", "repeated halves", "starts capital",
)
#: Shrinkage towards the pooled covariance, and towards the identity.
POOL, IDENTITY = 0.2, 0.02
#: Bounds of the standardised statistics, so that a single odd value cannot decide alone.
BOUND = 6.0
JUNK = re.compile(r"[#$%&*@^~|<>{}\\]")


def statistics(text: str) -> list[float]:
    """Logs of counts, and shares as log odds; of a text without words, those of nothing."""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    m = len(words)
    share = lambda k, of: float(np.log((k + 0.5) / (max(of, k) - k + 0.5 + 0.01 * of)))
    lengths = np.fromiter(map(len, words), np.float64, m) if m else np.zeros(1)
    chars = Counter(text)
    alpha = sum(k for c, k in chars.items() if c.isalpha())
    upper = sum(k for c, k in chars.items() if c.isupper())
    digit = sum(k for c, k in chars.items() if c.isdigit())
    space = sum(k for c, k in chars.items() if c.isspace())
    junk = sum(k for c, k in chars.items() if JUNK.match(c))
    p = np.array(list(chars.values())) / max(n, 1)
    kinds = len(set(words))
    half = Counter(words[: m // 2]) & Counter(words[m // 2 :])
    return [
        np.log1p(n), np.log1p(m), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())), share(upper, alpha), share(sum(map(str.isupper, words)), m), share(digit, n), share(n - alpha - digit - space, n), share(junk, n),
        share(chars["|"], m), share(chars["!"], m), share(chars[","] + chars["."], m), share(kinds, m), float(np.log1p(lengths.max())), share(len(lines) - len(set(lines)), len(lines)), float(np.log1p(n / max(1, len(lines)))),
        float(-(p * np.log(p)).sum()) if n else 0.0, share(int((lengths <= 3).sum()) if m else 0, m), share(sum(half.values()), m), float(text[:1].isupper()),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants by class, over standardised statistics; the curve from log-density difference to score."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    curve: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -BOUND, BOUND)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = self.standard(x)
        d = [-0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - 0.5 * g for m, w, g in zip(self.means, self.whiten, self.logdet)]
        return d[1] - d[0]

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        d = self.difference(np.array([statistics(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(curved(d) @ self.curve, -30, 30)))


def curved(d: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sign(d) * np.log1p(np.abs(d)), np.ones(len(d))])


def fit(x: np.ndarray, y: np.ndarray, share: float, pool: float = POOL, identity: float = IDENTITY) -> Discriminant:
    """From statistics and labels; share is that of label 1 among all rows, of which these are a sample."""
    k = x.shape[1]
    if not (0 < y.sum() < len(y)):
        one = min(0.99, max(0.01, share))
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((2, k)), np.stack([np.eye(k)] * 2), np.zeros(2), np.array([0.0, np.log(one / (1 - one))]))
    centre, scale = np.median(x, axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -BOUND, BOUND)
    means = np.stack([z[y == c].mean(axis=0) for c in (0, 1)])
    own = [(r := z[y == c] - means[c]).T @ r / max(1, len(r)) for c in (0, 1)]
    pooled = sum(c * (y == i).mean() for i, c in enumerate(own))
    whiten, logdet = [], []
    for c in own:
        s = (1 - pool) * c + pool * pooled
        s = (1 - identity) * s + identity * (np.trace(s) / k + 1e-3) * np.eye(k)
        low = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    out = Discriminant(centre, scale, means, np.stack(whiten), np.array(logdet), np.zeros(2))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    out.curve = logistic(curved(out.difference(x)), y.astype(float), weight)
    return out


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fit on a bounded sample (labels.PER_CLASS rows of each label); without rows of both labels the score is their share."""
    tune(docs.sparkSession)
    rows, share = sample(docs, labels, "quality", folds=folds, fold=fold, id_col=id_col, text_col=text_col)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "label": b.label, "x": [statistics(t) for t in b.text]})

    got = rows.mapInPandas(described, "doc_id long, label int, x array<double>").orderBy("doc_id", "label", "x").toPandas()
    x = np.stack(got.x.to_numpy()) if len(got) else np.zeros((0, len(STATISTICS)))
    return fit(x, got.label.to_numpy(), share)


def score(docs: DataFrame, labels: DataFrame, *, folds: int = 4, fold: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone.

    Null texts count as empty, and empty texts have statistics too; ids may be
    null or repeat; no rows give no rows.
    """
    tune(docs.sparkSession)
    model = train(docs, labels, folds=folds, fold=fold, id_col=id_col, text_col=text_col)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "score": model.score(b.text.tolist())})

    rows = keyed(docs, id_col, text_col).mapInPandas(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
