"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (words and word beginnings that
labelled rows suggest, and a few known insults) and pattern voters (how many
kinds, how dense, none at all). A generative label model estimates, from the
votes alone and by expectation-maximisation, how often each voter speaks in
either class, and how far voters depend on each other within a class; votes of
dependent voters weigh less. Its posteriors then train a linear (logistic)
classifier over vote counts, which scores every text.
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

from .common import Store, keyed, tune
from .labels import held_out, sample

#: Known insults, as lexicon voters whatever the labels say.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "disgusting", "worthless", "clown")
STEMS = (4, 5, 6)
#: Lexicon voters at most, candidates for them, in which share of the labelled toxic rows (and in how many at least) one must occur, and how many voters each of those should have.
LEXICON, CANDIDATES, SHARE, SUPPORT, VOTERS = 80, 3000, 0.004, 3, 3
PATTERNS = ("any", "two kinds", "three kinds", "dense", "none")
find_words = re.compile(r"\w+").findall


def grams(text: str) -> Counter:
    """Words in lower case (of under 40 characters: longer runs are no words), and their beginnings as stem*, with counts."""
    out: Counter = Counter()
    for w, n in Counter(find_words(text.lower())).items():
        if len(w) < 40:
            out[w] += n
            for k in STEMS:
                if len(w) > k:
                    out[w[:k] + "*"] += n
    return out


def counts(texts: list[str], lexicon: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each lexicon entry occurs in each text; words of each text."""
    place = {g: i for i, g in enumerate(lexicon)}
    stems: dict[str, list[tuple[str, int]]] = {}
    for g, i in place.items():
        if g.endswith("*"):
            stems.setdefault(g[:4], []).append((g[:-1], i))
    hits, n = np.zeros((len(texts), len(lexicon)), np.int64), np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = find_words(text.lower())
        n[row] = len(words)
        for w in set(words):
            own = [place[w]] if w in place else []
            own += [i for s, i in stems.get(w[:4], ()) if len(w) > len(s) and w.startswith(s)]
            if own:
                hits[row, own] += words.count(w)
    return hits, n


def support(toxic: int) -> float:
    return max(SUPPORT, SHARE * toxic)


def choose(has: np.ndarray, y: np.ndarray, candidates: list[str]) -> list[str]:
    """Greedy cover: the candidates that speak for the most rows of label 1 that have fewer than VOTERS so far, and for few of label 0."""
    order = sorted(range(len(candidates)), key=lambda i: (not candidates[i].endswith("*"), len(candidates[i]), candidates[i]))
    toxic, clean = has[y == 1][:, order].astype(np.float32), has[y == 0][:, order].sum(axis=0)
    want, out = np.full(len(toxic), VOTERS, np.float32), []
    while len(out) < LEXICON and len(order):
        gain = (want > 0) @ toxic - VOTERS * clean
        gain[out] = 0
        i = int(gain.argmax())
        if gain[i] < support(len(toxic)):
            break
        out.append(i)
        want -= toxic[:, i]
    return [candidates[order[i]] for i in out]


def votes(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """0 or 1 for each lexicon voter and each pattern voter."""
    kinds = (hits > 0).sum(axis=1)
    dense = hits.max(axis=1, initial=0) > 0.01 * np.maximum(n, 1)
    return np.column_stack([hits > 0, kinds > 0, kinds > 1, kinds > 2, dense, kinds == 0]).astype(float)


@dataclass
class LabelModel:
    """Vote rates of the voters by class, the weight that dependence leaves each of them, and the prior."""

    rates: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        gain = np.log(self.rates[1]) - np.log(self.rates[0])
        loss = np.log1p(-self.rates[1]) - np.log1p(-self.rates[0])
        z = (v * gain + (1 - v) * loss) @ self.weight + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation from the start that lexicon voters are right more often than not.

    Accuracies are the vote rates by class. Correlations are those of the votes'
    residuals within the classes; a voter's weight is one over the sum of
    its squared correlations with all voters, so k copies of a voter count as one.
    """
    none = v[:, -1]
    p = np.clip(0.9 * (1 - none) + 0.02, 0, 1)
    model = LabelModel(np.full((2, v.shape[1]), 0.5), np.ones(v.shape[1]), prior)
    for _ in range(rounds):
        mass = np.stack([1 - p, p])
        rates = (mass @ v + 0.5) / (mass.sum(axis=1, keepdims=True) + 1)
        spread = np.zeros((v.shape[1],) * 2)
        for c in (0, 1):
            r = v - rates[c]
            spread += (r * mass[c][:, None]).T @ r
        scale = np.sqrt(np.diag(spread)) + 1e-9
        corr = spread / scale[:, None] / scale
        weight = 1 / np.maximum(1, (np.where(np.abs(corr) > 0.1, corr, 0) ** 2).sum(axis=1))
        model = LabelModel(rates, weight, prior)
        p = model.posterior(v)
    return model


def inputs(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the linear classifier sees: votes, log counts over all entries, their density, a constant."""
    total = hits.max(axis=1, initial=0)
    return np.column_stack([votes(hits, n), np.log1p(hits.sum(axis=1)), np.log1p(1000 * total / np.maximum(n, 1)), np.ones(len(hits))])


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression on probabilities p, by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    total = weight.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - p)) / total + ridge * 0.01 * w
        h = (x * (weight * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x / total + ridge * 0.01 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Classifier:
    lexicon: list[str]
    weight: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(*counts(texts, self.lexicon)) @ self.weight, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on a bounded sample (labels.PER_CLASS rows of each label). Without labelled rows only the known insults vote."""
    tune(docs.sparkSession)
    store = Store(docs.sparkSession, "toxic")
    rows, share = sample(docs, labels, "toxic", folds=folds, fold=fold, id_col=id_col, text_col=text_col)
    rows = store.write(rows, "sample")

    def occurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(g, y) for y, t in zip(b.label, b.text) for g in grams(t)]
            yield pd.DataFrame(out, columns=["gram", "label"])

    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    df = rows.mapInPandas(occurring, "gram string, label int").groupBy("gram").agg(F.sum("label").alias("a"), F.sum(F.lit(1) - F.col("label")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    found = df.where(F.col("a") >= support(n1)).withColumn("odds", odds).where("odds > 3").orderBy((F.col("a") * F.col("odds")).desc(), "gram").limit(CANDIDATES)
    candidates = [r.gram for r in found.collect()]

    def having(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = counts(b.text.tolist(), candidates)[0] > 0
            yield pd.DataFrame({"label": b.label, "own": [np.flatnonzero(h) for h in hits]})

    own = rows.select("label", "text").mapInPandas(having, "label int, own array<int>").collect()
    has = np.zeros((len(own), len(candidates)), bool)
    for i, r in enumerate(own):
        has[i, r.own] = True
    lexicon = sorted({*choose(has, np.array([r.label for r in own]), candidates), *INSULTS})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits, n = counts(b.text.tolist(), lexicon)
            yield pd.DataFrame({"doc_id": b.doc_id, "label": b.label, "n": n, "hits": list(hits)})

    got = rows.select("doc_id", "label", "text").mapInPandas(counted, "doc_id long, label int, n long, hits array<long>").orderBy("doc_id", "label", "n").toPandas()
    store.drop("sample")
    if not len(got):
        hits, n = np.vstack([np.zeros(len(lexicon), np.int64), np.eye(len(lexicon), dtype=np.int64)]), np.full(len(lexicon) + 1, 100)
        return Classifier(lexicon, logistic(inputs(hits, n), (hits.sum(axis=1) > 0) * 0.96 + 0.02, np.ones(len(hits))))
    hits, n, y = np.stack(got.hits.to_numpy()), got.n.to_numpy(), got.label.to_numpy()
    # the sample has as many rows of each label as there are; weights give the classes the share they have among all labels
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    v = votes(hits, n)
    model = label_model(v, prior=min(0.95, max(0.05, (y == 1).mean())))
    return Classifier(lexicon, logistic(inputs(hits, n), model.posterior(v), weight))


def score(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone.

    Null and empty texts get the score of a text without any vote; ids may be
    null or repeat; no rows give no rows.
    """
    tune(docs.sparkSession)
    classifier = train(docs, labels, folds=folds, fold=fold, id_col=id_col, text_col=text_col)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "score": classifier.score(b.text.tolist())})

    rows = keyed(docs, id_col, text_col).mapInPandas(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that the classifier does not predict to be toxic."""
    tune(docs.sparkSession)
    classifier = train(docs, labels, id_col=id_col, text_col=text_col)

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(classifier.score(["" if t is None else t for t in text]))

    return docs.where(toxic(F.col(text_col).cast("string")) < threshold).select(*docs.columns)
