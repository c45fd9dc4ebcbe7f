"""A quality score learned from pairs of documents: Bradley-Terry ranking by logistic loss on feature differences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import arrow_map

PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
N_FEATURES = len(PUNCTUATION) + 12


@dataclass(frozen=True)
class Ranking:
    """How the model is fitted. ``most_rows`` bounds the labelled rows whose features come to the driver."""

    most_rows: int = 8_000
    pairs: int = 40_000
    ridge: float = 1.0
    steps: int = 12
    cut: float = 0.3
    folds: int = 5
    seed: int = 7


def features(text: str | None) -> np.ndarray:
    """Shares of character classes and repeated words over the whole text; square roots, so that rare marks still count."""
    x = np.zeros(N_FEATURES)
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return x
    n, w = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum()
    x[: len(PUNCTUATION)] = counts[PUNCTUATION] / w
    rest = [
        counts[65:91].sum() / max(letters, 1),
        counts[48:58].sum() / n,
        counts[32] / n,
        counts[10] / n,
        counts[128:].sum() / n,
        len(set(words)) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(w - 2, 1),
        min((n - w) / w, 40) / 10,
        sum(map(bytes.isupper, words)) / w,
        max(map(len, words)) > 60,
        min(w, 50) / 50,
    ]
    x[len(PUNCTUATION) :] = rest
    return np.sqrt(np.minimum(x, 4))


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, how: Ranking) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled training rows, at most ``most_rows``: first by the hash of their id, then of their text."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.filter(~held_out(F.col("doc_id"), how.folds))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.most_rows)  # a bound on learning, not on scoring
    order = F.struct(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).alias("place")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text", order)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), batch.column(2)], names=["label", "x", "place"])

    place = rows.schema["place"].dataType.simpleString()
    measured = arrow_map(rows, measure, f"label int, x array<double>, place {place}")
    found = measured.orderBy("place", "label").limit(how.most_rows).collect()  # ids may repeat; the bound and the order hold all the same
    return np.array([r["x"] for r in found]).reshape(-1, N_FEATURES), np.array([r["label"] for r in found], dtype=int)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights

    def score(self, x: np.ndarray, at: float) -> np.ndarray:
        """Between 0 and 1, and ``at`` for a document whose strength is the cut."""
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut + np.log(at / (1 - at)), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, how: Ranking) -> Model:
    """Newton steps on the ridge-penalised logistic loss of preference pairs (a good document over a poor one).

    The cut is the quantile of the strengths at the share of poor documents. Without both classes every strength is 0.
    """
    zero = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return zero
    centre, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    z, rng = (x - centre) / scale, np.random.default_rng(how.seed)
    d = z[rng.choice(good, how.pairs)] - z[rng.choice(poor, how.pairs)]
    w = np.zeros(N_FEATURES)
    for _ in range(how.steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # of the wrong order
        gradient = d.T @ p - how.ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + how.ridge * np.eye(N_FEATURES)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    strengths = z @ w
    below, above = np.quantile(strengths, [len(poor) / len(y), min(1.0, (len(poor) + 1) / len(y))], method="lower")
    return Model(centre, scale, w, float((below + above) / 2))


def rank_quality(docs: DataFrame, labels: DataFrame, how: Ranking | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Pairs of a good and a poor labelled document teach a linear strength by logistic loss on their features' difference; rows whose
    crc32(doc_id) is divisible by ``folds`` teach nothing. The score rises with the strength, and ``cut`` stands at the strengths'
    quantile of the share of poor documents. Only texts are scored: no label, language, source or id.
    Null or empty text: all features 0, scored like any other. Null doc_id: not held out, never a label. Several labels of an id: their
    majority, ties good. Null labels: ignored. Repeated rows: scored each. Empty tables: no rows, or the score ``cut`` for all.
    """
    how = how or Ranking()
    model = fit(*labelled(docs, labels, how), how)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(2).to_pylist()]).reshape(-1, N_FEATURES)
        scores = model.score(x, how.cut)
        predicted = pa.array((scores >= how.cut).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), predicted], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id"), how.folds).alias("held_out"), "text")
    return arrow_map(rows, score, f"doc_id {kind}, held_out boolean, score double, predicted int")
