"""Quality by Bradley-Terry pairwise ranking.

Preference pairs are a good and a poor labelled document. A document's strength is linear in features of its text, and
the logistic loss of strength differences is minimised over the pairs. The threshold is a quantile of the strengths:
the share of poor documents among the labelled ones lies below it. A score of CUT stands for that threshold.
"""

import zlib
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import utf8
from vistaquad.llm.toxicity import labelled

SAMPLE = 20_000  # labelled documents to learn from, at most; of each only its features come to the driver
PAIRS = 60_000
CUT = 0.3

_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"$%&#*@^~_=<>{}[]\\/"
N_FEATURES = 19


def features(text: bytes) -> list:
    """Shares of kinds of characters, sizes of words and lines, and how much repeats; defined for empty texts too."""
    n, words, lines = len(text), text.split(), [x for x in text.split(b"\n") if x.strip()]
    size, count = max(n, 1), max(len(words), 1)
    share = lambda kind: (n - len(text.translate(None, kind))) / size
    folded = [w.lower() for w in words]
    kinds: dict = {}
    for w in folded:
        kinds[w] = kinds.get(w, 0) + 1
    pairs = len(set(zip(folded, folded[1:], strict=False)))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        share(_LETTERS),
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        share(b"|"),
        share(b"!"),
        share(b".,"),
        share(b"\n"),
        sum(map(len, words)) / count,
        len(kinds) / count,
        np.log(count / max(len(kinds), 1)),
        max(kinds.values(), default=0) / count,
        sum(map(eq, folded, folded[1:])) / count,
        pairs / count,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(size / max(len(lines), 1)),
        len(zlib.compress(text, 1)) / (size + 20),
    ]


def _featured(batches):
    for batch in batches:
        rows = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), batch.column(2)], ["id", "x", "label"])


class Ranker:
    """Strength of a document: weights on its features and on how far each lies beyond knots of the training data."""

    QUANTILES = (0.01, 0.05, 0.15, 0.5, 0.85, 0.95, 0.99)

    def __init__(self, x: np.ndarray):
        self.knots = np.quantile(x, self.QUANTILES, axis=0)
        spread = x.std(axis=0)
        self.mean, self.scale = x.mean(axis=0), np.where(spread > 1e-9, spread, 1.0)
        self.weights, self.cut = np.zeros(x.shape[1] * (1 + len(self.QUANTILES))), 0.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        hinges = np.clip((x[:, None, :] - self.knots) / self.scale, 0, 4).reshape(len(x), -1)
        return np.concatenate([z, hinges], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.basis(x) @ self.weights - self.cut + np.log(CUT / (1 - CUT)), -40, 40)))


def rank(x: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Ranker | None:
    """Bradley-Terry strengths from pairs of a good and a poor row; None without both."""
    good, poor = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(poor):
        return None
    model, rng = Ranker(x), np.random.default_rng(seed)
    basis = model.basis(x)
    m = v = np.zeros(basis.shape[1])
    for step in range(1, rounds + 1):
        a, b = rng.choice(good, PAIRS // 20), rng.choice(poor, PAIRS // 20)
        gap = basis[a] - basis[b]
        g = -(gap / (1 + np.exp(np.clip(gap @ model.weights, -40, 40)))[:, None]).mean(axis=0) + decay * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        model.weights = model.weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    model.cut = float(np.quantile(basis @ model.weights, len(poor) / (len(good) + len(poor))))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Ranker | None:
    """Learn from a bounded sample (`sample` documents) of the labelled rows."""
    rows = labelled(docs, labels, label, sample).select("id", "text", "label").mapInArrow(_featured, "id long, x array<double>, label int").collect()
    rows = sorted(rows, key=itemgetter("id"))
    return rank(np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["label"] for r in rows]))


def _scorer(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            score = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return run


def quality(docs: DataFrame, model: Ranker | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1; CUT is the threshold).

    Null and empty texts are scored by their features like others; without a model (no labels of both kinds) every score
    is 0.5. Null ids, repeated rows and empty tables are passed on; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(_scorer(shared), f"id {dict(docs.dtypes)[id_column]}, score double")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op5"""
    scored = quality(docs, fit_quality(docs, labels))
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
