"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of itself and its character n-grams (hashed into buckets), a document the weighted
sum over its distinct words, by rarity of the buckets and scaled to unit weight; a linear softmax on it gives the label.
Embeddings and softmax are learned together by gradient descent with momentum. A misspelling shares most n-grams with
the word it stands for, so it gets a vector near that word's, met or not.

The labelled documents are dealt into FOLDS; each fold is scored by a model that has not seen it, and scale and bias of
the scores are fitted on those margins so that at 0.5 both kinds of error weigh the same. The model returned is the mean
of the folds' models, which is one softmax over their embeddings side by side.
"""

import pickle
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import MIX, alnum_words, mixed, utf8

BITS = 18  # of a bucket
BUCKETS = 1 << BITS
DIM = 4
SAMPLE = 4000  # labelled documents to learn from, at most; of each at most BUCKETS weights reach the task that learns
FOLDS = 3
NGRAMS = (3, 5)
BLOCK = 1 << 20  # characters whose n-grams are held at once
LEAST = 0.002  # share of the documents (two at least) that must hold a bucket for it to get a vector
SHARE = 0.004  # of a document's words that counts in full; what a word has beyond (junk repeats) counts by its root
ROUNDS = 40
RATE, SOFTMAX_RATE, MOMENTUM = 30.0, 0.6, 0.9


def gram_blocks(words: list):
    """(bucket, index of the word) of each word and of its character n-grams, with marks for its ends; all of every word,
    however long, a block at a time."""
    n = len(words)
    yield np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - BITS) for w in words), np.int32, n), np.arange(n, dtype=np.int32)
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    holder = np.repeat(np.arange(n, dtype=np.int32), list(map(len, marked)))
    text = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    for lo in range(0, len(text), BLOCK):
        h = np.zeros(min(BLOCK, len(text) - lo), np.uint64)
        for j in range(NGRAMS[1]):
            m = min(len(h), len(text) - lo - j)
            if m <= 0:
                break
            h = h[:m] * np.uint64(MIX) + text[lo + j : lo + j + m]
            if j + 1 >= NGRAMS[0]:
                own = holder[lo : lo + m]
                whole = own == holder[lo + j : lo + j + m]
                yield (mixed(h[whole] + np.uint64(j)) >> np.uint64(64 - BITS)).astype(np.int32), own[whole]


def weight(count: np.ndarray, total: int) -> np.ndarray:
    share = count / max(total, 1)
    return np.where(share <= SHARE, share, np.sqrt(share * SHARE))


def bag(text: bytes) -> tuple:
    """The buckets of a text, ascending, and the weight of each: that of its words, dealt out among their n-grams."""
    own = alnum_words(text)
    counts: dict = {}
    for w in own:
        counts[w] = counts.get(w, 0) + 1
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    words = list(counts)
    chars = np.fromiter((len(w.decode("utf-8", "replace")) + 2 for w in words), np.int64, len(words))
    grams = 1 + sum(np.maximum(chars - n + 1, 0) for n in range(NGRAMS[0], NGRAMS[1] + 1))
    each = weight(np.fromiter(counts.values(), np.float64, len(words)), len(own)) / grams
    if chars.sum() > BLOCK:
        total = sum(np.bincount(b, weights=each[w], minlength=BUCKETS) for b, w in gram_blocks(words))
        found = np.flatnonzero(total)
        return found.astype(np.int32), total[found].astype(np.float32)
    buckets, holders = map(np.concatenate, zip(*gram_blocks(words), strict=True))
    found, place = np.unique(buckets, return_inverse=True)
    return found, np.bincount(place, weights=each[holders]).astype(np.float32)


class Model:
    """table: embeddings of the buckets; rarity: of each bucket, 0 for those without a vector."""

    def __init__(self, table: np.ndarray, softmax: np.ndarray, bias: np.ndarray, rarity: np.ndarray):
        self.table, self.softmax, self.bias, self.rarity = table, softmax, bias, rarity
        # The softmax is linear, so a bucket's share of the label's margin can be summed instead of its vector.
        self.pull = table @ (softmax[:, 1] - softmax[:, 0])
        self.base = float(bias[1] - bias[0])

    def margin(self, found: np.ndarray, weights: np.ndarray) -> float:
        x = scaled(found, weights, self.rarity)
        return self.base + float(x @ self.pull[found])

    def score(self, texts: list) -> list:
        return [1 / (1 + np.exp(-np.clip(self.margin(*bag(t)), -40, 40))) for t in texts]


def scaled(found: np.ndarray, weights: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = weights * rarity[found]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def rarities(bags: list) -> np.ndarray:
    """The squared inverse document frequency of each bucket; 0 where hardly any document holds it, for its vector would
    only be learned by heart."""
    held = np.zeros(BUCKETS, np.int64)
    for found, _ in bags:
        held[found] += 1
    return np.where(held >= max(2, LEAST * len(bags)), np.log((len(bags) + 1) / (held + 0.5)) ** 2, 0).astype(np.float32)


def descend(bags: list, labels: np.ndarray, n_vectors: int, seed: int) -> tuple:
    """Embeddings of n_vectors buckets, softmax and bias, from documents as (bucket, weight). Labels of both kinds."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (n_vectors, DIM))
    softmax, bias = rng.normal(0, DIM**-0.5, (DIM, 2)), np.zeros(2)
    ends = np.cumsum([len(found) for found, _ in bags])
    bucket, weights = (np.concatenate(x) for x in zip(*bags, strict=True))
    cuts = np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20))  # documents in blocks, which bounds what is gathered
    blocks = [(a, b, slice(ends[a - 1] if a else 0, ends[b - 1])) for a, b in zip(cuts, [*cuts[1:], len(bags)], strict=True) if a < b]
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), np.diff(ends, prepend=0))
    share = np.where(labels == 1, 1 / labels.mean(), 1 / (1 - labels.mean())) ** 0.5
    share /= share.sum()
    speed = [np.zeros_like(x) for x in (table, softmax, bias)]
    for _ in range(ROUNDS):
        across = softmax[:, 1] - softmax[:, 0]
        pull, margin = table @ across, np.empty(len(bags))
        for a, b, s in blocks:
            margin[a:b] = np.bincount(doc[s] - a, weights=weights[s] * pull[bucket[s]], minlength=b - a)
        p = 1 / (1 + np.exp(-np.clip(margin + bias[1] - bias[0], -40, 40)))
        off = (p - labels) * share
        # Of two classes one loses what the other gains, so gradients need the errors summed by bucket and nothing more.
        by_bucket = sum(np.bincount(bucket[s], weights=weights[s] * off[doc[s]], minlength=n_vectors) for _, _, s in blocks)
        turn = by_bucket @ table
        steps = np.outer(by_bucket, across), np.stack([-turn, turn], axis=1), np.array([-off.sum(), off.sum()])
        for x, v, d, rate in zip((table, softmax, bias), speed, steps, (RATE, SOFTMAX_RATE, 1.0), strict=True):
            v *= MOMENTUM
            v += d
            x -= rate * v
    return table, softmax, bias


def calibration(margin: np.ndarray, labels: np.ndarray) -> tuple:
    """Scale and bias of margins by logistic regression in which both labels weigh the same."""
    w = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    middle, spread = margin.mean(), margin.std() + 1e-9
    z = np.stack([(margin - middle) / spread, np.ones(len(margin))], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        slope = z.T @ (w * (p - labels)) + [1e-3 * a[0], 0]
        bend = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-6])
        a -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    scale = max(a[0], 1e-3) / spread
    return scale, a[1] - scale * middle


def train(bags: list, labels: np.ndarray, seed: int = 7) -> Model:
    """The mean of FOLDS models, calibrated; without two documents of each label, a model that gives every text the
    share of label 1."""
    labels = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    fold = np.zeros(len(labels), np.int64)
    for kind in (0, 1):  # each fold gets its share of both labels
        own = rng.permutation(np.flatnonzero(labels == kind))
        fold[own] = np.arange(len(own)) % FOLDS
    rarity = rarities(bags)
    used = np.flatnonzero(rarity)
    if min((labels == 0).sum(), (labels == 1).sum()) < 2 or not len(used):
        positive = labels.mean() if len(labels) else 0.5
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 2)), np.array([0, np.log((positive + 0.01) / (1.01 - positive))]), np.zeros(BUCKETS, np.float32))
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used))
    known = []
    for found, weights in bags:
        x = scaled(found, weights, rarity)
        known.append((number[found[x > 0]], x[x > 0].astype(np.float32)))
    tables, softmaxes, biases, margin = [], [], [], np.zeros(len(labels))
    for k in np.unique(fold):
        rest = np.flatnonzero(fold != k)
        table, softmax, bias = descend([known[i] for i in rest], labels[rest], len(used), seed + int(k))
        pull = table @ (softmax[:, 1] - softmax[:, 0])
        for i in np.flatnonzero(fold == k):
            margin[i] = known[i][1] @ pull[known[i][0]] + bias[1] - bias[0]
        tables.append(table), softmaxes.append(softmax), biases.append(bias)
    scale, shift = calibration(margin, labels)
    whole = np.zeros((BUCKETS, DIM * len(tables)), np.float32)
    whole[used] = np.concatenate(tables, axis=1)
    return Model(whole, scale * np.concatenate(softmaxes) / len(tables), scale * np.mean(biases, axis=0) + [-shift / 2, shift / 2], rarity)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text and label of at most `sample` labelled documents, those first by a hash of their id; of several rows of one
    id the text of least hash, so there is one row for each id whatever number of rows share it.

    Rows whose crc32(id as text) mod 5 is 0 are held out and never learned from; nor are rows with a null id or label.
    """
    own = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 != 0))
    own = own.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # chosen: `sample` rows at most
    least = F.min(F.struct(F.xxhash64("text"), "text"))["text"]  # combined where the rows are read
    return found.groupBy("id", "label").agg(least.alias("text")).select("id", "text", "label")


def _bagger(batches):
    for batch in batches:
        for i, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, weights = bag(text)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([label], pa.int32()), pa.array([found.astype("<i4").tobytes()]), pa.array([weights.astype("<f4").tobytes()])], ["id", "label", "buckets", "weights"])


def _trainer(batches):
    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    rows.sort(key=itemgetter(0, 1, 2, 3))
    labels, bags = np.array([r[1] for r in rows]), [(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<f4")) for r in rows]
    del rows
    model = train(bags, labels)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.table, model.softmax, model.bias, model.rarity))], pa.binary())], ["model"])


def _scorer(shared):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # texts that are Python objects at a time
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1).to_pylist()), pa.float64())], ["id", "score"])

    return run


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores less than threshold; no shuffle.

    Null and empty texts have no words, so all of them stay or go by the softmax's bias alone, which is below 0.5 where
    most labelled documents aren't toxic. Repeated rows stay or go together; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts), dtype="float64")

    return docs.where(score(utf8(text_column)) < threshold)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from a bounded sample (`sample` documents) of the labelled rows.

    The documents become bags where they lie; at most BUCKETS weights of each reach the one task that learns, and only
    the model comes to the driver: BUCKETS x DIM x FOLDS floats at most.
    """
    bags = labelled(docs, labels, label, sample).mapInArrow(_bagger, "id long, label int, buckets binary, weights binary")
    found = bags.repartition(1).mapInArrow(_trainer, "model binary").first()
    return Model(*pickle.loads(found["model"])) if found else train([], np.empty(0))


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1).

    Null and empty texts have no words and get the score of the softmax's bias alone. Null ids, repeated rows and empty
    tables are passed on as they are; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x (DIM x FOLDS + 2) numbers: 15 MB
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(_scorer(shared), f"id {dict(docs.dtypes)[id_column]}, score double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7"""
    scored = toxicity(docs, fit_toxicity(docs, labels))
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
