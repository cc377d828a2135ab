"""Quality classifier by supervised subword embeddings.

A text is the bag of its words, its pairs of neighbouring words and its byte n-grams, each hashed
into ``BUCKETS`` learned vectors; the vectors are averaged and a softmax layer gives the classes.
Vectors and layer are fitted together by stochastic gradient descent in numpy, on the driver, over
at most ``TRAIN_PER_CLASS`` labelled documents of each class (those with the smallest hashes of
doc_id), and at most ``TRAIN_CHARS`` characters of each. A pair of equal words also counts for a bucket of its own, so that repetition is learned
for words never seen.

Scoring needs no vectors: the layer's weights are folded into one number for each bucket, so a task
looks up a table of 4 bytes a bucket. Whole texts are scored. Null and empty texts have no features:
their score is what the layer's bias says. Documents with a null label or without one don't train.
Of rows with one doc_id one text trains. Without any usable label every score is 0.5. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Texts, Words, hash_grams, held_out, mix, read, sums_between, text_slices

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
GRAMS = (3, 4, 5)
#: Bound of the training sample: documents of each label.
TRAIN_PER_CLASS = 600
#: Characters of a document that the model is trained on.
TRAIN_CHARS = 20_000
THRESHOLD = 0.3
DIM = 8
VECTOR_STEP = 8.0


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(texts: Texts):
    """Pairs (buckets, bounds): the features of text i are buckets[bounds[i]:bounds[i + 1]]."""
    words = Words(texts, SPACE, lower=False)
    yield _bucket(mix(words.hashes)), words.first  # mixed once more, so that a word and an equal n-gram differ
    h, follows = words.hashes, np.ones(len(words), bool)
    follows[words.first[:-1][np.diff(words.first) > 0]] = False
    at = np.flatnonzero(follows)
    with np.errstate(over="ignore"):
        pair = _bucket(mix(h[at - 1] * np.uint64(3) + h[at]))
    pair[h[at - 1] == h[at]] = 0
    yield pair, np.searchsorted(at, words.first)
    position = np.arange(len(words.data))
    ends = np.repeat(texts.bounds[1:], np.diff(texts.bounds))
    for n in GRAMS:
        start = position[position + n <= ends]
        yield _bucket(hash_grams(words.data, start, n)), np.searchsorted(start, texts.bounds)


class Model:
    """Folded weights: the log-odds of class 1 is bias + the mean of weight over a text's features."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def score(self, texts: Texts) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, bounds in features(texts):
            total += sums_between(self.weight[buckets], bounds)
            count += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -60, 60)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 2.0, batch: int = 16, seed: int = 7) -> Model:
    """Stochastic gradient descent over minibatches; the rate falls linearly to zero."""
    docs = []
    for _, _, part in text_slices(pa.array(texts, pa.large_string())):
        found = list(features(part))
        for i in range(len(part)):
            ids, many = np.unique(np.concatenate([b[o[i] : o[i + 1]] for b, o in found]), return_counts=True)
            docs.append((ids, (many / max(1, many.sum())).astype(np.float32)))
    if not docs:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)) if docs else ():
            now = rate * (1 - done / steps)
            done += len(pick)
            hidden = np.stack([docs[i][1] @ vectors[docs[i][0]] for i in pick])
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target[pick]) / len(pick)
            back = error @ out.T
            out -= now * hidden.T @ error
            bias -= now * error.sum(0)
            # A share is tiny, so vectors take longer steps than the layer does.
            for i, d in zip(pick, back, strict=True):
                vectors[docs[i][0]] -= VECTOR_STEP * len(pick) * now * docs[i][1][:, None] * d
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def training_sample(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``per_class`` labelled documents of each class, none held out."""
    labels = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("quality").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = [labels.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    # A passage of each, from a place that its doc_id decides, and one row of a doc_id: what comes to the driver is bounded.
    first = 1 + F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1)).cast("long")).cast("int")
    passage = F.substring("text", first, F.lit(TRAIN_CHARS)).alias("text")
    found = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "label", passage)
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "label"])
    return rows["text"].tolist(), rows["label"].to_numpy(np.int64)


def score_documents(documents: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``documents`` with a column of scores (replaced, if there is one of that name)."""
    documents = documents.drop(name)
    schema = documents.withColumn(name, F.lit(0.0)).schema
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts))], names=[*part.schema.names, name])

    return documents.mapInArrow(run, schema)


def quality(documents: DataFrame, labels: DataFrame, name: str = "quality_score") -> DataFrame:
    """Train on ``labels`` and score all documents."""
    return score_documents(documents, fit(*training_sample(documents, labels)), name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
