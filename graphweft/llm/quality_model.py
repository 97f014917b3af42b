"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per text, with softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import bounded_batches, mix64, powers, stored, table, text_blocks, text_bytes

#: Rows of the table of vectors.
BUCKETS = 1 << 17
#: Characters in an n-gram; words are marked at both ends.
SIZES = (3, 4)
DIMENSIONS = 16
#: Labelled rows that the model is fitted on, at most, and their distinct features together.
TRAIN_ROWS = 4000
TRAIN_FEATURES = 24_000_000
EPOCHS = 6
#: Step lengths for the output and for the vectors, whose gradients are shared out among a text's many features.
RATE, VECTOR_RATE = 0.5, 100.0
THRESHOLD = 0.7
ROWS = 256

#: A word that is the same as the one so many words before it counts as a marker word besides: a text that repeats
#: itself shows in the same feature whatever it repeats.
LAGS = (1, 2, 3)

SPACES = np.array([32, *range(9, 14)], np.uint32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts (words, repeat markers, then n-grams of characters by size), and the text of each."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    head = (data & 0xC0) != 0x80  # first bytes of characters
    upto = np.concatenate([[0], np.cumsum(head)])
    bounds = upto[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    # a gap before, between and after texts
    size = len(chars) + n + max(SIZES)
    inside, value, text = np.zeros(size, bool), np.full(size, 0x1234567, np.uint64), np.zeros(size, np.int64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    place = np.arange(len(chars)) + owner + 1
    text[place] = owner
    inside[place] = ~np.isin(chars, SPACES)
    at = place[inside[place]]
    value[at] = mix64(chars[inside[place]].astype(np.uint64) + np.uint64(1))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    buckets, of = [], []
    if len(starts):
        first = np.searchsorted(at, starts)
        length = np.diff(np.append(first, len(at)))
        nth = np.arange(len(at)) - np.repeat(first, length)
        words = mix64(np.add.reduceat(value[at] * powers(int(length.max()))[nth], first))
        buckets.append((words >> np.uint64(47)).astype(np.int64) % BUCKETS)
        of.append(text[starts])
        for lag in LAGS:
            same = (words[lag:] == words[:-lag]) & (of[0][lag:] == of[0][:-lag])
            buckets.append(np.full(int(same.sum()), int(mix64(np.full(1, lag, np.uint64))[0] >> np.uint64(47)) % BUCKETS))
            of.append(of[0][lag:][same])
    for k in SIZES:
        m = size - k + 1
        key, whole = np.zeros(m, np.uint64), np.ones(m, bool)
        for d in range(k):
            key = key * np.uint64(0x100000001B3) + value[d : d + m]
            if 0 < d < k - 1:
                whole &= inside[d : d + m]
        found = np.flatnonzero(whole)
        buckets.append((mix64(key[found] + np.uint64(k)) >> np.uint64(47)).astype(np.int64) % BUCKETS)
        of.append(text[found + 1])
    return np.concatenate(buckets), np.concatenate(of)


class Model:
    """Vectors E (a row a bucket) and output weights W of two classes; fitted by stochastic gradient descent."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.vectors = ((r.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
        self.weights = np.zeros((2, DIMENSIONS), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.rng = r
        self.table: np.ndarray | None = None

    @staticmethod
    def gradients(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, share: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Loss of one text, and its gradients with respect to its features' vectors, the weights and the biases."""
        hidden = share @ vectors
        z = weights @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        loss = -float(np.log(max(p[label], 1e-30)))
        p[label] -= 1
        return loss, np.outer(share, p @ weights), np.outer(p, hidden), p

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
        """rows: (distinct buckets, their share in the text, class)."""
        step, steps = 0, max(1, epochs * len(rows))
        for _ in range(epochs):
            for k in self.rng.permutation(len(rows)):
                buckets, share, label = rows[k]
                now = 1 - step / steps
                step += 1
                if not len(buckets):
                    continue
                own = self.vectors[buckets]
                _, to_vectors, to_weights, to_bias = self.gradients(own, self.weights, self.bias, share, label)
                self.vectors[buckets] = own - (now * VECTOR_RATE) * to_vectors.astype(np.float32)
                self.weights -= (now * rate) * to_weights.astype(np.float32)
                self.bias -= (now * rate) * to_bias.astype(np.float32)
        return self.freeze()

    def freeze(self) -> Model:
        """The output is linear in the mean vector, so one number for each bucket is all that scoring needs."""
        self.table = (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        """The softmax share of class 1. A text without features has that of the biases."""
        buckets, owner = features(texts)
        n = len(texts)
        total = np.bincount(owner, weights=self.table[buckets], minlength=n)
        count = np.bincount(owner, minlength=n)
        z = total / np.maximum(count, 1) + float(self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    buckets, owner = features(texts)
    key, count = np.unique(owner * BUCKETS + buckets, return_counts=True)
    ends = np.searchsorted(key, np.arange(1, len(texts) + 1) * BUCKETS)
    out = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        out.append(((key[a:b] % BUCKETS).astype(np.int32), (count[a:b] / max(1, count[a:b].sum())).astype(np.float32)))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS, most_features: int = TRAIN_FEATURES) -> Model:
    """Learn from the labelled rows of `docs`, at most `most`: the first by a hash of the id.

    Rows of `labels` without an id or label teach nothing; an id with several labels has the least, and one with
    several texts the first of them. A null text counts as empty. Texts become features on the executors; the driver
    takes them until they are `most_features` together. Without any labelled row every text scores one half.
    """
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    chosen = named.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # bounded: `most` ids; repeated ones are reduced before and after the shuffle
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    bounded_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            made = shares(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("at"), block.column("label"), pa.array([b.tobytes() for b, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())], ["at", "label", "buckets", "shares"])

    ready = found.select(F.struct(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("i")).alias("at"), "label", "text").select(F.concat_ws(":", F.lpad(F.hex("at.h"), 16, "0"), "at.i").alias("at"), "label", "text")
    rows = stored(ready.mapInArrow(extract, "at string, label int, buckets binary, shares binary"), "features")
    taken, used = [], 0
    for r in rows.orderBy("at").toLocalIterator():
        used += len(r.buckets) // 4
        if used > most_features and taken:
            break
        taken.append((np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32), int(r.label == 1)))
    return Model().fit(taken)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with score and predicted (these replace columns of those names), from the text alone.

    Null and empty texts, and texts of white space, get the model's prior. Rows are taken one by one.
    """
    bounded_batches(docs.sparkSession)
    slim = Model.__new__(Model)
    slim.table, slim.bias = model.table, model.bias
    sent = docs.sparkSession.sparkContext.broadcast(slim)  # one float for each of a fixed number of buckets
    new = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    old = [f for f in docs.schema.fields if f.name not in new]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            score = np.concatenate([sent.value.score(block.column("__text").slice(at, ROWS)) for at in range(0, block.num_rows, ROWS)])
            made = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*[block.column(f.name) for f in old], *made], [*[f.name for f in old], *new])

    schema = T.StructType([*old, *[T.StructField(k, t) for k, t in new.items()]])
    return docs.select(*[F.col(f"`{f.name}`") for f in old], F.col(f"`{text_col}`").alias("__text")).mapInArrow(mark, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out()))
    return score_quality(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")
