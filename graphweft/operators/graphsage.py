"""GraphSAGE: mean aggregation, tanh layers, training by analytic gradients."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph
from graphweft.operators.edges import steps_from
from graphweft.runtime import cut

#: Rows that training takes to the driver at most.
TRAIN_ROWS = 1_000_000
LOSSES = ("mse", "bce", "softmax")


@dataclass(frozen=True)
class Config:
    layers: int
    inputs: int
    outputs: int
    sample: int = 10
    normalise: bool = True
    seed: int = 0


@dataclass
class Model:
    """Layer k: tanh(own W + mean of neighbours V + b), the first from inputs, all to outputs."""

    config: Config
    own: list[np.ndarray]
    near: list[np.ndarray]
    bias: list[np.ndarray]

    @staticmethod
    def create(config: Config) -> Model:
        if min(config.layers, config.inputs, config.outputs, config.sample) < 1:
            raise GraphError("INVALID_ARGUMENT", "sizes start at 1")
        r = np.random.default_rng(config.seed)
        sizes = [config.inputs] + [config.outputs] * config.layers
        make = lambda a, b: r.uniform(-1, 1, (a, b)) / np.sqrt(a)
        return Model(config, [make(a, b) for a, b in zip(sizes, sizes[1:], strict=False)], [make(a, b) for a, b in zip(sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]])

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"config": self.config.__dict__, "own": [w.tolist() for w in self.own], "near": [w.tolist() for w in self.near], "bias": [b.tolist() for b in self.bias]}, f)

    @staticmethod
    def load(path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return Model(Config(**d["config"]), *[[np.array(w) for w in d[k]] for k in ("own", "near", "bias")])


def sampled(graph: PropertyGraph, config: Config, type_: str | None = None, direction: str = "both") -> DataFrame:
    """near, far: at most `sample` neighbours of each node, those of the least seeded hash."""
    edges = steps_from(graph, type_, direction).select("near", "far").distinct()
    rank = F.row_number().over(Window.partitionBy("near").orderBy(F.xxhash64(F.lit(config.seed), "near", "far"), "far"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= config.sample).select("near", "far")


def infer(graph: PropertyGraph, model: Model, features: DataFrame, type_: str | None = None, direction: str = "both") -> DataFrame:
    """id, vector for each row of features (id, features): one join and mean a layer, then Arrow batches of products."""
    c = model.config
    edges = cut(sampled(graph, c, type_, direction))
    now, size = features.select("id", F.col("features").cast("array<double>").alias("h")), c.inputs
    for k in range(c.layers):
        mean = edges.join(now, F.col("far") == F.col("id")).groupBy("near").agg(F.array(*[F.avg(F.get("h", i)) for i in range(size)]).alias("m"))
        joined = now.join(mean, F.col("id") == F.col("near"), "left").select("id", "h", F.coalesce("m", F.array_repeat(F.lit(0.0), size)).alias("m"))
        own, near, bias, last = model.own[k], model.near[k], model.bias[k], k == c.layers - 1 and c.normalise

        def layer(batches: Iterator[pd.DataFrame], own=own, near=near, bias=bias, last=last) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    h = np.tanh(np.stack(b["h"].to_numpy()) @ own + np.stack(b["m"].to_numpy()) @ near + bias)
                    if last:
                        h = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
                    yield pd.DataFrame({"id": b["id"], "h": list(h)})

        now, size = cut(joined.mapInPandas(layer, "id long, h array<double>")), c.outputs
    return now.select("id", F.col("h").alias("vector"))


@dataclass
class Training:
    train_rows: int
    validation_rows: int
    batches: int
    train_loss: float
    validation_loss: float | None
    history: list[tuple[float, float | None]] = field(default_factory=list)
    converged: bool = False
    accuracy: float = 0.0


def forward(model: Model, x: np.ndarray, mean: np.ndarray | Neighbours, linear: bool) -> tuple[np.ndarray, list]:
    """Outputs and what the backward pass needs. mean: row-stochastic neighbour matrix. linear: no tanh at the end."""
    h, kept = x, []
    for k, (own, near, bias) in enumerate(zip(model.own, model.near, model.bias, strict=True)):
        m = mean @ h
        z = h @ own + m @ near + bias
        out = z if linear and k == len(model.own) - 1 else np.tanh(z)
        kept.append((h, m, out))
        h = out
    return h, kept


def loss_of(z: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    """Mean loss over the entries (mse, bce) or rows (softmax), and its gradient."""
    if loss == "mse":
        d = z - y
        return float((d * d).mean()), 2 * d / d.size
    if loss == "bce":
        p = 1 / (1 + np.exp(-z))
        return float(-(y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12))).mean()), (p - y) / z.size
    e = np.exp(z - z.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return float(-(y * np.log(np.maximum(p, 1e-12))).sum(1).mean()), (p - y) / len(z)


def backward(model: Model, mean: np.ndarray | Neighbours, kept: list, grad: np.ndarray, linear: bool) -> list[tuple]:
    out = []
    for k in reversed(range(len(model.own))):
        h, m, y = kept[k]
        if not (linear and k == len(model.own) - 1):
            grad = grad * (1 - y * y)
        out.append((h.T @ grad, m.T @ grad, grad.sum(0)))
        grad = grad @ model.own[k].T + mean.T @ (grad @ model.near[k].T)
    return out[::-1]


class Neighbours:
    """Row-stochastic matrix of rows and their neighbours, kept as links: memory grows with links, not with n * n."""

    def __init__(self, n: int, rows: np.ndarray, columns: np.ndarray, share: np.ndarray | None = None):
        self.n, self.rows, self.columns = n, rows, columns
        self.share = 1.0 / np.bincount(rows, minlength=n)[rows] if share is None else share

    @property
    def T(self) -> Neighbours:  # noqa: N802
        return Neighbours(self.n, self.columns, self.rows, self.share)

    def __matmul__(self, h: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows, self.share * h[self.columns, j], self.n) for j in range(h.shape[1])], axis=1)


def _neighbours(ids: np.ndarray, edges: DataFrame, fitted: DataFrame) -> Neighbours:
    """Links among the fitted rows alone come to the driver. ids rise."""
    for end in ("near", "far"):
        edges = edges.join(fitted.select(F.col("id").alias(end)), end, "left_semi")
    links = edges.select("near", "far").toArrow()
    near, far = (np.searchsorted(ids, links.column(c).to_numpy(), "right") - 1 for c in ("near", "far"))
    return Neighbours(len(ids), near, far)


def train(graph: PropertyGraph, model: Model, data: DataFrame, epochs: int = 1, rate: float = 0.01, batch: int = 0, validation: float = 0.0, loss: str = "mse", tolerance: float = 0.0, seed: int = 0, type_: str | None = None) -> Training:
    """Fit in place on rows (id, features, targets), in id order; the last share `validation` of them validates.

    Targets of bce lie in [0, 1]; rows of softmax sum to 1. Up to TRAIN_ROWS rows, and at most `sample` links of each
    that end in such rows, go to the driver; inference stays distributed.
    """
    if loss not in LOSSES or epochs < 1 or not 0 <= validation < 1 or rate <= 0:
        raise GraphError("INVALID_ARGUMENT", "training options")
    rows = data.orderBy("id").limit(TRAIN_ROWS + 1).collect()
    if len(rows) > TRAIN_ROWS:
        raise GraphError("LIMIT", f"more than {TRAIN_ROWS} rows")
    ids = np.array([r["id"] for r in rows], np.int64)
    x, y = np.array([r["features"] for r in rows], float), np.array([r["targets"] for r in rows], float)
    if x.shape[1:] != (model.config.inputs,) or y.shape[1:] != (model.config.outputs,):
        raise GraphError("INVALID_ARGUMENT", "sizes of features or targets")
    if loss == "bce" and ((y < 0) | (y > 1)).any() or loss == "softmax" and (np.abs(y.sum(1) - 1) > 1e-6).any():
        raise GraphError("INVALID_ARGUMENT", f"targets of {loss}")
    mean = _neighbours(ids, sampled(graph, model.config, type_), data)
    n = len(ids)
    held = int(round(n * validation))
    fit, val = np.arange(n - held), np.arange(n - held, n)
    linear = loss != "mse"
    r = np.random.default_rng(seed)
    size = batch or len(fit)
    out = Training(len(fit), held, 0, 0.0, None)
    for _ in range(epochs):
        order = r.permutation(fit)
        for at in range(0, len(order), size):
            rows_ = order[at : at + size]
            z, kept = forward(model, x, mean, linear)
            grad = np.zeros_like(z)
            _, grad[rows_] = loss_of(z[rows_], y[rows_], loss)
            for k, (a, b, c) in enumerate(backward(model, mean, kept, grad, linear)):
                model.own[k] = model.own[k] - rate * a
                model.near[k] = model.near[k] - rate * b
                model.bias[k] = model.bias[k] - rate * c
            out.batches += 1
        z, _ = forward(model, x, mean, linear)
        now = loss_of(z[fit], y[fit], loss)[0], loss_of(z[val], y[val], loss)[0] if held else None
        out.history.append(now)
        if len(out.history) > 1 and abs(out.history[-2][0] - now[0]) < tolerance:
            out.converged = True
            break
    out.train_loss, out.validation_loss = out.history[-1]
    if loss != "mse":
        z, _ = forward(model, x, mean, linear)
        out.accuracy = float((z[fit].argmax(1) == y[fit].argmax(1)).mean()) if loss == "softmax" else float(((z[fit] > 0) == (y[fit] > 0.5)).mean())
    return out


def predict_probabilities(graph: PropertyGraph, model: Model, features: DataFrame, type_: str | None = None) -> DataFrame:
    """id, probabilities (softmax of the outputs), class, confidence."""
    out = infer(graph, model, features, type_)
    e = F.transform("vector", lambda x: F.exp(x))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    p = out.select("id", F.transform(e, lambda x: x / total).alias("probabilities"))
    top = F.array_max("probabilities")
    return p.select("id", "probabilities", (F.array_position("probabilities", top) - 1).cast("int").alias("class"), top.alias("confidence"))
