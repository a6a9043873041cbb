"""Two-tower scoring: pooling, forward passes and the in-batch loss."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layer = tuple[np.ndarray, np.ndarray]


def mean_pooled(histories: DataFrame, vectors: DataFrame, dim: int, request: str = "request_id", items: str = "history_item_ids", key: str = "item_id", vector: str = "v") -> DataFrame:
    """(request, v): mean vector of a history's known items; null if none is.

    An item counts as often as the history has it.
    """
    long = histories.select(request, F.explode(items).alias(key)).where(F.col(key).isNotNull()).join(vectors.select(key, vector), key)
    parts = long.groupBy(request).agg(*(F.avg(F.col(vector)[j].cast("double")).alias(f"__{j}") for j in range(dim)))
    return parts.select(request, F.array(*(F.col(f"__{j}") for j in range(dim))).alias("v"))


def attention_pool(query: np.ndarray, history: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Softmax attention of each query over its unmasked history; zeros if empty."""
    score = np.einsum("bd,bld->bl", query, history) / np.sqrt(query.shape[1])
    score = np.where(mask, score, -np.inf)
    top = np.where(mask.any(1), score.max(1, initial=-np.inf), 0)
    w = np.where(mask, np.exp(score - top[:, None]), 0)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
    return np.einsum("bl,bld->bd", w, history)


def lstm_pool(history: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Last hidden state of an LSTM over right-aligned histories.

    Gates are in the order input, forget, cell, output; padding leaves the
    state as it is.
    """
    n, d = len(history), u.shape[0]
    h, c = np.zeros((n, d)), np.zeros((n, d))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t in range(history.shape[1]):
        i, f, g, o = np.split(history[:, t] @ w + h @ u + b, 4, axis=1)
        nc = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        nh = sigmoid(o) * np.tanh(nc)
        on = mask[:, t : t + 1]
        h, c = np.where(on, nh, h), np.where(on, nc, c)
    return h


def forward(x: np.ndarray, layers: Sequence[Layer]) -> np.ndarray:
    """ReLU layers, a linear last one, then unit length."""
    for n, (w, b) in enumerate(layers):
        x = x @ w + b
        if n < len(layers) - 1:
            x = np.maximum(x, 0)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def export_vectors(df: DataFrame, key: str, features: str, layers: Sequence[Layer]) -> DataFrame:
    """(key, v): unit tower outputs; raises on a vector that is not finite."""
    dim = layers[-1][0].shape[1]
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = forward(np.array(b.column(features).to_pylist(), np.float64), layers)
                if not np.isfinite(v).all():
                    raise ValueError("a tower output is not finite")
                offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=[key, "v"])

    return df.where(F.col(features).isNotNull()).select(key, features).mapInArrow(run, f"{key} {kind}, v array<double>")


def batch_loss(users: np.ndarray, items: np.ndarray, ids: np.ndarray, temperature: float = 1.0, log_q: np.ndarray | None = None, alpha: float = 1.0) -> float:
    """Mean softmax loss of each row's item among the batch's items.

    Other rows with the same item are masked; ``log_q`` corrects for the items'
    sampling frequency.
    """
    logit = users @ items.T / temperature
    if log_q is not None:
        logit = logit - alpha * log_q[None, :]
    same = (ids[:, None] == ids[None, :]) & ~np.eye(len(ids), dtype=bool)
    logit = np.where(same, -np.inf, logit)
    top = logit.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(logit - top).sum(1)) + top[:, 0] - np.diag(logit)))


def in_batch_losses(df: DataFrame, batch: str, temperature: float = 1.0) -> DataFrame:
    """(batch, n, loss) from user_v, item_v, item_id (and log_q) of each row.

    A batch is bounded by the caller's batch size.
    """
    corrected = "log_q" in df.columns
    kind = dict(df.dtypes)[batch]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        u, i = np.array(f["user_v"].tolist(), float), np.array(f["item_v"].tolist(), float)
        loss = batch_loss(u, i, f["item_id"].to_numpy(), temperature, f["log_q"].to_numpy(float) if corrected else None)
        return pd.DataFrame({batch: [f[batch].iloc[0]], "n": [len(f)], "loss": [loss]})

    return df.groupBy(batch).applyInPandas(run, f"{batch} {kind}, n long, loss double")
