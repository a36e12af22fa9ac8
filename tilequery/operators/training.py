"""Fitting a linear triplet head on a table of feature triplets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.operators.knn import vectors_of
from tilequery.operators.select import split_exact
from tilequery.operators.transforms import MAX_DIMS, MODELS, Model
from tilequery.schema import TILE_TYPES, require
from tilequery.session import scratch_path

#: fixed values: margin, learning rate, weight decay, embedding width
MARGIN, RATE, DECAY, DIMS = 1.0, 1e-2, 0.01, 100
#: fixed values: shape of the one-cycle schedule
WARM_PART, START_DIVISOR, END_DIVISOR, MOMENTUM = 0.3, 25.0, 1e4, (0.85, 0.95)


def one_cycle_at(step: int, max_lr: float, total: int) -> tuple[float, float]:
    """Learning rate and momentum of one step: cosine up, then cosine down."""
    peak = WARM_PART * total - 1.0
    lo, hi = MOMENTUM
    cos = lambda a, b, p: b + (a - b) / 2.0 * (1.0 + np.cos(np.pi * p))
    first = max_lr / START_DIVISOR
    if step <= peak:
        p = step / peak
        return float(cos(first, max_lr, p)), float(cos(hi, lo, p))
    p = (step - peak) / (total - 1.0 - peak)
    return float(cos(max_lr, first / END_DIVISOR, p)), float(cos(lo, hi, p))


def one_cycle(spark: SparkSession, max_lr: float, epochs: int, steps_per_epoch: int) -> DataFrame:
    """Schedule table ``step, epoch, lr, momentum``."""
    total = epochs * steps_per_epoch
    if total < 1:
        raise ValueError("the schedule needs at least one step")
    peak = WARM_PART * total - 1.0
    lo, hi = MOMENTUM
    first = max_lr / START_DIVISOR
    up = F.col("step") / F.lit(peak or 1.0)
    down = (F.col("step") - F.lit(peak)) / F.lit((total - 1.0 - peak) or 1.0)

    def cos(a: float, b: float, p: Column) -> Column:
        return F.lit(b) + F.lit((a - b) / 2.0) * (1.0 + F.cos(F.lit(np.pi) * p))

    rising = F.col("step") <= F.lit(peak)
    return spark.range(total).select(
        F.col("id").cast("int").alias("step"), F.floor(F.col("id") / steps_per_epoch).cast("int").alias("epoch")
    ).withColumns(
        {
            "lr": F.when(rising, cos(first, max_lr, up)).otherwise(cos(max_lr, first / END_DIVISOR, down)),
            "momentum": F.when(rising, cos(hi, lo, up)).otherwise(cos(lo, hi, down)),
        }
    )


class HeadModel(Model):
    """``W f + b``."""

    kind = "head"

    def __init__(self, weights, bias):
        self.weights, self.bias = np.asarray(weights, dtype=float), np.asarray(bias, dtype=float)

    def params(self):
        return {"weights": self.weights, "bias": self.bias}

    def transform(self, df, vector="embedding", out="emb"):
        w, b = self.weights, self.bias

        @F.arrow_udf("array<double>")
        def run(v):
            y = vectors_of(v) @ w.T + b
            return pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))

        return df.withColumn(out, run(F.col(vector)))


MODELS[HeadModel.kind] = HeadModel


def _partials(weights: np.ndarray, margin: float):
    """Per partition: loss sums and the matrix ``Σ (a-n)(a-n)' - (a-d)(a-d)'`` of the active triplets."""

    def run(batches):
        sums, s = np.zeros(4), None
        for b in batches:
            if not b.num_rows:
                continue
            a, n, d = (vectors_of(b.column(k)) for k in range(3))
            near, far = a - n, a - d
            l_near, l_far = ((near @ weights.T) ** 2).sum(1), ((far @ weights.T) ** 2).sum(1)
            hinge = l_near - l_far + margin
            on = hinge > 0
            sums += [len(a), hinge[on].sum(), l_near.sum(), l_far.sum()]
            part = near[on].T @ near[on] - far[on].T @ far[on]
            s = part if s is None else s + part
        if s is not None:
            width = max(s.shape[1], 4)
            rows = np.zeros((len(s) + 1, width))
            rows[0, :4], rows[1:, : s.shape[1]] = sums, s
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["row", "v"]
            )

    return run


def _evaluate(rows: DataFrame, weights: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """``(n, loss, l_near, l_distant)`` means and the mean active matrix, summed by Spark."""
    part = rows.select(*TILE_TYPES).mapInArrow(_partials(weights, margin), "row int, v array<double>")
    total = part.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).take(MAX_DIMS + 1)
    if not total:
        return np.zeros(4), np.zeros((weights.shape[1],) * 2)
    table = np.array([r["v"] for r in sorted(total, key=lambda r: r["row"])])
    n = table[0, 0]
    return np.append(n, table[0, 1:4] / n), table[1:, : weights.shape[1]] / n


def fit_head(features: DataFrame, dims: int = DIMS, margin: float = MARGIN, lr: float = RATE, l2: float = DECAY, epochs: int = 5,
             n_batches: int = 8, train_fraction: float = 0.9, one_cycle_lr: bool = False, seed: int = 0, key: str = "tile_id"):
    """``(model, metrics)`` of a linear head trained with Adam on triplets ``key, anchor, neighbor, distant``.

    The training rows are stored once, laid out by batch, so a step reads its own
    batch only. A step is one job of partial sums; what comes back has the size of
    the weights. ``metrics``: ``epoch, step, split, loss, l_near, l_distant`` per step
    (``train``) and epoch (``valid``).
    """
    require(features, key, *TILE_TYPES)
    spark = features.sparkSession
    train, valid = split_exact(features.select(key, *TILE_TYPES), train_fraction, seed, key)
    batch = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.lit("batch")), F.lit(n_batches)).cast("int")
    path = scratch_path(spark)
    train.withColumn("batch", batch).repartition("batch", F.pmod(F.xxhash64(key), F.lit(32))).write.partitionBy("batch").parquet(path)
    stored = spark.read.parquet(path)
    width = len(stored.select("anchor").first()[0])
    if width > MAX_DIMS:
        raise ValueError(f"more than {MAX_DIMS} features per vector")
    rng = np.random.default_rng(seed)
    w = rng.uniform(-1.0, 1.0, (dims, width)) / np.sqrt(width)
    b = rng.uniform(-1.0, 1.0, dims) / np.sqrt(width)
    m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    metrics, t, total = [], 0, epochs * n_batches
    for epoch in range(epochs):
        for k in rng.permutation(n_batches):
            (n, loss, l_near, l_far), s = _evaluate(stored.filter(F.col("batch") == int(k)), w, margin)
            if not n:
                continue
            rate, beta1 = one_cycle_at(t, lr, total) if one_cycle_lr else (lr, 0.9)
            t += 1
            metrics.append((epoch, t, "train", float(loss), float(l_near), float(l_far)))
            for p, g, m, v in ((w, 2.0 * w @ s + l2 * w, m1, m2), (b, l2 * b, mb1, mb2)):
                m += (1.0 - beta1) * (g - m)
                v += (1.0 - 0.999) * (g * g - v)
                p -= rate * (m / (1.0 - beta1**t)) / (np.sqrt(v / (1.0 - 0.999**t)) + 1e-8)
        (n, loss, l_near, l_far), _ = _evaluate(valid, w, margin)
        if n:
            metrics.append((epoch, t, "valid", float(loss), float(l_near), float(l_far)))
    table = spark.createDataFrame(metrics, "epoch int, step int, split string, loss double, l_near double, l_distant double")
    return HeadModel(w, b), table
