"""Discriminative half of the train / evaluate sweep (T1, T2): one logistic model per subsample, with early stopping.

All models are trained together.  A round is one pass over the examples: every task adds up the gradients of the
models it meets, one aggregation sums them, and the models move on.  The weights (models x ``dims``) are the
only thing that travels to and from the driver; their number is checked against ``MAX_WEIGHTS`` before any work.

Gradients and losses are summed as whole multiples of 2^-32, so sums do not depend on the order of rows, the
partitioning, or on tasks that ran twice; a rerun gives the same weights to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.hashing import hash_u32
from varietas.operators.sweep import _tokens_of, token_counts
from varietas.session import cut_lineage

MAX_WEIGHTS = 4_000_000     # 32 MB of doubles, sent to every task once a round
_UNIT = float(2 ** 32)      # rows of one model may number 2^31 before a sum of units could overflow


@dataclass(frozen=True)
class Settings:
    """``dims`` buckets of the hashed vocabulary, ``rounds`` at most, ``patience`` rounds without a lower validation
    loss before a model stops, ``decay`` the L2 weight, ``valid_fraction`` of the training rows held back."""

    dims: int = 4096
    rounds: int = 60
    patience: int = 5
    decay: float = 1e-3
    valid_fraction: float = 0.33
    seed: int = 42

    @property
    def step(self) -> float:
        # the features have length one and the bias adds one: the loss has curvature of at most 2 / 4 + decay
        return 1.0 / (0.5 + self.decay)


def text_vectors(rows: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, idx, val): hashed bag of words of each distinct document in ``rows``, 1 + ln(count), of length one.

    ``docs`` holds (doc_id, text) or (doc_id, tokens).  Null or wordless texts get empty arrays.  An array has at most ``dims`` entries.
    """
    ids = rows.select("doc_id").distinct()
    counts = token_counts(_tokens_of(ids, docs), ["doc_id"])
    bucket = F.pmod(F.xxhash64("token"), F.lit(settings.dims)).cast("int")
    tf = counts.groupBy("doc_id", bucket.alias("b")).agg(F.sum("cnt").alias("cnt"))
    tf = tf.withColumn("v", 1.0 + F.log(F.col("cnt").cast("double")))
    bags = tf.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("bag"))
    norm = F.sqrt(F.aggregate("bag", F.lit(0.0), lambda acc, x: acc + x["v"] * x["v"]))
    bags = bags.withColumn("_n", norm).select("doc_id", F.col("bag.b").alias("idx"),
                                              F.transform("bag", lambda x: x["v"] / F.col("_n")).alias("val"))
    return ids.join(bags, "doc_id", "left").select(
        "doc_id", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("val", F.array().cast("array<double>")).alias("val"))


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, val) of all entries of a batch."""
    idx, val = batch.column("idx"), batch.column("val")
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(idx.offsets)))
    return row, np.asarray(idx.flatten()).astype(np.int64), np.asarray(val.flatten())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _gradients(keys: list[str], weights: np.ndarray, key: str):
    """Task of a round: per model met, the sums of units of (gradient, loss, held-back and training rows)."""
    size = weights.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: i for i, k in enumerate(keys)}
        acc = np.zeros((len(keys), size + 3), dtype=np.int64)
        flat = acc.reshape(-1)
        for batch in batches:
            which = np.array([number[k] for k in batch.column(key).to_pylist()], dtype=np.int64)
            row, col, val = _sparse(batch)
            y = np.asarray(batch.column("label"), dtype=np.float64)
            held = batch.column("is_valid").to_numpy(zero_copy_only=False).astype(bool)
            z = np.bincount(row, weights=weights[which[row], col] * val, minlength=len(y)) + weights[which, size - 1]
            loss = np.rint((np.logaddexp(0.0, z) - y * z) * _UNIT).astype(np.int64)
            np.add.at(acc, (which[held], size), loss[held])
            np.add.at(acc, (which, np.where(held, size + 2, size + 1)), 1)
            off = np.where(held, 0.0, _sigmoid(z) - y)
            np.add.at(flat, which[row] * (size + 3) + col, np.rint(off[row] * val * _UNIT).astype(np.int64))
            np.add.at(acc, (which, size - 1), np.rint(off * _UNIT).astype(np.int64))
        for i, k in enumerate(keys):
            at = np.flatnonzero(acc[i])
            if len(at):
                yield pa.RecordBatch.from_pydict({key: pa.array([k] * len(at)), "at": pa.array(at, pa.int32()),
                                                  "units": pa.array(acc[i][at])})

    return task


def train_logistic(train: DataFrame, vectors: DataFrame, settings: Settings = Settings(), key: str = "subsample",
                   label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(model, history) of one L2-regularised logistic model per value of ``key``.

    ``train``: (key, doc_id, label 0 / 1); rows without a label are left out.  ``vectors``: :func:`text_vectors`.

    Nesterov's accelerated gradient steps over all rows of a model.  A third (``valid_fraction``, by md5 of the ids) is
    held back; a model stops once its mean loss there has not fallen for ``patience`` rounds, and
    keeps the weights of its lowest loss (first round on ties).  Stopped models are filtered out of later passes.
    A model without held-back rows runs all rounds.  A model of one class learns that class.

    model: (key, weights array<double>, the last one the bias).  history: (key, rounds, best_round, valid_loss, n_train, n_valid).
    """
    held = F.pmod(hash_u32(settings.seed, "doc_id"), F.lit(10_000)) < int(settings.valid_fraction * 10_000)
    rows = train.where(F.col(label).isNotNull()).select(
        F.col(key).cast("string").alias(key), "doc_id", F.col(label).cast("int").alias("label"), held.alias("is_valid"))
    examples = cut_lineage(rows.join(vectors, "doc_id").select(key, "label", "is_valid", "idx", "val"))
    most = MAX_WEIGHTS // (settings.dims + 1)
    keys = sorted(r[0] for r in examples.select(key).distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"more than {most} models of {settings.dims} weights: train them in several calls")
    size = settings.dims + 1
    at = {k: np.zeros(size) for k in keys}          # weights
    ahead = {k: np.zeros(size) for k in keys}       # where the next gradient is taken
    best = {k: (np.inf, 0, np.zeros(size)) for k in keys}
    counts = {k: (0, 0) for k in keys}
    ran = dict.fromkeys(keys, 0)
    open_ = list(keys)
    for t in range(1, settings.rounds + 1):
        if not open_:
            break
        task = _gradients(list(open_), np.stack([ahead[k] for k in open_]), key)
        part = examples.where(F.col(key).isin(open_)) if len(open_) < len(keys) else examples
        sums = (part.mapInArrow(task, f"`{key}` string, at int, units long")
                .groupBy(key, "at").agg(F.sum("units").alias("units")))
        whole = {k: np.zeros(size + 3) for k in open_}
        for k, g in sums.toPandas().groupby(key):       # models x (dims + 4) numbers at most
            whole[k][g["at"].to_numpy()] = g["units"].to_numpy(dtype=np.float64)
        for k in list(open_):
            s = whole[k]
            n_train, n_valid = int(s[size + 1]), int(s[size + 2])
            counts[k], ran[k] = (n_train, n_valid), t
            loss = s[size] / _UNIT / n_valid if n_valid else -float(t)    # nothing held back: the last round is the best
            if loss < best[k][0]:
                best[k] = (loss, t, ahead[k])
            elif t - best[k][1] >= settings.patience:
                open_.remove(k)
                continue
            grad = s[:size] / _UNIT / max(n_train, 1)
            grad[:-1] += settings.decay * ahead[k][:-1]
            moved = ahead[k] - settings.step * grad
            ahead[k] = moved + (t - 1.0) / (t + 2.0) * (moved - at[k])
            at[k] = moved
    spark = examples.sparkSession
    model = spark.createDataFrame([(k, [float(x) for x in best[k][2]]) for k in keys], f"`{key}` string, weights array<double>")
    history = spark.createDataFrame(
        [(k, ran[k], best[k][1], float(best[k][0]) if counts[k][1] else None, *counts[k]) for k in keys],
        f"`{key}` string, rounds int, best_round int, valid_loss double, n_train long, n_valid long")
    return model, history


def predict_logistic(model: DataFrame, test: DataFrame, vectors: DataFrame, key: str = "subsample",
                     label: str = "label") -> DataFrame:
    """(key, doc_id, label, pred, score) of every test document under every model; 1 only above a score of 0.5.

    The model table is within ``MAX_WEIGHTS``, so each task holds it whole; test vectors are never copied per model.
    """
    weights = {r[0]: np.asarray(r[1]) for r in model.select(key, "weights").collect()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, col, val = _sparse(batch)
            for k, w in weights.items():
                z = np.bincount(row, weights=w[col] * val, minlength=batch.num_rows) + w[-1]
                yield pa.RecordBatch.from_pydict({
                    key: pa.array([k] * batch.num_rows, pa.string()), "doc_id": batch.column("doc_id"), "label": batch.column("label"),
                    "pred": pa.array((z > 0).astype(np.int32)), "score": pa.array(_sigmoid(z))})

    rows = test.select("doc_id", F.col(label).cast("int").alias("label")).join(vectors, "doc_id")
    kind = test.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "label", "idx", "val").mapInArrow(
        task, f"`{key}` string, doc_id {kind}, label int, pred int, score double")
