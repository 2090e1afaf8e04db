"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the pair sum is
computed in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import CHUNK_BYTES, cut

WORD_BITS = 14
_WORDS = 1 << WORD_BITS
_BINS = 20
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_MARKS = b"!?.,;:\"'()-"
_SYMBOLS = b"#*$%&|<>=+@\\^~_{}[]/"
#: Structure statistics first, then metadata of the text itself.
_STATS = ("words", "word_length", "symbols", "digits", "upper", "marks", "other_script", "distinct", "top_word",
          "equal_lines", "line_words", "longest_word", "lines", "repeat_pairs", "bare_lines", "marked_words",
          "chars", "first_upper", "ends")
SIZE = _WORDS + _BINS * len(_STATS)


def _share(part: float, whole: float) -> int:
    """Bin of a share: 0 for none, then by powers of two and, above a half, by tenths."""
    r = part / whole if whole else 0.0
    if r <= 0:
        return 0
    return 1 + max(0, min(9, int(np.floor(np.log2(r))) + 10)) if r < 0.5 else 11 + min(7, int((r - 0.5) * 16))


def _count(n: float) -> int:
    return min(_BINS - 1, int(np.log2(1 + n)))


def features(text: bytes) -> tuple[list[int], list[float]]:
    """Numbers and values of the non-zero inputs of a text (an empty text has its statistics' zero bins)."""
    words = text.split()
    n, size = len(words), len(text)
    low = text.lower().split()
    count = Counter(low)
    lines = [x for x in text.split(b"\n") if x.strip()]
    less = lambda drop: size - len(text.translate(None, drop))
    pairs = Counter(zip(low, low[1:]))
    stats = (
        _count(n), min(_BINS - 1, int(sum(map(len, words)) / n) if n else 0), _share(less(_SYMBOLS), size),
        _share(less(_DIGITS), size), _share(less(_UPPER), size), _share(less(_MARKS), size), _share(less(_HIGH), size),
        _share(len(count), n), _share(max(count.values(), default=0), n), _share(len(lines) - len(set(lines)), len(lines)),
        _count(n / len(lines)) if lines else 0, _count(max(map(len, words), default=0)), _count(len(lines)),
        _share(len(low) - 1 - len(pairs) if n else 0, n), _share(sum(x.rstrip()[-1:] not in b".!?:" for x in lines), len(lines)),
        _share(sum(1 for w in count if w.strip(_MARKS).isalpha() or w.isalpha()), len(count)),
        _count(size), _share(sum(x[:1].isupper() for x in lines), len(lines)),
        (1 if text.rstrip()[-1:] in (b".", b"!", b"?") else 2) if n else 0)
    hashed: dict[int, float] = {}
    for w, c in count.items():
        k = zlib.crc32(w) & (_WORDS - 1)
        hashed[k] = hashed.get(k, 0) + c
    values = np.log1p(np.fromiter(hashed.values(), float, len(hashed)))
    values /= np.linalg.norm(values) or 1.0
    at = [_WORDS + _BINS * i + b for i, b in enumerate(stats)]
    return [*hashed, *at], [*values.tolist(), *[0.5] * len(at)]


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray     # SIZE
    factors: np.ndarray    # SIZE x rank


def raw_scores(model: Model, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores of rows whose inputs begin at ``starts`` (every row has some): linear in their number."""
    v = model.factors[at] * x[:, None]
    pair = np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)
    return model.bias + np.add.reduceat(model.linear[at] * x, starts) + 0.5 * pair.sum(axis=1)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 6, rate: float = 0.1,
          batch: int = 32, decay: float = 1e-5, seed: int = 11) -> Model:
    """Adagrad on the log loss.  Without rows, or with one class, the model is its smoothed base rate."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    base = (labels.sum() + 1) / (n + 2)
    bias, linear = float(np.log(base / (1 - base))), np.zeros(SIZE)
    factors = rng.normal(0, 0.05, (SIZE, rank))
    if n == 0 or labels.min() == labels.max():
        return Model(bias, linear, np.zeros((SIZE, rank)))
    g_lin, g_fac, g_bias = np.full(SIZE, 1e-3), np.full((SIZE, rank), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            own = order[s:s + batch]
            at = np.concatenate([rows[i][0] for i in own])
            x = np.concatenate([rows[i][1] for i in own])
            sizes = np.array([len(rows[i][0]) for i in own])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = factors[at] * x[:, None]
            sums = np.add.reduceat(v, starts)
            z = bias + np.add.reduceat(linear[at] * x, starts) + 0.5 * (sums ** 2 - np.add.reduceat(v * v, starts)).sum(axis=1)
            err = (_sigmoid(z) - labels[own]) / len(own)
            e = np.repeat(err, sizes)
            uniq, inv = np.unique(at, return_inverse=True)
            d_lin = np.bincount(inv, e * x, len(uniq)) + decay * linear[uniq]
            d_each = (e * x)[:, None] * (np.repeat(sums, sizes, axis=0) - v)
            d_fac = np.stack([np.bincount(inv, d_each[:, f], len(uniq)) for f in range(rank)], axis=1) + decay * factors[uniq]
            g_bias += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(g_bias)
            g_lin[uniq] += d_lin ** 2
            linear[uniq] -= rate * d_lin / np.sqrt(g_lin[uniq])
            g_fac[uniq] += d_fac ** 2
            factors[uniq] -= 0.5 * rate * d_fac / np.sqrt(g_fac[uniq])
    return Model(bias, linear, factors)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [features(t.as_py() or b"") for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("h"), b.column("label"), pa.array([g[0] for g in got], pa.list_(pa.int32())),
             pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["h", "label", "at", "x"])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "quality", text_col: str = "text",
        id_col: str = "doc_id", max_rows: int = 8000, **options) -> Model:
    """Fit on at most ``max_rows`` labelled rows: those with the smallest id hash among rows whose id is ``allowed``.

    Whole texts are used.  Texts become features in the executors; the driver
    gets the features of the bounded sample.  Null labels, ids without a text
    and ids with two different labels are left out.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(allowed)
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("_hi"))
             .where(F.col("label") == F.col("_hi"))
             .select("_id", F.col("label").cast("int").alias("label"), F.xxhash64(F.col("_id").cast("string")).alias("h"))
             .orderBy("h", "_id").limit(max_rows))
    known = cut(known)
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sample = sample.join(F.broadcast(known), F.col("id") == F.col("_id"))   # at most max_rows rows
    got = (sample.select("h", "label", "text").mapInArrow(_feature_batches, "h long, label int, at array<int>, x array<float>")
           .toPandas().sort_values("h", kind="stable"))
    rows = [(np.asarray(a, np.int64), np.asarray(x, float)) for a, x in zip(got["at"], got["x"])]
    return train(rows, got["label"].to_numpy(float), **options)


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row with ``score``, the probability of label 1.

    Cases: null and empty texts are scored by their (zero) statistics; texts of any length are
    read whole; repeated rows get equal rows; an empty table gives an empty result.
    """
    rows = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text_col).cast("binary").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], 0
            while at < b.num_rows:
                got, size = [], 0
                while at < b.num_rows and size < CHUNK_BYTES // 2:
                    raw = b.column("t")[at].as_py() or b""
                    got.append(features(raw))
                    size += len(raw)
                    at += 1
                starts = np.cumsum([0] + [len(g[0]) for g in got[:-1]])
                out.append(_sigmoid(raw_scores(sent.value, np.concatenate([np.array(g[0], np.int64) for g in got]),
                                               np.concatenate([np.array(g[1]) for g in got]), starts)))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in names] + [pa.array(np.concatenate(out) if out else np.zeros(0))],
                                             [*names, "score"])

    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in names] + ["score double"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(keep)], "score")
