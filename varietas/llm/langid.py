"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces
(forward algorithm); a text's is the product over its words.  The piece
probabilities are fitted by expectation maximisation over the same sums
(forward-backward); the vocabulary itself is never trained.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varietas.llm.common import CHUNK_BYTES, cut

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
_MARK = "▁"                 # stands before every word in the vocabulary's pieces
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONG = 40                       # longer words take the plain loop, whose memory is linear in the word
_CACHE = 200_000                 # words whose scores a task keeps


def load_pieces(path: str = VOCABULARY) -> tuple[list[str], list[int]]:
    """Pieces and, for each byte, the number of its fallback piece.  Read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_of = [], [-1] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_of[int(model.id_to_piece(i)[3:5], 16)] = len(pieces)
            pieces.append("")
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces.append(model.id_to_piece(i))
    return pieces, byte_of


class Lattice:
    """Finds the vocabulary's pieces in words."""

    def __init__(self, pieces: list[str], byte_of: list[int]):
        self.number = {p: i for i, p in enumerate(pieces) if p}
        self.byte_of = np.array(byte_of)
        self.longest = max(map(len, self.number))
        by_length: dict[int, list[tuple[int, int]]] = {}
        for p, i in self.number.items():
            by_length.setdefault(len(p), []).append((int(self._hash(p)), i))
        self.tables = {}
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = (np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows]))

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + np.uint64(ord(c))
        return h

    def find(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, length) to the piece number of each row of equally long words, -1 where there is none."""
        n = codes.shape[1]
        prefix, power, out = [np.zeros(len(codes), np.uint64)], [np.uint64(1)], {}
        with np.errstate(over="ignore"):
            for j in range(n):
                prefix.append(prefix[-1] * _BASE + codes[:, j])
                power.append(power[-1] * _BASE)
            for size, (hashes, numbers) in self.tables.items():
                for i in range(n - size + 1):
                    h = prefix[i + size] - prefix[i] * power[size]
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    out[i, size] = np.where(hashes[at] == h, numbers[at], -1)
        return out

    def spell(self, char: str, log_p: np.ndarray) -> np.ndarray:
        """A character without a piece of its own is spelt in byte pieces."""
        return log_p[self.byte_of[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]].sum(axis=0)


def _codes(words: list[str]) -> np.ndarray:
    flat = np.frombuffer("".join(_MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), -1).astype(np.uint64)


def _edges(lattice: Lattice, codes: np.ndarray, log_p: np.ndarray):
    """Piece numbers by (start, length), and the probability table with rows for spelt characters and for 'none'."""
    found = lattice.find(codes)
    extra, rows = [], {}
    for j in range(codes.shape[1]):
        none = found[j, 1] < 0
        if none.any():
            numbers = found[j, 1].copy()
            for c in np.unique(codes[none, j]):
                if int(c) not in rows:
                    rows[int(c)] = len(log_p) + len(extra)
                    extra.append(lattice.spell(chr(int(c)), log_p))
                numbers[none & (codes[:, j] == c)] = rows[int(c)]
            found[j, 1] = numbers
    p = np.vstack([np.exp(log_p), *[np.exp(x)[None] for x in extra], np.zeros((1, log_p.shape[1]))])
    return found, p


def word_scores(lattice: Lattice, words: list[str], log_p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, all segmentations summed."""
    out = np.empty((len(words), log_p.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, places in by_length.items():
        if n > _LONG:
            for k in places:
                out[k] = _long_score(lattice, words[k], log_p)
            continue
        for at in range(0, len(places), 20_000):
            part = places[at:at + 20_000]
            codes = _codes([words[k] for k in part])
            found, p = _edges(lattice, codes, log_p)
            alpha = [np.ones((len(part), log_p.shape[1]))]
            for j in range(1, codes.shape[1] + 1):
                total = np.zeros_like(alpha[0])
                for size in range(1, min(j, lattice.longest) + 1):
                    piece = found.get((j - size, size))
                    if piece is not None and (piece >= 0).any():
                        total += alpha[j - size] * p[piece]
                alpha.append(total)
            with np.errstate(divide="ignore"):
                out[part] = np.log(alpha[-1])
            low = np.flatnonzero((alpha[-1] < 1e-280).any(axis=1))
            for i in low:     # too small for plain numbers
                out[part[i]] = _long_score(lattice, words[part[i]], log_p)
    return out


def _long_score(lattice: Lattice, word: str, log_p: np.ndarray) -> np.ndarray:
    """The same sum in logs, one word at a time; keeps only as many places as the longest piece."""
    marked = _MARK + word
    alpha = {0: np.zeros(log_p.shape[1])}
    for j in range(1, len(marked) + 1):
        total = None
        for size in range(1, min(j, lattice.longest) + 1):
            piece = lattice.number.get(marked[j - size:j])
            if piece is None and size > 1:
                continue
            step = alpha[j - size] + (lattice.spell(marked[j - 1], log_p) if piece is None else log_p[piece])
            total = step if total is None else np.logaddexp(total, step)
        alpha[j] = total
        alpha.pop(j - lattice.longest, None)
    return alpha[len(marked)]


def _long_counts(lattice: Lattice, word: str, lang: int, weight: float, log_p: np.ndarray, total: np.ndarray) -> None:
    """Adds one word's expected uses to ``total``: forward-backward in logs, in time linear in the word."""
    marked, p = _MARK + word, log_p[:, lang]
    n = len(marked)
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    edges = []          # (start, end, piece or none, log probability), by end
    for j in range(1, n + 1):
        for size in range(1, min(j, lattice.longest) + 1):
            piece = lattice.number.get(marked[j - size:j])
            if piece is None and size > 1:
                continue
            x = float(lattice.spell(marked[j - 1], log_p)[lang] if piece is None else p[piece])
            edges.append((j - size, j, piece, x))
            alpha[j] = np.logaddexp(alpha[j], alpha[j - size] + x)
    for i, j, _, x in reversed(edges):
        beta[i] = np.logaddexp(beta[i], x + beta[j])
    for i, j, piece, x in edges:
        if piece is not None:
            total[piece, lang] += weight * np.exp(alpha[i] + x + beta[j] - alpha[n])


def expected_counts(lattice: Lattice, words: list[str], lang: np.ndarray, weight: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece per language: forward-backward over all segmentations of each word."""
    total = np.zeros_like(log_p)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, places in by_length.items():
        if n > _LONG:
            for k in places:
                _long_counts(lattice, words[k], int(lang[k]), float(weight[k]), log_p, total)
            continue
        for at in range(0, len(places), 20_000):
            part = np.array(places[at:at + 20_000])
            codes, own = _codes([words[k] for k in part]), lang[part]
            found, p = _edges(lattice, codes, log_p)
            length = codes.shape[1]
            prob = {k: p[v, own] for k, v in found.items() if (v >= 0).any()}
            alpha = np.zeros((length + 1, len(part)))
            beta = np.zeros_like(alpha)
            alpha[0] = beta[length] = 1
            for (i, size), x in sorted(prob.items(), key=lambda e: e[0][0] + e[0][1]):
                alpha[i + size] += alpha[i] * x
            for (i, size), x in sorted(prob.items(), key=lambda e: -e[0][0]):
                beta[i] += x * beta[i + size]
            low = alpha[length] < 1e-280                     # too small for plain numbers
            for k in part[low].tolist():
                _long_counts(lattice, words[k], int(lang[k]), float(weight[k]), log_p, total)
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = np.where(low, 0.0, weight[part] / alpha[length])
            for (i, size), x in prob.items():
                piece = found[i, size]
                use = (piece >= 0) & (piece < len(log_p))   # spelt characters teach nothing about pieces
                np.add.at(total, (piece[use], own[use]), (alpha[i] * x * beta[i + size] * scale)[use])
    return total


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    pieces: list[str]
    byte_of: list[int]
    log_p: np.ndarray     # pieces x languages


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        vocabulary: str = VOCABULARY, docs_per_lang: int = 1000, rounds: int = 3) -> Model:
    """Piece probabilities from a bounded sample of labelled rows.

    Parameters bound the fit only: of each language the ``docs_per_lang`` rows
    with the smallest id hash are used (whole texts, all words).  Word counts and the E-step are distributed; the driver holds the
    model (pieces x languages).  Rows without text or language are left out.
    """
    spark = rows.sparkSession
    usable = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    place_of = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 12)   # 52 bits
    ids = usable.select(F.col(lang_col).alias("lang"), place_of.alias("h"), F.xxhash64(text_col).alias("th"))
    # a hash border keeps about four times the rows wanted of each language, so no language is ranked whole
    border = F.col("h").cast("double") * F.col("n") < F.lit(4.0 * docs_per_lang * 2 ** 52)
    sizes = ids.groupBy(F.col("lang").alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    near = ids.join(F.broadcast(sizes), F.col("lang") == F.col("_l")).where(border)   # one row a language
    order = Window.partitionBy("lang").orderBy("h", "th")
    picked = (near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= docs_per_lang)
              .select("_l", F.col("h").alias("_h"), F.col("th").alias("_t")).distinct())
    picked = cut(picked)   # at most docs_per_lang rows a language
    langs = tuple(sorted(r["_l"] for r in picked.select("_l").distinct().collect()))
    pieces, byte_of = load_pieces(vocabulary)
    v, k = len(pieces), len(langs)
    log_p = np.full((v, max(k, 1)), -np.log(v))
    if not langs:
        return Model((), pieces, byte_of, log_p)
    sample = usable.select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"),
                           place_of.alias("h"), F.xxhash64(text_col).alias("th")).join(
        F.broadcast(picked), (F.col("lang") == F.col("_l")) & (F.col("h") == F.col("_h")) & (F.col("th") == F.col("_t")), "left_semi")
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text, lang in zip(b.column("text"), b.column("lang")):
                own = place[lang.as_py()]
                seen.update((own, w) for w in words_of(text.as_py().decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([a for a, _ in seen], pa.int32()), "word": pa.array([w for _, w in seen], pa.string()),
                "n": pa.array(list(seen.values()), pa.int64())})

    words = cut(sample.select("text", "lang").mapInArrow(count, "lang int, word string, n long")
                .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, byte_of, log_p))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, p, total = Lattice(*sent.value[:2]), sent.value[2], None
            for b in batches:
                got = expected_counts(lattice, b.column("word").to_pylist(), b.column("lang").to_numpy(),
                                      b.column("n").to_numpy().astype(float), p)
                total = got if total is None else total + got
            if total is not None:
                i, j = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(i, pa.int32()), "lang": pa.array(j, pa.int32()),
                                                  "e": pa.array(total[i, j])})

        got = (words.mapInArrow(expect, "piece int, lang int, e double").groupBy("piece", "lang")
               .agg(F.sum("e").alias("e")).toPandas())   # at most pieces x languages rows
        e = np.zeros((v, k))
        e[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["e"].to_numpy()
        pooled = e.sum(axis=1) + 0.01
        prior = 100.0 * pooled / pooled.sum()     # pieces a language never used keep a little of the others' share
        log_p = np.log((e + prior[:, None]) / (e.sum(axis=0) + prior.sum()))
    return Model(langs, pieces, byte_of, log_p)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score (the posterior of the predicted language, equal priors).

    Cases: a text that is null or has no letter is ``und`` with score 0, as is
    every text if the model has no language; ties go to the first language by
    name; texts of any length are scored whole, in linear time; repeated rows get equal rows;
    an empty table gives an empty result.
    """
    keep = keep if keep is not None else {c: F.col(c) for c in docs.columns if c != text_col}
    rows = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text_col).cast("binary").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        lattice, cache, table = Lattice(m.pieces, m.byte_of), {}, np.empty((1024, len(m.langs)))
        for b in batches:
            preds, scores, at = [], [], 0
            texts = b.column("t")
            while at < b.num_rows:
                own, size = [], 0
                while at < b.num_rows and size < CHUNK_BYTES:
                    raw = texts[at].as_py() or b""
                    own.append(words_of(raw.decode("utf-8", "replace")))
                    size += len(raw)
                    at += 1
                if len(cache) > _CACHE:
                    cache = {}
                new = list({w for ws in own for w in ws if w not in cache})
                if new and m.langs:
                    start = len(cache)
                    if start + len(new) > len(table):
                        table = np.concatenate([table[:start], np.empty((start + 2 * len(new), len(m.langs)))])
                    table[start:start + len(new)] = word_scores(lattice, new, m.log_p)
                    cache.update(zip(new, range(start, start + len(new))))
                for ws in own:
                    if not ws or not m.langs:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = table[np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(total.argmax())
                    preds.append(m.langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in names] + [pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"])

    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in names]
                       + ["lang_pred string", "score double"])
    return rows.mapInArrow(score, schema).select(
        *[F.col(f"k{i}").alias(n) for i, n in enumerate(keep)], "lang_pred", "score")
