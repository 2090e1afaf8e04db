"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; a line that more distinct documents of a host
carry than the limits allow is boilerplate and is removed; a document that
loses most of its words is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import column, cut, fresh

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))   # UTF-8 bytes that start no code point
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0000000000")
_ZEROS = re.compile(b"0+")


@dataclass(frozen=True)
class Limits:
    """Limits of the rules; shares and counts behave alike at every size."""

    min_words: int = 20            # base: fewer words fail
    repeat_percent: int = 30       # base: a larger percentage of words in repeated 8-word windows fails
    window: int = 8
    line_docs: int = 10            # a removed line is in more than this many distinct documents of its host
    line_share: float = 0.02       # ... and in more than this share of them
    lost_share: float = 0.6        # a document losing more than this share of its words is depleted
    left_words: int = 10           # ... as is one with fewer words left after a removal


def repeat_words(words: list[bytes], size: int) -> int:
    """Words inside ``size``-word windows that occur twice or more, the first occurrence included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*[words[i:] for i in range(size)]))
    if len(set(windows)) == len(windows):
        return 0
    count, end, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def normal_line(words: list[bytes]) -> bytes:
    """Case, numbers and spacing of a line do not count."""
    return _ZEROS.sub(b"0", b" ".join(words).translate(_NORMAL))


def _digest(x: bytes) -> bytes:
    return hashlib.md5(x, usedforsecurity=False).digest()


def _number(digest: bytes) -> int:
    """The first 64 bits in a signed long, in the same order."""
    return int.from_bytes(digest[:8], "big") - (1 << 63)


def line_hash(normal: bytes) -> int:
    return _number(_digest(normal))


def _facts(text: bytes, size: int) -> dict:
    hashes, lens, seen, dup, words = [], [], set(), 0, []
    for line in text.split(b"\n"):
        if own := line.split():   # bytes split at \x20 and \x09-\x0D only
            dup += line in seen
            seen.add(line)
            hashes.append(line_hash(normal_line(own)))
            lens.append(len(own))
            words += own
    flat = b"".join(words)
    return {"n_words": len(words), "word_chars": len(flat.translate(None, _CONTINUATION)),
            "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)), "n_dup_lines": dup,
            "n_repeat_words": repeat_words(words, size), "lines": hashes, "line_words": lens}


_FACTS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))]


def _fact_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_facts(x.as_py() or b"", size) for x in b.column("text")]
            cols = [b.column(c) for c in ("id", "host", "text_hash")]
            cols += [pa.array([r[k] for r in rows], t) for k, t in _FACTS]
            yield pa.RecordBatch.from_arrays(cols, ["id", "host", "text_hash", *[k for k, _ in _FACTS]])
    return run


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source",
          limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs`` with the rule counts, the verdict and the lines to remove.

    Columns: id, text_hash, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_words (long), removed (hashes of the normalised lines to
    remove), base_failed, depleted, kept (boolean).

    *Distinct documents* are distinct texts, for a line as for its host: exact copies count once, near copies each.

    Cases: null and empty texts have no words and fail the base rules; a null host is a host;
    repeated rows are judged alike and count once; lines without a word are
    never removed; an empty table gives an empty result; further columns are ignored.

    Scale: one pass over the texts; afterwards only (host, line hash, document hash)
    rows are shuffled, distinct before and after the shuffle, and a line or host that
    a third of all rows share is counted by partial aggregation.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    seen = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"),
                       F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    facts = seen.mapInArrow(_fact_batches(limits.window), f"""id {id_type}, host string, text_hash long, n_words long,
        word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>,
        line_words array<long>""")
    facts = cut(facts.withColumn("row", F.monotonically_increasing_id()))
    each = facts.select("row", "host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    each = each.select("row", "host", "text_hash", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hosts = (facts.where(F.size("lines") > 0).select(F.col("host").alias("dh"), "text_hash").distinct()
             .groupBy("dh").agg(F.count(F.lit(1)).alias("host_docs")))
    n = (each.select("host", "line", "text_hash").distinct().groupBy(F.col("host").alias("h"), F.col("line").alias("l"))
         .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.line_docs))
    n = n.join(hosts, F.col("h").eqNullSafe(F.col("dh")))
    frequent = cut(n.where(F.col("n") > F.lit(float(limits.line_share)) * F.col("host_docs")).select("h", "l"))
    same = F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))
    lost = (each.join(frequent, same, "left_semi").groupBy(F.col("row").alias("lost_row"))
            .agg(F.sum("words").alias("lost_words"), F.collect_set("line").alias("removed")))
    out = facts.join(lost, F.col("row") == F.col("lost_row"), "left")
    n, gone = F.col("n_words"), F.coalesce(F.col("lost_words"), F.lit(0))
    failed = (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * n)
    depleted = (gone > 0) & ((gone > F.lit(limits.lost_share) * n) | (n - gone < limits.left_words))
    return (out.withColumn("n_removed_words", gone).withColumn("base_failed", failed).withColumn("depleted", depleted)
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
            .select("id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "n_removed_words", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
                    "base_failed", "depleted", "kept"))


def drop_lines(text: bytes, removed: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n")
                      if not (own := x.split()) or line_hash(normal_line(own)) not in removed)


def _clean_texts(texts, removed):
    import pandas as pd
    return pd.Series([None if t is None else drop_lines(bytes(t), set(int(x) for x in r))
                      for t, r in zip(texts, removed)], dtype=object)


def apply_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source",
                limits: Limits = Limits()) -> DataFrame:
    """The kept rows of ``docs`` (all columns), their boilerplate lines removed from the text.

    Rows meet their verdict by id and text hash; the cases are those of :func:`judge`.
    """
    verdict = judge(docs, text_col, id_col, host_col, limits).where("kept")
    # equal (id, text) rows of one host have one verdict, of several hosts one each: a row is kept if any is
    vid, vhash, removed, th = (fresh(docs, x) for x in ("_verdict_id", "_verdict_hash", "_removed", "_text_hash"))
    verdict = verdict.groupBy(F.col("id").alias(vid), F.col("text_hash").alias(vhash)).agg(
        F.flatten(F.collect_set("removed")).alias(removed))
    rows = docs.withColumn(th, F.xxhash64(text_col))
    met = rows.join(verdict, F.col(id_col).eqNullSafe(F.col(vid)) & (F.col(th) == F.col(vhash)))
    clean = F.pandas_udf(_clean_texts, "binary")
    some = F.size(removed) > 0     # only these texts travel to Python
    new = F.when(some, clean(F.when(some, F.col(text_col).cast("binary")), F.col(removed)).cast("string")
                 ).otherwise(F.col(text_col))
    return met.select(*[(new if c == text_col else column(c)).alias(c) for c in docs.columns])
