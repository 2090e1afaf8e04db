"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is three segments, each read as a word of the perfect
binary Golay code [23, 12, 7].  Words that differ little decode to a common
codeword index when a word at the covering radius also lists its codewords
one step further out; by the pigeonhole principle two near fingerprints agree
in one segment and nearly in another.  Joins on (segment, codeword
index) keys give the candidates, each verified by its bit distance.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import column, cut, fresh
from varietas.llm.components import components

#: Bits of the three segments, from the lowest bit up; each fits a Golay word of 23.
SEGMENTS = (22, 21, 21)
_GENERATOR = 0b101011100011   # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay generator polynomial
#: Largest group whose fingerprints are compared with each other; larger ones go through :func:`_midpoints`.
GROUP = 64
#: A fingerprint of more than 1 / HOT_SHARE of all rows is joined by broadcast (there are fewer than HOT_SHARE of them).
HOT_SHARE = 1000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit k is 1 if it is set in over half of the shingles' XXH64 (seed 42); no words: 0."""
    words = text.lower().split()   # of bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(b" ".join(x), 42) for x in zip(*[words[i:] for i in range(shingle)])), np.uint64,
                         len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):   # blocks, so a very long text needs no more memory
        part = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(fp.view(np.int64))],
                                             ["id", "text_hash", "fp"])
    return run


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp) per row; fp is the unsigned fingerprint in a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                        F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(_fingerprint_batches(shingle), f"id {kind}, text_hash long, fp long"))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, _GENERATOR << (bit - 11), 0)
    return r


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the error pattern of the nearest codeword (weight 0 to 3), and for weight 3 the five of weight 4 (else 0)."""
    one = 1 << np.arange(23, dtype=np.int64)
    i, j, k = np.meshgrid(*[np.arange(23)] * 3, indexing="ij")
    near = np.zeros(2048, np.int64)
    three = (one[i] | one[j] | one[k])[(i < j) & (j < k)]
    two = (one[i[:, :, 0]] | one[j[:, :, 0]])[i[:, :, 0] < j[:, :, 0]]
    for errors in (three, two, one, np.zeros(1, np.int64)):
        near[_syndrome(errors)] = errors
    weight3 = np.zeros(2048, bool)
    weight3[_syndrome(three)] = True
    four = (three[:, None] | one[None, :]).ravel()
    four = np.unique(four[np.bitwise_count(four) == 4])
    s = _syndrome(four)
    four, s = four[weight3[s]], s[weight3[s]]
    order = np.argsort(s, kind="stable")
    far = np.zeros((2048, 5), np.int64)
    found, start, count = np.unique(s[order], return_index=True, return_counts=True)
    for n, (x, at) in enumerate(zip(found, start)):
        far[x] = four[order[at:at + count[n]]]
    return near, far


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices of nearby codewords: the nearest one; for words at distance 3 also the five at distance 4.

    Any two words at distance 1 or 2 share an index (tested over all cosets).
    Returns (position of the word, index).
    """
    near, far = _tables()
    s = _syndrome(words)
    first = (words ^ near[s]) >> 11
    more = far[s]
    at, col = np.nonzero(more)
    return (np.concatenate([np.arange(len(words)), at]),
            np.concatenate([first, (words[at] ^ more[at, col]) >> 11]))


def keys(fp: np.ndarray, max_distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints: (position of the fingerprint, key).

    Up to 2 differing bits leave one segment equal and another with at most
    one error: a key is an equal segment with a codeword index of another.  Up to 4
    leave one segment with at most one and another with at most two errors: a
    key is a pair of codeword indices.
    """
    x = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.uint64)
    segs, at = [], 0
    for bits in SEGMENTS:
        segs.append((x >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    index = [codeword_indices(s) for s in segs]
    place, out = [], []
    for i in range(3):
        for j in range(3):
            if i == j or max_distance > 2 and i > j:
                continue
            tag = np.int64(3 * i + j) << 40
            p, c = index[j]
            if max_distance <= 2:
                place.append(p)
                out.append(tag | segs[i][p] << 12 | c)
                continue
            q, d = index[i]
            order = np.argsort(q, kind="stable")
            starts = np.searchsorted(q[order], np.arange(len(x)))
            n = np.bincount(q, minlength=len(x))
            rep = n[p]
            off = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
            place.append(np.repeat(p, rep))
            out.append(tag | d[order[np.repeat(starts[p], rep) + off]] << 12 | np.repeat(c, rep))
    return np.concatenate(place), np.concatenate(out)


def _key_batches(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            place, key = keys(fp, max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[place])], ["key", "fp"])
    return run


def _forest(fp: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links of a small group that connect what all its verified links connect (at most one per fingerprint)."""
    x = np.unique(fp).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= max_distance
    todo, out = set(range(len(x))), []
    while todo:
        stack = [todo.pop()]
        while stack:
            a = stack.pop()
            for b in [b for b in todo if near[a, b]]:
                todo.discard(b)
                stack.append(b)
                out.append((int(x[a].view(np.int64)), int(x[b].view(np.int64))))
    return out


def _link_batches(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [e for fps in b.column("fps") for e in _forest(np.array(fps.as_py(), np.int64), max_distance)]
            got = np.array(got, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
    return run


def _midpoint_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [0] + [1 << i for i in range(64)]
        if radius == 2:
            flips += [1 << i | 1 << j for i in range(64) for j in range(i)]
        flips = np.array(flips, np.uint64)
        for b in batches:
            all_fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at:at + 4096]
                mid = fp.view(np.uint64)[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mid.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)))], ["mid", "fp"])
    return run


def _midpoints(crowd: DataFrame, max_distance: int) -> DataFrame:
    """The links inside crowded groups, exactly and without comparing all pairs.

    Two fingerprints at distance d <= 2r have a common word within r of each,
    so they meet in that word's group.  A group has at most 65 members for r =
    1 and 2,081 for r = 2, whatever the data.
    """
    words = crowd.mapInArrow(_midpoint_batches(1 if max_distance <= 2 else 2), "mid long, fp long")
    groups = words.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select("fps").mapInArrow(_link_batches(max_distance), "a long, b long").distinct()


def links(nodes: DataFrame, max_distance: int = 2) -> DataFrame:
    """``nodes(fp)``, distinct, to verified links (a, b) that connect all fingerprints within ``max_distance``."""
    if not 0 <= max_distance <= 4:
        raise ValueError("max_distance must be 0 to 4")
    if max_distance == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    keyed = nodes.select("fp").mapInArrow(_key_batches(max_distance), "key long, fp long")
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    groups = (keyed.join(sizes.where(F.col("n") <= GROUP).select("key"), "key")
              .groupBy("key").agg(F.collect_list("fp").alias("fps")))
    found = groups.select("fps").mapInArrow(_link_batches(max_distance), "a long, b long")
    big = sizes.where(F.col("n") > GROUP).select("key")
    crowd = keyed.join(big, "key", "left_semi").select("fp").distinct()
    return found.union(_midpoints(crowd, max_distance))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3,
                    max_distance: int = 2) -> DataFrame:
    """(id, text_hash, fp, component_id) per row: component_id is the smallest id reachable over links, its own included.

    Fingerprints link at ``max_distance`` or fewer differing bits.  Equal
    fingerprints (exact copies) meet in one aggregation and are never paired.

    Cases: null, empty and word-less texts have the fingerprint 0 and link like any other;
    repeated rows are copies; a null id gets the component of the others (null only if
    none has an id); an empty table gives an empty result; further columns are ignored.

    Scale: 30 keys of 16 bytes per distinct fingerprint; a group of over 64
    fingerprints under one key is handled exactly by midpoints (65 rows per
    fingerprint, groups of at most 65), so no key emits its pairs.
    """
    docs_fp = cut(fingerprints(docs, text_col, id_col, shingle))
    nodes = cut(docs_fp.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    label = components(links(nodes, max_distance))
    linked = label.join(nodes, F.col("node") == F.col("fp")).select("node", "label", "low")
    roots = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    of_fp = linked.select("node", "label").join(roots, "label").select(F.col("node"), "component_id")
    lowest = cut(nodes.join(of_fp, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component_id", "low").alias("component_id"), "n"))
    # fingerprints of more than a thousandth of all rows: below a thousand, so they may be broadcast
    total = nodes.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT_SHARE > total
    hot = lowest.where(often).select(F.col("_fp").alias("_hot"), F.col("component_id").alias("_hot_id"))
    met = docs_fp.join(F.broadcast(hot), F.col("fp") == F.col("_hot"), "left")
    common = met.where(F.col("_hot").isNotNull()).select("id", "text_hash", "fp", F.col("_hot_id").alias("component_id"))
    rare = met.where(F.col("_hot").isNull()).select("id", "text_hash", "fp")
    return common.unionByName(rare.join(lowest.where(~often), F.col("fp") == F.col("_fp"))
                              .select("id", "text_hash", "fp", "component_id"))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3,
                max_distance: int = 2) -> DataFrame:
    """One row of each component, with all columns: that with the smallest id.

    Of rows that repeat this id the one with the smallest text hash stays (one
    of them, if they are equal).  Rows without an id go if their component has a row
    with one, else they stay.
    """
    kid, kth, kn, th = (fresh(docs, x) for x in ("_kept_id", "_kept_hash", "_kept_n", "_text_hash"))
    comp = cut(near_duplicates(docs, text_col, id_col, shingle, max_distance)
               .where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(kid), F.col("text_hash").alias(kth)))
    stay = cut(comp.where(F.col(kid).isNotNull()).groupBy(kid).agg(F.min(kth).alias(kth), F.count(kth).alias(kn))
               .unionByName(comp.where(F.col(kid).isNull()).distinct().withColumn(kn, F.lit(1).cast("long"))))
    rows = docs.withColumn(th, F.xxhash64(text_col))
    kept = rows.join(stay.drop(kn), F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(th) == F.col(kth)), "left_semi")
    if stay.where(F.col(kn) > 1).limit(1).count():   # ids are not unique: rows may be equal in id and text
        once = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        kept = once.unionByName(kept.where(F.col(id_col).isNull()))
    return kept.select(*[column(c) for c in docs.columns])
