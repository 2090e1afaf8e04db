"""Benchmark decontamination: windows of test items looked up in training texts.

Everything is a DataFrame expression: texts become word arrays, each position
gives the hash of its window, the hashes meet the benchmark's window table (a broadcast hash
join while that table is provably small), and a hit is verified on the
words themselves.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import column, cut, fresh

#: Words of the contract are runs of ASCII letters and digits and of all characters beyond ASCII; these stand between them.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Largest window table that is broadcast (rows); a row is a hash, an id and the window's text.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    # one pass lower-cases and blanks what is no word; a pattern of the same class takes several times as long
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    spaced = F.translate(text, BETWEEN + upper, " " * len(BETWEEN) + lower)
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


_PLACE = "struct<pos:int,len:int,hash:bigint>"


def word_hashes(w: Column) -> Column:
    """Hash of every word: a window is hashed from these, so that each word's characters are read once."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _places(hashes: str, lengths: list[int]) -> Column:
    """Array of (pos, len, hash): a mark at pos -1, then every window of the given lengths.

    A window's words are taken one by one (the hash of several columns is that of their array): ``slice`` inside a lambda reads
    the whole array anew for every position.
    """
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("hash")))
    def window(k: int):
        return lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).alias("hash"))

    per_length = [F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), window(k))) for k in lengths]
    return F.concat(mark, *[F.coalesce(x, F.array().cast(f"array<{_PLACE}>")) for x in per_length])


def item_windows(benchmark: DataFrame, n: int = 10, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """(item, hash, len, window): the distinct windows of every item.

    A window is ``n`` consecutive words; an item with fewer words, but not
    none, is one window; null texts and items without a word have none.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    one = items.where(F.size("w") > 0).withColumn("pos", F.explode(at))
    sliced = one.select("item", F.slice("w", F.col("pos") + 1, n).alias("s"))
    return sliced.select("item", F.xxhash64(word_hashes(F.col("s"))).alias("hash"), F.size("s").alias("len"),
                         F.concat_ws(" ", "s").alias("window")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", id_col: str = "doc_id",
         item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_words, spans (merged (start, end) word ranges that are hit),
    n_hit, items (ids of items with a window in the text, sorted as strings).

    A word is hit if any occurrence of a benchmark window covers it.

    Cases: null, empty and word-less texts have no words and no hits; items without words match nothing; null item
    ids do not count as items, but their windows hit; repeated rows give equal rows; an empty benchmark
    gives no hits, an empty table an empty result; further columns are ignored.

    Scale: texts are read once and never shuffled; only hit positions are. The
    window table is broadcast up to ``BROADCAST_WINDOWS`` rows (its size is counted first) and
    joined by a shuffle of (position, hash) rows beyond. A window's items are
    attached after the hits of a text have been reduced to distinct windows.
    """
    owned = cut(item_windows(benchmark, n, item_text, item_id).withColumn("wid", F.xxhash64("window", "len")))
    table = owned.select(F.col("hash").alias("thash"), F.col("len").alias("tlen"), "window", "wid").distinct()
    lengths = sorted(r["len"] for r in owned.select("len").distinct().collect())   # at most n values
    small = owned.count() <= BROADCAST_WINDOWS
    seen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    # explode_outer: a plain explode would have its argument evaluated a second time in an inferred filter
    seen = seen.withColumn("h", word_hashes(F.col("w")))
    at = seen.select("id", "text_hash", F.size("w").alias("n_words"), "w", F.explode_outer(_places("h", lengths)).alias("p"))
    own = F.slice("w", F.greatest(F.col("p.pos"), F.lit(0)) + 1, F.col("p.len"))
    at = at.select("id", "text_hash", "n_words", F.col("w") if small else own.alias("w"),
                   F.col("p.pos").alias("pos"), F.col("p.len").alias("len"), F.col("p.hash").alias("hash"))
    met = at.join(F.broadcast(table) if small else table,
                  (F.col("hash") == F.col("thash")) & (F.col("len") == F.col("tlen")), "left")
    said = F.concat_ws(" ", F.slice("w", F.col("pos") + 1, F.col("len")) if small else F.col("w"))
    kept = met.where((F.col("pos") < 0) | (F.col("wid").isNotNull() & (said == F.col("window"))))
    span = F.when(F.col("pos") >= 0, F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")))
    per_text = kept.groupBy("id", "text_hash", "n_words").agg(
        F.count_if(F.col("pos") < 0).alias("copies"), F.sort_array(F.collect_set(span)).alias("raw"),
        F.collect_set("wid").alias("wids"))
    # overlapping and touching spans become one
    spans = F.aggregate("raw", F.array().cast("array<struct<start:int,end:int>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    per_text = cut(per_text.select("id", "text_hash", "n_words", "copies", "wids", spans.alias("spans")))
    found = per_text.where(F.size("wids") > 0).select("id", "text_hash", F.explode("wids").alias("wid"))
    found = (found.join(owned.select("wid", "item").distinct(), "wid")
             .groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_th"))
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    out = per_text.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "spans",
                      F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


#: The same words before lower-casing, and what lies between them.
_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of the (start, end) word ranges and what stands between two of one range."""
    parts = F.regexp_extract_all(text, F.lit(f"{_CASED}|{_BETWEEN}"), 0)
    lead = F.when(text.rlike(f"^{_BETWEEN}"), 1).otherwise(0)   # parts alternate; lead: the first is no word

    def stays(part: Column, i: Column) -> Column:
        word = F.pmod(i + lead, F.lit(2)) == 0
        k = F.floor((i - lead) / 2).cast("int")   # of a word its number, else that of the word before
        return ~F.exists(spans, lambda s: (k >= s["start"]) & F.when(word, k < s["end"]).otherwise(k + 1 < s["end"]))

    return F.when(F.size(spans) > 0, F.array_join(F.filter(parts, stays), "")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, text_col: str = "text",
                  id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows that are hit (``remove="documents"``) or without the hit words (``"spans"``).

    Cases: those of :func:`hits`; null and word-less texts stay as they are; repeated rows go or stay together; all columns are kept.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    hid, hth, spans, th = (fresh(docs, x) for x in ("_hit_id", "_hit_hash", "_hit_spans", "_text_hash"))
    hit = hits(docs, benchmark, n, text_col, id_col, item_text, item_id).where("n_hit > 0")
    hit = hit.select(F.col("id").alias(hid), F.col("text_hash").alias(hth), F.col("spans").alias(spans)).distinct()
    rows = docs.withColumn(th, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(hid)) & (F.col(th) == F.col(hth))
    if remove == "documents":
        return rows.join(hit, same, "left_anti").select(*[column(c) for c in docs.columns])
    new = F.when(F.col(spans).isNotNull(), without_spans(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    return rows.join(hit, same, "left").select(*[(new if c == text_col else column(c)).alias(c) for c in docs.columns])
