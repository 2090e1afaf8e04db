"""Bottom-k sketches of word shingles: mergeable fingerprints of texts.

A text's fingerprint is the k smallest distinct hashes of its shingles.  The
sketch of a union is the k smallest of both sketches, so parts are sketched
apart and merged; two sketches estimate resemblance, containment and the number
of distinct shingles.  A sketch with fewer than k hashes holds all of them, and
what is computed from such sketches is exact.

Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varietas.llm.common import ascii_lower, cut, fresh, numbered

K = 128
WIDTH = 5
#: A word is a run without ASCII white space; CJK ideographs and kana, written without blanks, are words of their own.
WORD = "[⺀-鿿豈-﫿]|[^\\x20\\x09-\\x0D⺀-鿿豈-﫿]+"


def word_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of every word, A-Z lower-cased; null has none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(hashes: str, k: int = K, width: int = WIDTH) -> Column:
    """Sorted k smallest distinct shingle hashes of the word hashes in the column named ``hashes``.

    Fewer than ``width`` words are one shingle; no words give an empty sketch.
    The column must exist (not be an expression), so that it is evaluated once.
    """
    h, n = F.col(hashes), F.size(hashes)
    many = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(width))))
    every = (F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(h)))
             .otherwise(F.array().cast("array<bigint>")))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what ``a`` and ``b`` were made of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(parts: DataFrame, keys: list[str], col: str, k: int = K) -> DataFrame:
    """One row per key: the sketch of all its parts, in the column ``col``.

    Null sketches and keys without any hash give an empty sketch.  Hashes are made distinct and cut to
    k per key before they meet, so a key with very many parts does not gather
    them in one task.
    """
    h, rn = fresh(parts, "_hash"), fresh(parts, "_rank")
    one = parts.select(*keys, F.explode_outer(col).alias(h)).distinct()
    first = one.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(h).asc_nulls_last())))
    return (first.where(F.col(rn) <= k).groupBy(*keys)
            .agg(F.sort_array(F.collect_list(h)).alias(col)))


def _sample(a: Column, b: Column, k: int) -> Column:
    """The uniform sample of the union's shingles that both sketches describe."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    both = F.sort_array(F.array_union(a, b))
    return F.when(whole, both).otherwise(F.slice(both, 1, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard coefficient of the shingle sets (two empty sketches: 1; one: 0)."""
    u = _sample(a, b, k)
    common = F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common.cast("double") / F.size(u))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of ``a``'s shingles that ``b`` has (an empty ``a``: 1), on the union's sample."""
    u = _sample(a, b, k)
    own = F.size(F.array_intersect(u, a))
    common = F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(own == 0, F.lit(0.0)).otherwise(common.cast("double") / own)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63) + 1) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def as_text(a: Column) -> Column:
    """The hashes as 16 lower-case hex digits each, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, copies, n_chars, next_id, next_hash) of every distinct row of (id, text).

    The next row is the one with the next smaller id; after the smallest comes the largest.  Null ids are
    smaller than all others; rows of one id go by their text's hash.
    Equal rows follow each other, so all but one of ``copies`` are followed by the same text again.

    Only ids and hashes are ranked, by range partitions and their counts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))
    rows = rows.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("copies"), F.max("n_chars").alias("n_chars"))
    ranked = cut(numbered(rows, [], ["id", "text_hash"], "place"))
    n = ranked.count()
    if not n:
        return ranked.select("id", "text_hash", "copies", "n_chars", F.col("id").alias("next_id"),
                             F.col("text_hash").alias("next_hash"))
    other = ranked.select(F.pmod(F.col("place") + 1, F.lit(n)).alias("place"), F.col("id").alias("next_id"),
                          F.col("text_hash").alias("next_hash"))
    return cut(ranked.join(other, "place").drop("place"))


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, share: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of an edited text, and the likeness of both.

    The edited text has the last floor(n_chars / share) code points replaced by the first
    as many (or all) of the next text (:func:`next_texts`).
    Columns: id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next (resemblance to the edited and the
    next text), held_edited (containment in the edited text), n_shingles (distinct, estimated).

    Cases: a null text is empty; a text without words has an empty sketch, which resembles only
    empty ones (1, else 0); null ids follow the smallest id; repeated rows give as many rows, each followed by its equal but
    the last; one row alone is its own next; an empty table gives an empty result; further columns are ignored.

    Scale: a text is shuffled once, by its id and hash; at most a third of it and its
    sketch travel to the text before it.  A row holds one text and its hashes, never those of a group.
    """
    near = next_texts(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if near.where("copies > 1").limit(1).count():
        texts = texts.dropDuplicates(["id", "text_hash"])

    def met(other: DataFrame, oid: str, oth: str) -> DataFrame:
        return texts.join(other, F.col("id").eqNullSafe(F.col(oid)) & (F.col("text_hash") == F.col(oth)))

    ask = near.select(F.col("id").alias("to_id"), F.col("text_hash").alias("to_hash"), "next_id", "next_hash", "copies",
                      "n_chars", F.floor(F.col("n_chars") / share).cast("int").alias("take"))
    sent = met(ask, "next_id", "next_hash").select("to_id", "to_hash", "copies", "n_chars", "take",
                                                   F.substring("text", F.lit(1), F.col("take")).alias("piece"),
                                                   word_hashes(F.col("text")).alias("hashes"))
    sent = sent.withColumn("next_sketch", sketch("hashes", k, width)).drop("hashes")
    base = met(sent, "to_id", "to_hash").withColumn("hashes", word_hashes(F.col("text")))
    base = base.withColumn("sketch", sketch("hashes", k, width))
    # one edit by the text that follows, and for repeated rows one by the text itself
    step = F.array(F.struct(F.lit(1).cast("long").alias("n"), F.col("piece").alias("piece"), F.col("next_sketch").alias("s")))
    again = F.array(F.struct((F.col("copies") - 1).alias("n"), F.substring("text", F.lit(1), F.col("take")).alias("piece"),
                             F.col("sketch").alias("s")))
    base = base.withColumn("edit", F.explode(F.when(F.col("copies") > 1, F.concat(step, again)).otherwise(step)))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("take")).cast("int")), F.col("edit.piece"))
    made = base.select("id", "n_chars", "sketch", F.col("edit.n").alias("n"), F.col("edit.s").alias("next_sketch"),
                       edited.alias("edited"))
    made = made.withColumn("hashes", word_hashes(F.col("edited"))).withColumn("edited_sketch", sketch("hashes", k, width))
    out = made.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch",
                      resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                      resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
                      containment(F.col("sketch"), F.col("edited_sketch"), k).alias("held_edited"),
                      distinct_shingles(F.col("sketch"), k).alias("n_shingles"), "n")
    return out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
