"""Bottom-k fingerprints against brute force."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from varietas.llm import bottomk, queries_sketch

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[⺀-鿿豈-﫿]|[^ \t-\r⺀-鿿豈-﫿]+")


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def shingles(text, width=5):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(low)]
    out = set()
    for i in range(max(len(h) - width + 1, 1 if h else 0)):
        v = 42
        for x in h[i:i + width]:
            v = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), v)
        out.add(signed(v))
    return out


def likeness(a, b, k):
    sa, sb = sorted(a)[:k], sorted(b)[:k]
    u = sorted(set(sa) | set(sb))
    u = u if len(sa) < k and len(sb) < k else u[:k]
    return 1.0 if not u else len(set(u) & set(sa) & set(sb)) / len(u)


def expected(rows, k=bottomk.K):
    """Brute force over a list of (doc_id, text), one order of the rows with equal ids."""
    hash_of = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42)) if t is not None else 42
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(r[1])), reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        take = len(text) // 3
        edited = text[:len(text) - take] + nxt[:take]
        own, other = shingles(text), shingles(edited)
        show = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(s)[:k])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(other),
                    round(likeness(own, other, k), 12), round(likeness(own, shingles(nxt), k), 12)))
    return Counter(out)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def got(df):
    return Counter(tuple(round(r[c], 12) if isinstance(r[c], float) else r[c] for c in COLUMNS) for r in df.collect())


def test_whole_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries_sketch.op11_bottomk_fingerprints(spark, SMALL)) == expected(rows)


def query(docs):
    f = bottomk.fingerprints(docs)
    return f.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", bottomk.as_text(F.col("sketch")).alias("fingerprint"),
                    bottomk.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def test_odd_rows(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(30_000))
    rows = [(1, "One two three four five six"), (2, None), (3, ""), (4, long), (4, long), (4, "another text, same id"), (None, "no id at all"),
            (None, None), (7, "été été naïve 漢字かな交じり文 😀 x"), (8, "ONE two three four five six"), (9, "  \t\n "), (9, "  \t\n "), (9, "  \t\n ")]
    assert got(query(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)
    one = [(5, "only row")]
    docs = spark.createDataFrame([(*one[0], 1, "x", "y")], "doc_id bigint, text string, id int, sketch string, n string")
    assert got(query(docs)) == expected(one)
    none = query(spark.createDataFrame([], "doc_id bigint, text string"))
    assert none.collect() == [] and none.columns == COLUMNS


def test_a_third_of_all_rows_with_one_text(spark):
    rows = [(i, "the one text that everyone has copied" if i % 3 else f"text {i} of its own, with some words {i}") for i in range(300)]
    assert got(query(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)


@pytest.mark.parametrize(("share", "size"), [(0.9, 3000), (0.5, 3000), (0.1, 3000), (0.5, 60)])
def test_estimates(spark, share, size):
    a = [f"w{i}" for i in range(size)]
    b = a[:int(size * share)] + [f"v{i}" for i in range(size - int(size * share))]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    df = df.select(bottomk.word_hashes(F.col("a")).alias("a"), bottomk.word_hashes(F.col("b")).alias("b"))
    df = df.select(bottomk.sketch("a", 256).alias("a"), bottomk.sketch("b", 256).alias("b"))
    r = df.select(bottomk.resemblance(F.col("a"), F.col("b"), 256).alias("j"), bottomk.containment(F.col("a"), F.col("b"), 256).alias("c"),
                  bottomk.distinct_shingles(F.col("a"), 256).alias("n")).first()
    sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
    slack = 0.12 if size > 256 else 1e-9
    assert abs(r["j"] - len(sa & sb) / len(sa | sb)) <= slack and abs(r["c"] - len(sa & sb) / len(sa)) <= 1.5 * slack
    assert abs(r["n"] / len(sa) - 1) <= (0.2 if size > 256 else 0)


def test_parts_merge_to_the_whole(spark):
    words = [f"w{i * i % 4001}" for i in range(2000)]
    parts = [(1, " ".join(words[i:i + 104])) for i in range(0, 2000, 100)] + [(2, "a b"), (2, None), (3, None)]
    df = spark.createDataFrame(parts, "k int, t string").select("k", bottomk.word_hashes(F.col("t")).alias("h"))
    df = df.select("k", bottomk.sketch("h").alias("s"))
    merged = {r["k"]: r["s"] for r in bottomk.merge_rows(df, ["k"], "s").collect()}
    assert merged == {1: sorted(shingles(" ".join(words)))[:bottomk.K], 2: sorted(shingles("a b")), 3: []}
    two = df.where("k = 1").limit(2).collect()
    pair = spark.createDataFrame([(two[0]["s"], two[1]["s"])], "a array<bigint>, b array<bigint>")
    assert pair.select(bottomk.merge(F.col("a"), F.col("b"))).first()[0] == sorted({*two[0]["s"], *two[1]["s"]})[:bottomk.K]


def test_no_python_workers(spark):
    plan = queries_sketch.op11_bottomk_fingerprints(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
