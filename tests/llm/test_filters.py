"""Quality rules, SimHash near duplicates and decontamination against brute force."""

import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varietas.llm import components, decontaminate, queries_filter, quality_rules, simhash

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def oracle(name, folder=SMALL):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            at = f"{folder}/{t}.parquet" if os.path.isfile(f"{folder}/{t}.parquet") else f"{folder}/{t}.parquet/*.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    res = con.execute(queries_filter.ORACLE[name])
    cols = [d[0] for d in res.description]
    return cols, sorted(res.fetchall())


@pytest.mark.parametrize("name", ["op4_quality_rules", "op6_decontaminate"])
def test_query_matches_sql(spark, name):
    cols, want = oracle(name)
    got = queries_filter.QUERIES[name](spark, SMALL).select(*cols).collect()
    assert sorted(tuple(r) for r in got) == want


# ---- quality rules -----------------------------------------------------------------------------------------

def brute_repeats(words, size=8):
    w = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    hit = {i + o for i, x in enumerate(w) if w.count(x) > 1 for o in range(size)}
    return len(hit)


def test_repeat_words_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 30))]
        assert quality_rules.repeat_words(words, 3) == brute_repeats(words, 3)
        assert quality_rules.repeat_words(words, 8) == brute_repeats(words, 8)


def test_quality_edge_cases(spark):
    plain = " ".join(f"w{i}x" for i in "abcdefghijklmnopqrstuvwxyz")
    texts = [None, "", "   \n\t", plain, plain, "é ü #|$\nx\nx\n \n \nX", plain + "\r\n" + plain.upper()]
    docs = frame(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r["id"]: r for r in quality_rules.judge(docs).collect()}
    assert [got[i]["n_words"] for i in range(7)] == [0, 0, 0, 26, 26, 6, 52]
    assert got[5]["word_chars"] == 8 and got[5]["n_symbols"] == 3 and got[5]["n_dup_lines"] == 1
    assert [got[i]["kept"] for i in range(7)] == [False, False, False, True, True, False, True]
    assert quality_rules.judge(docs.limit(0)).count() == 0
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6]


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    rng = random.Random(3)
    unique = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n))
    rich = [f"Read our COOKIE  notice {i} now\n{unique(40)}\n{unique(10)}" for i in range(60)]
    poor = [f"{unique(9)}\n" + "\n".join(f"menu entry number {k} of this very site here {i}" for k in "ab") for i in range(60)]
    copies = [f"{unique(30)}\nmiddle of the copies\n{unique(5)}"] * 40
    docs = frame(spark, rich + poor + copies)
    got = {r["id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 6 for i in range(60))      # numbers and case do not count
    assert all(got[i]["depleted"] and not got[i]["kept"] for i in range(60, 120))
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 0 for i in range(120, 160))  # copies are one document
    out = {r["doc_id"]: r["text"] for r in quality_rules.apply_rules(docs).collect()}
    assert out[0] == rich[0].split("\n", 1)[1] and out[130] == copies[0] and 75 not in out
    # another host does not count
    two = frame(spark, rich[:6], "a").union(frame(spark, rich[6:12], "b"))
    assert quality_rules.judge(two).where("n_removed_words > 0").count() == 0


def test_sql_agrees_on_pages_of_frequent_lines(spark, tmp_path):
    menu = [f"entry {k} of the menu that all of these pages share here" for k in "abcdefgh"]
    rng = random.Random(4)
    pages = ["\n".join(rng.sample(menu, 5)) for _ in range(200)]
    rich = [f"the menu of this site\n{' '.join(str(rng.random()).replace('0.', 'w') for _ in range(30))}" for _ in range(40)]
    docs = frame(spark, pages).union(frame(spark, [*rich, None, "", *rich[:3]], "t")).union(frame(spark, rich[:15], None))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cols, want = oracle("op4_quality_rules", str(tmp_path))
    got = queries_filter.op4_quality_rules(spark, str(tmp_path)).select(*cols).collect()
    assert sorted(tuple(r) for r in got) == want and sum(not r["kept"] for r in got) >= 200


def test_pages_of_frequent_lines_only_count_as_documents(spark):
    menu = [f"entry {k} of the menu that all of these pages share here" for k in "abcdef"]
    pages = ["\n".join(p) for p in itertools.islice(itertools.permutations(menu), 60)]
    shared = "one phrase aaa that many other lines have in common"     # one common minimum must not merge pages either
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ghijklmnop") for _ in range(9))
    rich = [f"the site's notice\n{shared}\n" + " ".join(word() for _ in range(30)) for _ in range(60)]
    got = {r["id"]: r for r in quality_rules.judge(frame(spark, pages).union(frame(spark, [None] * 60 + rich, "t"))
                                                   .where("text IS NOT NULL")).collect()}
    assert all(got[i]["depleted"] and not got[i]["kept"] and len(got[i]["removed"]) == 6 for i in range(60))
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 13 for i in range(60, 120))


# ---- SimHash -----------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words, cur = words + [cur] * bool(cur), ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_fingerprints_and_components_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r["text"]) for r in docs]
    label = brute_components(fps)
    got = {r["doc_id"]: r for r in queries_filter.op3_simhash_golay(spark, SMALL).collect()}
    for i, r in enumerate(docs):
        assert got[r["doc_id"]]["fingerprint"] == f"{fps[i]:016x}"
        assert got[r["doc_id"]]["component_id"] == docs[label[i]]["doc_id"]


def test_golay_lists_share_an_index_up_to_two_errors():
    near, far = simhash._tables()
    assert (np.bitwise_count(near) <= 3).all() and (np.bitwise_count(far).max(axis=1)[np.bitwise_count(near) == 3] == 4).all()
    words = near.astype(np.int64)   # one word of every coset; the code is linear, so these stand for all words
    errors = [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]

    def lists(w):
        place, index = simhash.codeword_indices(w)
        out = [set() for _ in w]
        for p, k in zip(place, index):
            out[p].add(int(k))
        return out
    base = lists(words)
    for e in errors:
        assert all(a & b for a, b in zip(base, lists(words ^ e)))


def test_keys_meet_and_links_connect(spark):
    rng = random.Random(5)
    for k in (1, 2, 3, 4):
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randrange(1, k + 1)):
                y ^= 1 << b
            place, key = simhash.keys(np.array([x, y], np.uint64).view(np.int64), k)
            assert set(key[place == 0]) & set(key[place == 1])
    # a crowd around one value (far over the group bound), a chain, and noise
    seed = rng.getrandbits(64)
    fps = {seed ^ 1 << i for i in range(64)} | {seed ^ 1 << i ^ 1 << j ^ 1 << k for i, j, k in
                                                 [rng.sample(range(64), 3) for _ in range(150)]} | {seed}
    chain = [rng.getrandbits(64)]
    for i in range(12):
        chain.append(chain[-1] ^ 1 << (2 * i) ^ 1 << (2 * i + 1))
    fps = sorted(fps | set(chain) | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(nodes, 2)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    label = {r["node"]: r["label"] for r in components.components(edges).collect()}
    want = brute_components(fps)
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(label.get(x, x))
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_near_duplicate_edge_cases(spark):
    texts = [None, "", " \n", "one", "ONE", "a b c", "a b c", "b b b " * 4000]
    docs = frame(spark, texts).withColumn("fp", F.lit("clash")).withColumn("id", F.lit(0))
    docs = docs.unionByName(docs.where("doc_id = 5"))
    got = sorted((r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (5, 5), (6, 5), (7, 7)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 5, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x y z q"), (3, "x y z q"), (None, "alone and far away")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(nulls).collect()) == ["3", "None"]


# ---- decontamination ---------------------------------------------------------------------------------------

def brute_hits(texts, items, n=10):
    import re
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+",
                               "".join(c.lower() if c < "\x80" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, found = low(t), set(), set()
        for k, x in items:
            v = low(x)
            for i in range(max(1, len(v) - n + 1) if v else 0):
                win = v[i:i + n]
                for j in range(len(w) - len(win) + 1):
                    if w[j:j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        found.add(str(k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_hits_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    rng = random.Random(9)
    words = ["a", "b", "Çé", "d1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(6)] + [(7, None), (8, "...")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(20)] + [None, "", "B, a-A!"]
    docs = frame(spark, texts).withColumn("hash", F.lit("clash")).withColumn("w", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, [x for x in items if x[1]], 4)
    got = {r["id"]: r for r in decontaminate.hits(docs, bench, 4).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], len(got[i]["items"]),
             hashlib.sha256(",".join(got[i]["items"]).encode()).hexdigest()) for i in range(len(texts))] == want


def test_decontaminate_removes(spark):
    item = "The quick brown fox jumps over the lazy dog and runs home"
    texts = [f"Before it. {item.upper()}, after it", "clean words only", None, item, "clean words only"]
    docs, bench = frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs.unionByName(docs.where("doc_id = 1"))
    gone = decontaminate.decontaminate(docs, bench)
    assert gone.columns == docs.columns and sorted(r["doc_id"] for r in gone.collect()) == [1, 1, 2, 4]
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert left[0] == "Before it. , after it" and left[3] == "" and left[1] == texts[1] and left[2] is None
    assert decontaminate.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.hits(docs.limit(0), bench).count() == 0
