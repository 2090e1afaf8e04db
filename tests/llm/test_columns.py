"""No helper column of an operator may meet a column of the caller's table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from varietas.llm import bottomk, decontaminate, kdtree, langid, licenses, mixing, pii, quality_rules, simhash
from varietas.llm.common import crc_mod, n_words, numbered

NAMES = """_found _words _made _names _new _late _text _own row id text_hash fp component_id node label low n _id _th _n _removed _vid _vhash
 _verdict_id _verdict_hash _kept_id _kept_hash _kept_n _hit_id _hit_th _hit_hash _hit_spans _text_hash _mix_id _mix_key _copies _rows _copy
 copies copy of key hash size taken uid pi g s w k0 c0 o0 leaf hot_leaf heavy hg hp bg pg qg p piece piece_shard heavy_shard tree_shard shard slot
 _group _size _piece _coord_0 _p _off _rn _pid _g0 _count _before _part _nth _by0 host lines removed kept n_words spans items place
 sketch edited piece hashes edit next_id next_hash known digest name line_licenses lang_pred score n_mentions pii_kinds
 q w.x a`b""".split()
NAMES = list(dict.fromkeys(NAMES))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["Mr. John Smith met Mrs Mary Jones. " + " ".join(f"plain{i} word{i * 7 % 11}" for i in range(20)),
         "copy of a text " + " ".join(f"same{i}" for i in range(30)), "copy of a text " + " ".join(f"same{i}" for i in range(30)),
         "the benchmark passage has ten words or more in it surely and some others too " + " ".join(f"x{i}" for i in range(25)), None, "",
         " ".join(f"other{i}" for i in range(60))]


def docs(spark, extra=True):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)], SCHEMA)
    if extra:
        df = df.select("*", *[F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(NAMES)])
    return df


def bench(spark):
    return spark.createDataFrame([(1, "the benchmark passage has ten words or more in it surely")], "item_id long, text string")


def pack(df):
    return sorted((str(r["doc_id"]), str(r["text"]), *(v for k, v in sorted(r.asDict().items()) if k in NAMES)) for r in df.collect())


KEEPING = {
    "pii": lambda spark, d: pii.replace_pii(d, "k"),
    "quality": lambda spark, d: quality_rules.apply_rules(d),
    "simhash": lambda spark, d: simhash.deduplicate(d),
    "documents": lambda spark, d: decontaminate.decontaminate(d, bench(spark)),
    "spans": lambda spark, d: decontaminate.decontaminate(d, bench(spark), remove="spans"),
    "mixing": lambda spark, d: mixing.take(d, n_words(F.col("text")), F.xxhash64("text")),
    "kdtree": lambda spark, d: kdtree.shard(d, 2, F.coalesce(F.octet_length("text"), F.lit(0)) + 8, F.xxhash64("text"),
                                            {"lang": kdtree.unit_hash(F.col("lang"))}, ["doc_id"]),
    "numbered": lambda spark, d: numbered(d, ["source"], ["doc_id"], "the_number"),
    **{f"stage {name}": (lambda spark, d, f=f: f(spark, d, "/root/testdata/sf0.001")) for name, f in corpus_pipeline.STAGES[:-1]},
}


@pytest.mark.parametrize("name", list(KEEPING))
def test_columns_come_back_unchanged(spark, name):
    plain, got = KEEPING[name](spark, docs(spark, extra=False)).collect(), KEEPING[name](spark, docs(spark)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in plain) == sorted((r["doc_id"], r["text"] or "") for r in got) and got
    for r in got:
        assert [r[n] for n in NAMES] == [f"{i}-{r['doc_id']}" for i in range(len(NAMES))]


READING = {
    "judge": lambda spark, d: quality_rules.judge(d), "near": lambda spark, d: simhash.near_duplicates(d),
    "hits": lambda spark, d: decontaminate.hits(d, bench(spark)), "scan": lambda spark, d: licenses.scan(d, licenses.known_licences(spark)),
    "fingerprints": lambda spark, d: bottomk.fingerprints(d), "mix": lambda spark, d: mixing.mix(d, n_words(F.col("text"))),
    "langid": lambda spark, d: langid.predict(d, langid.fit(d.where(crc_mod(F.col("doc_id"), 3) != 1)), keep={"doc_id": F.col("doc_id")}),
    "stage sharding": lambda spark, d: corpus_pipeline.shards(spark, d, ""),
}


@pytest.mark.parametrize("name", list(READING))
def test_further_columns_do_not_matter(spark, name):
    plain, got = READING[name](spark, docs(spark, extra=False)), READING[name](spark, docs(spark))
    assert plain.columns == got.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
