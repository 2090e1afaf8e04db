"""Words of the decontamination contract, made without a pattern."""

import re

from pyspark.sql import functions as F

from varietas.llm import decontaminate


def test_words_equal_the_contract_pattern_and_use_none(spark):
    every = "".join(f"a{chr(c)}B" for c in range(128))
    texts = [every, "", " ", None, "  Lead and Trail\n", "Éa ß-x  ZZ\x00q", " ünder_score", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decontaminate.words(F.col("t")).alias("w"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for i, t in enumerate(texts)}
    assert {r["i"]: r["w"] for r in df.collect()} == want
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
