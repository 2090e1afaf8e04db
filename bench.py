"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion through the ``noop`` sink (no rows travel to
the driver).  The first query also warms the JVM; every query is timed alone.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from varietas.plans import embedding_plans, sampling_plans, stats_plans, suite_plans, sweep_plans, topic_plans  # noqa: E402
from varietas.session import get_spark  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = {
    # D6 + V1 + V5: 36 source subsamples with Vendi scores (the flagship)
    "subsample_scores": sampling_plans.q_subsample_scores,
    # V3: cosine Vendi per topic over all sentence vectors
    "topic_vendi": embedding_plans.q_topic_vendi,
    # V7: moments of all pairwise cosine distances
    "distance_profile": embedding_plans.q_distance_profile,
    # X1 + X2: c-TF-IDF over every document
    "c_tf_idf": topic_plans.q_c_tf_idf,
    # Centred topic cosine
    "centred_topic_cosine": topic_plans.q_centred_topic_cosine,
    # T1 + T2 + A10 + J4: naive Bayes for all 36 subsamples, metrics, vs
    "sweep_results": sweep_plans.q_sweep_results,
    # A14 on lineitem
    "ols_by_group": stats_plans.q_ols_by_group,
    # A12 + A13 (distributed average ranks) on lineitem
    "corr_by_group": stats_plans.q_corr_by_group,
    # Exact deciles on lineitem
    "price_deciles": stats_plans.q_price_deciles,
    # E1 + B2 + T2 + J7: location variants of the held-out documents, scored by every model
    "location_suite": suite_plans.q_location_suite,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # stage / task times without the UI
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]})
    spark = get_spark(f"local[{cpus}]", app="varietas-bench",
                      shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    # warm the JVM and the Python workers outside the timings
    from pyspark.sql.functions import pandas_udf
    warm = pandas_udf(lambda s: s + 1, "long")
    spark.range(0, 10_000, numPartitions=cpus).select(warm("id").alias("x")).agg({"x": "sum"}).collect()

    def _np(pdf):
        import numpy as np
        return pdf.assign(id=np.asarray(pdf["id"]) + 1)
    spark.range(0, 10_000, numPartitions=cpus).withColumn("g", F.col("id") % cpus) \
        .groupBy("g").applyInPandas(lambda pdf: _np(pdf[["id"]]), "id long").agg({"id": "count"}).collect()
    # warm the JVM's parquet, string and regex paths on a table the headline
    # queries do not read (JIT compilation otherwise lands on the first text query)
    from varietas.functions.text import tokenize
    (spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode_outer(tokenize("text")).alias("w"))
     .groupBy("w").count().write.format("noop").mode("overwrite").save())
    times: dict[str, float] = {}
    for name, fn in HEADLINE.items():
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
