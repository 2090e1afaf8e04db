import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from varietas.functions.pvalues import f_upper, t_two_sided
from varietas.functions.text import bin_edges
from varietas.operators import stats

# Fixed values: (vs, mcc) of the 36 rows of the small-corpus source sweep
SMALL_SOURCE = [
    (1.975, 0.0), (1.916, 0.3410055986179968), (1.0, 0.6018008123072197), (1.083, 0.6352169254850863),
    (1.994, 0.6278869318223956), (1.015, 0.6421898353752664), (1.015, 0.5478551913138292),
    (2.38, 0.6542589262656453), (1.657, 0.6255135152452905), (1.419, 0.6234698886740376),
    (2.432, 0.6492377863180634), (2.059, 0.6809799233003844), (2.147, 0.64570956321079),
    (2.628, 0.6569157593440944), (2.473, 0.5999572238262744), (3.3, 0.6505189037836466),
    (2.614, 0.6536541889483066), (1.218, 0.6743007344521016), (4.793, 0.6441548680506404),
    (4.24, 0.6536390746730814), (3.284, 0.6658461983966274), (7.131, 0.6484684436950345),
    (6.784, 0.6780853183870652), (7.121, 0.6603082438683838), (7.617, 0.6542589262656453),
    (8.519, 0.6359391188825226), (7.774, 0.6719516266938839), (8.266, 0.659990744922234),
    (8.16, 0.6555220002080826), (8.178, 0.66695735444793), (8.18, 0.6360689813789342),
    (8.146, 0.6476924767543251), (8.18, 0.6367601807710518), (8.695, 0.6359391188825226),
    (8.695, 0.6305652688023412), (8.695, 0.6421898353752664),
]


def _sweep(spark):
    return spark.createDataFrame([("small", "source", v, m) for v, m in SMALL_SOURCE],
                                 "dataset string, dimension string, vs double, mcc double")


def test_golden_regression(spark):
    r = stats.ols(_sweep(spark), "mcc", "vs", ["dataset"]).collect()[0]
    assert abs(r["slope"] - 1.021229e-02) < 1e-8
    assert abs(r["intercept"] - 0.570321) < 1e-6
    assert abs(r["r2"] - 0.066331) < 1e-6
    assert abs(r["p"] - 0.129402) < 1e-6


def test_golden_correlations(spark):
    p = stats.pearson(_sweep(spark), "vs", "mcc", ["dataset"]).collect()[0]
    s = stats.spearman(_sweep(spark), "vs", "mcc", ["dataset"]).collect()[0]
    assert round(p["r"], 3) == 0.258 and round(s["rho"], 3) == 0.284


def test_golden_anova_low_high(spark):
    df = stats.with_min_max(_sweep(spark), "vs", ["dataset"], "s").withColumn("g", bin_edges("s"))
    sizes = {r["g"]: r["c"] for r in df.groupBy("g").agg(F.count("*").alias("c")).collect()}
    assert (sizes["low"], sizes["middle"], sizes["high"]) == (7, 19, 10)
    a = stats.anova(df, "mcc", "g", ["dataset"], groups=["low", "high"]).collect()[0]
    assert round(a["f"], 3) == 3.163


def test_metrics_rules(spark):
    conf = spark.createDataFrame([("a", 162, 127, 3, 43), ("zero", 0, 0, 165, 170), ("one", 5, 0, 5, 0)],
                                 "k string, tp long, fp long, fn long, tn long")
    got = {r["k"]: r for r in stats.metrics_from_confusion(conf).collect()}
    assert abs(got["a"]["mcc"] - 0.3410055986179968) < 1e-12
    assert abs(got["a"]["f1"] - 0.7136563876651983) < 1e-12
    assert abs(got["a"]["roc_auc"] - 0.6173796791443851) < 1e-12
    z = got["zero"]
    assert (z["mcc"], z["f1"], z["precision"], z["recall"], z["roc_auc"]) == (0.0, 0.0, 0.0, 0.0, 0.5)
    assert got["one"]["roc_auc"] is None and got["one"]["mcc"] == 0.0


def test_group_metrics_null_categories(spark):
    pred = spark.createDataFrame([("PrejudiceTest", "m", "region", "A", 1, 1), ("PrejudiceTest", "m", "region", "E", 0, 1),
                                  ("FactualTest", "m", "x", "y", 0, 0), ("FactualTest", "m", "x", "z", 0, 1)],
                                 "test string, model string, category string, category_minority string, label int, pred int")
    rows = {(r["test"], r["category_minority"]): r for r in stats.group_metrics(pred).collect()}
    assert ("FactualTest", None) in rows and rows[("FactualTest", None)]["Accuracy"] == 0.5
    assert rows[("PrejudiceTest", "A")]["Accuracy"] == 1.0


def test_ranks_and_quantiles_with_ties(spark):
    rng = np.random.default_rng(2)
    vals = rng.integers(0, 15, size=400).astype(float)
    grp = rng.integers(0, 3, size=400)
    pdf = pd.DataFrame({"g": grp, "v": vals, "id": np.arange(400)})
    df = spark.createDataFrame(pdf).repartition(5)
    rk = stats.average_rank(df, "v", ["g"], "r").toPandas().sort_values("id")
    ref = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(rk["r"].to_numpy(), ref.sort_index().to_numpy())
    q = stats.quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()
    for r in q:
        want = np.percentile(pdf[pdf.g == r["g"]].v, r["q"] * 100)
        assert abs(r["value"] - want) < 1e-9


def test_p_values():
    assert abs(t_two_sided(2.0, 10) - 0.07338803477074924) < 1e-12
    assert abs(t_two_sided(-1.5, 34) - 0.142843964) < 1e-8
    assert abs(f_upper(3.0, 2, 20) - 0.072538150) < 1e-8


def test_one_class_suite_metrics(spark):
    pred = spark.createDataFrame([("FactualTest", "m", None, None, 0, p) for p in (0, 0, 1, 0)],
                                 "test string, model string, category string, category_minority string, label int, pred int")
    r = stats.group_metrics(pred).collect()[0]
    assert r["MCC"] == 0.0 and r["F1"] == 0.0 and r["Accuracy"] == 0.75
