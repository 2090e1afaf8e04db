"""Tasks of the FEAST quadrature."""

import numpy as np

from varietas.llm import whitening


def test_feast_needs_no_shuffle_for_its_points(spark):
    v = np.diag([9.0, 4.0, 2.0, 1.0, 0.5])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    frame = whitening.quadrature_points(spark, 8)
    assert frame.rdd.getNumPartitions() == 8 and "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(whitening.components(spark, v, 3)[0], [9.0, 4.0, 2.0])
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
