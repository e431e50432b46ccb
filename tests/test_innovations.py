"""The scan over blocks equals a sequential filter."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tillpoint.forecast.innovations import innovations


def _sequential(u, theta):
    e = np.zeros(len(u) + len(theta))
    for t, v in enumerate(u):
        e[len(theta) + t] = 0.0 if np.isnan(v) else v - theta @ e[t:t + len(theta)][::-1]
    return np.where(np.isnan(u), np.nan, e[len(theta):])


def test_blocks_equal_a_sequential_filter(spark):
    rng = np.random.default_rng(1)
    parts = []
    for k, n, theta in ((1, 500, [0.6, -0.3, 0.2]), (2, 37, [0.9, 0.0, -0.4]), (3, 2, [0.5, 0.1, 0.0])):
        u = rng.normal(size=n)
        u[: min(3, n - 1)] = np.nan
        if n > 100:
            u[[60, 61, 200]] = np.nan
        parts.append(pd.DataFrame({"k": k, "pos": range(n), "u": u, "theta": [theta] * n}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).withColumn("u", F.expr("nullif(u, double('NaN'))"))
    for block in (7, 64, 100_000):
        got = innovations(df.repartition(5), "theta", "u", "pos", ["k"], block=block).toPandas().sort_values(["k", "pos"])
        want = np.concatenate([_sequential(p["u"].to_numpy(), np.array(p["theta"].iloc[0])) for p in parts])
        assert np.allclose(got["e"].astype(float), want, equal_nan=True)
    one = innovations(df.where("k = 1").drop("k"), "theta", "u", block=50).toPandas().sort_values("pos")
    assert np.allclose(one["e"].astype(float), want[:500], equal_nan=True)
