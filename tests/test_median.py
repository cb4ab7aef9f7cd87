import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators.median import medians


@pytest.mark.parametrize("buckets,most", [(1000, 1 << 14), (4, 5), (2, 1)])
def test_medians_equal_numpy(spark, buckets, most):
    r = np.random.default_rng(4)
    n = 3001
    x = {"smooth": r.normal(size=n), "skewed": np.exp(20 * r.normal(size=n)), "few": r.integers(0, 3, n) / 7, "hot": np.where(r.random(n) < 0.6, 5.5, r.normal(size=n)), "holes": np.where(r.random(n) < 0.3, np.nan, r.normal(size=n)), "ints": r.integers(-(10**9), 10**9, n).astype(float), "none": np.full(n, np.nan)}
    part = r.integers(0, 5, n)
    trains = {0: [1, 2, 3, 4], 1: [0, 2, 3, 4], 7: [0, 1, 2, 3, 4], 8: [3], 9: []}
    rows = [(int(p), *[None if np.isnan(v) and k == "holes" else float(v) for k, v in zip(x, vs)]) for p, *vs in zip(part, *x.values())]
    df = spark.createDataFrame(rows, ["part", *x]).repartition(4)
    found = medians(df, list(x), "part", trains, buckets, most)
    wanted = {}
    for t, parts in trains.items():
        for c, v in x.items():
            own = v[np.isin(part, parts) & ~np.isnan(v)]
            if len(own):
                wanted[t, c] = float(np.median(own))
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], rel=1e-15) for k in wanted)


def test_medians_of_nothing(spark):
    df = spark.range(4).select(F.lit(0).alias("part"), F.lit(None).cast("double").alias("x"), F.col("id").alias("odd name"))
    assert medians(df, ["x", "odd name"], "part", {0: [0]}) == {(0, "odd name"): 1.5}
    assert medians(df.limit(0), ["x"], "part", {0: [0]}) == {}
