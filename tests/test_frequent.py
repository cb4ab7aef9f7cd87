from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.operators.frequent import Frequent, summaries
from assay.operators.profile import target_purity, top_values


def rows(spark, n=6000):
    """A column of few values, one with three frequent ones among singles, a key, a key with repeats, long texts, values in twos, and nothing."""
    df = spark.range(n).repartition(5)
    i = F.col("id")
    return df.select(
        F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("few"),
        F.when(i % 10 == 1, "often").when(i % 12 == 2, "less").when(i % 14 == 3, "least").otherwise(F.concat(F.lit("x"), i)).alias("skewed"),
        F.concat(F.lit("Customer#"), i).alias("key"),
        F.concat(F.lit("k"), F.when(i < 4, 7).when(i < 6, 9).otherwise(i)).alias("nearly"),
        F.concat(F.repeat(F.lit("long "), 40), i % 40).alias("long text"),
        F.concat(F.lit("pair."), i % (n // 2)).alias("a.b"),
        F.lit(None).cast("string").alias("nothing"),
        (i % 4 == 0).alias("flag"),
    )


@pytest.mark.parametrize("size", [16, 4096])
def test_top_values_equal_plain_counts(spark, size):
    df = rows(spark).cache()
    want = set()
    for c in df.columns:
        counts = Counter(r[0] if not isinstance(r[0], bool) else str(r[0]).lower() for r in df.select(f"`{c}`").collect() if r[0] is not None)
        want |= {(c, v, n, p + 1) for p, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3])}
    assert {tuple(r) for r in Frequent(df, df.columns, size).top(3).collect()} == want


def test_summaries_lack_no_more_than_they_say(spark):
    df = rows(spark).cache()
    size, columns = 16, ["skewed", "key", "few"]
    found = {}
    for r in summaries(df, columns, size).collect():
        found.setdefault(r["name"], {})[r["key"]] = r["n"]
    for i, c in enumerate(columns):
        lacking = found[i].pop(None)
        true = Counter("=" + r[0] for r in df.select(c).collect() if r[0] is not None)
        assert lacking <= df.count() / size and len(found[i]) <= 5 * 2 * size
        assert all(found[i].get(k, 0) <= n <= found[i].get(k, 0) + lacking for k, n in true.items())


def test_columns_of_few_values(spark):
    df = rows(spark)
    assert set(Frequent(df, df.columns, 16).few(50)) == {"few", "nothing", "flag"}  # 40 texts don't fit 2 x 16
    assert set(Frequent(df, df.columns).few(50)) == {"few", "long text", "nothing", "flag"}
    assert Frequent(df.limit(0), df.columns).top(3).count() == 0 and Frequent(df, []).top(3).count() == 0
    assert {r["name"] for r in target_purity(df, "flag").collect()} == {"few", "long text"}
    assert top_values(df, "flag", 1).where("name = 'few'").first()["value"] == "a"
