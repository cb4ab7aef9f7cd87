import pytest
from pyspark.sql import functions as F

from assay.functions.portable import uniform
from assay.operators import filters, profile, split
from tests.frames import churn, houses


def flags(df, target, task="classification"):
    return {r["name"]: r["flags"] for r in profile.column_profile(df, target, task).collect()}


def test_flags(spark):
    dev = split.split_holdout(churn(spark), "Churn", "classification", ["customer_id"]).where("split = 'dev'").drop("split").cache()
    got = flags(dev, "Churn")
    assert "possible_leakage" in got["refund_issued"] and "id_like" in got["customer_id"]
    assert not got["contract"] and not got["monthly_charges"]
    assert {r["name"] for r in profile.auto_drop_columns(profile.column_profile(dev, "Churn", "classification")).collect()} == {"customer_id", "refund_issued"}


def test_a_text_leak(spark):
    u = lambda s: uniform(s, "id")
    df = spark.range(1000).withColumn("y", F.when(u(1) < 0.5, "a").otherwise("b"))
    df = df.withColumn("status", F.when((u(2) < 0.995) & (F.col("y") == "a"), "closed").otherwise("open")).withColumn("noise", F.when(u(3) < 0.5, "p").otherwise("q")).drop("id")
    got = flags(df, "y")
    assert "possible_leakage" in got["status"] and not got["noise"]


def test_missing_constant_and_nan(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1.0, float("nan") if i % 3 else float(i), 5, float(i)) for i in range(60)], "id int, half double, n double, same int, y double")
    p = {r["name"]: r for r in profile.column_profile(df, "y", "regression").collect()}
    assert "mostly_missing" in p["half"]["flags"] and "constant" in p["half"]["flags"] and "constant" in p["same"]["flags"]
    assert p["n"]["missing_pct"] == 66.7 and p["same"]["corr_with_target"] is None and "possible_leakage" in p["id"]["flags"]
    assert p["id"]["kind"] == "numeric" and p["n"]["n_unique"] == 20


def test_nested_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0], "a")], "id int, v array<double>, y string")
    got = {r["name"]: r["kind"] for r in profile.column_profile(df, "y", "classification").collect()}
    assert got == {"id": "numeric", "v": "nested"}
    assert profile.column_profile(df.limit(0), "y", "classification").count() == 2


def test_approximate_counts_agree_where_they_decide(spark):
    df = churn(spark)
    exact = {r["name"]: r["n_unique"] for r in profile.distinct(df).collect()}
    near = {r["name"]: r["n_unique"] for r in profile.distinct(df, approx=True).collect()}
    assert near["customer_id"] == exact["customer_id"] == 3000 and all(abs(near[c] - exact[c]) <= 0.2 * exact[c] for c in exact)


def test_inspection(spark):
    df = churn(spark)
    assert profile.inspect_sample(df, "last_login_days", ["customer_id"]).count() == 10
    assert profile.inspect_value_counts(df, "last_login_days", 100).where("value is null").count() == 1
    assert profile.inspect_target_rate(df, "customer_id", "Churn").count() == 0
    shares = profile.inspect_target_rate(df, "contract", "Churn").groupBy("value").agg(F.sum("share").alias("s")).collect()
    assert len(shares) == 3 and all(abs(r["s"] - 1) < 0.002 for r in shares)
    with pytest.raises(ValueError, match="there are"):
        profile.inspect_sample(df, "nope", ["customer_id"])


def test_regression_summary(spark):
    r = profile.target_summary(houses(spark), "SalePrice").first()
    assert r["min"] >= 30000 and r["skew"] is not None and r["missing_pct"] == 0


def test_filters(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c")], "y double, x string")
    assert filters.drop_missing_target(df, "y").count() == 1
    assert filters.drop_columns(df, ["x", "y", "zz"], "y").columns == ["y"]
    assert filters.filter_known_labels(df, "x", df.where("x <> 'c'")).count() == 2
