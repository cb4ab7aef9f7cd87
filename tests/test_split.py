import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions.portable import text_hash
from assay.operators import rank, split
from tests.frames import churn


def test_holdout_has_both_sides_and_class_shares(spark):
    got = split.split_holdout(churn(spark), "Churn", "classification", ["customer_id"]).cache()
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert n == {"dev": 2400, "hidden": 600}
    share = {r["split"]: r["s"] for r in got.groupBy("split").agg(F.avg((F.col("Churn") == "Yes").cast("int")).alias("s")).collect()}
    assert abs(share["dev"] - share["hidden"]) < 0.01
    assert got.select("customer_id").distinct().count() == 3000


def test_time_holdout_is_later(spark):
    t = spark.range(100).select(F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id as int))").alias("when"), F.col("id").alias("x"), (F.col("id") % 2).alias("y"))
    assert split.sorted_time_column(t, "y", "x") == "when"
    got = split.split_holdout(t, "y", "classification", ["x"], "when")
    r = {x["split"]: x for x in got.groupBy("split").agg(F.min("when").alias("lo"), F.max("when").alias("hi"), F.count("*").alias("n")).collect()}
    assert r["dev"]["hi"] < r["hidden"]["lo"] and r["hidden"]["n"] == 20
    fell = t.withColumn("when", F.when(F.col("x") == 57, F.col("when") - F.expr("interval 3 days")).otherwise(F.col("when")))
    assert split.sorted_time_column(fell, "y", "x") is None
    assert split.sorted_time_column(t.withColumn("when", F.when(F.col("x") != 5, F.col("when"))), "y", "x") is None


@pytest.mark.parametrize("assign", [lambda d: split.fold_kfold(d, 7, ["customer_id"]), lambda d: split.fold_stratified(d, 7, "Churn", ["customer_id"])])
def test_folds_are_even_and_ignore_partitions(spark, assign):
    a = assign(churn(spark).coalesce(1)).select("customer_id", "fold", "Churn")
    b = assign(churn(spark).repartition(17)).select("customer_id", "fold", "Churn")
    assert a.exceptAll(b).count() == 0
    sizes = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_stratified_folds_are_even_in_each_class(spark):
    got = split.fold_stratified(churn(spark), 7, "Churn", ["customer_id"]).groupBy("Churn", "fold").count().collect()
    for c in ("Yes", "No"):
        sizes = [r["count"] for r in got if r["Churn"] == c]
        assert max(sizes) - min(sizes) <= 1


def test_a_class_of_one_row_is_not_stratified(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "id long, y string")
    assert split.holdout_stratified(df, "y", ["id"]).where("split = 'hidden'").count() == 2


def test_time_folds(spark):
    df = spark.range(103).withColumn("t", F.when(F.col("id") < 100, F.col("id") % 10))
    got = split.fold_timeseries(df, 4, "t", ["id"]).cache()
    assert sorted(r["count"] for r in got.where("fold is not null").groupBy("fold").count().collect()) == [20] * 4
    assert [r["pos"] for r in got.where("t is null").orderBy("id").collect()] == [100, 101, 102]
    train = {r["train_fold"]: r["count"] for r in split.timeseries_train(got, 4, 103).groupBy("train_fold").count().collect()}
    assert train == {0: 23, 1: 43, 2: 63, 3: 83}


def test_ranks_equal_a_global_sort_without_one_task(spark):
    df = spark.range(5000).withColumn("v", F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") * 37 % 101).cast("double")))
    ranked = rank.rank_by_value(df, "v", ["id"], buckets=16)
    plain = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_last(), "id")))
    assert ranked.select("id", "rank").exceptAll(plain.select("id", F.col("rank").cast("long"))).count() == 0
    hashed = rank.rank_by_hash(df, text_hash(1, "id"), ["id"], ["v"])
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_cross_split_duplicates(spark):
    df = churn(spark)
    few = df.orderBy("customer_id").limit(5)
    assert split.cross_split_duplicates(df, few, "Churn").count() == 5
    assert split.cross_split_duplicates(df.where("customer_id > 100010"), few, "Churn").count() == 0


def test_guess_task(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i), "x", None if i == 4 else 1) for i in range(50)], "wide int, few int, real double, text string, holes int")
    got = {c: split.guess_task(rows, c).first()["task"] for c in rows.columns}
    assert got == {"wide": "regression", "few": "classification", "real": "regression", "text": "classification", "holes": "regression"}


def test_rows_without_a_possible_match_are_held_back(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("a.b"), F.when(F.col("id") % 7 > 0, F.col("id") % 11 / 10).alias("x"), F.col("id").alias("y"))
    few = spark.createDataFrame([(3, 0.3, 1), (-9, 0.0, 2), (0, None, 3), (0, -0.0, 4)], "`a.b` long, x double, y long")
    passed = split.possible_matches(df, few, ["a.b", "x"])
    assert passed.columns == df.columns and passed.count() < 20
    got = {r["y"] for r in split.cross_split_duplicates(df, few, "y").collect()}
    pairs = {(r["a.b"], r["x"]) for r in df.collect()}
    assert got == {y for a, x, y in [(3, 0.3, 1), (-9, 0.0, 2), (0, None, 3), (0, 0.0, 4)] if (a, x) in pairs}


@pytest.mark.parametrize("kind", ["double", "float"])
def test_not_a_number_and_signed_zeros_match(spark, kind):
    df = spark.createDataFrame([(float("nan"), "a"), (0.0, "b"), (None, "c")], f"x {kind}, y string")
    other = spark.createDataFrame([(float("nan"), "d"), (-0.0, "e"), (None, "f")], f"x {kind}, y string")
    assert split.cross_split_duplicates(df, other, "y").count() == 3
    assert split.cross_split_duplicates(df.limit(0), other, "y").count() == 0
