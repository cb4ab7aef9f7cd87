import pytest
from pyspark.sql import functions as F

from assay.operators.rank import in_text_ranges, rank_by_text


def test_ranges_are_even_on_common_beginnings(spark):
    df = spark.range(200000).select(F.format_string("Customer#%09d", "id").alias("v"), F.lit(1).alias("g"))
    sizes = [r["n"] for r in in_text_ranges(df, "v", ["g"], "b", 10000).groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 200000 / 20


@pytest.mark.parametrize("groups", [1, 3])
def test_ranks_of_texts(spark, groups):
    values = ["", "a", "aa", "é", "Customer#1", "Customer#", "Customer#10", "\U0001f600", "z" * 300, "z" * 299 + "a"] + [f"k{i}" for i in range(50)]
    df = spark.createDataFrame([(v, i % groups) for i, v in enumerate(values)], "v string, g int").repartition(3)
    found = {(r["g"], r["v"]): r["rank"] for r in rank_by_text(df, "v", ["g"]).collect()}
    for g in range(groups):
        own = sorted((v for i, v in enumerate(values) if i % groups == g), key=lambda v: v.encode())
        assert [found[g, v] for v in own] == list(range(1, len(own) + 1))
    assert sorted(r["rank"] for r in rank_by_text(df, "v", []).collect()) == list(range(1, len(values) + 1))
    assert rank_by_text(df.limit(0), "v", []).count() == 0
