from pyspark.sql import functions as F

from assay.operators import metrics


def test_predictions_of_several_classes_are_made_once(spark):
    """Not once for each class and pass."""
    made = spark.sparkContext.accumulator(0)

    def share(k):
        made.add(1)
        return [(k * m % 101) / 101 for m in (7, 13, 29)]

    rows = spark.range(0, 300, 1, 3).select(F.lit("m").alias("model"), (F.col("id") % 3).cast("int").alias("label"), F.udf(share, "array<double>")("id").alias("probs"))
    found = metrics.roc_auc_ovr(rows, ["model"]).first()["value"]
    assert made.value == 300
    each = []
    for c, m in enumerate((7, 13, 29)):
        scores = [((k * m % 101), k % 3 == c) for k in range(300)]
        pos, neg = [s for s, y in scores if y], [s for s, y in scores if not y]
        each.append(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert abs(found - sum(each) / 3) < 1e-12
