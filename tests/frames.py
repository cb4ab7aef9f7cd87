"""Tables of the tests, made by Spark from seeded hashes."""

from pyspark.sql import functions as F

from assay.functions.portable import uniform


def churn(spark):
    """3,000 rows with an id, a leak, a column with a tenth missing, and about a fifth positive."""
    u = lambda s: uniform(s, "customer_id")
    df = spark.range(100000, 103000).withColumnRenamed("id", "customer_id").repartition(4)
    df = df.withColumns({"tenure_months": (1 + F.floor(u(1) * 71)).cast("int"), "monthly_charges": F.round(15 + 135 * u(2), 2), "support_tickets": F.floor(u(3) * 5).cast("int"), "has_streaming": u(4) < 0.4, "last_login_days": F.when(u(5) >= 0.1, F.round(-10 * F.log(u(6) + 1e-9)))})
    df = df.withColumns({"contract": F.when(u(7) < 0.55, "month-to-month").when(u(7) < 0.8, "one-year").otherwise("two-year"), "payment_method": F.element_at(F.array(*map(F.lit, ("card", "bank", "check", "paypal"))), (1 + F.floor(u(8) * 4)).cast("int"))})
    logit = -2.2 + F.when(F.col("contract") == "month-to-month", 1.2).otherwise(-0.5) - 0.03 * F.col("tenure_months") + 0.35 * F.col("support_tickets") + 0.01 * (F.col("monthly_charges") - 70)
    yes = u(9) < 1 / (1 + F.exp(-logit))
    flipped = u(10) < 0.01
    return df.withColumn("refund_issued", F.when(flipped, 1 - yes.cast("int")).otherwise(yes.cast("int"))).withColumn("Churn", F.when(yes, "Yes").otherwise("No"))


def houses(spark):
    """2,000 rows of a regression, with noise columns and missing values."""
    u = lambda s: uniform(s, "id")
    df = spark.range(2000).repartition(4).withColumns({"sqft": F.round(400 + 4000 * u(1)), "bedrooms": (1 + F.floor(u(1) * 4 + u(2) * 3)).cast("int"), "age_years": F.floor(u(3) * 100).cast("int"), "garage": u(4) < 0.6, "lot_size": F.when(u(5) >= 0.15, 1000 + 9000 * u(6))})
    df = df.withColumn("neighborhood", F.element_at(F.array(*map(F.lit, ("north", "south", "east", "west", "center"))), (1 + F.floor(u(7) * 5)).cast("int")))
    return df.withColumn("SalePrice", F.round((30000 + 150 * F.col("sqft") - 500 * F.col("age_years") + F.when(F.col("neighborhood") == "center", 80000).otherwise(0) + 60000 * u(8)) / 100) * 100)
