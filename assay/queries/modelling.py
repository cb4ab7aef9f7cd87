"""Queries on models, cross-validation and whole runs.

Most have small parameters, so that a run over the given tables takes seconds; all rows are used.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.portable import uniform
from assay.operators import boosting, cv, split
from assay.operators.models import Spec
from assay.plans import compare
from assay.queries import query, table, uniform_sql
from assay.session import cut, shared_folder

KEYS = ["c_custkey"]
SMALLER = {"logreg": {"max_iter": 20}, "random_forest": {"n_estimators": 5, "max_depth": 4}, "gbt_leaf": {"n_estimators": 10, "num_leaves": 15}, "gbt_depth": {"n_estimators": 10, "max_depth": 4}, "mlp": {"hidden_layer_sizes": (32,), "max_iter": 30}, "ridge": {}}


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders' number, mean price and last date, and targets that depend on them by hash."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_orderdate").alias("last_order"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").join(o, "c_custkey", "left")
    u = uniform("target", "c_custkey")
    signal = F.col("c_acctbal") / 10000 + F.coalesce("n_orders", F.lit(0)) / 20 + F.when(F.col("c_mktsegment") == "BUILDING", 0.3).otherwise(0.0)
    c = c.withColumn("spend", 100 * signal + 40 * u)
    c = c.withColumn("rich", F.when(signal + u > 1.2, "yes").otherwise("no"))
    return c.withColumn("tier", F.when(signal + u < 0.8, "low").when(signal + u < 1.5, "middle").otherwise("high"))


def _of(target: str, spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).drop(*({"spend", "rich", "tier"} - {target}))


def _model(model: str, task: str, target: str, name: str, **params):
    spec = Spec(model, model, task, target, SMALLER[model] | params, drop=("c_custkey",))

    def run(spark: SparkSession, d: str) -> DataFrame:
        parted = split.split_holdout(_of(target, spark, d), target, task, KEYS)
        return cv.predict_holdout(parted.where("split = 'dev'").drop("split"), parted.where("split = 'hidden'").drop("split"), spec, KEYS)

    query(None, name)(run)


_model("logreg", "classification", "rich", "model_logreg", class_weight="balanced")
_model("ridge", "regression", "spend", "model_ridge")
_model("random_forest", "classification", "tier", "model_rf_clf")
_model("random_forest", "regression", "spend", "model_rf_reg")
_model("gbt_leaf", "classification", "rich", "model_gbt_leaf")
_model("gbt_depth", "regression", "spend", "model_gbt_depth")
_model("gbt_depth", "classification", "tier", "model_gbt_ovr")
_model("mlp", "classification", "tier", "model_mlp_clf")


@query("""WITH o AS (SELECT o_totalprice AS y, month(o_orderdate) AS month, year(o_orderdate) AS year, o_custkey % 100 AS part FROM orders),
x AS (SELECT (SELECT avg(y) FROM o) - y AS g, unnest([0, 1, 2]) AS feature, unnest([month, year, part]) AS v FROM o),
b AS (SELECT feature, v, sum(sum(g)) OVER w AS gl, sum(count(*)) OVER w AS hl, sum(sum(g)) OVER a AS g, sum(count(*)) OVER a AS h FROM x GROUP BY feature, v WINDOW w AS (PARTITION BY feature ORDER BY v), a AS (PARTITION BY feature)),
s AS (SELECT *, gl * gl / (hl + 5) + (g - gl) * (g - gl) / (h - hl + 5) - g * g / (h + 5) AS gain FROM b WHERE hl < h)
SELECT CAST(feature AS INT) AS feature, CAST(v AS DOUBLE) AS bound, round(gain / (SELECT sum(g * g) FROM x WHERE feature = 0), 8) AS gain, round(-gl / (hl + 5), 4) AS left_value, round(-(g - gl) / (h - hl + 5), 4) AS right_value FROM s ORDER BY s.gain DESC, feature, v LIMIT 1""")
def boost_stump(spark: SparkSession, d: str) -> DataFrame:
    """The first split of a boosted tree: of all features and bounds the one of largest gain, with L2 in gain and values."""
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("label"), F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 100).alias("p"))
    rows = VectorAssembler(inputCols=["m", "y", "p"], outputCol="features").transform(o)
    model = boosting.Boosting("regression", 0, boosting.Params(n_estimators=1, learning_rate=1.0, num_leaves=2, reg_lambda=5.0)).fit(rows)
    tree = model.rounds[0][0]
    feature, bin_ = tree.feature[0], tree.bin[0]
    spread = rows.agg(F.var_pop("label") * F.count("*")).first()[0]
    found = [(feature, float(model.bounds[feature][bin_]), round(tree.gain[0] / spread, 8), round(tree.value[tree.left[0]], 4), round(tree.value[tree.right[0]], 4))]
    return spark.createDataFrame(found, "feature int, bound double, gain double, left_value double, right_value double").coalesce(1)


@query()
def boost_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Log loss of the customers' tier after each round of three coupled trees; it falls."""
    spec = Spec("softmax", "gbt_leaf", "classification", "tier", {"n_estimators": 12, "num_leaves": 8}, drop=("c_custkey",))
    ready = cut(cv.prepare(_of("tier", spark, d), spec))
    made, model, _ = cv.fit_whole(ready, spec)
    rows = made.apply(ready)
    outs = []
    for k in range(1, len(model.rounds) + 1):
        part = boosting.Booster(model.task, model.bounds, model.start, model.rounds[:k], model.n_features)
        own = F.element_at("probs", F.col("label").cast("int") + 1)
        outs.append(part.transform(rows).agg(F.avg(-F.log(own)).alias("log_loss")).select(F.lit(k).alias("round"), F.round("log_loss", 6).alias("log_loss")))
    return reduce(DataFrame.unionByName, outs)


@query()
def model_mlp_reg(spark: SparkSession, d: str) -> DataFrame:
    """Customers' spend by a perceptron of the menu's defaults but for 30 epochs at most."""
    spec = Spec("mlp", "mlp", "regression", "spend", {"max_iter": 30}, drop=("c_custkey",))
    parted = split.split_holdout(_of("spend", spark, d), "spend", "regression", KEYS)
    return cv.predict_holdout(parted.where("split = 'dev'").drop("split"), parted.where("split = 'hidden'").drop("split"), spec, KEYS)


@query(f"""WITH f AS (SELECT o_orderkey, month(o_orderdate) + year(o_orderdate) * 12.0 - 23900 AS x, o_totalprice AS y, CAST(floor({uniform_sql("'ridge'", "CAST(o_orderkey AS VARCHAR)")} * 3) AS INT) AS fold FROM orders),
k AS (SELECT DISTINCT fold FROM f)
SELECT k.fold, round(regr_sxy(y, x) / (regr_sxx(y, x) + 10.0), 6) AS slope, round(avg(y) - regr_sxy(y, x) / (regr_sxx(y, x) + 10.0) * avg(x), 4) AS intercept FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold""")
def ridge_cv_1d(spark: SparkSession, d: str) -> DataFrame:
    """Ridge of one feature in each fold, from one pass of sums: training sums are totals less the fold's own."""
    o = table(spark, d, "orders").select((F.month("o_orderdate") + F.year("o_orderdate") * 12.0 - 23900).alias("x"), F.col("o_totalprice").alias("y"), F.floor(uniform("ridge", "o_orderkey") * 3).cast("int").alias("fold"))
    x, y = F.col("x"), F.col("y")
    sums = o.groupBy("fold").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    total = sums.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "x", "y", "xx", "xy")], F.lit(1).alias("one"))
    t = sums.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("n") + 10.0)
    return t.select("fold", F.round(slope, 6).alias("slope"), F.round(F.col("y") / F.col("n") - slope * F.col("x") / F.col("n"), 4).alias("intercept"))


@query()
def featurize(spark: SparkSession, d: str) -> DataFrame:
    spec = Spec("rows", "logreg", "classification", "rich", drop=("c_custkey",))
    ready = cv.prepare(_of("rich", spark, d), spec, ("c_custkey",))
    made = cv.learn(ready.withColumn("_own", F.lit(0)), spec, ("label", "c_custkey"), "_own", {0: [0]})[0]
    return made.apply(ready).select("c_custkey", "label", vector_to_array("features").alias("features"))


@query("""WITH r AS (SELECT value AS y, CAST(user_id % 50 AS DOUBLE) AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
f AS (SELECT *, n // 5 AS m, n - 4 * (n // 5) AS first FROM r), k AS (SELECT CAST(unnest(range(4)) AS INT) AS fold),
fits AS (SELECT fold, avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) / (regr_sxx(y, x) + 10.0 * var_pop(x)) AS slope FROM k JOIN f ON pos < first + fold * m GROUP BY fold),
scored AS (SELECT fold, CASE WHEN pos < first + fold * m THEN 'train' ELSE 'test' END AS side, y, my + slope * (x - mx) AS p FROM fits JOIN f ON pos < first + (fold + 1) * m)
SELECT fold, side, metric, round(CASE metric WHEN 'rmse' THEN rmse WHEN 'mae' THEN mae ELSE r2 END, 4) AS value
FROM (SELECT fold, side, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM scored GROUP BY fold, side), (SELECT unnest(['rmse', 'mae', 'r2']) AS metric)""")
def cv_timeseries(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on folds in time: each trains on the rows before its block only."""
    e = table(spark, d, "events").select("event_id", "ts", "value", (F.col("user_id") % 50).cast("double").alias("x"))
    folded = split.assign_folds(e, 4, ["event_id"], time_col="ts")
    scores = cv.cross_validate(folded, Spec("ridge", "ridge", "regression", "value", {"alpha": 10.0}, drop=("event_id", "ts")), in_time=True)
    return scores.select("fold", "side", "metric", F.round("value", 4).alias("value"))


def _spec(model: str = "logreg") -> Spec:
    return Spec(model, model, "classification", "rich", SMALLER[model], drop=("c_custkey",))


@query()
def cv_candidate(spark: SparkSession, d: str) -> DataFrame:
    folded = split.assign_folds(_of("rich", spark, d), 2, KEYS, stratify="rich")
    return cv.cross_validate(folded, _spec())


@query()
def cv_round(spark: SparkSession, d: str) -> DataFrame:
    folded = split.assign_folds(_of("rich", spark, d), 2, KEYS, stratify="rich")
    return cv.run_round(folded, [_spec(), _spec("random_forest")])[0]


@query()
def predict_holdout(spark: SparkSession, d: str) -> DataFrame:
    parted = split.holdout_stratified(_of("tier", spark, d), "tier", KEYS)
    spec = Spec("forest", "random_forest", "classification", "tier", SMALLER["random_forest"], drop=("c_custkey",))
    return cv.predict_holdout(parted.where("split = 'dev'").drop("split"), parted.where("split = 'hidden'").drop("split"), spec, KEYS)


@query()
def fit_final(spark: SparkSession, d: str) -> DataFrame:
    return cv.fit_final(_of("rich", spark, d), _spec())


@query()
def top_features(spark: SparkSession, d: str) -> DataFrame:
    return cv.fit_final(_of("rich", spark, d), _spec("random_forest"))


@query()
def model_save_load(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    cv.fit_final(_of("rich", spark, d), _spec(), path)
    model, record = cv.load_final(spark, path)
    stage = model.stages[0]
    return spark.createDataFrame(list(zip(record["features"], stage.coefficients.toArray().tolist())), "name string, coefficient double")


@query()
def smoke_round(spark: SparkSession, d: str) -> DataFrame:
    """Every model of the menu with its defaults, on 3 folds."""
    specs = compare.smoke_specs("classification", "rich", ("c_custkey",))
    scores, status = cv.run_round(split.assign_folds(_of("rich", spark, d), 3, KEYS, stratify="rich"), specs)
    return status.select("candidate", "ok", "error").join(cv.cv_summary(scores.where("metric = 'roc_auc'")).select("candidate", "mean"), "candidate", "left")


@query()
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: which customers are rich, from split to recommendation."""
    found = compare.compare_models(_of("rich", spark, d), "rich", KEYS, specs=compare.small_portfolio, folds=2, confirm_folds=2, confirm_repeats=2)
    return found.finalists.drop("error")
