"""Queries on metrics, significance, resampling and selection.

Predictions are formulas on the given tables: of prices for regression, of document sizes for two
classes, and hashed shares for three. Fold scores are those predictions' errors, fold by fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.portable import uniform
from assay.functions.student import t_sf as t_sf_column
from assay.operators import cv, metrics, resample, select, stats
from assay.queries import query, table, uniform_sql
from assay.session import cut

MODELS = {"flat": (150000.0, 0.0, 0.0), "close": (0.0, 0.9, 20000.0), "near": (0.0, 0.9, 21000.0), "loose": (0.0, 0.8, 60000.0)}


def regression(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("label"))
    parts = [o.select(F.lit(m).alias("model"), "o_orderkey", "label", (F.lit(a) + F.lit(b) * F.col("label") + F.lit(c) * uniform(m, "o_orderkey")).alias("score")) for m, (a, b, c) in MODELS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_O = "CAST(o_orderkey AS VARCHAR)"
REGRESSION = "preds AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, o_orderkey, o_totalprice AS label, {a} + {b} * o_totalprice + {c} * {uniform_sql(chr(39) + m + chr(39), _O)} AS score FROM orders" for m, (a, b, c) in MODELS.items()) + ")"


def binary(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("label"), "n_chars")
    size = j.select(F.lit("size").alias("model"), "doc_id", "label", F.round(F.col("n_chars") / (F.col("n_chars") + 1500), 2).alias("score"))
    return size.unionByName(j.select(F.lit("mixed").alias("model"), "doc_id", "label", (0.3 * F.col("label") + 0.7 * uniform("mixed", "doc_id")).alias("score")))


BINARY = f"""preds AS (SELECT 'size' AS model, doc_id, quality AS label, round(n_chars / (n_chars + 1500), 2) AS score FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'mixed', doc_id, quality, CAST(0.3 AS DOUBLE) * quality + CAST(0.7 AS DOUBLE) * {uniform_sql("'mixed'", "CAST(doc_id AS VARCHAR)")} FROM labels JOIN documents USING (doc_id))"""


def multiclass(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"))
    raw = F.array(*[uniform(f"c{k}", "o_orderkey") + 0.3 * (F.col("label") == k).cast("double") for k in range(3)])
    total = F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)
    return o.withColumn("raw", raw).select(F.lit("hashed").alias("model"), "o_orderkey", "label", F.transform("raw", lambda x: x / total).alias("probs"))


_RAW = ", ".join(f"{uniform_sql(f'{chr(39)}c{k}{chr(39)}', _O)} + CAST(0.3 AS DOUBLE) * CAST(label = {k} AS INT) AS r{k}" for k in range(3))
MULTICLASS = f"""raw AS (SELECT o_orderkey, label, {_RAW} FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label FROM orders)),
preds AS (SELECT 'hashed' AS model, o_orderkey, label, [r0 / (r0 + r1 + r2), r1 / (r0 + r1 + r2), r2 / (r0 + r1 + r2)] AS probs FROM raw)"""


def _metric(metric: str, preds, sql: str, classes: int = 2, name: str | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return metrics.score(preds(spark, d), metric, classes=classes).withColumn("value", F.round("value", 6))

    query(sql, name or f"metric_{metric}")(run)


_metric("rmse", regression, f"WITH {REGRESSION} SELECT model, round(sqrt(avg((label - score) ** 2)), 6) AS value FROM preds GROUP BY model")
_metric("mae", regression, f"WITH {REGRESSION} SELECT model, round(avg(abs(label - score)), 6) AS value FROM preds GROUP BY model")
_metric("r2", regression, f"WITH {REGRESSION} SELECT model, round(1 - sum((label - score) ** 2) / (var_pop(label) * count(*)), 6) AS value FROM preds GROUP BY model")
_metric("accuracy", binary, f"WITH {BINARY} SELECT model, round(avg(CAST(label = CAST(score >= 0.5 AS INT) AS DOUBLE)), 6) AS value FROM preds GROUP BY model")
_AUC = "SELECT {by}, round(sum(pos * (before + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), {digits}) AS value FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT {by}, score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS neg FROM {of} GROUP BY ALL)) GROUP BY {by}"
_metric("roc_auc", binary, f"WITH {BINARY} {_AUC.format(by='model', digits=6, of='preds')}")
_LABELLED = f"{MULTICLASS}, named AS (SELECT model, label, list_position(probs, list_max(probs)) - 1 AS p FROM preds)"
_metric("f1_macro", multiclass, f"WITH {_LABELLED}, per AS (SELECT model, k, coalesce(2.0 * count(*) FILTER (WHERE label = k AND p = k) / nullif(count(*) FILTER (WHERE label = k) + count(*) FILTER (WHERE p = k), 0), 0) AS f FROM named, (SELECT unnest([0, 1, 2]) AS k) GROUP BY model, k) SELECT model, round(avg(f), 6) AS value FROM per GROUP BY model", classes=3)
_metric("roc_auc", multiclass, f"WITH {MULTICLASS}, each AS (SELECT model || '|' || k AS mk, CAST(label = k AS INT) AS label, probs[k + 1] AS score FROM preds, (SELECT unnest([0, 1, 2]) AS k)), auc AS ({_AUC.format(by='mk', digits=12, of='each')}) SELECT split_part(mk, '|', 1) AS model, round(avg(value), 6) AS value FROM auc GROUP BY 1", classes=3, name="metric_roc_auc_ovr")


@query(f"WITH {_LABELLED} SELECT label, CAST(p AS INT) AS predicted, count(*) AS n FROM named GROUP BY ALL")
def score_to_label(spark: SparkSession, d: str) -> DataFrame:
    return multiclass(spark, d).groupBy("label", metrics.predicted_label(probs="probs").alias("predicted")).agg(F.count("*").alias("n"))


# --- fold scores


def _fold_errors(spark: SparkSession, d: str) -> DataFrame:
    """candidate, repeat, fold, side, metric, value: rmse of the formulas on test and training sides of 2 x 5 folds."""
    p = regression(spark, d).withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1))))
    p = p.withColumn("own", F.floor(uniform(F.concat(F.lit("r"), F.col("repeat")), "o_orderkey") * 5).cast("int"))
    sums = p.groupBy(F.col("model").alias("candidate"), "repeat", "own").agg(F.sum((F.col("label") - F.col("score")) * (F.col("label") - F.col("score"))).alias("e"), F.count("*").alias("n"))
    # training sides are totals less a fold's own: a few rows for each candidate
    totals = sums.groupBy("candidate", "repeat").agg(F.sum("e").alias("te"), F.sum("n").alias("tn"))
    both = sums.join(totals, ["candidate", "repeat"])
    sides = F.array(F.struct(F.lit("test").alias("side"), F.sqrt(F.col("e") / F.col("n")).alias("value")), F.struct(F.lit("train").alias("side"), F.sqrt((F.col("te") - F.col("e")) / (F.col("tn") - F.col("n"))).alias("value")))
    return cut(both.select("candidate", "repeat", F.col("own").alias("fold"), F.inline(sides)).withColumn("metric", F.lit("rmse")))  # a few rows, used several times


FOLDS = f"""{REGRESSION}, placed AS (SELECT preds.*, repeat, CAST(floor({uniform_sql("'r' || repeat", _O)} * 5) AS INT) AS fold FROM preds, (SELECT unnest([0, 1]) AS repeat)),
sums AS (SELECT model AS candidate, repeat, fold, sum((label - score) ** 2) AS e, count(*) AS n FROM placed GROUP BY ALL),
scores AS (SELECT candidate, repeat, fold, 'test' AS side, sqrt(e / n) AS value FROM sums UNION ALL
SELECT candidate, repeat, fold, 'train', sqrt((sum(e) OVER w - e) / (sum(n) OVER w - n)) FROM sums WINDOW w AS (PARTITION BY candidate, repeat))"""
SUMMARY = f"""{FOLDS}, summary AS (SELECT candidate, avg(value) FILTER (WHERE side = 'test') AS mean, stddev_pop(value) FILTER (WHERE side = 'test') AS std, avg(value) FILTER (WHERE side = 'train') AS train_mean, count(*) FILTER (WHERE side = 'test') AS n_folds FROM scores GROUP BY candidate)"""


@query(f"WITH {SUMMARY} SELECT candidate, round(mean, 4) AS mean, round(std, 4) AS std, round(train_mean, 4) AS train_mean, n_folds FROM summary")
def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    return cv.cv_summary(_fold_errors(spark, d)).select("candidate", *[F.round(c, 4).alias(c) for c in ("mean", "std", "train_mean")], "n_folds")


FAMILY = "CASE WHEN candidate IN ('close', 'near') THEN 'line' ELSE candidate END"


def _results(spark: SparkSession, d: str) -> DataFrame:
    """A row for each candidate, with one failure; close and near are of one family."""
    r = cv.cv_summary(_fold_errors(spark, d)).select("candidate", F.when(F.col("candidate").isin("close", "near"), "line").otherwise(F.col("candidate")).alias("model"), "mean", "std", "train_mean", F.lit(True).alias("ok"))
    failed = r.agg(F.lit("broken").alias("candidate")).select("candidate", F.lit("broken").alias("model"), *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "train_mean")], F.lit(False).alias("ok"))
    return r.unionByName(failed)


RESULTS = f"{SUMMARY}, results AS (SELECT candidate, {FAMILY} AS model, mean, std, train_mean, true AS ok FROM summary UNION ALL SELECT 'broken', 'broken', NULL, NULL, NULL, false)"


@query(f"WITH {RESULTS} SELECT candidate, ok, round(mean, 4) AS mean, row_number() OVER (ORDER BY ok DESC, mean ASC NULLS LAST, candidate) AS place FROM results")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return select.leaderboard(_results(spark, d), "rmse").select("candidate", "ok", F.round("mean", 4).alias("mean"), F.col("place").cast("long").alias("place"))


@query(f"WITH {RESULTS} SELECT candidate, round(mean - train_mean, 2) AS overfit_gap FROM results")
def overfit_gap(spark: SparkSession, d: str) -> DataFrame:
    return select.overfit_gap(_results(spark, d), "rmse").select("candidate", F.round("overfit_gap", 2).alias("overfit_gap"))


@query(f"WITH {REGRESSION} SELECT model AS candidate, 1 - sum((label - score) ** 2) / (var_pop(label) * count(*)) > 0.995 AS suspicious FROM preds GROUP BY model")
def flag_suspicious(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.score(regression(spark, d), "r2").select(F.col("model").alias("candidate"), F.col("value").alias("mean"))
    return select.flag_suspicious(r, "r2").select("candidate", "suspicious")


BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean NULLS LAST, candidate) AS r FROM results WHERE ok) WHERE r = 1)"


@query(f"WITH {RESULTS}, {BEST} SELECT model, candidate, round(mean, 4) AS mean FROM best")
def best_per_family(spark: SparkSession, d: str) -> DataFrame:
    return select.best_per_family(_results(spark, d), "rmse").select("model", "candidate", F.round("mean", 4).alias("mean"))


FINALISTS = f"{BEST}, finalists AS (SELECT candidate, model, mean, std, row_number() OVER (ORDER BY mean, candidate) = 1 AS is_best FROM best ORDER BY mean, candidate LIMIT 3)"


@query(f"WITH {RESULTS}, {FINALISTS} SELECT candidate, model, round(mean, 4) AS mean, is_best FROM finalists")
def top_finalists(spark: SparkSession, d: str) -> DataFrame:
    return select.top_finalists(_results(spark, d), "rmse").select("candidate", "model", F.round("mean", 4).alias("mean"), "is_best")


RATIO = stats.train_ratio(5)


def _tests(spark: SparkSession, d: str) -> DataFrame:
    test = _fold_errors(spark, d).where("side = 'test'").select("candidate", "repeat", "fold", (-F.col("value")).alias("value"))
    return stats.corrected_t(test, "close", RATIO)


def t_sf_sql(t: str, n: str) -> str:
    """The tail for an odd number of degrees of freedom, 9 here, as its finite series."""
    a, c = f"atan({t} / sqrt({n}))", f"cos(atan({t} / sqrt({n})))"
    return f"((1 - 2 / pi() * ({a} + sin({a}) * ({c} + 2.0/3 * {c} ** 3 + 8.0/15 * {c} ** 5 + 16.0/35 * {c} ** 7))) / 2)"


TESTS = f"""diffs AS (SELECT s.candidate, s.value - b.value AS d FROM scores s JOIN scores b ON b.candidate = 'close' AND b.side = 'test' AND s.side = 'test' AND b.repeat = s.repeat AND b.fold = s.fold),
moments AS (SELECT candidate, count(*) AS n_folds, avg(d) AS mean_diff, var_samp(d) AS var FROM diffs GROUP BY candidate),
tests AS (SELECT *, CASE WHEN var = 0 THEN 0 ELSE mean_diff / sqrt((1.0 / n_folds + {RATIO}) * nullif(var, 0)) END AS t FROM moments),
valued AS (SELECT *, CASE WHEN var = 0 THEN 0.5 ELSE {t_sf_sql("t", "9.0")} END AS p FROM tests),
adjusted AS (SELECT *, max(step) OVER (ORDER BY p, candidate ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM (SELECT *, least(1.0, ((SELECT count(*) FROM valued) - row_number() OVER (ORDER BY p, candidate) + 1) * p) AS step FROM valued)),
tied AS (SELECT *, candidate = 'close' OR round(p_adjusted, 4) >= 0.05 AS tie FROM adjusted)"""


@query(f"WITH {FOLDS}, {TESTS} SELECT candidate, n_folds, round(mean_diff, 4) AS mean_diff, round(t, 4) AS t, round(p, 8) AS p FROM valued")
def nb_corrected_t(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select("candidate", "n_folds", F.round("mean_diff", 4).alias("mean_diff"), F.round("t", 4).alias("t"), F.round("p", 8).alias("p"))


@query(f"SELECT o_orderkey, round({t_sf_sql('((o_totalprice - 150000) / 50000)', '9.0')}, 9) AS p FROM orders")
def t_sf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(t_sf_column((F.col("o_totalprice") - 150000) / 50000, F.lit(9)), 9).alias("p"))


def _adjusted(spark: SparkSession, d: str) -> DataFrame:
    return stats.tie_group(stats.holm(_tests(spark, d).withColumn("run", F.lit(1)), ["run"]), "close")


@query(f"WITH {FOLDS}, {TESTS} SELECT candidate, round(p_adjusted, 8) AS p_adjusted FROM adjusted")
def holm_adjust(spark: SparkSession, d: str) -> DataFrame:
    return _adjusted(spark, d).select("candidate", F.round("p_adjusted", 8).alias("p_adjusted"))


@query(f"WITH {FOLDS}, {TESTS} SELECT candidate, tie FROM tied")
def tie_group(spark: SparkSession, d: str) -> DataFrame:
    return _adjusted(spark, d).select("candidate", "tie")


# --- resampling

REPS = 20


EXACT = f"""{REGRESSION}, ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', '0', {_O})), o_orderkey) AS r FROM (SELECT DISTINCT o_orderkey FROM preds)),
size AS (SELECT count(*) AS n FROM ranked),
draws AS (SELECT rep, CAST(floor({uniform_sql("'0'", "CAST(rep AS VARCHAR)", "CAST(slot AS VARCHAR)")} * n) + 1 AS BIGINT) AS r FROM size, (SELECT unnest(range(5)) AS rep), (SELECT unnest(range((SELECT n FROM size))) AS slot)),
reps AS (SELECT rep, model, sqrt(avg((label - score) ** 2)) AS value FROM draws JOIN ranked USING (r) JOIN preds USING (o_orderkey) GROUP BY ALL)"""
_BOUNDS = []
_total, _term = 0.0, 0.36787944117144233
for _k in range(12):
    _total += _term
    _BOUNDS.append(_total)
    _term /= _k + 1
POISSON = f"""{REGRESSION}, weighted AS (SELECT rep, model, label, score, {" + ".join(f"CAST(u >= CAST({b!r} AS DOUBLE) AS INT)" for b in _BOUNDS)} AS w FROM (SELECT rep, preds.*, {uniform_sql("'0'", "CAST(rep // 4 AS VARCHAR)", _O).replace(", 1, 8)", ", CAST(1 + 8 * (rep % 4) AS INT), 8)")} AS u FROM preds, (SELECT unnest(range({REPS})) AS rep))),
reps AS (SELECT rep, model, sqrt(sum(w * (label - score) ** 2) / sum(w)) AS value FROM weighted WHERE w > 0 GROUP BY ALL)"""


@query(f"WITH {EXACT} SELECT rep, model, round(value, 4) AS value FROM reps")
def bootstrap_exact(spark: SparkSession, d: str) -> DataFrame:
    drawn = stats.resample_exact(regression(spark, d), ["o_orderkey"], 5)
    return metrics.score(drawn, "rmse", ("rep", "model"), "weight").select(F.col("rep").cast("long").alias("rep"), "model", F.round("value", 4).alias("value"))


@query()
def bootstrap_multinomial(spark: SparkSession, d: str) -> DataFrame:
    """200 resamples of n of n rows, drawn down a tree of buckets."""
    return resample.multinomial_scores(regression(spark, d), "rmse", ["o_orderkey"], 200)


@query(f"WITH {POISSON} SELECT rep, model, round(value, 4) AS value FROM reps")
def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    scored = resample.poisson_scores(regression(spark, d), "rmse", ["o_orderkey"], REPS)
    return scored.select(F.col("rep").cast("long").alias("rep"), "model", F.round("value", 4).alias("value"))


INTERVALS = f"""{POISSON}, full_ AS (SELECT model, sqrt(avg((label - score) ** 2)) AS value FROM preds GROUP BY model),
paired AS (SELECT r.model, r.value, r.value - b.value AS d FROM reps r JOIN reps b ON b.rep = r.rep AND b.model = 'close'),
ci AS (SELECT model, quantile_cont(value, 0.025) AS ci_lo, quantile_cont(value, 0.975) AS ci_hi, quantile_cont(d, 0.025) AS diff_lo, quantile_cont(d, 0.975) AS diff_hi FROM paired GROUP BY model),
intervals AS (SELECT model, value AS score, ci_lo, ci_hi, value - (SELECT value FROM full_ WHERE model = 'close') AS diff, diff_lo, diff_hi FROM full_ JOIN ci USING (model))"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return cut(stats.bootstrap(regression(spark, d), "rmse", "close", ["o_orderkey"], REPS))  # a row for each model


@query(f"WITH {INTERVALS} SELECT model, round(score, 3) AS score, round(ci_lo, 3) AS ci_lo, round(ci_hi, 3) AS ci_hi FROM intervals")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).select("model", *[F.round(c, 3).alias(c) for c in ("score", "ci_lo", "ci_hi")])


@query(f"WITH {INTERVALS} SELECT model, round(diff, 3) AS diff, round(diff_lo, 3) AS diff_lo, round(diff_hi, 3) AS diff_hi FROM intervals")
def bootstrap_diff(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).select("model", *[F.round(c, 3).alias(c) for c in ("diff", "diff_lo", "diff_hi")])


# --- finalists


def _finalists(spark: SparkSession, d: str) -> DataFrame:
    return select.top_finalists(_results(spark, d), "rmse").select("candidate", "model", "mean", "std")


_ALL = f"{RESULTS}, {FINALISTS}, {TESTS}, " + INTERVALS.replace(REGRESSION + ", ", "")
_JOINED = f"""{_ALL}, joined AS (SELECT f.candidate, f.model, mean, std, n_folds, p_adjusted, tie, i.score, i.ci_lo, i.ci_hi, i.diff, i.diff_lo, i.diff_hi, nullif(concat_ws('; ', CASE WHEN p_adjusted IS NULL THEN 'no confirmation' END, CASE WHEN i.score IS NULL THEN 'no hidden score' END), '') AS error
FROM finalists f LEFT JOIN tied USING (candidate) LEFT JOIN (SELECT * FROM intervals WHERE model <> 'flat') i ON i.model = f.candidate)"""
_SHOWN = {"mean": 3, "std": 3, "p_adjusted": 8, "score": 3, "ci_lo": 3, "ci_hi": 3, "diff": 3, "diff_lo": 3, "diff_hi": 3}


@query(f"WITH {_JOINED} SELECT candidate, round(mean, 3) AS mean, round(p_adjusted, 8) AS p_adjusted, round(score, 3) AS score, error FROM joined")
def finalist_join(spark: SparkSession, d: str) -> DataFrame:
    joined = select.finalist_join(_finalists(spark, d), _adjusted(spark, d), _intervals(spark, d).where("model <> 'flat'"))
    return joined.select("candidate", F.round("mean", 3).alias("mean"), F.round("p_adjusted", 8).alias("p_adjusted"), F.round("score", 3).alias("score"), "error")


def _table(spark: SparkSession, d: str) -> DataFrame:
    return select.finalist_table(_finalists(spark, d), _adjusted(spark, d), _intervals(spark, d).where("model <> 'flat'"), "rmse")


@query(f"WITH {_JOINED} SELECT candidate, {', '.join(f'round({c}, {n}) AS {c}' for c, n in _SHOWN.items())}, n_folds, tie, coalesce(candidate = (SELECT candidate FROM joined WHERE tie ORDER BY mean, candidate LIMIT 1), false) AS recommended FROM joined")
def finalist_table(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select("candidate", *[F.round(c, n).alias(c) for c, n in _SHOWN.items()], "n_folds", "tie", "recommended")


@query(f"WITH {_JOINED} SELECT candidate, round(mean, 3) AS mean FROM joined WHERE tie ORDER BY mean, candidate LIMIT 1")
def recommend(spark: SparkSession, d: str) -> DataFrame:
    return select.recommend(_table(spark, d), "rmse").select("candidate", F.round("mean", 3).alias("mean"))
