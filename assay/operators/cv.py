"""Cross-validation, hidden-set prediction and the final fit.

Preprocessing is learned on each fold's training rows. Rows stay in Spark: the driver sees counts,
statistics of columns, and metrics.
"""

from __future__ import annotations

import json
import math
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators import features, gram, metrics
from assay.operators.boosting import Booster
from assay.operators.forest import Grown
from assay.operators.mlp import Network
from assay.operators.models import MENU, SLOW, TOGETHER, Spec, build_estimator, predictions, top_features
from assay.operators.profile import kinds
from assay.session import cut
from assay.store import Store, fingerprint

RESULT = "candidate string, repeat int, fold int, side string, metric string, value double"


def feature_columns(train: DataFrame, spec: Spec, keep: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Numeric and text columns of a `clean` table that are features."""
    columns = {c: k for c, k in kinds(train).items() if c not in keep and c not in spec.drop}
    numbers = [c for c, k in columns.items() if k == "numeric"]
    texts = [c for c, k in columns.items() if k == "categorical"]
    return numbers, texts


@dataclass
class Features:
    """What the rows of one training set say about the columns; apply() makes the vector of any rows.

    Numbers are filled and, for scaled models, standardized by population deviation; text is
    one-hot encoded with at most `max_categories` outputs, or ordinal. A column without a value in
    the training rows is left out.
    """

    spec: Spec
    numbers: dict  # column: its median, mean and std
    modes: dict  # column: what fills it
    outputs: dict  # column: its one-hot outputs
    codes: DataFrame | None  # name, value and code, for ordinal encoding

    @property
    def names(self) -> list[str]:
        hot = [f"{c}__ord" for c in self.modes] if self.codes is not None else [f"{c}__{v}" for c in self.modes for v in self.outputs[c]]
        return [*[f"{c}__num" for c in self.numbers], *hot]

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for c, s in self.numbers.items():
            x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(s[self.spec.prep.numeric_impute])))
            out.append((x - F.lit(float(s["mean"]))) / F.lit(float(s["std"]) or 1.0) if self.spec.scaled else x)
        for i, (c, mode) in enumerate(self.modes.items()):
            v = F.coalesce(F.col(f"`{c}`"), F.lit(mode))
            if self.codes is not None:
                own = self.codes.where(F.col("name") == c).select(F.col("value").alias("_v"), F.col("code").cast("double").alias(f"_c{i}"))
                df = df.join(own, v == F.col("_v"), "left").drop("_v")
                out.append(F.coalesce(f"_c{i}", F.lit(-1.0)))
                continue
            own = [k for k in self.outputs[c] if k != features.INFREQUENT]
            out += [(~v.isin(own) if k == features.INFREQUENT else v == F.lit(k)).cast("double") for k in self.outputs[c]]
        names = [f"_f{i}" for i in range(len(out))]
        df = df.withColumns(dict(zip(names, out)))
        return VectorAssembler(inputCols=names, outputCol="features").transform(df).drop(*names, *[c for c in df.columns if c.startswith("_c")])


def learn(ready: DataFrame, spec: Spec, keep: tuple[str, ...], own: str, trains: dict[int, list[int]]) -> dict[int, Features]:
    """Features of each training set: `trains` names the values of column `own` whose rows are in it.

    All sets' numbers come from one aggregate and all categories from another; the driver gets a few
    values for each set and column.
    """
    numbers, texts = feature_columns(ready, spec, (own, *keep))
    prep, stats, modes, outputs, codes = spec.prep, {f: {} for f in trains}, {f: {} for f in trains}, {f: {} for f in trains}, {}
    if numbers:
        for r in features.numeric_stats(ready, numbers, own, trains).collect():
            if r["median"] is not None:
                stats[r["fold"]][r["name"]] = r
    if texts:
        counts = features.category_counts(ready, texts, own, trains)
        if prep.categorical == "ordinal":
            counts = counts.persist()
            codes = {f: features.ordinal_codes(counts.where(F.col("fold") == f)).drop("fold") for f in trains}
            found = [(r["fold"], r["name"], [r["mode"]]) for r in features.impute_mode(counts).collect()]
        else:
            top = features.leading(counts, prep.max_categories).groupBy("fold", "name").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("top"))
            found = [(r["fold"], r["name"], [x["value"] for x in r["top"]]) for r in top.collect()]
        for f, c, values in sorted(found, key=lambda x: texts.index(x[1])):
            modes[f][c], outputs[f][c] = values[0], features.outputs_of(values, prep.max_categories)
    return {f: Features(spec, {c: stats[f][c] for c in numbers if c in stats[f]}, modes[f], outputs[f], codes.get(f)) for f in trains}


def prepare(df: DataFrame, spec: Spec, keep: tuple[str, ...] = (), classes: DataFrame | None = None) -> DataFrame:
    """Rows with a target, features cleaned, and label: the target's number, or its class's place."""
    held = df.where(F.col(spec.target).isNotNull()).drop(*[c for c in spec.drop if c not in keep])
    if isinstance(held.schema[spec.target].dataType, (T.FloatType, T.DoubleType)):
        held = held.where(~F.isnan(spec.target))
    if spec.task == "regression":
        held = held.withColumn("label", F.col(spec.target).cast("double"))
    else:
        held = features.label_encode(held, spec.target, classes)
    return features.clean(held.drop(spec.target), ("label", *keep))


@dataclass
class Facts:
    """Of a training set: its rows, by class if it has classes, and the label's deviation."""

    n: int
    std: float
    classes: dict[float, int]


def facts_of(ready: DataFrame, task: str, own: str, trains: dict[int, list[int]]) -> dict[int, Facts]:
    """Of all training sets, from one aggregate with a row for each part and class."""
    by = [own, "label"] if task == "classification" else [own]
    rows = ready.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("label").alias("_mean"), F.var_pop("label").alias("_var")).collect()
    out = {}
    for f, parts in trains.items():
        mine = [r for r in rows if r[own] in parts]
        n = sum(r["_n"] for r in mine)
        mean = sum(r["_n"] * r["_mean"] for r in mine) / max(n, 1)
        var = sum(r["_n"] * (r["_var"] + (r["_mean"] - mean) ** 2) for r in mine) / max(n, 1)
        classes: dict[float, int] = {}
        for r in mine if task == "classification" else []:
            classes[r["label"]] = classes.get(r["label"], 0) + r["_n"]
        out[f] = Facts(n, math.sqrt(var), classes)
    return out


def _fit(train: DataFrame, spec: Spec, made: Features, facts: Facts, n_classes: int):
    estimator = build_estimator(spec, len(made.names), n_classes, facts.n, facts.std or 1.0)
    ready = made.apply(train)
    if estimator.hasParam("weightCol") and estimator.isSet("weightCol"):
        each = [(F.lit(c), F.lit(facts.n / (len(facts.classes) * k))) for c, k in sorted(facts.classes.items())]
        ready = ready.withColumn("weight", F.element_at(F.create_map(*[x for pair in each for x in pair]), F.col("label")))
    return estimator.fit(ready)


class Folds:
    """A table with folds, prepared once for all candidates of a task: its rows, training sets and their statistics.

    Each repeat's fold is a training set: of all other folds of the repeat or, in time, of the rows
    before the fold's block; those of no fold, the earliest, train for all.
    """

    def __init__(self, df: DataFrame, spec: Spec, fold_cols: tuple[str, str] = ("repeat", "fold"), in_time: bool = False):
        rep, fold = fold_cols
        self.task, self.keep, self.learned, self.lock = spec.task, fold_cols, {}, threading.Lock()
        places = df.groupBy(rep, fold).agg(F.count("*").alias("n")).orderBy(rep, F.asc_nulls_first(fold)).collect()
        number = F.coalesce(*[F.when(F.col(rep).eqNullSafe(F.lit(r)) & F.col(fold).eqNullSafe(F.lit(f)), i) for i, (r, f, _) in enumerate(places)], F.lit(-1))
        self.ready = cut(prepare(df.withColumn("_own", number), spec, (*fold_cols, "_own")))
        self.places = {i: (r, f) for i, (r, f, _) in enumerate(places) if f is not None}
        self.trains = {i: [j for j, (q, g, _) in enumerate(places) if q == r and j != i and (g is None or not in_time or g < f)] for i, (r, f) in self.places.items()}
        self.facts = facts_of(self.ready, spec.task, "_own", self.trains)
        self.classes = 1 + int(max((max(x.classes, default=0) for x in self.facts.values()), default=0)) if spec.task == "classification" else 0

    def features(self, spec: Spec) -> dict[int, Features]:
        """Learned once for all candidates with the same preprocessing."""
        key = (spec.prep.categorical, spec.prep.max_categories)
        with self.lock:
            if key not in self.learned:
                self.learned[key] = learn(self.ready, spec, ("label", *self.keep), "_own", self.trains)
            return {i: replace(x, spec=spec) for i, x in self.learned[key].items()}

    def jobs(self, spec: Spec) -> list[list[int]]:
        """Folds to fit at a time: all, of models that fit several training sets side by side, else each alone."""
        return [list(self.places)] if spec.model in TOGETHER and self.places else [[i] for i in self.places]

    def scored(self, spec: Spec, folds: list[int]) -> list[DataFrame]:
        """repeat, fold, side, label and score or probs of the rows of each fold and of its training set, by a model fitted on the latter."""
        made = self.features(spec)
        train = lambda i: self.ready.where(F.col("_own").isin(self.trains[i]))
        if spec.model in TOGETHER:
            first = self.facts[folds[0]]
            fitted = build_estimator(spec, len(made[folds[0]].names), self.classes, first.n, first.std or 1.0).fit_sets({i: made[i].apply(train(i)) for i in folds})
        else:
            fitted = {i: _fit(train(i), spec, made[i], self.facts[i], self.classes) for i in folds}
        return [self._predicted(spec, i, made[i], fitted[i]) for i in folds]

    def _predicted(self, spec: Spec, i: int, made: Features, model) -> DataFrame:
        own = self.ready.where(F.col("_own").isin([i, *self.trains[i]]))
        if self.spread(spec):
            own = own.repartition(self.spread(spec))
        out = predictions(model.transform(made.apply(own)), spec.task, self.classes)
        side, (r, f) = F.when(F.col("_own") == i, "test").otherwise("train").alias("side"), self.places[i]
        value = "score" if "score" in out.columns else "probs"
        return out.select(F.lit(r).alias("repeat"), F.lit(f).alias("fold"), side, "label", value)

    def spread(self, spec: Spec, each: int = 2_000) -> int:
        """Over how many partitions a slow model's rows are dealt, if they are so few that they may lie in one; else 0."""
        rows, most = sum(self.facts[i].n for i in self.places), self.ready.sparkSession.sparkContext.defaultParallelism
        return min(most, math.ceil(rows / each)) if spec.model in SLOW and rows < 100_000 * most else 0

    def scores(self, spec: Spec, parts: list[DataFrame], each: int = 100_000) -> list[tuple]:
        """candidate, repeat, fold, side, metric and value: each metric in one job for all folds."""
        if not parts:
            return []
        rows = sum(self.facts[i].n for i in self.places)
        scored, by = cut(reduce(DataFrame.unionByName, parts).coalesce(max(self.spread(spec), math.ceil((rows + 1) / each)))), ("repeat", "fold", "side")
        found = [metrics.score(scored, m, by, classes=max(self.classes, 2)).withColumn("metric", F.lit(m)) for m in metrics.TASK_METRICS[spec.task]]
        return [(spec.name, *x) for x in reduce(DataFrame.unionByName, found).select(*by, "metric", "value").collect()]


    def ridge_scores(self, specs: list[Spec]) -> dict[str, list[tuple]]:
        """The rows of `scores` of several ridge candidates with the same preprocessing, by name, from two passes."""
        made = self.features(specs[0])
        found = gram.ridge_scores(self.ready, made, self.trains, [float(s.params.get("alpha", MENU["regression"]["ridge"]["alpha"])) for s in specs])
        out: dict[str, list[tuple]] = {s.name: [] for s in specs}
        for (i, k, side, metric), value in found.items():
            out[specs[k].name].append((specs[k].name, *self.places[i], side, metric, value))
        return out


def from_products(spec: Spec) -> bool:
    """Whether a candidate's scores come from sums of products: ridge on one-hot features with known parameters."""
    return spec.model == "ridge" and spec.task == "regression" and spec.prep.categorical == "onehot" and set(spec.params) <= {"alpha"}


def cross_validate(df: DataFrame, spec: Spec, fold_cols: tuple[str, str] = ("repeat", "fold"), in_time: bool = False) -> DataFrame:
    """candidate, repeat, fold, side (train or test), metric, value of one candidate on rows with repeat and fold (see `Folds`)."""
    folds = Folds(df, spec, fold_cols, in_time)
    if from_products(spec):
        return df.sparkSession.createDataFrame(folds.ridge_scores([spec])[spec.name], RESULT).coalesce(1)
    return df.sparkSession.createDataFrame(folds.scores(spec, [x for job in folds.jobs(spec) for x in folds.scored(spec, job)]), RESULT).coalesce(1)


def cv_summary(scores: DataFrame) -> DataFrame:
    """candidate, metric, mean, std (population), train_mean, n_folds and folds (in order) of long scores."""
    test = F.col("side") == "test"
    out = scores.groupBy("candidate", "metric").agg(
        F.avg(F.when(test, F.col("value"))).alias("mean"),
        F.stddev_pop(F.when(test, F.col("value"))).alias("std"),
        F.avg(F.when(~test, F.col("value"))).alias("train_mean"),
        F.count(F.when(test, F.col("value"))).alias("n_folds"),
        F.array_sort(F.collect_list(F.when(test, F.struct("repeat", "fold", "value")))).alias("folds"),
    )
    return out.withColumn("folds", F.transform("folds", lambda x: x["value"]))


def run_round(df: DataFrame, specs: list[Spec], threads: int = 6, in_time: bool = False, store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """Long scores of all candidates that worked; and name, model, ok, error, fit_seconds of each.

    Candidates share the prepared rows and their statistics; a few are fitted at a time. With a
    store, each candidate's scores are kept there as it ends, and those that are there for the same
    rows and folds are not fitted again.
    """
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("candidate names repeat")
    spark = df.sparkSession
    rows_hash = fingerprint(df) if store else None
    keys = {s.name: store.key(s, rows_hash, in_time) if store else None for s in specs}
    known: dict[str, tuple] = {}
    for s in specs:
        if store and store.has("scores", keys[s.name]):
            found = store.table("scores", keys[s.name], lambda: df).collect()  # a row for each fold and metric
            known[s.name] = [(s.name, *r[:-1]) for r in found], None, found[0]["fit_seconds"] if found else 0.0
    every, specs = specs, [s for s in specs if s.name not in known]

    def keep(s: Spec, result: tuple) -> tuple:
        if store and not result[1]:
            rows = [(*r[1:], result[2]) for r in result[0]]
            store.table("scores", keys[s.name], lambda: spark.createDataFrame(rows, RESULT.partition(", ")[2] + ", fit_seconds double").coalesce(1))
        return result

    shared: dict[tuple, Folds] = {}
    for s in specs:
        if (s.task, s.target, s.drop) not in shared:
            shared[s.task, s.target, s.drop] = Folds(df, s, in_time=in_time)

    def tried(job):
        began = time.time()
        try:
            return job(), None, time.time() - began
        except Exception as e:  # a failing candidate is a result, not the round's end
            return None, f"{type(e).__name__}: {e}"[:1500], time.time() - began

    def ended(spec: Spec) -> tuple:
        mine = [x for s, x in zip(owners, fits) if s is spec]
        wrong = next((e for _, e, _ in mine if e), None)
        rows, wrong, took = (None, wrong, 0.0) if wrong else tried(lambda: of(spec).scores(spec, [x for part, _, _ in mine for x in part]))
        return keep(spec, (rows or [], wrong, took + sum(t for _, _, t in mine)))

    of = lambda s: shared[s.task, s.target, s.drop]
    alike: dict[tuple, list[Spec]] = {}
    for s in specs:
        if from_products(s):
            alike.setdefault((s.task, s.target, s.drop, s.prep), []).append(s)
    rest = [s for s in specs if not from_products(s)]
    owners, parts = zip(*[(s, job) for s in rest for job in of(s).jobs(s)]) if rest else ((), ())
    with ThreadPoolExecutor(threads) as pool:
        ridges = pool.map(lambda own: (own, tried(lambda: of(own[0]).ridge_scores(own))), list(alike.values()))
        fits = list(pool.map(lambda s, job: tried(lambda: of(s).scored(s, job)), owners, parts))
        ends = {s.name: x for s, x in zip(rest, pool.map(ended, rest))}
        for own, (rows, wrong, took) in ridges:
            ends |= {s.name: keep(s, ((rows or {}).get(s.name, []), wrong, took / len(own))) for s in own}
    done = [(known | ends)[s.name] for s in every]
    status = [(s.name, s.model, e is None, e, t) for s, (_, e, t) in zip(every, done)]
    # a row for each candidate, fold and metric
    return spark.createDataFrame([r for rows, _, _ in done for r in rows], RESULT).coalesce(1), spark.createDataFrame(status, "candidate string, model string, ok boolean, error string, fit_seconds double").coalesce(1)


def fit_whole(ready: DataFrame, spec: Spec, keep: tuple[str, ...] = ()):
    """Features, model and number of classes of one candidate on all rows of a prepared table."""
    ready, one = ready.withColumn("_own", F.lit(0)), {0: [0]}
    made, facts = learn(ready, spec, ("label", *keep), "_own", one)[0], facts_of(ready, spec.task, "_own", one)[0]
    n_classes = 1 + int(max(facts.classes, default=0)) if spec.task == "classification" else 0
    return made, _fit(ready, spec, made, facts, n_classes), n_classes


class Holdout:
    """dev and hidden rows, prepared once, on first use, for all candidates of a task that drop the same columns."""

    def __init__(self, dev: DataFrame, hidden: DataFrame, spec: Spec, keys: list[str]):
        self.given, self.spec, self.keys, self.learned, self.lock = (dev, hidden), spec, keys, {}, threading.Lock()
        self.ready: tuple[DataFrame, DataFrame] | None = None

    def _features(self, spec: Spec) -> Features:
        key = (spec.prep.categorical, spec.prep.max_categories)
        with self.lock:
            if self.ready is None:
                keep, (dev, hidden) = tuple(self.keys), self.given
                classes = dev.select(spec.target) if spec.task == "classification" else None
                self.ready = cut(prepare(dev, self.spec, keep).withColumn("_own", F.lit(0))), cut(prepare(hidden, self.spec, keep, classes))
                self.facts = facts_of(self.ready[0], spec.task, "_own", {0: [0]})[0]
            if key not in self.learned:
                self.learned[key] = learn(self.ready[0], spec, ("label", *self.keys), "_own", {0: [0]})[0]
            return replace(self.learned[key], spec=spec)

    def predict(self, spec: Spec) -> DataFrame:
        """model, keys, label, and score or probs of the hidden rows of known class, by a model fitted on dev; 6 decimals."""
        made = self._features(spec)
        n_classes = 1 + int(max(self.facts.classes, default=0)) if spec.task == "classification" else 0
        model = _fit(self.ready[0], spec, made, self.facts, n_classes)
        scored = predictions(model.transform(made.apply(self.ready[1])), spec.task, n_classes)
        value = F.round("score", 6).alias("score") if "score" in scored.columns else F.transform("probs", lambda p: F.round(p, 6)).alias("probs")
        return scored.select(F.lit(spec.name).alias("model"), *self.keys, "label", value)


def predict_holdout(dev: DataFrame, hidden: DataFrame, spec: Spec, keys: list[str]) -> DataFrame:
    """The predictions of one candidate (see `Holdout`)."""
    return Holdout(dev, hidden, spec, keys).predict(spec)


def predict_cost(preds: DataFrame) -> float:
    """Milliseconds to make 1,000 predictions, written nowhere."""
    began = time.time()
    preds.write.format("noop").mode("overwrite").save()
    return 1e6 * (time.time() - began) / max(1, preds.count())


def fit_final(df: DataFrame, spec: Spec, path: str | None = None, top: int = 10) -> DataFrame:
    """name and importance of the top features of the candidate fitted on all rows; the model and its spec go to path."""
    made, model, _ = fit_whole(cut(prepare(df, spec)), spec)
    if path:
        spark = df.sparkSession
        own = isinstance(model, (Booster, Network, Grown))
        if isinstance(model, Grown):
            model.save(f"{path}/model")
        elif own:
            spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        else:
            PipelineModel([model]).write().overwrite().save(f"{path}/model")
        record = {"name": spec.name, "model": spec.model, "task": spec.task, "target": spec.target, "params": spec.params, "features": made.names, "kind": type(model).__name__ if own else "pipeline"}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
    return top_features(model, made.names, df.sparkSession, top)


def load_final(spark, path: str) -> tuple[PipelineModel | Booster | Network | Grown, dict]:
    """What fit_final has saved."""
    record = json.loads(spark.read.text(f"{path}/spec").first()[0])
    if record["kind"] == "Grown":
        return Grown.load(spark, f"{path}/model"), record
    kind = {"Booster": Booster, "Network": Network}.get(record["kind"])
    return (PipelineModel.load(f"{path}/model") if kind is None else kind.from_json(spark.read.text(f"{path}/model").first()[0])), record
