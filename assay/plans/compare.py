"""A whole comparison: split, profile, cross-validate, confirm, test once on hidden rows, fit the winner, report."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators import cv, profile, select, split, stats
from assay.operators.filters import drop_missing_target, require_columns
from assay.operators.models import MENU, Spec, portfolio
from assay.session import cut
from assay.store import Store, fingerprint
from assay.streaming.events import SCHEMA, append_event

MAX_ROUNDS, MAX_CANDIDATES = 3, 8


@dataclass
class Comparison:
    """What a run has found. All are DataFrames but run_id, task, time_col, dropped and recommended."""

    run_id: str
    task: str
    time_col: str | None
    dropped: list[str]
    summary: DataFrame
    profile: DataFrame
    scores: DataFrame
    results: DataFrame
    tests: DataFrame
    predictions: DataFrame
    finalists: DataFrame
    recommended: str
    top_features: DataFrame
    events: DataFrame


def small_portfolio(task: str, target: str, drop: tuple[str, ...] = ()) -> list[Spec]:
    """One modest candidate of each of three families, for small tables."""
    linear = ("logreg", {"max_iter": 50}) if task == "classification" else ("ridge", {})
    rest = [("random_forest", {"n_estimators": 10, "max_depth": 5}), ("gbt_depth", {"n_estimators": 5, "max_depth": 3})]
    return [Spec(f"{m}_small", m, task, target, p, drop=drop) for m, p in (linear, *rest)]


def smoke_specs(task: str, target: str, drop: tuple[str, ...] = (), **smaller: dict) -> list[Spec]:
    """Every model of the menu with its defaults, or with smaller parameters given by model."""
    return [Spec(m, m, task, target, smaller.get(m, {}), drop=drop) for m in MENU[task]]


def check_round(specs: list[Spec], earlier: list[str], number: int) -> list[Spec]:
    """Specs with names that no earlier round has; more than 3 rounds or, after the first, 8 candidates are a ValueError."""
    if number > MAX_ROUNDS or (number > 1 and len(specs) > MAX_CANDIDATES):
        raise ValueError(f"at most {MAX_ROUNDS} rounds, and {MAX_CANDIDATES} candidates in later ones")
    taken, out = set(earlier), []
    for s in specs:
        name, k = s.name, 1
        while name in taken:
            k += 1
            name = f"{s.name}_r{number}" if k == 2 else f"{s.name}_r{number}_{k - 1}"
        taken.add(name)
        out.append(replace(s, name=name))
    return out


def compare_models(df: DataFrame, target: str, keys: list[str], order_col: str | None = None, task: str | None = None, specs=None, later=(), folds: int = 5, confirm_folds: int = 2, confirm_repeats: int = 5, n_boot: int = 2000, threads: int = 6, model_path: str | None = None, log_path: str | None = None, store_path: str | None = None) -> Comparison:
    """Compares candidates on 80 % of the rows and scores the finalists once on the rest.

    specs: a function of task, target and dropped columns; the portfolio if None. later: for each
    further round, two at most, a function of the results so far (a DataFrame), task, target and
    dropped columns that gives its candidates, eight at most. Scores are by roc_auc or rmse. Rows without target are left out; keys make splits and folds independent of
    how the table is partitioned. The winner is fitted on all rows, and saved to model_path; the
    run's events are appended to the log at log_path. Scores and hidden predictions are kept at
    store_path by a hash of rows, folds and candidate: a run that has died is run again with the
    same arguments and fits what is absent.
    """
    run_id, log = uuid.uuid4().hex[:12], []
    store = Store(df.sparkSession, store_path) if store_path else None

    def emit(kind: str, **payload) -> None:
        log.append((run_id, time.time(), kind, json.dumps(payload, default=str)))

    require_columns(df, target, *keys, order_col)
    df = cut(drop_missing_target(df, target))
    task = task or split.guess_task(df, target).first()["task"]
    metric = "roc_auc" if task == "classification" else "rmse"
    time_col = split.sorted_time_column(df, target, order_col) if order_col else None
    emit("run_start", target=target, task=task, metric=metric, time_col=time_col)
    parted = cut(split.split_holdout(df, target, task, keys, time_col))
    dev, hidden = (parted.where(F.col("split") == s).drop("split") for s in ("dev", "hidden"))
    found = cut(profile.column_profile(dev, target, task))
    dropped = sorted(r["name"] for r in profile.auto_drop_columns(found).collect())
    summary = split.split_summary(parted, "time" if time_col else "random, stratified" if task == "classification" else "random", target)

    def folded(k: int, repeats: int, seed: int) -> DataFrame:
        return split.assign_folds(dev, k, keys, repeats, target if task == "classification" else None, time_col, seed)

    candidates, results, scores = [], None, None
    in_folds = cut(folded(folds, 1, split.SEED))
    for number, propose in enumerate([specs or portfolio, *later], 1):
        proposed = propose(task, target, tuple(dropped)) if number == 1 else propose(results, task, target, tuple(dropped))
        proposed = check_round(proposed, [c.name for c in candidates], number)
        candidates += proposed
        emit("round_start", round=number, candidates=[c.name for c in proposed], dropped=dropped)
        new, status = cv.run_round(in_folds, proposed, threads, bool(time_col), store)
        found_now = status.join(cv.cv_summary(new.where(F.col("metric") == metric)).drop("metric"), "candidate", "left")
        found_now = select.flag_suspicious(select.overfit_gap(found_now, metric), metric)
        scores = new if scores is None else scores.unionByName(new)
        results = (found_now if results is None else results.unionByName(found_now)).persist()
        emit("leaderboard", round=number, best=[r["candidate"] for r in select.leaderboard(results, metric).where("place <= 3").collect()])
    finalists = select.top_finalists(results, metric).persist()
    names = {r["candidate"]: r["is_best"] for r in finalists.collect()}  # three at most
    if not names:
        raise RuntimeError("no candidate worked: " + "; ".join(f"{r['candidate']}: {r['error']}" for r in results.collect()))
    chosen = [s for s in candidates if s.name in names]
    again, _ = cv.run_round(cut(folded(confirm_folds, confirm_repeats, split.SEED + 1)), chosen, threads, bool(time_col), store)
    better = again.where((F.col("side") == "test") & (F.col("metric") == metric)).select("candidate", "repeat", "fold", select.signed(metric, F.col("value")).alias("value"))
    best = better.groupBy("candidate").agg(F.avg("value").alias("v")).orderBy(F.desc("v"), "candidate").first()["candidate"]
    ratio = stats.train_ratio(confirm_folds, bool(time_col))
    tests = stats.tie_group(stats.holm(stats.corrected_t(better, best, ratio).withColumn("_run", F.lit(0)), ["_run"]).drop("_run"), best)
    emit("confirm", best=best, folds=confirm_folds, repeats=confirm_repeats)

    rows_hash = fingerprint(parted) if store else None
    holdouts: dict[tuple, cv.Holdout] = {}
    for s in chosen:
        if s.drop not in holdouts:
            holdouts[s.drop] = cv.Holdout(dev, hidden, s, keys)

    def predicted(s: Spec) -> tuple[DataFrame, float]:
        if not store:
            p = holdouts[s.drop].predict(s)
            return cut(p), cv.predict_cost(p)
        p, key = None, store.key(s, rows_hash, keys)

        def costed() -> DataFrame:
            return df.sparkSession.createDataFrame([(cv.predict_cost(p),)], "ms double").coalesce(1)

        if not (store.has("predictions", key) and store.has("costs", key)):
            p = holdouts[s.drop].predict(s)
        kept, costs = store.table("predictions", key, lambda: p), store.table("costs", key, costed)
        return kept.withColumn("model", F.lit(s.name)), costs.first()["ms"]

    with ThreadPoolExecutor(threads) as pool:
        each = list(pool.map(predicted, chosen))
    costs = [(s.name, c) for s, (_, c) in zip(chosen, each)]
    preds = reduce(DataFrame.unionByName, [p for p, _ in each])
    classes = max(2, dev.select(target).distinct().count()) if task == "classification" else 2
    intervals = stats.bootstrap(preds, metric, best, keys, n_boot, classes=classes)
    listed = finalists.select("candidate", "model", "mean", "std", "fit_seconds").join(df.sparkSession.createDataFrame(costs, "candidate string, predict_ms_per_1k double").coalesce(1), "candidate")
    table = cut(select.finalist_table(listed, tests, cut(intervals), metric))
    emit("hidden_test", models=[s.name for s in chosen])
    pick = select.recommend(table, metric).first()["candidate"]
    top = cv.fit_final(df, next(s for s in chosen if s.name == pick), model_path)
    emit("final_model", name=pick, path=model_path)
    emit("report", recommended=pick, tie=[r["candidate"] for r in table.where("tie").collect()])
    emit("run_end", seconds=round(time.time() - log[0][1], 1))
    events = df.sparkSession.createDataFrame(log, SCHEMA)
    if log_path:
        append_event(events, log_path)
    return Comparison(run_id, task, time_col, dropped, summary, found, scores, results, tests, preds, table, pick, top, events)
