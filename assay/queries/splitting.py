"""Queries on holdouts and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import split
from assay.queries import hash_sql, query, table

_KEY = "CAST(o_orderkey AS VARCHAR)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")


@query("SELECT 'ts' AS name, (SELECT count(DISTINCT ts) FROM events) AS n_values, bool_and(coalesce(p <= ts, true)) AS in_order FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)")
def sorted_time_column(spark: SparkSession, d: str) -> DataFrame:
    return split.sorted_time_columns(table(spark, d, "events"), "value", "event_id")


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts NULLS LAST, event_id) <= round_even(0.8 * (SELECT count(*) FROM events), 0) THEN 'dev' ELSE 'hidden' END AS split FROM events")
def holdout_time(spark: SparkSession, d: str) -> DataFrame:
    return split.holdout_time(table(spark, d, "events"), "ts", ["event_id"]).select("event_id", "split")


_RANDOM = f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {hash_sql(chr(39) + '42' + chr(39), _KEY)}, o_orderkey) <= ceil(round(0.2 * (SELECT count(*) FROM orders), 9)) THEN 'hidden' ELSE 'dev' END AS split FROM orders"


@query(f"SELECT o_orderkey, split FROM ({_RANDOM})")
def holdout_random(spark: SparkSession, d: str) -> DataFrame:
    return split.holdout_random(_orders(spark, d), ["o_orderkey"]).select("o_orderkey", "split")


_STRATIFIED = f"""sizes AS (SELECT o_orderstatus, count(*) AS size FROM orders GROUP BY 1),
exact AS (SELECT *, ceil(round(0.2 * (SELECT count(*) FROM orders), 9)) AS total, size * ceil(round(0.2 * (SELECT count(*) FROM orders), 9)) / (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS e FROM sizes),
quota AS (SELECT o_orderstatus, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, o_orderstatus) <= total - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS q FROM exact),
parted AS (SELECT o.*, CASE WHEN row_number() OVER (PARTITION BY o.o_orderstatus ORDER BY {hash_sql(chr(39) + '42' + chr(39), _KEY)}, o_orderkey) <= q THEN 'hidden' ELSE 'dev' END AS split FROM orders o JOIN quota USING (o_orderstatus))"""


@query(f"WITH {_STRATIFIED} SELECT o_orderkey, o_orderstatus, split FROM parted")
def holdout_stratified(spark: SparkSession, d: str) -> DataFrame:
    return split.holdout_stratified(_orders(spark, d), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "split")


def _hash(repeat: int) -> str:
    return hash_sql(f"'42.{repeat}'", _KEY)


@query(f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_hash(0)}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def fold_kfold(spark: SparkSession, d: str) -> DataFrame:
    return split.fold_kfold(_orders(spark, d), 5, ["o_orderkey"]).select("o_orderkey", "fold")


def _strat_sql(repeat: int) -> str:
    return f"""SELECT o_orderkey, CAST(((SELECT count(*) FROM orders x WHERE x.o_orderstatus < o.o_orderstatus) + row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash(repeat)}, o_orderkey) - 1) % 5 AS INT) AS fold, {repeat} AS repeat FROM orders o"""


@query(f"SELECT o_orderkey, fold FROM ({_strat_sql(0)})")
def fold_stratified(spark: SparkSession, d: str) -> DataFrame:
    return split.fold_stratified(_orders(spark, d), 5, "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


@query(" UNION ALL ".join(f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_hash(r)}, o_orderkey) - 1) % 2 AS INT) AS fold, {r} AS repeat FROM orders" for r in range(3)))
def fold_repeated(spark: SparkSession, d: str) -> DataFrame:
    return split.assign_folds(_orders(spark, d), 2, ["o_orderkey"], repeats=3).select("o_orderkey", "fold", "repeat")


@query(" UNION ALL ".join(map(_strat_sql, range(2))))
def fold_repeated_stratified(spark: SparkSession, d: str) -> DataFrame:
    return split.assign_folds(_orders(spark, d), 5, ["o_orderkey"], repeats=2, stratify="o_orderstatus").select("o_orderkey", "fold", "repeat")


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts NULLS LAST, event_id) - 1 AS pos, (SELECT count(*) FROM events) AS n FROM events)
SELECT event_id, pos, CASE WHEN pos >= n - 4 * (n // 5) THEN CAST((pos - (n - 4 * (n // 5))) // (n // 5) AS INT) END AS fold FROM r""")
def fold_timeseries(spark: SparkSession, d: str) -> DataFrame:
    return split.fold_timeseries(table(spark, d, "events"), 4, "ts", ["event_id"]).select("event_id", "pos", "fold")


_FEATURES = "o_orderstatus, o_orderpriority, month(o_orderdate)"
_SPLIT_CELLS = f"WITH s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, date_trunc('month', o_orderdate) AS m, split FROM ({_RANDOM}))"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return split.holdout_random(_orders(spark, d), ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_orderpriority", F.trunc("o_orderdate", "month").alias("m"), "split")


@query(f"{_SPLIT_CELLS} SELECT o_orderkey FROM s h WHERE split = 'hidden' AND EXISTS (SELECT 1 FROM s v WHERE v.split = 'dev' AND v.o_orderpriority IS NOT DISTINCT FROM h.o_orderpriority AND v.m IS NOT DISTINCT FROM h.m)")
def cross_split_duplicates(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    side = lambda s: c.where(F.col("split") == s).drop("split")
    return split.cross_split_duplicates(side("dev"), side("hidden"), "o_orderstatus", exclude=("o_orderkey",)).select("o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def union_splits(spark: SparkSession, d: str) -> DataFrame:
    s = split.holdout_stratified(_orders(spark, d), "o_orderstatus", ["o_orderkey"])
    both = s.where("split = 'dev'").unionByName(s.where("split = 'hidden'"))
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"""{_SPLIT_CELLS} SELECT count(*) FILTER (WHERE split = 'dev') AS n_dev, count(*) FILTER (WHERE split = 'hidden') AS n_hidden, 'random' AS method,
(SELECT count(*) FROM s h WHERE split = 'hidden' AND EXISTS (SELECT 1 FROM s v WHERE v.split = 'dev' AND v.o_orderpriority IS NOT DISTINCT FROM h.o_orderpriority AND v.m IS NOT DISTINCT FROM h.m)) AS n_duplicates FROM s""")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return split.split_summary(_cells(spark, d), "random", "o_orderstatus", exclude=("o_orderkey",))
