"""Queries on sources, filters, the profile and features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.portable import uniform
from assay.operators import features, filters, profile, split
from assay.queries import hash_sql, query, table, uniform_sql
from assay.session import shared_folder
from assay.sources import tables
from assay.streaming import events

ROUND = "round(CAST({} AS DOUBLE), {})"


# --- sources, sinks, events


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderstatus")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.read_table(spark, f"{d}/orders.parquet")
    return orders.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_STRINGS = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, o_orderpriority FROM orders"


@query(f"""
WITH s AS ({_STRINGS}),
cells AS (SELECT o_orderkey, 'placed' AS name, placed AS v FROM s UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM s),
first AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o_orderkey) AS r FROM cells WHERE v IS NOT NULL)
SELECT name, count(*) AS n, min(length(v)) AS shortest, avg(CASE WHEN try_strptime(v, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 1.0 ELSE 0 END) AS parsed FROM first WHERE r <= 200 GROUP BY name""")
def infer_datetimes(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("placed"), "o_orderpriority")
    return tables.datetime_share(texts, "o_orderkey").select("name", "n", F.col("shortest").cast("long").alias("shortest"), "parsed")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events.as_events(table(spark, d, "events"), "user_id", "ts", "event_type", ["event_id", "value"])


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """The events, appended to a new log in the shared folder and replayed from there."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    events.append_event(_events(spark, d), path)
    return events.replay(spark, path).withColumn("event_id", F.get_json_object("payload", "$.event_id").cast("long"))


_EVENTS = "SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) / 1e6 AS ts, event_type AS kind, event_id, value FROM events"


@query(f"SELECT kind, count(*) AS n, round(min(ts), 3) AS first_ts, round(max(ts), 3) AS last_ts, CAST(sum(event_id) AS BIGINT) AS ids FROM ({_EVENTS}) GROUP BY kind")
def event_append(spark: SparkSession, d: str) -> DataFrame:
    e = _logged(spark, d)
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.min("ts"), 3).alias("first_ts"), F.round(F.max("ts"), 3).alias("last_ts"), F.sum("event_id").alias("ids"))


@query(f"SELECT run_id, ts, kind, event_id FROM ({_EVENTS}) ORDER BY ts, run_id, kind")
def event_replay(spark: SparkSession, d: str) -> DataFrame:
    return _logged(spark, d).select("run_id", "ts", "kind", "event_id")


@query(f"SELECT run_id, kind, count(*) AS n_events, max(ts) AS ts FROM ({_EVENTS}) GROUP BY run_id, kind")
def event_latest_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return events.latest_by_kind(_events(spark, d)).select("run_id", "kind", "n_events", "ts")


@query(f"SELECT run_id, kind, count(*) AS n_events, max(ts) AS ts FROM ({_EVENTS}) GROUP BY run_id, kind")
def event_feed(spark: SparkSession, d: str) -> DataFrame:
    """The live feed: a stream reads half of the log and ends; the rest comes with the last hours again and some late ones; a new stream goes on."""
    log, (sink, state) = _events(spark, d), [f"{shared_folder(spark)}/{x}-{uuid.uuid4().hex}" for x in ("feed", "state")]
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    middle = log.agg(F.percentile_approx("ts", 0.5)).first()[0]
    events.append_event(log.where(F.col("ts") <= middle), path)
    events.follow(spark, path, sink, state, late=7200.0, idle=1e9).awaitTermination()
    again = log.where((F.col("ts") <= middle) & (F.col("ts") > middle - 3600))
    late = log.where(F.col("ts") > middle).withColumns({"ts": F.lit(middle - 1e6), "payload": F.lit("late")})
    events.append_event(log.where(F.col("ts") > middle).unionByName(again).unionByName(late), path)
    events.follow(spark, path, sink, state, late=7200.0, idle=1e9).awaitTermination()
    return events.followed(spark, sink).drop("payload")


# --- filters: lineitem's discounts with every tenth by hash missing


def _holes(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with some values missing: null in l_tax, NaN in l_discount."""
    u = lambda s: uniform(s, "l_orderkey", "l_linenumber", "l_partkey")
    li = table(spark, d, "lineitem")
    return li.withColumn("l_tax", F.when(u(1) >= 0.1, F.col("l_tax"))).withColumn("l_discount", F.when(u(2) >= 0.1, F.col("l_discount")).otherwise(F.lit(float("nan")))).withColumn("l_returnflag", F.when(u(3) >= 0.1, F.col("l_returnflag")))


_KEY = ("CAST(l_orderkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)", "CAST(l_partkey AS VARCHAR)")
HOLES = f"""holes AS (SELECT * REPLACE (CASE WHEN {uniform_sql("'1'", *_KEY)} >= 0.1 THEN l_tax END AS l_tax, CASE WHEN {uniform_sql("'2'", *_KEY)} >= 0.1 THEN l_discount END AS l_discount, CASE WHEN {uniform_sql("'3'", *_KEY)} >= 0.1 THEN l_returnflag END AS l_returnflag) FROM lineitem)"""


@query(f"WITH {HOLES} SELECT l_linestatus, count(*) AS n, round(sum(l_discount), 4) AS discount FROM holes WHERE l_discount IS NOT NULL GROUP BY l_linestatus")
def drop_missing_target(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_missing_target(_holes(spark, d), "l_discount").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 4).alias("discount"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_columns(table(spark, d, "part"), ["p_brand", "p_type", "no_such_column", "p_retailprice"], target="p_retailprice")


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {hash_sql("'42'", "CAST(p_partkey AS VARCHAR)")}, p_partkey) <= ceil(round(0.2 * count(*) OVER (), 9)) AS hidden FROM part)
SELECT p_type, count(*) AS n FROM r WHERE hidden AND p_type IN (SELECT p_type FROM r WHERE NOT hidden) GROUP BY 1""")
def filter_known_labels(spark: SparkSession, d: str) -> DataFrame:
    """Hidden parts whose type the other parts have too."""
    parted = split.holdout_random(table(spark, d, "part"), ["p_partkey"])
    known = filters.filter_known_labels(parted.where("split = 'hidden'"), "p_type", parted.where("split = 'dev'"))
    return known.groupBy("p_type").agg(F.count("*").alias("n"))


_GUESSES = (("orders", "o_orderstatus", "'classification'"), ("lineitem", "l_linenumber", "CASE WHEN n_missing = 0 AND n_distinct <= 20 THEN 'classification' ELSE 'regression' END"), ("part", "p_size", "CASE WHEN n_missing = 0 AND n_distinct <= 20 THEN 'classification' ELSE 'regression' END"), ("orders", "o_totalprice", "'regression'"))


@query(" UNION ALL ".join(f"SELECT target, {task} AS task, n_distinct, n_missing FROM (SELECT '{c}' AS target, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_missing FROM {t})" for t, c, task in _GUESSES))
def guess_task(spark: SparkSession, d: str) -> DataFrame:
    first, *rest = [split.guess_task(table(spark, d, t), c) for t, c, _ in _GUESSES]
    for r in rest:
        first = first.unionByName(r)
    return first


# --- profile: customer with planted columns


def planted(spark: SparkSession, d: str) -> DataFrame:
    """customer with a target (is the balance over 5,000), two leaks of it, a constant and a mostly missing column."""
    u = lambda s: uniform(s, "c_custkey")
    c = table(spark, d, "customer").withColumn("rich", F.when(F.col("c_acctbal") > 5000, "yes").otherwise("no"))
    yes = F.col("rich") == "yes"
    flip = u(11) < 0.005
    return c.withColumns(
        {
            "leak_number": F.when(flip, 1 - yes.cast("int")).otherwise(yes.cast("int")),
            "leak_text": F.when(u(12) < 0.005, "open").when(yes, "closed").otherwise("open"),
            "nothing": F.lit("same"),
            "rare": F.when(u(13) < 0.3, F.floor(u(14) * 7)),
            "active": u(15) < 0.4,
        }
    )


_C = "CAST(c_custkey AS VARCHAR)"
PLANTED = f"""planted AS (SELECT *, CASE WHEN {uniform_sql("'11'", _C)} < 0.005 THEN CAST(rich = 'no' AS INT) ELSE CAST(rich = 'yes' AS INT) END AS leak_number,
  CASE WHEN {uniform_sql("'12'", _C)} < 0.005 THEN 'open' WHEN rich = 'yes' THEN 'closed' ELSE 'open' END AS leak_text, 'same' AS nothing,
  CASE WHEN {uniform_sql("'13'", _C)} < 0.3 THEN CAST(floor({uniform_sql("'14'", _C)} * 7) AS BIGINT) END AS rare, {uniform_sql("'15'", _C)} < 0.4 AS active
  FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS rich FROM customer))"""
COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "leak_number", "leak_text", "nothing", "rare", "active")
NUMBERS = ("c_custkey", "c_nationkey", "c_acctbal", "leak_number", "rare")
INTEGERS = ("c_custkey", "c_nationkey", "leak_number", "rare")
LEVELS = ("c_name", "c_mktsegment", "leak_text", "nothing", "active")


def _union(rows) -> str:
    return " UNION ALL ".join(rows)


@query("SELECT count(*) AS n_rows, 5 AS n_features FROM orders")
def profile_shape(spark: SparkSession, d: str) -> DataFrame:
    return profile.shape(table(spark, d, "orders"), "o_orderstatus")


_PAIRS = "SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM holes"


@query(f"WITH {HOLES} SELECT (SELECT count(*) FROM holes) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_PAIRS}))) AS n_duplicates")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_rows(_holes(spark, d).select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"))


@query("SELECT o_orderstatus AS class, round(count(*) / (SELECT CAST(count(o_orderstatus) AS DOUBLE) FROM orders), 3) AS share FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_balance(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT count(DISTINCT o_totalprice) AS n_classes, round(100.0 * avg(CAST(o_totalprice IS NULL AS INT)), 1) AS missing_pct, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(avg(o_totalprice), 4) AS mean, round(skewness(o_totalprice), 4) AS skew FROM orders")
def target_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.target_summary(table(spark, d, "orders"), "o_totalprice")


@query(f"WITH {PLANTED} " + _union(f"SELECT '{c}' AS name, round(100.0 * avg(CAST({c} IS NULL AS INT)), 1) AS missing_pct FROM planted" for c in (*COLUMNS, "rich")))
def profile_missing(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing(planted(spark, d))


@query(f"WITH {PLANTED} " + _union(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_unique FROM planted" for c in (*COLUMNS, "rich")))
def profile_distinct(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct(planted(spark, d))


@query(f"WITH {PLANTED} " + _union(f"SELECT '{c}' AS name, {', '.join(f'round(CAST({f}({c}) AS DOUBLE), 4) AS {n}' for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg'), ('skew', 'skewness')))} FROM planted" for c in NUMBERS))
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric(planted(spark, d))


def _corr(c: str) -> str:
    return f"SELECT '{c}' AS name, round(corr(CAST({c} AS DOUBLE), CAST(rich = 'yes' AS DOUBLE)), 4) AS corr_with_target FROM planted"


CORR = _union(map(_corr, NUMBERS))


@query(f"WITH {PLANTED} {CORR}")
def corr_with_target(spark: SparkSession, d: str) -> DataFrame:
    return profile.correlation(planted(spark, d), "rich", "classification")


CELLS = "cells AS (" + _union(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, rich AS class FROM planted" for c in LEVELS) + ")"


@query(f"WITH {PLANTED}, {CELLS} SELECT * FROM (SELECT name, value, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, value) AS place FROM cells WHERE value IS NOT NULL GROUP BY name, value) WHERE place <= 3")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(planted(spark, d), "rich")


PURITY = f"""WITH {PLANTED}, {CELLS}, counts AS (SELECT name, value, class, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
best AS (SELECT name, value, max(n) AS best, sum(n) AS n FROM counts GROUP BY name, value),
purity AS (SELECT name, round(sum(best) / sum(n), 6) AS target_purity, count(*) AS levels FROM best GROUP BY name)"""


@query(f"{PURITY} SELECT name, target_purity FROM purity WHERE levels BETWEEN 2 AND 50")
def target_purity(spark: SparkSession, d: str) -> DataFrame:
    return profile.target_purity(planted(spark, d), "rich")


def _flagged(flag: str, kinds: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = profile.column_profile(planted(spark, d), "rich", "classification")
        return p.where(F.array_contains("flags", flag) & F.col("kind").isin(*kinds)).select("name")

    return run


_DISTINCT = "WITH {planted}, u AS (" + _union(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS u, count(*) AS n, round(100.0 * avg(CAST({c} IS NULL AS INT)), 1) AS m FROM planted" for c in COLUMNS) + ")"
_DISTINCT = _DISTINCT.replace("{planted}", PLANTED)
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
query(f"WITH {PLANTED} SELECT name FROM ({CORR}) WHERE abs(corr_with_target) > 0.95", "flag_leakage_numeric")(_flagged("possible_leakage", ("numeric",)))
query(f"{PURITY} SELECT name FROM purity WHERE levels BETWEEN 2 AND 50 AND target_purity > 0.98 AND target_purity - (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM planted GROUP BY rich)) > 0.05", "flag_leakage_categorical")(_flagged("possible_leakage", ("categorical", "boolean")))
query(f"{_DISTINCT} SELECT name FROM u WHERE n > 50 AND ((name IN {_IN(INTEGERS)} AND u = n AND m = 0) OR (name IN ('c_name', 'c_mktsegment', 'leak_text', 'nothing') AND u >= 0.95 * n))", "flag_id_like")(_flagged("id_like", ("numeric", "categorical", "boolean")))
query(f"{_DISTINCT} SELECT name FROM u WHERE name IN {_IN(LEVELS)} AND u > 50", "flag_high_cardinality")(_flagged("high_cardinality", ("categorical", "boolean")))
query(f"{_DISTINCT} SELECT name FROM u WHERE u <= 1", "flag_constant")(_flagged("constant", ("numeric", "categorical", "boolean", "datetime")))
query(f"{_DISTINCT} SELECT name FROM u WHERE m > 40", "flag_mostly_missing")(_flagged("mostly_missing", ("numeric", "categorical", "boolean", "datetime")))


_FLAGS = f"""{PURITY}, u AS ({_union(f"SELECT {i} AS position, '{c}' AS name, count(DISTINCT {c}) AS u, count(*) AS n, round(100.0 * avg(CAST({c} IS NULL AS INT)), 1) AS m FROM planted" for i, c in enumerate(COLUMNS))}),
r AS ({CORR}), p AS (SELECT * FROM purity WHERE levels BETWEEN 2 AND 50), share AS (SELECT max(n) / sum(n) AS s FROM (SELECT count(*) AS n FROM planted GROUP BY rich)),
flagged AS (SELECT u.position, u.name, CASE WHEN u.name IN {_IN(NUMBERS)} THEN 'numeric' WHEN u.name = 'active' THEN 'boolean' ELSE 'categorical' END AS kind, m AS missing_pct, u.u AS n_unique, corr_with_target, target_purity,
  coalesce(abs(corr_with_target) > 0.95, false) OR coalesce(target_purity > 0.98 AND target_purity - (SELECT s FROM share) > 0.05, false) AS leak,
  n > 50 AND ((u.name IN {_IN(INTEGERS)} AND u.u = n AND m = 0) OR (u.name IN ('c_name', 'c_mktsegment', 'leak_text', 'nothing') AND u.u >= 0.95 * n)) AS id,
  u.name IN {_IN(LEVELS)} AND u.u > 50 AS high, u.u <= 1 AS constant, m > 40 AS missing
  FROM u LEFT JOIN r USING (name) LEFT JOIN p USING (name))"""


@query(f"{_FLAGS} SELECT position, name, kind, missing_pct, n_unique, corr_with_target, target_purity, concat_ws(',', CASE WHEN leak THEN 'possible_leakage' END, CASE WHEN id THEN 'id_like' END, CASE WHEN high THEN 'high_cardinality' END, CASE WHEN constant THEN 'constant' END, CASE WHEN missing THEN 'mostly_missing' END) AS flags FROM flagged")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    p = profile.column_profile(planted(spark, d), "rich", "classification")
    return p.select("position", "name", "kind", "missing_pct", "n_unique", "corr_with_target", "target_purity", F.array_join("flags", ",").alias("flags"))


@query(f"{_FLAGS} SELECT name FROM flagged WHERE leak OR id OR constant")
def auto_drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile.auto_drop_columns(profile.column_profile(planted(spark, d), "rich", "classification"))


@query(f"WITH {HOLES} SELECT l_returnflag AS value, 'string' AS type FROM holes WHERE l_returnflag IS NOT NULL ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10")
def inspect_sample(spark: SparkSession, d: str) -> DataFrame:
    return profile.inspect_sample(_holes(spark, d), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(f"WITH {HOLES} SELECT l_returnflag AS value, count(*) AS n FROM holes GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 15")
def inspect_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.inspect_value_counts(_holes(spark, d), "l_returnflag")


@query(f"""WITH {HOLES}, c AS (SELECT coalesce(l_returnflag, 'nan') AS value, l_linestatus AS class, count(*) AS n FROM holes WHERE l_linestatus IS NOT NULL GROUP BY ALL)
SELECT value, class, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY value), 3) AS share FROM c WHERE value IN (SELECT DISTINCT value FROM c ORDER BY 1 LIMIT 15)""")
def inspect_target_rate(spark: SparkSession, d: str) -> DataFrame:
    return profile.inspect_target_rate(_holes(spark, d), "l_returnflag", "l_linestatus")


# --- features


@query(f"WITH {PLANTED} SELECT c_custkey, CAST(active AS INT) AS active FROM planted")
def bool_to_int(spark: SparkSession, d: str) -> DataFrame:
    return features.bool_to_int(planted(spark, d).select("c_custkey", "active"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS o_orderdate_year, CAST(month(o_orderdate) AS INT) AS o_orderdate_month, CAST(isodow(o_orderdate) - 1 AS INT) AS o_orderdate_dow FROM orders")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    return features.date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))


@query(f"WITH {HOLES} SELECT l_returnflag, l_linenumber, count(*) AS n FROM holes GROUP BY ALL")
def to_string_null_safe(spark: SparkSession, d: str) -> DataFrame:
    return features.to_string_null_safe(_holes(spark, d)).groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return features.label_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "label")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """The table with holes, with folds by hash of its key."""
    h = _holes(spark, d)
    h = h.withColumn("l_discount", F.when(~F.isnan("l_discount"), F.col("l_discount")))
    return h.withColumn("fold", F.floor(uniform(9, "l_orderkey", "l_linenumber", "l_partkey") * 3).cast("int"))


FOLDED = f"{HOLES}, folded AS (SELECT *, CAST(floor({uniform_sql(chr(39) + '9' + chr(39), *_KEY)} * 3) AS INT) AS fold FROM holes), folds AS (SELECT DISTINCT fold FROM folded)"
_NUMERIC = ("l_tax", "l_discount")


def _stat(name: str, sql: str, digits: int = 6):
    text = f"WITH {FOLDED} " + _union(f"SELECT folds.fold, '{c}' AS name, round({sql.format(c)}, {digits}) AS {name} FROM folds JOIN folded ON folded.fold <> folds.fold GROUP BY folds.fold" for c in _NUMERIC)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return features.numeric_stats(_folded(spark, d), list(_NUMERIC), "fold").select("fold", "name", F.round(name, digits).alias(name))

    query(text, {"median": "impute_median", "mean": "impute_mean"}[name])(run)


_stat("median", "quantile_cont(CAST({} AS DOUBLE), 0.5)")
_stat("mean", "avg({})")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 4) AS l_quantity FROM lineitem")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return features.standardize(li, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 4))


_COUNTS = f"WITH {FOLDED}, counts AS (" + _union(f"SELECT folds.fold, '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM folds JOIN folded ON folded.fold <> folds.fold WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("l_returnflag", "month")) + ")"
_COUNTS = _COUNTS.replace("AS fold FROM holes)", "AS fold, CAST(month(l_shipdate) * 3 + l_linenumber AS VARCHAR) AS month FROM holes)")


def _categories(spark: SparkSession, d: str) -> DataFrame:
    f = _folded(spark, d).withColumn("month", (F.month("l_shipdate") * 3 + F.col("l_linenumber")).cast("string"))
    return features.category_counts(f, ["l_returnflag", "month"], "fold")


@query(f"{_COUNTS} SELECT fold, name, value AS mode FROM (SELECT *, row_number() OVER (PARTITION BY fold, name ORDER BY n DESC, value) AS r FROM counts) WHERE r = 1")
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    return features.impute_mode(_categories(spark, d))


@query(f"{_COUNTS} SELECT fold, name, value, CASE WHEN levels <= 20 OR r < 20 THEN value ELSE '__infrequent__' END AS output FROM (SELECT *, row_number() OVER (PARTITION BY fold, name ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY fold, name) AS levels FROM counts)")
def onehot_capped(spark: SparkSession, d: str) -> DataFrame:
    return features.onehot_categories(_categories(spark, d))


@query(f"{_COUNTS} SELECT fold, name, value, row_number() OVER (PARTITION BY fold, name ORDER BY value) - 1 AS code FROM counts")
def ordinal_encode(spark: SparkSession, d: str) -> DataFrame:
    return features.ordinal_codes(_categories(spark, d)).withColumn("code", F.col("code").cast("long"))


@query("SELECT o_orderstatus, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * CAST(count(*) AS DOUBLE)), 6) AS weight, count(*) AS n FROM orders GROUP BY 1")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return features.balanced_weights(table(spark, d, "orders"), "o_orderstatus").groupBy("o_orderstatus").agg(F.round(F.min("weight"), 6).alias("weight"), F.count("*").alias("n"))
