"""The log of a run's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "run_id string, ts double, kind string, payload string"


def as_events(df: DataFrame, run_id: str, ts: str, kind: str, payload: list[str]) -> DataFrame:
    """run_id, ts (seconds), kind and payload (JSON) of any table with a time column."""
    seconds = F.expr(f"unix_micros(cast(`{ts}` as timestamp))") / F.lit(1e6)
    return df.select(F.col(run_id).cast("string").alias("run_id"), seconds.alias("ts"), F.col(kind).cast("string").alias("kind"), F.to_json(F.struct(*payload)).alias("payload"))


def append_event(events: DataFrame, path: str) -> None:
    """Adds events to the log, one JSON object a line."""
    events.select("run_id", "ts", "kind", "payload").write.mode("append").json(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The log in order of time."""
    return spark.read.schema(SCHEMA).json(path).orderBy("ts", "run_id", "kind", "payload")


def latest_by_kind(events: DataFrame) -> DataFrame:
    """n_events and the latest ts and payload of each run and kind; for tables and streams alike."""
    return events.groupBy("run_id", "kind").agg(F.count("*").alias("n_events"), F.max("ts").alias("ts"), F.max_by("payload", F.struct("ts", "payload")).alias("payload"))


FEED = "run_id string, kind string, slot timestamp, n_events long, first double, ts double, payload string, idle double, mark double"


def feed(spark: SparkSession, path: str, late: float = 3600.0, idle: float = 86400.0) -> DataFrame:
    """A stream of changes to count and latest event of each run and kind in each slot of `idle` seconds, from the log at path.

    Events without run, time, kind or payload go. Events that come again, or more than `late` seconds
    of event time after the newest one, are dropped; what is remembered of them and of slots is
    forgotten by the same clock, so that state does not grow with the log. mark: the clock as this
    change tells it. Slots are put together when read (`followed`).
    """
    log = spark.readStream.schema(SCHEMA).json(path).where("run_id is not null and ts is not null and kind is not null and payload is not null")
    timed = log.withColumns({"at": F.timestamp_micros((F.col("ts") * 1000000).cast("long")), "id": F.xxhash64("run_id", "ts", "kind", "payload")})
    once = timed.withWatermark("at", f"{late} seconds").dropDuplicates(["id", "at"])
    slot = F.window("at", f"{max(1, round(idle * 1000000))} microseconds")
    found = once.groupBy("run_id", "kind", slot.alias("_slot")).agg(F.count("*").alias("n_events"), F.min("ts").alias("first"), F.max("ts").alias("ts"), F.max_by("payload", F.struct("ts", "payload")).alias("payload"))
    return found.select("run_id", "kind", F.col("_slot.start").alias("slot"), "n_events", "first", "ts", "payload", F.lit(float(idle)).alias("idle"), (F.col("ts") - late).alias("mark"))


def follow(spark: SparkSession, path: str, sink: str, checkpoint: str, **limits: float) -> StreamingQuery:
    """Writes the changes of `feed` below sink, a folder for each micro-batch, until all that the log has is read.

    Another run with the same checkpoint goes on where this one ended, or has died: a batch that is
    run again replaces its folder.
    """

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return feed(spark, path, **limits).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, sink: str) -> DataFrame:
    """run_id, kind, n_events, and ts and payload of the latest event, of what a sink has.

    A run's kind that has no event for more than `idle` seconds of event time is forgotten, and starts
    anew with a later event; events nearer to each other than that are in the same slot or the next.
    """
    changes = spark.read.schema(f"{FEED}, batch long").parquet(sink)
    clock = changes.agg(F.max("mark").alias("clock"))
    slots = changes.groupBy("run_id", "kind", "slot").agg(F.max_by(F.struct("n_events", "first", "ts", "payload", "idle"), "batch").alias("last")).select("run_id", "kind", "slot", "last.*")
    later = Window.partitionBy("run_id", "kind").orderBy(F.desc("slot"))
    gap = F.coalesce(F.lag("first").over(later) > F.col("ts") + F.col("idle"), F.lit(False))
    ended = F.sum(F.col("gap").cast("int")).over(later.rowsBetween(Window.unboundedPreceding, 0))
    open_ = slots.withColumn("gap", gap).withColumn("ended", ended).where("ended = 0").groupBy("run_id", "kind").agg(F.sum("n_events").alias("n_events"), F.max(F.struct("ts", "payload")).alias("last"), F.max("idle").alias("idle"))
    return open_.join(F.broadcast(clock), F.col("last.ts") + F.col("idle") >= F.col("clock")).select("run_id", "kind", "n_events", "last.*")
