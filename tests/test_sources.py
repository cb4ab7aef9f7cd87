from pyspark.sql import functions as F

from assay.sources import tables
from assay.streaming import events


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,x,flag,day,text\n1,1.5,true,2024-01-02,hello\n2,NA,False,2024-02-03,"a, b"\n3,nan,,n/a,\n')
    df = tables.read_table(spark, str(tmp_path / "t.csv"), "id")
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "day": "timestamp_ntz", "text": "string"}
    rows = df.orderBy("id").collect()
    assert rows[1]["x"] is None and rows[2]["day"] is None and rows[1]["text"] == "a, b" and rows[1]["flag"] is False and rows[2]["text"] is None


def test_short_and_mixed_texts_stay_texts(spark):
    df = spark.createDataFrame([(i, "2024", "2024-01-01" if i % 2 else "soon enough") for i in range(10)], "id int, short string, mixed string")
    assert dict(tables.infer_datetimes(df, "id").dtypes) == {"id": "int", "short": "string", "mixed": "string"}


def test_stage_and_results(spark, tmp_path):
    df = spark.range(5).withColumn("s", F.lit("x"))
    assert tables.stage(df, str(tmp_path / "a.parquet")).count() == 5
    tables.save_results(str(tmp_path / "r"), one=df, two=df.limit(2))
    assert spark.read.parquet(str(tmp_path / "r/two")).count() == 2


def test_events(spark, sf_dir, tmp_path):
    e = events.as_events(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_type", ["event_id", "value"])
    path = str(tmp_path / "log")
    n = e.count()
    events.append_event(e.where("ts % 2 < 1"), path)
    events.append_event(e.where("not ts % 2 < 1"), path)
    log = events.replay(spark, path)
    assert log.count() == n and [r["ts"] for r in log.limit(50).collect()] == sorted(r["ts"] for r in log.limit(50).collect())
    events.follow(spark, path, str(tmp_path / "sink"), str(tmp_path / "state"), late=1e9).awaitTermination()
    streamed = events.followed(spark, str(tmp_path / "sink"))
    wanted = events.latest_by_kind(spark.read.schema(events.SCHEMA).json(path))
    assert streamed.exceptAll(wanted).count() == 0 and streamed.count() == wanted.count()
