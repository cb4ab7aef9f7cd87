import pytest

from assay import queries
from assay.streaming import events


@pytest.mark.parametrize("name", ["event_append", "event_replay"])
def test_event_queries_write_and_read_the_log(spark, sf_dir, name, monkeypatch):
    called, append, replay = [], events.append_event, events.replay
    monkeypatch.setattr(events, "append_event", lambda e, path: (called.append(path), append(e, path))[1])
    monkeypatch.setattr(events, "replay", lambda s, path: (called.append(path), replay(s, path))[1])
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
    assert len(called) == 2 and called[0] == called[1]


def _run(spark, tmp_path, **limits):
    events.follow(spark, str(tmp_path / "log"), str(tmp_path / "sink"), str(tmp_path / "state"), **limits).awaitTermination()
    return {(r["run_id"], r["kind"]): (r["n_events"], r["ts"], r["payload"]) for r in events.followed(spark, str(tmp_path / "sink")).collect()}


def _add(spark, tmp_path, rows):
    events.append_event(spark.createDataFrame(rows, events.SCHEMA).coalesce(1), str(tmp_path / "log"))


def test_feed_goes_on_after_a_restart(spark, tmp_path):
    _add(spark, tmp_path, [("a", 1000.0, "x", "1"), ("a", 1500.0, "x", "2"), ("a", 1500.0, "x", "2"), ("b", 1400.0, "y", "3"), ("c", None, "y", "4"), (None, 1.0, "y", "4")])
    assert _run(spark, tmp_path, late=600.0) == {("a", "x"): (2, 1500.0, "2"), ("b", "y"): (1, 1400.0, "3")}
    # repeated, too late, late but in time, new
    _add(spark, tmp_path, [("a", 1500.0, "x", "2"), ("a", 100.0, "x", "0"), ("a", 1200.0, "x", "1b"), ("b", 2000.0, "y", "5")])
    assert _run(spark, tmp_path, late=600.0) == {("a", "x"): (3, 1500.0, "2"), ("b", "y"): (2, 2000.0, "5")}
    assert _run(spark, tmp_path, late=600.0) == {("a", "x"): (3, 1500.0, "2"), ("b", "y"): (2, 2000.0, "5")}


def test_feed_forgets_idle_runs(spark, tmp_path):
    limits = {"late": 10.0, "idle": 100.0}
    _add(spark, tmp_path, [("a", 1000.0, "x", "1"), ("b", 1000.0, "x", "1")])
    assert _run(spark, tmp_path, **limits) == {("a", "x"): (1, 1000.0, "1"), ("b", "x"): (1, 1000.0, "1")}
    _add(spark, tmp_path, [("b", 1090.0, "x", "2"), ("c", 5000.0, "x", "3")])
    _run(spark, tmp_path, **limits)
    _add(spark, tmp_path, [("c", 5001.0, "x", "4")])
    assert _run(spark, tmp_path, **limits) == {("c", "x"): (2, 5001.0, "4")}


def test_feed_state_is_aggregated_by_spark(spark, tmp_path):
    """No Python for each run: 20,000 runs took minutes."""
    _add(spark, tmp_path, [("a", 1000.0, "x", "1")])
    query = events.follow(spark, str(tmp_path / "log"), str(tmp_path / "sink"), str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted(o["operatorName"] for o in query.lastProgress["stateOperators"]) == ["dedupe", "stateStoreSave"]


def test_feed_counts_a_run_across_slots_until_it_is_idle(spark, tmp_path):
    """Events 60 s apart are one run over several slots of 100 s; a gap of more than 100 s, even inside a batch, ends it."""
    limits = {"late": 1000.0, "idle": 100.0}
    _add(spark, tmp_path, [("a", 1000.0 + 60 * k, "x", f"{k:02}") for k in range(10)] + [("b", 900.0, "x", "0"), ("b", 1090.0, "x", "1"), ("b", 1190.0, "x", "2")])
    assert _run(spark, tmp_path, **limits) == {("a", "x"): (10, 1540.0, "09"), ("b", "x"): (2, 1190.0, "2")}
    _add(spark, tmp_path, [("a", 1600.0, "x", "10"), ("a", 1001.0, "x", "late, in time"), ("b", 900.0, "x", "0"), ("c", 2300.0, "x", "1")])
    assert _run(spark, tmp_path, **limits) == {("a", "x"): (12, 1600.0, "10"), ("c", "x"): (1, 2300.0, "1")}
