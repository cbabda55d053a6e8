import json

import pytest
from pyspark.sql import functions as F

from spanisle.streaming import windows
from spanisle.streaming.alerts import AlertRegistry


def test_registration_and_delivery():
    pushed = []
    r = AlertRegistry(lambda url, data: pushed.append((url, data)))
    a, b = r.register("Proc"), r.register("proc", one_time=True)
    assert a.alert == b.alert and len(r.alerts) == 1
    p = r.register("proc", one_time=True, notify_url="http://x", push=True)
    assert r.register("PROC", notify_url="http://x", push=True) is p
    assert r.raise_event(a.alert, [1]) == ["http://x"] and r.raise_event(a.alert, [2]) == []
    assert pushed == [("http://x", [1])]
    assert json.loads(r.status(a.id)) == {"data": [1, 2]} and r.status(a.id) == "None"
    assert json.loads(r.status(b.id)) == {"data": [1, 2]}
    r.raise_event(a.alert, [3])
    assert r.status(b.id) == "None" and r.status(99) == "None"
    with pytest.raises(KeyError):
        r.raise_event(9, [])


def test_windows_on_a_stream_match_a_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    agg = {"n": F.count("*")}
    for n, make in enumerate((lambda d: windows.tumbling(d, "ts", "1 hour", agg, ["event_type"]), lambda d: windows.sliding(d, "ts", "2 hours", "1 hour", agg), lambda d: windows.session(d, "ts", "30 minutes", agg, ["user_id"]))):
        stream = make(windows.read(spark, str(tmp_path / "in"), batch.schema, 1))
        q = stream.writeStream.outputMode("complete").format("memory").queryName(f"w{n}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"w{n}").collect())) == sorted(map(tuple, make(batch).collect()))


def test_alert_sink_and_drain(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    r = AlertRegistry()
    c = r.register("errors")
    stream = windows.read(spark, str(tmp_path / "in"), batch.schema).where("event_type = 'error'").select("event_id")
    windows.drain(stream, r.sink(c.alert), str(tmp_path / "c1"), None).awaitTermination(120)
    assert len(json.loads(r.status(c.id))["data"]) == batch.where("event_type = 'error'").count()
    windows.drain(stream, windows.to_parquet(str(tmp_path / "out")), str(tmp_path / "c2"), None).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.where("event_type = 'error'").count()
    assert windows.deduplicated(batch, "ts", ["user_id"], "1 hour").count() == batch.select("user_id").distinct().count()


def test_alert_sink_delivers_all_rows(spark):
    pushed = []
    r = AlertRegistry(lambda url, data: pushed.append(data))
    a = r.register("all", one_time=True)
    r.register("all", one_time=True, notify_url="http://x", push=True)
    r.sink(a.alert)(spark.range(2500).toDF("id"), 0)
    assert sorted(x["id"] for x in json.loads(r.status(a.id))["data"]) == list(range(2500))
    assert [len(x) for x in pushed] == [1000, 1000, 500] and sorted(x["id"] for p in pushed for x in p) == list(range(2500))
    r.sink(a.alert)(spark.range(0).toDF("id"), 1)
    assert len(pushed) == 3
