"""The versioned table and document store through crashes and replays, and merged state on streams."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from titerframe.sources.store import DocumentStore, VersionedTable
from titerframe.streaming import state


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k string, at int, v int")


def content(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_resumed_runs_leave_every_key_once(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and not table.done("a")
    assert table.append_missing(rows(spark, ("x", 1, 1), ("y", 1, 2), ("y", 1, 2), (None, 1, 3)), ["k"], "a")
    # killed after the write and before the commit
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, new: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.append_missing(rows(spark, ("y", 2, 9), ("z", 2, 4)), ["k"], "b")
    monkeypatch.undo()
    assert len(content(table)) == 3 and not table.done("b")
    again = VersionedTable(spark, str(tmp_path / "t"))
    left = again.missing(rows(spark, ("x", 0, 0), ("z", 0, 0)).select("k"), ["k"])
    assert [r.k for r in left.collect()] == ["z"]
    assert again.append_missing(rows(spark, ("y", 2, 9), ("z", 2, 4), (None, 5, 5)), ["k"], "b")
    assert not again.append_missing(rows(spark, ("w", 9, 9)), ["k"], "b")  # committed: nothing to do
    assert content(again) == sorted([("x", 1, 1), ("y", 1, 2), (None, 1, 3), ("z", 2, 4)], key=str)
    assert again.state()["runs"] == ["a", "b"] and again.vacuum() == 0


def test_writers_that_meet_both_get_in(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.append_missing(rows(spark, ("x", 1, 1)), ["k"], "first")
    real, met = VersionedTable._commit, []

    def late(self, new):
        if not met:  # another writer commits the same version first
            met.append(1)
            assert two.append_missing(rows(spark, ("y", 1, 1), ("z", 1, 1)), ["k"], "other")
        return real(self, new)

    monkeypatch.setattr(VersionedTable, "_commit", late)
    assert one.append_missing(rows(spark, ("z", 5, 5), ("w", 5, 5)), ["k"], "mine")
    assert content(one) == [("w", 5, 5), ("x", 1, 1), ("y", 1, 1), ("z", 1, 1)] and one.state()["version"] == 3
    assert one.vacuum() == 1  # the first try's folder


def test_upserts_replay_across_restarts(spark, tmp_path):
    source, target = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"))
    rows(spark, ("a", 1, 1), ("b", 1, 2)).coalesce(1).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema("k string, at int, v int").parquet(source)
        q = stream.writeStream.foreachBatch(target.sink(["k"], "at", f"q-{checkpoint}")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    run("c1")
    rows(spark, ("a", 2, 10), ("b", 0, 99), ("c", 1, 3)).coalesce(1).write.mode("append").parquet(source)
    run("c1")
    want = [("a", 2, 10), ("b", 1, 2), ("c", 1, 3)]
    assert content(target) == want
    run("c2")  # a new query that begins with batch 0 merges into what is there
    assert content(target) == want and target.state()["version"] == 3
    target.sink(["k"], "at", "q-c1")(rows(spark, ("a", 9, 9)), 0)  # a replayed batch
    assert content(target) == want


def test_documents_by_id_and_by_content(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "d"))
    docs = [("p1", "alpha"), ("p0", "alpha"), (None, "beta"), ("p3", None), ("p4", "é")]
    assert store.save(spark.createDataFrame(docs, "id string, body string"), "r1")
    table = {r.id: r for r in store.table.read().collect()}
    assert set(table) == {"p0", "p4", next(i for i in table if i.startswith("doc_"))}
    sha = table["p4"].sha256
    assert [r.id for r in store.by_sha(spark.createDataFrame([(sha,), ("none",)], "sha256 string")).collect()] == ["p4"]
    assert store.save(spark.createDataFrame([("p4", "new"), ("p9", "alpha")], "id string, body string"), "r2")
    got = {r.id: bytes(r.body).decode() for r in store.by_id(spark.createDataFrame([("p0",), ("p4",), ("p9",)], "id string")).collect()}
    assert got == {"p0": "alpha", "p4": "new"}  # the content of p9 is stored under p0


# --------------------------------------------------------------------------------------------------------------- state


def test_merged_state_over_restarts_and_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    source, out = tmp_path / "in", tmp_path / "out"
    batches = [
        [("j", "stage", "qc", "2024-01-01 00:00:00"), ("j", "stage", "fit", "2024-01-01 00:00:05"), ("k", "n", "1", "2024-01-01 00:00:00"), ("j", None, "x", "2024-01-01 00:00:00")],
        [("j", "stage", "old", "2024-01-01 00:00:03"), ("j", "files", "2", "2024-01-01 00:00:09"), ("j", "tie", "a", "2024-01-01 00:01:00"), ("j", "tie", "b", "2024-01-01 00:01:00")],
        [("l", "n", "5", "2024-01-09 00:00:00")],
        [("l", "n", None, "2024-01-09 00:00:01"), ("j", "again", "1", "2024-01-09 00:00:02")],
    ]
    schema, said = "job string, field string, value string, at timestamp", []
    listener = state.listen(spark, said.append)
    for i, rows_ in enumerate(batches):  # every batch by a query of its own, restarted from the checkpoint
        df = spark.createDataFrame(rows_, "job string, field string, value string, at string").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        merged = state.merged_state(stream, "job", "field", "value", "at", "10 minutes", ttl_ms=3600_000)
        sink = merged.writeStream.outputMode("update").foreachBatch(lambda b, n, i=i: b.withColumn("run", F.lit(i)).write.mode("append").json(str(out)))
        sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.streams.removeListener(listener)
    got = [r.asDict(recursive=True) for r in spark.read.schema("job string, n_updates long, updated_ms long, fields map<string,string>, expired boolean, run int").json(str(out)).collect()]
    by_run = lambda i, expired=False: {r["job"]: (r["n_updates"], r["fields"]) for r in got if r["run"] == i and r["expired"] == expired}
    assert by_run(0) == {"j": (2, {"stage": "fit"}), "k": (1, {"n": "1"})}
    assert by_run(1) == {"j": (6, {"stage": "fit", "files": "2", "tie": "b"})}  # the late update of stage changed nothing
    gone = {r["job"] for r in got if r["expired"]}
    assert gone == {"j", "k"}
    assert by_run(3)["j"] == (1, {"again": "1"})  # forgotten, so it starts anew
    assert by_run(3)["l"][0] == 2 and by_run(3)["l"][1].get("n") is None
    table = spark.createDataFrame([r for b in batches[:2] for r in b], "job string, field string, value string, at string").withColumn("at", F.to_timestamp("at"))
    assert {r.job: (r.n_updates, r.fields) for r in state.merged_table(table, "job", "field", "value", "at").collect()} == {"j": (6, {"stage": "fit", "files": "2", "tie": "b"}), "k": (1, {"n": "1"})}
    for _ in range(50):
        if any(s["stage"] == "progress" and s["rows"] for s in said) and sum(s["stage"] == "ended" for s in said) >= 4:
            break
        time.sleep(0.2)
    assert {s["stage"] for s in said} == {"started", "progress", "ended"} and max(s["state_rows"] for s in said) > 0
    json.dumps(said)
