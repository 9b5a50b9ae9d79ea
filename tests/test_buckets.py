"""Upserts by bucket: what a batch rewrites, crashes at each step, and batches that come again."""

import random

import pytest

from ledgerspark.sources.buckets import BucketTable, upsert_sink
from ledgerspark.sources.tables import upsert

SCHEMA = "k string, v string, w string"


def merge(target, batch):
    return upsert(target, batch, "k").drop("outcome")


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, None) for k, v in pairs], SCHEMA)


def held(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), "k", buckets=32)
    t.create(rows(spark, [(f"k{i}", "old") for i in range(400)]))
    return t


def test_only_touched_buckets_are_rewritten(spark, tmp_path, table):
    before = table.manifest().folders
    touched = table.upsert(rows(spark, [(f"k{i}", "new") for i in range(10)]), merge, 0)
    after = table.manifest().folders
    assert len(touched) <= 10 and {int(k) for k in after if after[k] != before[k]} == set(touched)
    fresh = [f for f in files(tmp_path) if f.startswith(f"data/v{1:020d}/")]
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in fresh} == set(touched)
    assert held(table) == {f"k{i}": "new" if i < 10 else "old" for i in range(400)}


def test_replays_change_nothing(spark, tmp_path, table):
    batch = rows(spark, [("k1", "a"), (" k900 ", "b"), ("", "no key"), ("k2", "")])
    table.upsert(batch, merge, 5)
    seen, state = files(tmp_path), held(table)
    assert table.upsert(batch, merge, 5) == [] and table.upsert(rows(spark, [("k1", "late")]), merge, 4) == []
    assert files(tmp_path) == seen and held(table) == state
    assert state["k1"] == "a" and state["k900"] == "b" and state["k2"] == "old" and len(state) == 401


@pytest.mark.parametrize("step", ["put", "_clean"])
def test_crashes(spark, tmp_path, table, monkeypatch, step):
    """Before the manifest the old version holds and the batch is merged again; behind it the batch is in."""
    batch = rows(spark, [("k1", "new"), ("k700", "new")])

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(table.files if step == "put" else table, step, die)
        with pytest.raises(RuntimeError):
            table.upsert(batch, merge, 0)
    again = BucketTable(spark, str(tmp_path), "k", buckets=32)
    assert held(again)["k1"] == ("old" if step == "put" else "new")
    again.upsert(batch, merge, 0)
    assert held(again)["k1"] == "new" and held(again)["k700"] == "new" and len(held(again)) == 401


def test_old_versions_go(spark, tmp_path, table):
    for number in range(5):
        table.upsert(rows(spark, [("k1", str(number))]), merge, number)
    used = set(table.manifest().folders.values())
    assert len(list((tmp_path / "manifest").glob("*.json"))) == 2
    present = {p.name for p in (tmp_path / "data").iterdir()}
    assert used <= present and len(present - used) <= 1
    assert held(table)["k1"] == "4"


def test_stream_equals_one_batch(spark, tmp_path):
    """Any cut of a sequence of changes into batches gives the table of the changes one after another."""
    random.seed(3)
    changes = [(f"k{random.randrange(40)}", str(i)) for i in range(120)]
    want = dict(changes)
    source, table = tmp_path / "in", BucketTable(spark, str(tmp_path / "t"), "k", buckets=8)
    for a in range(0, 120, 30):
        spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(changes[a : a + 30])], "k string, v string, n long").coalesce(1).write.mode("append").parquet(str(source))
    last = upsert_sink(table, lambda target, batch: upsert(target.drop("n"), batch, "k", "n").drop("outcome"))
    stream = spark.readStream.schema("k string, v string, n long").option("maxFilesPerTrigger", 1).parquet(str(source))
    stream.writeStream.foreachBatch(lambda df, i: last(df, i)).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert held(table) == want


def test_empty(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "k")
    table.create(rows(spark, []))
    assert table.read().collect() == [] and table.upsert(rows(spark, []), merge, 0) == []
