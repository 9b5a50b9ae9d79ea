"""Pulls by cursor: each message once, whatever the batches, breaks and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.sources import cursor
from ledgerspark.streaming import jobs


def messages(spark, ranges):
    """Messages of (tenant, first, last)."""
    rows = [(t, i, f"text {i}", "x") for t, a, b in ranges for i in range(a, b + 1)]
    return spark.createDataFrame(rows, "corpid string, seq long, text string, unused string")


SCHEMA = "seq long, corpid string, text string"


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def pull(spark, log, out, state, **options):
    """One run over all there is, into Parquet."""
    df = cursor.message_stream(spark, log, schema(spark), **options)
    df.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return sorted((r["corpid"], r["seq"], r["text"]) for r in spark.read.parquet(out).collect())


def all_of(ranges):
    return sorted((t, i, f"text {i}") for t, a, b in ranges for i in range(a, b + 1))


def test_pulls_and_restarts(spark, tmp_path):
    log, out, state, stored = (str(tmp_path / x) for x in ("log", "out", "state", "cursor"))
    cursor.append_messages(messages(spark, [("a", 1, 40), ("b c", 5, 9)]), log)
    assert pull(spark, log, out, state, limit="7", cursor=stored) == all_of([("a", 1, 40), ("b c", 5, 9)])
    cursor.append_messages(messages(spark, [("a", 41, 60), ("d", 1, 3)]), log)
    assert pull(spark, log, out, state, limit="7", cursor=stored) == all_of([("a", 1, 60), ("b c", 5, 9), ("d", 1, 3)])
    assert pull(spark, log, out, state, limit="7", cursor=stored) == all_of([("a", 1, 60), ("b c", 5, 9), ("d", 1, 3)])
    # what was committed last is stored; a query of its own goes on behind it
    assert json.loads((tmp_path / "cursor").read_text())["a"] >= 40
    cursor.store_cursor(stored, {"a": 58, "b c": 9, "d": 0})
    assert pull(spark, log, str(tmp_path / "out2"), str(tmp_path / "state2"), cursor=stored) == all_of([("a", 59, 60), ("d", 1, 3)])


def test_killed_between_batches(spark, tmp_path):
    """A query that dies before its batch is done reads that batch again, and no other."""
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    taken, alive = [], [True]

    def write(batch, number):
        rows = [(r["corpid"], r["seq"]) for r in batch.collect()]
        if not alive[0]:
            raise RuntimeError("killed")
        taken.append((number, rows))

    def run():
        df = cursor.message_stream(spark, log, schema(spark), limit="5")
        df.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    cursor.append_messages(messages(spark, [("a", 1, 20)]), log)
    run()
    cursor.append_messages(messages(spark, [("a", 21, 30), ("b", 1, 4)]), log)
    alive[0] = False
    with pytest.raises(Exception, match="killed"):
        run()
    cursor.append_messages(messages(spark, [("a", 31, 33)]), log)
    alive[0] = True
    run()  # the batch that was broken off
    run()
    got = [x for _, rows in taken for x in rows]
    assert sorted(got) == [(t, i) for t, i, _ in all_of([("a", 1, 33), ("b", 1, 4)])]
    assert len({n for n, _ in taken}) == len(taken)


def test_begins_behind_a_cursor_and_prunes(spark, tmp_path):
    log = str(tmp_path / "log")
    for a in (1, 101, 201):
        cursor.append_messages(messages(spark, [("a", a, a + 99), ("b", a, a + 99)]).coalesce(1), log)
    assert pull(spark, log, str(tmp_path / "o"), str(tmp_path / "s"), after='{"a": 250, "b": 299}') == all_of([("a", 251, 300), ("b", 300, 300)])
    held = cursor.Log(log)
    parts = held.between({"a": 250, "b": 299}, held.newest(), 1000)
    assert {p.tenant for p in parts} == {"a", "b"} and all(held.seen[p.file][1][p.groups[0]].high > 250 for p in parts)
    assert sum(len(p.groups) for p in parts) < sum(len(g) for _, g in held.seen.values())
    spark.dataSource.register(cursor.MessageLog)
    batch = spark.read.format("message_log").schema(SCHEMA).options(path=log, after='{"a": 250}').load()
    assert batch.groupBy("corpid").count().orderBy("corpid").collect() == [("a", 50), ("b", 300)]


def test_empty_log(spark, tmp_path):
    log = str(tmp_path / "log")
    df = cursor.message_stream(spark, log, schema(spark))
    df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "o")).isEmpty()


def test_ingest_drops_repeats(spark, tmp_path):
    """ST1 on the log: a message that a producer wrote twice counts once."""
    log = str(tmp_path / "log")
    rows = messages(spark, [("a", 1, 30)]).withColumn("sent_at", F.timestamp_seconds(F.col("seq")))
    cursor.append_messages(rows, log)
    cursor.append_messages(rows.where("seq > 20"), log)
    df = cursor.message_stream(spark, log, rows.select("corpid", "seq", "sent_at").schema)
    jobs.ingest(df).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(1, 31))
