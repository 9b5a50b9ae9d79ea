"""Counters by day: they add up to the counters of all records, and are kept up with changes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import ledger
from ledgerspark.sources.buckets import BucketTable
from ledgerspark.streaming import counters

SCHEMA = "id long, enterprise_id long, deleted int, status string, doc_category string, policy_no string, is_abnormal int, created_day date"


def record(i, rng):
    return (i, rng.randrange(2), int(rng.random() < 0.1), rng.choice(["done", "success", "failed", "pending"]), rng.choice(["保单", "批单", "", None]), rng.choice(["", None, "P1", "P2", "P3"]), rng.randrange(2), rng.choice([None, *[dt.date(2024, 1, d) for d in range(1, 8)]]))


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_days_add_up(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([record(i, rng) for i in range(400)], SCHEMA)
    daily = ledger.daily_counters(df)
    for tenant in (0, 1):
        assert table(ledger.counters_of(daily, tenant)) == table(ledger.counters(df.where(F.col("enterprise_id") == tenant)))
    some = df.where("enterprise_id = 1 and created_day between '2024-01-02' and '2024-01-04'")
    assert table(ledger.counters_of(daily, 1, "2024-01-02", "2024-01-04")) == table(ledger.counters(some))


def test_kept_up_with_changes(spark, tmp_path):
    rng = random.Random(2)
    state = {i: record(i, rng) for i in range(60)}
    now = lambda: spark.createDataFrame(list(state.values()), SCHEMA)
    kept = BucketTable(spark, str(tmp_path), counters.DAY, buckets=16)
    kept.create(counters.daily_table(now()))
    write = counters.counter_sink(kept, now)
    for number in range(3):
        old = [state[i] for i in rng.sample(sorted(state), 3)]
        new = [record(i, rng) for i in [old[0][0], old[1][0], 100 + number]]
        del state[old[2][0]]
        state.update({r[0]: r for r in new})
        before = kept.manifest().folders
        write(spark.createDataFrame(old + new, SCHEMA), number)
        after, days = kept.manifest().folders, {r[-1] for r in old + new}
        assert sum(after.get(k) != before.get(k) for k in {*after, *before}) <= len(days)
        assert table(kept.read().drop(counters.DAY)) == table(ledger.daily_counters(now()))
    write(spark.createDataFrame(old + new, SCHEMA), 2)
    assert table(kept.read().drop(counters.DAY)) == table(ledger.daily_counters(now()))


@pytest.mark.parametrize("tenant", [0, 9])
def test_empty(spark, tenant):
    assert ledger.counters_of(ledger.daily_counters(spark.createDataFrame([], SCHEMA)), tenant).collect() == []
