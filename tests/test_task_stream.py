"""Tasks kept up with changes equal a full run after each batch; deletions, moves and broken batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import renewal
from ledgerspark.sources.buckets import BucketTable
from ledgerspark.streaming import tasks as t

TODAY = "2024-06-01"
RECORD = "id long, enterprise_id long, status string, doc_category string, deleted int, plate_no string, vin string, insured string, company_short string, policy_no string, policy_type string, total_premium string, end_date date, sender string"
TASKS = "customer_key string, enterprise_id long, policy_type string, end_date date, priority int, primary_record_id long, assignee long, status string, active boolean"


def record(i, rng):
    end = dt.date(2024, 6, 1) + dt.timedelta(days=rng.choice([-400, -31, -30, -5, 0, 7, 20, 30, 31, 200]))
    return (i, rng.randrange(2), rng.choice(["done"] * 5 + ["failed"]), rng.choice(["保单"] * 5 + ["批单"]), 0, rng.choice(["京A1", "京A2", "京A3", "", "新车"]), rng.choice(["LSVA000001", "LSVA000002", ""]), "甲", "乙", f"P{i}", rng.choice(["交强险", "商业险"]), "1", end, "s")


def make(spark, tmp_path, start, existing=()):
    cars = BucketTable(spark, str(tmp_path / "records"), t.CAR, buckets=4)
    tasks = BucketTable(spark, str(tmp_path / "tasks"), t.CAR, buckets=4)
    rows = spark.createDataFrame(start, RECORD)
    cars.create(t.with_car(rows))
    first = renewal.rebuild(spark.createDataFrame(list(existing), TASKS).drop("active"), rows, TODAY).drop("outcome")
    tasks.create(first.withColumn(t.CAR, t.car(F.col("customer_key"), F.col("enterprise_id"))))
    return cars, tasks


def changes(spark, rows):
    kind = f"change_no long, before struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD.split(', '))}>, after struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD.split(', '))}>"
    return spark.createDataFrame(rows, kind)


COLUMNS = ["customer_key", "enterprise_id", "policy_type", "end_date", "priority", "primary_record_id", "assignee", "status", "active"]


def held(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_any_sequence_of_changes_equals_a_full_run(spark, tmp_path):
    rng = random.Random(8)
    state = {i: record(i, rng) for i in range(40)}
    existing = [("京A1", 0, "交强险", dt.date(2023, 1, 1), 0, 99, 5, "following", True), ("京A2", 1, "商业险", dt.date(2023, 1, 1), 0, 98, 6, "lost", True), ("京Z9", 1, "商业险", dt.date(2023, 1, 1), 0, 97, None, "pending", True)]
    cars, tasks = make(spark, tmp_path, list(state.values()), existing)
    write = t.task_sink(cars, tasks, TODAY)
    for number in range(4):
        before, rows = spark.createDataFrame(tasks.read().select(*COLUMNS).collect(), TASKS), []
        for n in range(rng.randrange(1, 9)):
            i = rng.choice([rng.randrange(40), rng.randrange(200)])
            old, new = state.pop(i, None), record(i, rng) if rng.random() < 0.75 else None
            if new:
                state[i] = new
            if old or new:
                rows.append((n, old, new))
        write(changes(spark, rows), number)
        now = spark.createDataFrame(list(state.values()), RECORD)
        want = renewal.rebuild(before.drop("active"), now, TODAY)
        assert held(tasks.read()) == held(want), number
        assert sorted(r["id"] for r in cars.read().collect()) == sorted(state)
    assert any(not r[-1] for r in held(tasks.read()))


def test_moves_deletions_and_dates_put_right(spark, tmp_path):
    rng = random.Random(1)
    base = list(record(1, rng))
    base[1:8] = [0, "done", "保单", 0, "京A1", "", "甲"]
    due = tuple([*base[:10], "交强险", "1", dt.date(2024, 6, 5), "s"])
    moved = tuple([*due[:5], "京A2", *due[6:]])
    later = tuple([*due[:12], dt.date(2025, 6, 5), "s"])
    cars, tasks = make(spark, tmp_path, [due])
    write = t.task_sink(cars, tasks, TODAY)
    state = lambda: [(r[0], r[3].isoformat(), r[-1]) for r in held(tasks.read())]
    write(changes(spark, [(0, due, later)]), 0)  # beyond the window, but the task is there
    assert state() == [("京A1", "2025-06-05", True)]
    write(changes(spark, [(0, later, due), (1, due, moved)]), 1)  # two changes of one record: the last one counts, both customers are made anew
    assert state() == [("京A1", "2025-06-05", False), ("京A2", "2024-06-05", True)]
    write(changes(spark, [(0, moved, None)]), 2)
    assert state() == [("京A1", "2025-06-05", False), ("京A2", "2024-06-05", False)] and cars.read().isEmpty()


@pytest.mark.parametrize("broken", ["tasks", "records"])
def test_a_batch_that_breaks_off_comes_again(spark, tmp_path, monkeypatch, broken):
    rng = random.Random(3)
    start = {i: record(i, rng) for i in range(20)}
    cars, tasks = make(spark, tmp_path, list(start.values()))
    rows = [(0, start[1], record(1, rng)), (1, start[2], None), (2, None, record(50, rng))]
    write = t.task_sink(cars, tasks, TODAY)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(tasks if broken == "tasks" else cars, "_commit", die)
        with pytest.raises(RuntimeError):
            write(changes(spark, rows), 0)
    for _ in range(2):
        write(changes(spark, rows), 0)
    after = [start[i] for i in start if i not in (1, 2)] + [rows[0][2], rows[2][2]]
    assert sorted(r["id"] for r in cars.read().collect()) == sorted(r[0] for r in after)
    first = renewal.rebuild(spark.createDataFrame([], TASKS).drop("active"), spark.createDataFrame(list(start.values()), RECORD), TODAY).drop("outcome")
    assert held(tasks.read()) == held(renewal.rebuild(first.drop("active"), spark.createDataFrame(after, RECORD), TODAY))
