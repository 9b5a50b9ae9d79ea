"""Targets of any periods by running totals: against sums of days, and linear in targets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerspark.operators.analytics import attainment, running_totals

DAY = dt.date(2024, 1, 1)


def make(spark, n):
    rng = random.Random(5)
    records = [(rng.randrange(3), DAY + dt.timedelta(days=rng.randrange(200)), f"{rng.randrange(1000)}.25元") for _ in range(600)] + [(0, None, "1"), (1, DAY, "无"), (None, DAY, "5")]
    targets = []
    for i in range(n):
        a, b = rng.randrange(-30, 240), rng.randrange(-30, 240)
        targets.append((i, rng.choice([0, 1, 2, 9]), "custom", DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=b), rng.choice([0, 1000])))
    return records, targets


RECORD = "enterprise_id long, created_day date, total_premium string"
TARGET = "target_id long, enterprise_id long, period_type string, period_start date, period_end date, target_cents long"


def test_any_periods(spark):
    records, targets = make(spark, 400)
    got = {r["target_id"]: r["actual_cents"] for r in attainment(spark.createDataFrame(records, RECORD), spark.createDataFrame(targets, TARGET), "2024-06-01").collect()}
    value = lambda t: 0 if t == "无" else round(float(t.rstrip("元")) * 100)
    assert got == {i: sum(value(v) for e, d, v in records if e == tenant and d and a <= d <= b) for i, tenant, _, a, b, _ in targets}


def test_rows_are_linear_in_targets(spark):
    """A hundred thousand targets of one tenant: two look-ups each, and no join of targets with days."""
    records, _ = make(spark, 0)
    targets = spark.range(100_000).select(F.col("id").alias("target_id"), F.when(F.col("id") < 0, 1).otherwise(0).cast("long").alias("enterprise_id"), F.lit("custom").alias("period_type"), F.date_add(F.lit(DAY), (F.col("id") % 100).cast("int")).alias("period_start"), F.date_add(F.lit(DAY), (100 + F.col("id") % 90).cast("int")).alias("period_end"), F.lit(1).cast("long").alias("target_cents"))
    found = attainment(spark.createDataFrame(records, RECORD), targets, "2024-06-01")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 100_000 and found.where("actual_cents <= 0").isEmpty()
    assert running_totals(spark.createDataFrame(records, RECORD)).count() <= 4 * 200
