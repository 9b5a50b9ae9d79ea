"""Renewal tasks kept up with a stream of changes, by what changed and nothing else.

Records and tasks are tables in buckets by customer (tenant and car).  A change has both images of a record, so the old and the new
customer are known; a batch reads and writes the buckets of its customers only.  Tasks are written before records and both know their
last batch, so a batch that was broken off anywhere comes again without harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators import renewal
from ledgerspark.sources.buckets import BucketTable

#: Key of both tables.
CAR = "car"


def car(customer: Column, tenant: Column) -> Column:
    """A tenant's customer as one text; records without a plate or frame number have one key in common and no tasks."""
    return F.concat_ws("|", tenant.cast("string"), F.coalesce(customer, F.lit("")))


def with_car(records: DataFrame) -> DataFrame:
    return records.withColumn(CAR, car(renewal.customer_key(), F.col("enterprise_id")))


def images(changes: DataFrame) -> DataFrame:
    """What changes do to records: for each record and each customer that it had or has, ``car``, ``id``, and ``rec``, the record that stays there.

    ``changes`` has ``change_no``, ``before`` and ``after``; of a record's changes the greatest number counts, and one without ``after`` deletes it.
    """
    keyed = changes.withColumn("id", F.coalesce("after.id", "before.id"))
    last = keyed.groupBy("id").agg(F.max(F.struct("change_no", "after"))["after"].alias("rec")).where("rec is not null").select("id", "rec", "rec.plate_no", "rec.vin", "rec.enterprise_id")
    stays = with_car(last).select(CAR, "id", "rec")
    had = with_car(keyed.select("id", F.explode(F.array("before", "after")).alias("r")).where("r is not null").select("id", "r.plate_no", "r.vin", "r.enterprise_id")).select(CAR, "id").distinct()
    return had.join(stays, [CAR, "id"], "left")


def changed_records(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The records of some buckets after a batch of :func:`images`."""
    kept = target.join(batch.select("id").distinct(), "id", "left_anti")
    return kept.select(*target.columns).unionByName(batch.where("rec is not null").select(CAR, "rec.*").select(*target.columns))


def task_sink(records: BucketTable, tasks: BucketTable, today: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for changes.  Both tables are made before: records with ``car``, tasks as ``rebuild`` gives them, with ``car``."""

    def write(changes: DataFrame, number: int) -> None:
        batch = images(changes).persist()
        touched = [r["b"] for r in batch.select(records.bucket().alias("b")).distinct().collect()]
        customers = renewal.changed_customers(changes)

        def merge(target: DataFrame, _: DataFrame) -> DataFrame:
            after = changed_records(records.read(touched), batch)
            fresh = renewal.rebuild(target, after, today, customers).drop("outcome")
            rest = target.join(customers, renewal.CUSTOMER, "left_anti")
            return rest.select(*target.columns).unionByName(fresh.withColumn(CAR, car(F.col("customer_key"), F.col("enterprise_id"))).select(*target.columns))

        tasks.upsert(batch, merge, number)
        records.upsert(batch, changed_records, number)
        batch.unpersist()

    return write
