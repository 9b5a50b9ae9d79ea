"""Counters by day and tenant, kept up with changes of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators import ledger
from ledgerspark.sources.buckets import BucketTable

#: Key of the table: the day as a text.
DAY = "day_key"


def daily_table(records: DataFrame) -> DataFrame:
    """``daily_counters`` with the key of the table."""
    return ledger.daily_counters(records).withColumn(DAY, F.coalesce(F.col("created_day").cast("string"), F.lit("")))


def counter_sink(table: BucketTable, records: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for changed records (``created_day`` of each, before and after): their days are counted anew.

    ``records`` gives the records as they are after the batch; only those of its days are counted, and only their days' buckets written.
    """

    def write(changed: DataFrame, number: int) -> None:
        days = changed.select("created_day").distinct()
        keyed = days.select(F.coalesce(F.col("created_day").cast("string"), F.lit("")).alias(DAY))

        def merge(target: DataFrame, batch: DataFrame) -> DataFrame:
            now = records()
            mine = now.join(days.select(F.col("created_day").alias("__day")), now["created_day"].eqNullSafe(F.col("__day")), "left_semi")
            return target.join(batch, DAY, "left_anti").select(*target.columns).unionByName(daily_table(mine).select(*target.columns))

        table.upsert(keyed, merge, number)

    return write
