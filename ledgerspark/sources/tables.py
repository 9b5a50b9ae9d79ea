"""Reading, incremental pulls, copies, upserts and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions.columns import blank_to_null, parse_date
from ledgerspark.operators import fill, ledger


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Files of a kind that Spark reads (parquet, orc, csv, json, text), or a database table (``jdbc``).

    A database is read in parallel where ``partitionColumn``, bounds and ``numPartitions`` are among the options.
    """
    reader = spark.read.format(kind).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.option("dbtable", path).load() if kind == "jdbc" else reader.load(path)


def pull(source: DataFrame, after: int, limit: int, key: str = "seq") -> tuple[DataFrame, Column]:
    """The next rows behind a cursor, at most ``limit`` in key order, and the aggregate that gives the new cursor."""
    return source.where(F.col(key) > after).orderBy(key).limit(limit), F.coalesce(F.max(key), F.lit(after))


def pull_all(source: DataFrame, after: int, key: str = "seq") -> DataFrame:
    """All rows behind a cursor; what a loop over short batches gathers."""
    return source.where(F.col(key) > after)


def copy_new(source: DataFrame, target: DataFrame, keys: list[str], order: str) -> DataFrame:
    """S3: the rows to insert: the first of each key that the target lacks."""
    first = source.groupBy(*keys).agg(F.min(order).alias(order))
    return source.join(first, [*keys, order], "left_semi").join(target.select(*keys), keys, "left_anti")


def copy_counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """S3: one row: rows in all, inserted and skipped."""
    per_key = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    old = target.select(*keys).distinct().withColumn("old", F.lit(1))
    j = per_key.join(old, keys, "left")
    inserted = F.coalesce(F.sum(F.when(F.col("old").isNull(), 1)), F.lit(0))
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), inserted.alias("inserted"), (F.coalesce(F.sum("n"), F.lit(0)) - inserted).alias("skipped"))


def replace_latest(source: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """S3: the cache's way: of all rows of a key, target before source, the last one stays."""
    both = target.select(*source.columns).withColumn("side", F.lit(0)).unionByName(source.withColumn("side", F.lit(1)))
    latest = both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("side"), F.desc(order))))
    return latest.where("place = 1").drop("place", "side")


def export_ledger(
    records: DataFrame, enterprise_id: int, first: str, end: str, merge: bool = False, complete: Callable[[DataFrame, DataFrame], DataFrame] | None = None, columns: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The ledger of a tenant and period: finished, normal, policies only, without repetition; on request by car.

    ``complete`` gets the ledger's rows and all records of the tenant and returns the rows with their blanks filled (F1 to F11);
    ``columns`` adds configured columns (C1 to C9); both come before rows are merged by car.
    """
    rows = ledger.deduplicate(ledger.search(records, enterprise_id=enterprise_id, status="done", abnormal=False, category="保单", created=(first, end)))
    rows = complete(rows, ledger.search(records, enterprise_id=enterprise_id)) if complete else rows
    rows = columns(rows) if columns else rows
    return ledger.merge_by_car(rows) if merge else ledger.plain_order(rows)


def completed(fields: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A completion for ``export_ledger``: blanks by file, plate, frame number and person, in this order, from all records."""

    def complete(rows: DataFrame, everything: DataFrame) -> DataFrame:
        filled = fill.fill_same_file(everything, [c for c in fields if c not in fill.PARTIES], [c for c in fields if c in fill.PARTIES])
        for step in (fill.fill_same_plate, fill.fill_same_vin, fill.fill_by_person):
            filled = step(filled, fields)
        return filled.join(rows.select("id"), "id", "left_semi")

    return complete


def write_ledger(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write by tenant."""
    rows.write.mode("overwrite").partitionBy("enterprise_id").format(kind).save(path)


def upsert(target: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The target after an upsert by a trimmed key: filled incoming values win, unknown keys are added.

    Of incoming rows with one key the filled value of the greatest ``order`` wins in each column (ties, and without an order: the greatest
    value); rows with a blank key are not taken.
    """
    last = lambda c: F.max(blank_to_null(F.col(c))) if order is None else F.max(F.when(blank_to_null(F.col(c)).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"]
    columns = [c for c in target.columns if c != key]
    fresh = incoming.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").groupBy(F.trim(key).alias("__k")).agg(*[last(c).alias(f"n_{c}") for c in columns if c in incoming.columns], F.lit(1).alias("is_new"))
    t = target.withColumn("is_old", F.lit(1))
    j = t.join(fresh, F.trim(t[key]) == F.col("__k"), "full")
    outcome = F.when(F.col("is_old").isNull(), "inserted").when(F.col("is_new").isNull(), "kept").otherwise("updated")
    return j.select(F.coalesce(t[key], F.col("__k")).alias(key), *[F.coalesce(f"n_{c}", c).alias(c) if c in incoming.columns else F.col(c) for c in columns], outcome.alias("outcome"))


def known_keys(incoming: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Incoming keys, trimmed, that the target has."""
    return incoming.select(F.trim(key).alias(key)).where(F.col(key) != "").distinct().join(target.select(F.trim(key).alias(key)).distinct(), key, "left_semi")


def restore_types(rows: DataFrame, amounts: list[str], dates: list[str], percents: list[str]) -> DataFrame:
    """Typed columns for an export: plain numbers, readable dates and percents become such, other texts null; identifiers stay texts."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"[,，¥￥元\s]", "")
    number = lambda c: F.when(F.rlike(bare(c), F.lit(r"^-?\d+(?:\.\d+)?$")), bare(c).try_cast("decimal(18,2)"))
    percent = lambda c: F.when(F.rlike(F.trim(c), F.lit(r"^-?\d+(?:\.\d+)?%$")), F.regexp_replace(F.trim(c), "%", "").try_cast("decimal(18,6)") / 100)
    return rows.withColumns({c: number(F.col(c)) for c in amounts} | {c: parse_date(F.col(c)) for c in dates} | {c: percent(F.col(c)) for c in percents})
