"""Deep pages against sorting, with ties and nulls; few rows are sorted."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators.paging import deep_page, narrowed


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(2)
    data = [(i, None if i % 17 == 0 else random.randrange(12), random.choice(["a", "b", "é", ""])) for i in range(4000)] + [(9999, 3, "same")] * 50
    return data, spark.createDataFrame(data, "id long, day int, name string").repartition(5).cache()


def ordered(data, descending):
    return sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]), reverse=descending)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("number, size", [(1, 10), (7, 100), (40, 100), (41, 100), (400, 10), (500, 100), (1, 5000)])
def test_pages(rows, number, size, descending):
    data, df = rows
    got = [tuple(r) for r in deep_page(df, ["day", "name", "id"], number, size, descending, few=200).collect()]
    assert got == ordered(data, descending)[(number - 1) * size : number * size]


def test_few_rows_are_sorted(spark):
    df = spark.range(300_000).select((F.col("id") % 50).alias("day"), "id")
    scope, rest = narrowed(df, ["day", "id"], 200_000, 100, few=2000)
    assert scope.count() <= 2000 and rest < 2000
    assert [tuple(r) for r in deep_page(df, ["day", "id"], 2001, 100, descending=False, few=2000).collect()] == [(200_000 // 6000, 50 * k + 200_000 // 6000) for k in range(200_000 % 6000, 200_000 % 6000 + 100)]


def test_the_range_reaches_the_scan(spark, tmp_path):
    spark.range(50_000).select("id", F.lit("x").alias("v")).write.parquet(str(tmp_path / "t"))
    page = deep_page(spark.read.parquet(str(tmp_path / "t")), ["id"], 400, 100, few=500)
    assert "GreaterThanOrEqual(id," in page._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in page.collect()] == list(range(10_099, 9_999, -1))


def test_empty(spark):
    df = spark.createDataFrame([], "id long")
    assert deep_page(df, ["id"], 1, 10).collect() == [] and deep_page(df, ["id"], 3, 10, descending=False).collect() == []
