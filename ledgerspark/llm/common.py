"""What the training-data operators share: reading tables, cutting lineage, samples, the word pattern, parts of batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Code points of texts that a Python worker handles at once.
PART = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so that any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that is unset and the master is one local
    process, as in tests, a temporary folder is taken; elsewhere this is an error.  Lost executors do not lose the rows.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def hash_sample(df: DataFrame, limit: int, *by: str) -> DataFrame:
    """At most ``limit`` rows, the first in hash order of the columns ``by``; the same rows give the same sample.

    Rows behind about twice the share that is wanted are left out before any are sorted, so what the last task of the
    sort gets does not grow with the number of partitions.
    """
    n = df.count()
    place = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    bound = (1 << 30) if n <= 2 * limit else int((1 << 30) * 2 * limit / n) + 1
    return df.withColumn("__place", place).where(F.col("__place") < bound).orderBy("__place", *by).limit(limit).drop("__place")


def parts(texts: list[str], size: int = PART) -> Iterator[slice]:
    """Slices of texts of about ``size`` code points, one text at least.

    Spark bounds what a Python worker gets at once (``spark.sql.execution.arrow.maxBytesPerBatch``); these slices bound
    what the worker makes of it.
    """
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > size:
            yield slice(at, i)
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def row_hashes(docs: DataFrame, names: tuple[str, str] = ("r1", "r2")) -> DataFrame:
    """Add two 64-bit hashes of all columns: rows that agree in both are the same row, repeated."""
    columns = [F.col(c) for c in docs.columns]
    return docs.withColumns({names[0]: F.xxhash64(*columns), names[1]: F.xxhash64(F.lit("again"), *columns)})


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Add ``number``, from 0 on, to rows of a written table (``cut``) that are equal in the columns ``by``, which hold no null.

    Rows are numbered within each of the table's partitions, behind the numbers of the partitions before, so that no task gets more
    of a group than one partition holds.  Which of equal rows gets which number is open; the numbers of a group are always the same.
    """
    placed = rows.withColumn("__part", F.spark_partition_id())
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n")).select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = placed.withColumn("__in", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(F.lit(1))) - 1)
    return inside.join(first.hint("merge"), [*by, "__part"]).withColumn("number", F.col("__first") + F.col("__in")).drop("__part", "__first", "__in")


def word_count(text: Column) -> Column:
    """Number of words of a text column; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
