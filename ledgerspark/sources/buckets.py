"""A table kept by upserts, in buckets by key, of which a batch rewrites only those it touches.

``data/v<n>/key_bucket=<k>`` holds bucket k as version n wrote it; ``manifest/<n>.json`` says for each bucket which version's files are
its own, and which batch came last.  A version counts once its manifest is there, which is written last and as a whole: a crash before
leaves the table as it was, and the same batch writes its files anew; a batch that comes again after it changes nothing.
Files that none of the last ``keep`` manifests names are removed, so readers of these manifests are never disturbed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerspark.sources.shared import Files

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Manifest:
    """A version: its number, the last batch in it, the schema, and by bucket the folder of its files."""

    number: int
    batch: int
    schema: str
    folders: dict[str, str]


class BucketTable:
    """The table at ``path``, by ``key`` (trimmed) in ``buckets`` parts; their number holds for the table's life.

    A bucket is read and written by few tasks, so choose as many as make a bucket some hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path, key, buckets, keep
        self.files = Files(spark, path)

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(F.trim(F.col(self.key).cast("string"))), F.lit(self.buckets)).cast("int")

    def manifest(self) -> Manifest | None:
        """The newest version; null before the first one."""
        numbers = [int(n[:-5]) for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        return Manifest(**json.loads(self.files.text(f"{self.path}/manifest/{max(numbers):020d}.json"))) if numbers else None

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, of the newest version."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(self.path)
        return self._rows(m, only)

    def _rows(self, m: Manifest, only: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        paths = [f"{self.path}/data/{folder}/key_bucket={k}" for k, folder in sorted(m.folders.items()) if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, merge: Merge, number: int) -> list[int]:
        """Merge a batch into the buckets of its keys; the buckets that were rewritten, none if the batch had come before.

        ``merge`` gets the rows of these buckets and the batch, and returns all rows that the buckets hold from now on.
        """
        m = self.manifest()
        if m is not None and number <= m.batch:
            self._clean()
            return []
        touched = sorted(r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect())
        if m is not None and not touched:
            return []
        rows = merge(self._rows(m, touched) if m else batch.limit(0), batch)
        folder = f"v{(m.number + 1 if m else 0):020d}"
        rows.withColumn("key_bucket", self.bucket()).repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(f"{self.path}/data/{folder}")
        written = {n.partition("=")[2] for n in self.files.names(f"{self.path}/data/{folder}") if n.startswith("key_bucket=")}
        kept = {k: v for k, v in (m.folders if m else {}).items() if int(k) not in touched}
        self._commit(Manifest(m.number + 1 if m else 0, number, rows.schema.json(), kept | {k: folder for k in written}))
        self._clean()
        return touched

    def create(self, rows: DataFrame) -> None:
        """The first version, before any batch."""
        self.upsert(rows, lambda _, batch: batch, -1)

    def _commit(self, m: Manifest) -> None:
        path = f"{self.path}/manifest/{m.number:020d}.json"
        if self.files.exists(path):
            raise FileExistsError(path)
        self.files.put(path, json.dumps(m.__dict__))

    def _clean(self) -> None:
        """Remove manifests but the last ``keep`` ones, then files that no manifest names; unfinished versions among them."""
        names = [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        for n in names[: -self.keep]:
            self.files.remove(f"{self.path}/manifest/{n}")
        held = [Manifest(**json.loads(self.files.text(f"{self.path}/manifest/{n}"))) for n in names[-self.keep :]]
        used = {(folder, k) for m in held for k, folder in m.folders.items()}
        for folder in self.files.names(f"{self.path}/data"):
            own = [n for n in self.files.names(f"{self.path}/data/{folder}") if n.startswith("key_bucket=")]
            gone = [n for n in own if (folder, n.partition("=")[2]) not in used]
            if len(gone) == len(own):
                self.files.remove(f"{self.path}/data/{folder}")
            else:
                for n in gone:
                    self.files.remove(f"{self.path}/data/{folder}/{n}")


def upsert_sink(table: BucketTable, merge: Merge) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into a table in buckets."""

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, merge, number)

    return write
