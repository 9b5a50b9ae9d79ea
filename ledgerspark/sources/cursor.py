"""S2, ST1: pulls by sequence number as a streaming source, ``spark.readStream.format("message_log")``.

A message log is a folder of Parquet files by tenant (``corpid=...``) to which files are only added.  Offsets are the highest sequence
number taken of each tenant; a batch is all between two offsets, dealt to tasks as ranges of row groups of about ``limit`` rows.  New
offsets come from the footers of new files alone; a task reads only row groups whose statistics meet its range, and only the columns asked for.
Spark's checkpoint makes each message count once; ``commit`` also stores the cursor, from which a query without a checkpoint can go on.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TENANT, SEQ = "corpid", "seq"


@dataclass
class Rows(InputPartition):
    """Row groups of a file, and the sequence numbers wanted of them: above ``after``, up to ``upto``."""

    file: str
    tenant: str
    groups: list[int]
    after: int
    upto: int


@dataclass
class Group:
    """A row group by its footer: number of rows, least and greatest sequence number."""

    rows: int
    low: int
    high: int


class Log:
    """The files of a message log and what their footers say; files are looked at once, as they never change."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        self.seen: dict[str, tuple[str, list[Group]]] = {}

    def refresh(self) -> None:
        for info in self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            folder, name = posixpath.split(info.path)
            tenant = posixpath.basename(folder)
            hidden = name.startswith(("_", ".")) or "/_temporary/" in info.path
            if info.path not in self.seen and info.is_file and name.endswith(".parquet") and tenant.startswith(f"{TENANT}=") and not hidden:
                with self.fs.open_input_file(info.path) as f:
                    self.seen[info.path] = (unquote(tenant.partition("=")[2]), groups_of(pq.ParquetFile(f)))

    def newest(self) -> dict[str, int]:
        self.refresh()
        out: dict[str, int] = {}
        for tenant, groups in self.seen.values():
            out[tenant] = max([out.get(tenant, 0), *[g.high for g in groups]])
        return out

    def between(self, start: dict[str, int], end: dict[str, int], limit: int) -> list[Rows]:
        """Ranges of row groups, of about ``limit`` rows each, that hold what lies between two offsets."""
        self.refresh()
        out = []
        for file, (tenant, groups) in sorted(self.seen.items()):
            after, upto = start.get(tenant, 0), end.get(tenant, 0)
            held, rows = [], 0
            for i, g in enumerate(groups):
                if g.high > after and g.low <= upto:
                    held, rows = [*held, i], rows + g.rows
                if held and (rows >= limit or i == len(groups) - 1):
                    out.append(Rows(file, tenant, held, after, upto))
                    held, rows = [], 0
        return out


def groups_of(file: pq.ParquetFile) -> list[Group]:
    meta, column = file.metadata, file.schema_arrow.names.index(SEQ)
    out = []
    for i in range(meta.num_row_groups):
        group = meta.row_group(i)
        stats = group.column(column).statistics
        if stats is not None and stats.has_min_max:
            out.append(Group(group.num_rows, stats.min, stats.max))
        else:
            values = pc.min_max(file.read_row_group(i, [SEQ], use_threads=False).column(0)).as_py()
            out.append(Group(group.num_rows, values["min"] or 0, values["max"] or 0))
    return out


def read_rows(path: str, part: Rows, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The wanted rows of some row groups, with the columns of ``schema`` in its order; the tenant comes from the folder."""
    want = to_arrow_schema(schema)
    names = [n for n in want.names if n != TENANT]
    with Log(path).fs.open_input_file(part.file) as f:
        for batch in pq.ParquetFile(f).iter_batches(row_groups=part.groups, columns=list({*names, SEQ}), use_threads=False):
            seq = batch.column(batch.schema.names.index(SEQ))
            batch = batch.filter(pc.and_(pc.greater(seq, part.after), pc.less_equal(seq, part.upto)))
            if batch.num_rows:
                columns = [pa.array([part.tenant] * batch.num_rows, pa.string()) if n == TENANT else batch.column(batch.schema.names.index(n)).cast(want.field(n).type) for n in want.names]
                yield pa.RecordBatch.from_arrays(columns, schema=want)


class MessageLog(DataSource):
    """Options: ``path`` of the log, ``limit`` of rows a task (10,000), ``cursor`` (a file), ``after`` (JSON of tenants and numbers to begin behind)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return f"{TENANT} string, {SEQ} long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStream(self.options, schema)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema, self.limit = options["path"], schema, int(options.get("limit", 10_000))
        self.cursor, self.after = options.get("cursor"), json.loads(options.get("after", "{}"))
        self.log = Log(self.path)

    def initialOffset(self) -> dict:
        return (load_cursor(self.cursor) if self.cursor else None) or self.after

    def latestOffset(self) -> dict:
        newest = self.log.newest()
        return {t: max(newest.get(t, 0), self.after.get(t, 0)) for t in sorted({*newest, *self.after})}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.log.between(start, end, self.limit)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Rows)
        return read_rows(self.path, partition, self.schema)

    def commit(self, end: dict) -> None:
        if self.cursor:
            store_cursor(self.cursor, end)


class LogReader(DataSourceReader):
    """The same rows in batch: all behind ``after``."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.stream, self.path, self.schema = LogStream(options, schema), options["path"], schema

    def partitions(self) -> Sequence[InputPartition]:
        return self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Rows)
        return read_rows(self.path, partition, self.schema)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def load_cursor(path: str) -> dict[str, int] | None:
    """The stored cursor, a number for each tenant; null if there is none yet."""
    fs, name = _store(path)
    if not fs.get_file_info(name).is_file:
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


def store_cursor(path: str, cursor: dict[str, int]) -> None:
    """Store the cursor as a whole; no tenant goes back."""
    fs, name = _store(path)
    old = load_cursor(path) or {}
    with fs.open_output_stream(f"{name}.part") as f:
        f.write(json.dumps({t: max(old.get(t, 0), cursor.get(t, 0)) for t in sorted({*old, *cursor})}).encode())
    fs.move(f"{name}.part", name)


def append_messages(messages: DataFrame, path: str) -> None:
    """Add messages to a log, by tenant and in order of sequence number, so that row groups hold ranges of it."""
    messages.repartitionByRange(TENANT, SEQ).sortWithinPartitions(TENANT, SEQ).write.mode("append").partitionBy(TENANT).parquet(path)


def message_stream(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """The log at ``path`` as a stream with the columns of ``schema``."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").schema(schema).options(path=path, **options).load()
