"""The folder that driver and executors share, and files in it through Hadoop's file systems, so that any store Spark can open will do."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); only a master of one local process may leave it unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or tempfile.mkdtemp(prefix="ledgerspark-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that lost executors do not lose it and plans stay short."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Files:
    """Listing, reading, moving and removing small files and folders of a store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(str(f.getPath().getName()) for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return str(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write a new file as a whole: under another name first, then moved."""
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(part, self._path(path)):
            self._fs.delete(part, False)
            raise FileExistsError(path)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
