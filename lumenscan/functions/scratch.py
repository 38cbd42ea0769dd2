"""Tables that are written to the shared folder and read again, so that lineage and plans end there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). On one machine a local one will do
    where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _own[app]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def write(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class files_of:
    """A folder's own files, in whatever store it lies."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path))

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self._at(name)).getLen()

    def rename(self, name: str, to: str) -> None:
        if not self.fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{name} could not be renamed to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def move(self, folder: str) -> None:
        if not self.fs.rename(self.path, self.jvm.org.apache.hadoop.fs.Path(folder)):
            raise OSError(f"{self.path} could not be moved to {folder}")
