"""Cutting lineage with tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset on one machine (tests), a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="evidara-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders of this session that may still hold tables.
_FOLDERS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of the session. Only once every result that reads them has been written: in a long session
    they would else pile up in the shared folder until its end."""
    jvm = spark._jvm.org.apache.hadoop.fs
    while _FOLDERS:
        path = jvm.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one operator call. Lost executors cost nothing: the files outlive them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._next = 0

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again, with a known size and no lineage."""
        path = f"{self.folder}/{self._next}"
        self._next += 1
        df.write.parquet(path)
        if path.endswith("/0"):  # the results may read any table as long as the session lives
            _FOLDERS.append(self.folder)
            self._file_system().deleteOnExit(self._path(self.folder))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        for table in tables:
            self._file_system().delete(self._path(table._scratch_path), True)

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _file_system(self):  # noqa: ANN202
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
