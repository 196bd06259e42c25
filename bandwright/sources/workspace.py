"""Tables that several steps read, written once to shared storage.

A written table cuts the lineage, so a lost executor costs a re-read and not a
rebuild. It is columnar, so later steps read only the columns they use, and its
file sizes are known to the optimizer, which decides from them whether a join
side may be broadcast.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"


class Workspace:
    """A fresh folder of Parquet tables below the shared checkpoint folder.

    Results that read its tables are lazy, so it stays as long as the application
    unless it is removed; it goes when the application ends.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = posixpath.join(root or shared_folder(spark), f"bandwright-{uuid.uuid4().hex}")
        self.leaves_at_exit = False

    def path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write ``df`` and return it as read back, with the same columns."""
        df.write.partitionBy(*partition_by).parquet(self.path(name))
        if not self.leaves_at_exit:
            location, system = located(self.spark, self.root)
            self.leaves_at_exit = system.deleteOnExit(location)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name)).select(*like.columns)

    def parts(
        self, name: str, like: DataFrame, column: str, values: Iterable[int]
    ) -> dict[int, DataFrame]:
        """A table saved by ``column`` as one frame per value.

        Each frame lists its own directory only. A filter on the whole table
        reads the same files, but counts as large as the table when the
        optimizer looks for sides to broadcast.
        """
        found = {}
        for value in values:
            folder = self.path(f"{name}/{column}={value}")
            if self.exists(folder):
                reader = self.spark.read.schema(like.schema).option("basePath", self.path(name))
                found[value] = reader.parquet(folder)
            else:
                found[value] = like.limit(0)
        return found

    def exists(self, path: str) -> bool:
        location, system = located(self.spark, path)
        return system.exists(location)

    def remove(self) -> None:
        """Delete the folder once nothing reads its tables any more."""
        location, system = located(self.spark, self.root)
        system.delete(location, True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or else its warehouse, which is shared as well.

    The default warehouse is a folder of the driver's machine, which executors on other
    machines don't see; it will do in local mode only.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    warehouse = spark.conf.get(WAREHOUSE_DIR)
    unset = warehouse.removeprefix("file:").rstrip("/") == os.path.abspath("spark-warehouse")
    if unset and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"no shared folder: set {CHECKPOINT_DIR} to one that all executors see")
    return warehouse


def located(spark: SparkSession, path: str):
    """A path and the file system that holds it, as the cluster knows them."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def files_below(spark: SparkSession, path: str, deep: bool = True) -> list[str]:
    """``path``, size and time, tab-separated, of every file below a path; none if it is missing."""
    location, system = located(spark, path)
    found = []
    if system.exists(location):
        left = system.listFiles(location, deep)
        while left.hasNext():
            file = left.next()
            found.append(f"{file.getPath().toString()}\t{file.getLen()}\t{file.getModificationTime()}")
    return found


def read_text(spark: SparkSession, path: str) -> str:
    [row] = spark.read.text(path, wholetext=True).collect()
    return row["value"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it gets its name when it is written."""
    location, system = located(spark, path)
    made, _ = located(spark, posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}"))
    out = system.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(made, location):
        raise OSError(f"not written: {path}")


def delete(spark: SparkSession, path: str) -> None:
    location, system = located(spark, path)
    system.delete(location, True)


def kept_while_running(spark: SparkSession, name: str) -> str:
    """A shared folder of the application, by name, that goes when the application ends."""
    path = posixpath.join(shared_folder(spark), f"{name}-{spark.sparkContext.applicationId}")
    location, system = located(spark, path)
    system.mkdirs(location)
    system.deleteOnExit(location)
    return path
