"""Where tables live: named versioned tables, and plain Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.sources.store import Store


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def dir_size(df: DataFrame) -> int:
    """Bytes of the files a DataFrame reads; 0 for one that reads none."""
    total = 0
    for name in df.inputFiles():
        fs, p, _ = _path(df.sparkSession, name)
        total += fs.getFileStatus(p).getLen()
    return total


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a plain Parquet folder beside the old one and puts it in its place.

    Between the two renames there is neither; tables that are read meanwhile belong in a
    ``Store`` (see ``Namespace``), whose commits leave no such gap.
    """
    spark = df.sparkSession
    fs, target, make = _path(spark, path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    old = make(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't move the table at {path}")
    if not fs.rename(make(staging), target):
        fs.rename(old, target)
        raise OSError(f"can't put the new table at {path}")
    fs.delete(old, True)


class Namespace:
    """Versioned tables by name under a root; names are single path parts. A plain Parquet folder is read as well."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if not name or "/" in name or name in (".", ".."):
            raise ValueError(f"not a table name: {name!r}")
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, p, _ = _path(self.spark, self.path(name))
        return fs.exists(p)

    def store(self, name: str) -> Store:
        return Store(self.spark, self.path(name))

    def read(self, name: str, expected: str | None = None) -> DataFrame:
        """The table; with ``expected`` (column names and types in DDL) another schema is refused."""
        store = self.store(name)
        df = store.read() if store.exists() else self.spark.read.parquet(store.path)
        if expected is not None:
            want = {f.name: f.dataType for f in self.spark.createDataFrame([], expected).schema.fields}
            if want != {f.name: f.dataType for f in df.schema.fields}:
                raise ValueError(f"table {name} has another schema: {df.schema.simpleString()}")
        return df

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces the table; earlier states stay for readers that began with them, until ``vacuum``."""
        self.store(name).commit(replace={"rows": df})

    def remove(self, name: str) -> bool:
        fs, p, _ = _path(self.spark, self.path(name))
        return fs.delete(p, True)

    def names(self) -> list[str]:
        fs, p, _ = _path(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, size, crc of the files of a folder, read as binary."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.crc32("content").alias("crc"))
