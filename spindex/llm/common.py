"""What the operators of this subpackage share: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spindex-")
        sc.setCheckpointDir(found)
    return found


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that ``saved`` writes inside it when it ends; what is still to be read must be saved outside."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            _delete(spark, folder)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, keep: bool = False, clear: bool = False) -> DataFrame:
    """The rows written once as a Parquet table in the shared folder and read from there.

    Cuts the lineage without tying any block to an executor; later reads prune columns.
    Within ``scratch`` the table goes with it, unless it is to be kept. With ``clear`` the
    files this query shuffled go when it ends; else they stay until the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/spindex-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    if _OPEN and not keep:
        _OPEN[-1].append(folder)
    before = spark.conf.get(_CLEANUP)
    try:
        if clear:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if clear:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = folder
    return out


class Buckets:
    """A table in the shared folder to which rows are added, in buckets by a key, so that what joins it by that key shuffles its own side alone.

    It has an entry in the session's catalog, under a name of its own, until it is discarded.
    """

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.key, self.number = spark, key, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"spindex_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/{self.table}"
        self.path = f"{self.folder}/{name}"
        if _OPEN:
            _OPEN[-1].append(self.folder)

    def add(self, df: DataFrame) -> None:
        """Adds rows; the files shuffled for it go when it ends."""
        before = self.spark.conf.get(_CLEANUP)
        try:
            self.spark.conf.set(_CLEANUP, "true")
            df.write.format("parquet").mode("append").bucketBy(self.number, self.key).option("path", self.path).saveAsTable(self.table)
        finally:
            self.spark.conf.set(_CLEANUP, before)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def discard(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        _delete(self.spark, self.folder)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``saved`` wrote, once all that reads it is written itself."""
    _delete(table.sparkSession, table._folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Arrow batches hold fewer rows than Spark's default, which suits numbers, not long texts; a session's own choice stays."""
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(rows))


def text_bytes(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id, the UTF-8 bytes of the text (null: empty) and further columns."""
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text, *[F.col(f"`{c}`") for c in more])


def give_back() -> None:
    """Returns freed memory to the system, so that a worker kept for the next job doesn't hold what this one needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema) -> DataFrame:
    """Maps each Arrow batch by ``fn``; batches are independent, so a lost task is simply run again."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        give_back()

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small(df: DataFrame, most: int) -> bool:
    """Whether the rows number ``most`` at most; reads no more than needed to tell."""
    return len(df.select(F.lit(1)).limit(most + 1).take(most + 1)) <= most if most < 10_000 else df.limit(most + 1).count() <= most


def least_hashes(df: DataFrame, key: str, n: int, group: str | None = None) -> DataFrame:
    """The ``n`` rows, of each group, with the smallest hashes of a key; ties by the key.

    Counts come first, so that only rows below a hash that leaves about 1.5 n of a group
    are ever ranked, however many partitions there are.
    """
    used = set(df.columns)
    name, at, limit, place = (fresh(c, used) for c in ("group", "unit", "bound", "place"))
    unit = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    rows = df.withColumn(at, unit)
    if group is None:
        share = min(1.0, (1.5 * n + 50) / max(1, df.count()))
        near = rows.where(F.col(at) < F.lit(share * (1 << 40)))
        return near.orderBy(at, key).limit(n).select(df.columns)
    bound = df.groupBy(F.col(group).alias(name)).agg((F.least(F.lit(1.0), F.lit(1.5 * n + 50) / F.count(F.lit(1))) * F.lit(float(1 << 40))).alias(limit))
    near = rows.join(F.broadcast(bound), F.col(group).eqNullSafe(F.col(name))).where(F.col(at) < F.col(limit))
    order = F.row_number().over(Window.partitionBy(name).orderBy(at, key))
    return near.withColumn(place, order).where(F.col(place) <= n).select(df.columns)


def fresh(name: str, used: set[str]) -> str:
    """A column name like ``name`` that isn't in use, in any letter case; it is in use from now on."""
    while name.lower() in {u.lower() for u in used}:
        name = f"_{name}"
    used.add(name)
    return name


#: Ids that may be broadcast to drop rows; beyond that rows are dropped by a shuffle join.
MOST_DROPPED = 500_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows, all columns, whose id isn't among ``ids`` (one column of that name); rows of null id stay."""
    ids = ids.where(F.col(id_col).isNotNull()).distinct()
    few = ids.limit(MOST_DROPPED + 1).count() <= MOST_DROPPED
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_anti").select(docs.columns)
