"""Ordered key/value tables over an operation log.

A log row is (key, seq, op, value); op is 'put' or 'delete', seq is a unique integer.
The state at any version is the newest operation of each key up to it, which is one
partially aggregated shuffle on the key; earlier states stay readable.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from spindex.functions.guards import bound_key, stored_key
from spindex.operators.scans import running_sum
from spindex.sources.tables import dir_size, replace_table


def fold(log: DataFrame, at: int | None = None) -> DataFrame:
    """key, value of the live keys, at a version or now."""
    rows = log if at is None else log.where(F.col("seq") <= at)
    newest = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return newest.where("last.op = 'put'").select("key", "last.value")


def snapshot_at(log: DataFrame, version: int) -> DataFrame:
    """The state right after the commit of a version; a version that never was is an error."""
    if log.where(F.col("seq") == version).isEmpty():
        raise ValueError(f"there is no commit {version}")
    return fold(log, version)


def rewind(log: DataFrame, version: int) -> DataFrame:
    """The log without what came after a version."""
    return log.where(F.col("seq") <= version)


def boundaries(log: DataFrame) -> DataFrame:
    """seq, size: each commit in order and the number of live keys after it; deletes of absent keys commit nothing."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("seq"))
    was = F.coalesce(before == "put", F.lit(False))
    rows = log.select("key", "seq", "op", was.alias("was")).where("op = 'put' or was")
    change = F.when(F.col("op") == "put", F.when(F.col("was"), 0).otherwise(1)).otherwise(-1)
    return running_sum(rows, change, "seq", "size").select("seq", "size")


class KVTable:
    """Lookups and scans over (key, value) rows of unique keys.

    Ranges and lookups are plain predicates on ``key``, so over a compacted table they
    prune files and row groups; numbers are ordered as numbers, strings by UTF-8 bytes.
    """

    def __init__(self, rows: DataFrame, key_col: str = "key", order: int = 16):
        if order < 3:
            raise ValueError("an order is at least 3")
        self.rows, self.key, self.order = rows, key_col, order

    @classmethod
    def from_log(cls, log: DataFrame, at: int | None = None) -> KVTable:
        return cls(fold(log, at))

    def get(self, key: object) -> DataFrame:
        """The row of a key, or none."""
        return self.rows.where(F.col(self.key) == F.lit(stored_key(key)))

    def range(self, low: object = None, high: object = None) -> DataFrame:
        """Rows from low to high, both included, in order; either end may be open, and low above high gives none."""
        df = self.rows
        if low is not None:
            df = df.where(F.col(self.key) >= F.lit(bound_key(low)))
        if high is not None:
            df = df.where(F.col(self.key) <= F.lit(bound_key(high)))
        return df.orderBy(self.key)

    def scan(self) -> DataFrame:
        return self.range()

    def iterate(self, low: object = None, high: object = None) -> Iterator[Row]:
        """Rows in order, one partition in memory at a time."""
        return self.range(low, high).toLocalIterator(prefetchPartitions=True)

    def batches(self, rows: int, low: object = None, high: object = None) -> Iterator[list[Row]]:
        held: list[Row] = []
        for row in self.iterate(low, high) if rows > 0 else ():
            held.append(row)
            if len(held) == rows:
                yield held
                held = []
        if held:
            yield held

    def size(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def put(self, rows: DataFrame) -> KVTable:
        """Inserts or replaces; of the given rows keys must be unique."""
        return KVTable(self.rows.join(rows.select(self.key), self.key, "left_anti").select(self.rows.columns).unionByName(rows.select(self.rows.columns)), self.key, self.order)

    def delete(self, keys: DataFrame) -> KVTable:
        """Without the listed keys; absent ones change nothing."""
        return KVTable(self.rows.join(keys.select(self.key).distinct(), self.key, "left_anti").select(self.rows.columns), self.key, self.order)

    def clear(self) -> KVTable:
        return KVTable(self.rows.limit(0), self.key, self.order)

    def verify(self) -> DataFrame:
        """One row: the number of rows, of distinct keys, of null keys, and whether all is well."""
        per_key = self.rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"))
        nulls = F.coalesce(F.sum(F.when(F.col(self.key).isNull(), F.col("n"))), F.lit(0))
        rows = F.coalesce(F.sum("n"), F.lit(0))
        return per_key.agg(rows.alias("n_rows"), F.count(self.key).alias("n_keys"), nulls.alias("n_null"), ((rows == F.count(self.key)) & (nulls == 0)).alias("ok"))

    def compact(self, path: str, partitions: int | None = None) -> dict[str, int]:
        """Writes the live rows range-partitioned and sorted by key; returns sizes in bytes before and after."""
        old = dir_size(self.rows)
        split = self.rows.repartitionByRange(partitions, self.key) if partitions else self.rows.repartitionByRange(self.key)
        replace_table(split.sortWithinPartitions(self.key), path)
        new = dir_size(self.rows.sparkSession.read.parquet(path))
        return {"oldSize": old, "newSize": new, "bytesSaved": max(0, old - new)}


def mixed_order(df: DataFrame, number_col: str, string_col: str) -> DataFrame:
    """Orders keys of either kind: numbers first, then strings by their bytes; a row has one of both columns."""
    return df.orderBy(F.col(string_col).isNotNull(), number_col, string_col)


def composite_range(df: DataFrame, prefix: dict[str, object], rest: list[str]) -> DataFrame:
    """Rows whose leading key columns equal the prefix, in the order of the remaining ones."""
    for name, value in prefix.items():
        df = df.where(F.col(name) == F.lit(stored_key(value)))
    return df.orderBy(*prefix, *rest)
