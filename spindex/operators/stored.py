"""Tables that are changed in place, each change one commit of a ``Store``.

Key/value operations and points only ever append, so that earlier states stay
readable; ``compact`` writes the live rows anew. Every change may carry the index of the
log entry it applies, which never falls.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spindex.functions.guards import SAFE_INT
from spindex.operators import entrylog, kv, spatial, versions
from spindex.sources.store import APPLIED, Store


def _values(applied: int | None, **more) -> dict:
    return {**more, **({} if applied is None else {APPLIED: applied})}


def checked_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; an integer beyond 2**53 - 1 or a number that is NaN in any of the columns is an error when they are read."""
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        bad = F.abs(F.col(c)) > SAFE_INT if kind == "long" else F.isnan(c) if kind in ("double", "float") else None
        if bad is not None:
            df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c}: value out of range")).cast(kind if kind != "long" else "bigint")).otherwise(F.col(c)))
    return df


class KVStore:
    """Keys and values as a log of operations (key, seq, op, value)."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, key_type: str = "bigint", value_type: str = "string", order: int = 16) -> KVStore:
        if order < 3:
            raise ValueError("an order is at least 3")
        made = cls(spark, path)
        if made.store.exists():
            raise ValueError(f"{path} is there already")
        made.store.commit(replace={"log": spark.createDataFrame([], f"key {key_type}, seq bigint, op string, value {value_type}")}, values={"order": order, "seq": 0})
        return made

    def log(self) -> DataFrame:
        return self.store.read("log")

    def table(self, at: int | None = None) -> kv.KVTable:
        """The live rows, now or right after an operation."""
        return kv.KVTable(kv.fold(self.log(), at), order=self.store.value("order"))

    def _add(self, rows: DataFrame, op: str, applied: int | None) -> None:
        base = self.store.state()
        log = self.store.read("log")
        # keys of one change are distinct, so they may share a place in the order
        new = rows.select("key", F.lit(base["values"]["seq"] + 1).cast("long").alias("seq"), F.lit(op).alias("op"), ("value" if "value" in rows.columns else F.lit(None).cast(log.schema["value"].dataType).alias("value")))
        self.store.commit(append={"log": new}, values=_values(applied, seq=base["values"]["seq"] + 1), base=base)

    def put(self, rows: DataFrame, applied: int | None = None) -> None:
        """Inserts or replaces keys (key, value); null keys, and a key twice, are refused."""
        if not rows.groupBy("key").count().where("key is null or count > 1").isEmpty():
            raise ValueError("a key can't be null, nor given twice")
        self._add(checked_values(rows, ["key", "value"]), "put", applied)

    def delete(self, keys: DataFrame, applied: int | None = None) -> None:
        """Removes keys; absent ones change nothing."""
        here = self.table().rows.select("key")
        self._add(keys.select("key").distinct().join(here, "key", "left_semi"), "delete", applied)

    def rewind(self, seq: int) -> None:
        """Forgets all operations after one."""
        base = self.store.state()
        self.store.commit(replace={"log": kv.rewind(self.log(), seq)}, values={"seq": min(seq, base["values"]["seq"])}, base=base)

    def compact(self) -> dict[str, int]:
        """Writes the live rows alone, sorted by key; returns sizes in bytes before and after."""
        base, old = self.store.state(), self.store.size_in_bytes()
        live = kv.fold(self.log()).select("key", F.lit(base["values"]["seq"]).cast("long").alias("seq"), F.lit("put").alias("op"), "value")
        self.store.commit(replace={"log": live.repartitionByRange("key").sortWithinPartitions("key")}, base=base)
        self.store.vacuum()
        new = self.store.size_in_bytes()
        return {"oldSize": old, "newSize": new, "bytesSaved": max(0, old - new)}


class PointStore:
    """Points (object_id, lat, lng) in order of insertion."""

    SCHEMA = "object_id string, lat double, lng double, seq bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)
        if not self.store.exists():
            self.store.commit(replace={"rows": spark.createDataFrame([], self.SCHEMA)}, values={"seq": 0})

    def points(self, version: int | None = None) -> DataFrame:
        return self.store.read("rows", version)

    def insert(self, points: DataFrame, applied: int | None = None) -> None:
        base = self.store.state()
        at = base["values"]["seq"]
        # the partition's number above the row's: order within a change, below all later ones for 2**13 partitions
        order = F.shiftleft(F.spark_partition_id().cast("long"), 31) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 31) - 1))
        new = points.select("object_id", "lat", "lng", (order + F.lit(at)).alias("seq"))
        self.store.commit(append={"rows": new}, values=_values(applied, seq=at + (1 << 44)), base=base)

    def _without(self, left: DataFrame, base: dict, applied: int | None) -> None:
        self.store.commit(replace={"rows": left}, values=_values(applied), base=base)

    def remove(self, ids: DataFrame, applied: int | None = None) -> None:
        """Without the first point of each listed id."""
        base = self.store.state()
        self._without(spatial.remove_first(self.points(), ids, "seq"), base, applied)

    def remove_located(self, object_id: str, lat: float, lng: float, applied: int | None = None) -> None:
        base = self.store.state()
        self._without(spatial.remove_located(self.points(), object_id, lat, lng, "seq"), base, applied)

    def clear(self, applied: int | None = None) -> None:
        base = self.store.state()
        self._without(self.points().limit(0), base, applied)

    def iterate_box(self, *box: float) -> Iterator[Row]:
        """The points of a box, one partition in memory at a time."""
        return spatial.search_box(self.points(), *box).toLocalIterator(prefetchPartitions=True)

    def rewind(self, version: int) -> None:
        """Back to the points of an earlier commit."""
        self.store.rewind(version)

    def compact(self) -> dict[str, int]:
        base, old = self.store.state(), self.store.size_in_bytes()
        self._without(spatial.clustered(self.points()), base, None)
        self.store.vacuum()
        new = self.store.size_in_bytes()
        return {"oldSize": old, "newSize": new, "bytesSaved": max(0, old - new)}


class VersionStore:
    """Versioned texts (log_id, version, text); a log's versions count from 1, or on from where it was begun."""

    def __init__(self, spark: SparkSession, path: str, diffs_per_snapshot: int = 10):
        versions.kind(F.lit(1), diffs_per_snapshot)
        self.store = Store(spark, path)
        if not self.store.exists():
            self.store.commit(replace={"rows": spark.createDataFrame([], "log_id bigint, version bigint, text string")}, values={"diffs_per_snapshot": diffs_per_snapshot})

    def rows(self) -> DataFrame:
        return self.store.read()

    def add(self, texts: DataFrame, seq_col: str = "seq", applied: int | None = None) -> None:
        """Each row (log_id, text, and an order) a new version of its log, equal texts included."""
        base = self.store.state()
        last = self.rows().groupBy("log_id").agg(F.max("version").alias("_last"))
        new = versions.number_versions(texts, "log_id", seq_col).join(last, "log_id", "left")
        new = new.select("log_id", (F.col("version") + F.coalesce("_last", F.lit(0))).alias("version"), "text")
        self.store.commit(append={"rows": new}, values=_values(applied), base=base)


class EntryLog:
    """A replicated log: raw records (pos, index, term, type, payload) and the voter's state, committed together."""

    SCHEMA = "pos bigint, index bigint, term bigint, type int, payload string"

    def __init__(self, spark: SparkSession, path: str, base_index: int = 0, base_term: int = 0):
        self.spark, self.store = spark, Store(spark, path)
        if not self.store.exists():
            first = entrylog.HardState(base_index=base_index, base_term=base_term, last_index=base_index, last_term=base_term, current_term=base_term, commit_index=base_index)
            self.store.commit(replace={"raw": spark.createDataFrame([], self.SCHEMA)}, values={"pos": 0, **vars(first)})

    def _hard(self, values: dict) -> entrylog.HardState:
        return entrylog.HardState(**{k: values[k] for k in entrylog.HardState.__dataclass_fields__})

    @property
    def state(self) -> entrylog.HardState:
        return self._hard(self.store.state()["values"])

    def live(self) -> DataFrame:
        return entrylog.fold(self.store.read("raw"), base_index=self.state.base_index)

    def append(self, entries: list[tuple[int, str]], kind: int = entrylog.NORMAL) -> int:
        """Adds entries (term, payload) at the end; returns the last index. Terms lie between the last entry's and the current one."""
        base = self.store.state()
        hard, pos, rows = self._hard(base["values"]), base["values"]["pos"], []
        for term, payload in entries:
            hard = hard.append(term)
            pos += 1
            rows.append((pos, hard.last_index, term, kind, payload))
        self.store.commit(append={"raw": self.spark.createDataFrame(rows, self.SCHEMA)}, values={**vars(hard), "pos": pos}, base=base)
        return hard.last_index

    def truncate_from(self, index: int) -> None:
        """Cuts the log at an index; committed entries can't be cut, and a cut just past the end changes nothing."""
        base = self.store.state()
        old = self._hard(base["values"])
        before = entrylog.term_at(self.live(), index - 1, old.base_index, old.base_term) if old.base_index < index <= old.last_index else 0
        hard = old.truncate_from(index, before or 0)
        if hard != old:
            pos = base["values"]["pos"] + 1
            cut = self.spark.createDataFrame([(pos, index, old.current_term, entrylog.TRUNCATE, None)], self.SCHEMA)
            self.store.commit(append={"raw": cut}, values={**vars(hard), "pos": pos}, base=base)

    def set_hard_state(self, term: int, candidate: int = 0) -> None:
        base = self.store.state()
        self.store.commit(values=vars(self._hard(base["values"]).vote(term, candidate)), base=base)

    def set_commit_index(self, index: int) -> None:
        base = self.store.state()
        self.store.commit(values=vars(self._hard(base["values"]).commit(index)), base=base)

    def compact(self, base_index: int, base_term: int) -> None:
        """Drops the entries up to a new base, whose term must be the log's own; the commit index is at least the base."""
        base = self.store.state()
        old = self._hard(base["values"])
        if base_index < old.base_index or entrylog.term_at(self.live(), base_index, old.base_index, old.base_term) != base_term:
            raise ValueError(f"entry {base_index} isn't in the log with term {base_term}")
        hard = entrylog.replace(old, base_index=base_index, base_term=base_term, commit_index=max(old.commit_index, base_index))
        self.store.commit(replace={"raw": self.live().where(F.col("index") > base_index)}, values=vars(hard), base=base)
