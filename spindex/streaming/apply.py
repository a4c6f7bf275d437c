"""Applying a stream of log entries to a table exactly once.

Each batch is one commit that adds its operations and records the last index applied
and the batch's own number, so a batch that comes again after a crash is known and
changes nothing, and what a batch has to look up doesn't grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.sources.store import APPLIED
from spindex.sources.tables import Namespace


class Applier:
    """A ``foreachBatch`` sink that adds (index, key, op, value) entries to an operation log.

    Entries at or below the index applied are skipped; of several of one index the one
    of the smallest hash is taken.
    """

    def __init__(self, space: Namespace, name: str):
        self.store = space.store(name)

    def applied_index(self) -> int:
        """The last index applied, 0 for none."""
        return self.store.applied_index

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        base = self.store.state()
        if batch_id <= base["values"].get("batch", -1):
            return
        applied = base["values"].get(APPLIED, 0)
        rest = [c for c in batch.columns if c != "index"]
        fresh = batch.where(F.col("index") > applied).groupBy("index").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("x")).select("index", "x.*")
        top = fresh.agg(F.max("index")).first()[0]
        self.store.commit(append={"log": fresh}, values={APPLIED: top or applied, "batch": batch_id}, base=base)

    def log(self) -> DataFrame | None:
        """All applied operations as a log (key, seq, op, value)."""
        if not self.store.exists():
            return None
        return self.store.read("log").select("key", F.col("index").alias("seq"), "op", "value")

    def compact(self) -> None:
        """Writes the batches as one folder."""
        base = self.store.state()
        self.store.commit(replace={"log": self.store.read("log").repartitionByRange("index")}, base=base)
        self.store.vacuum()


def tail(spark: SparkSession, path: str, schema: str, max_bytes: int = 65536) -> DataFrame:
    """A stream of the entries in a folder of Parquet files, in steps of about so many bytes."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(path)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Applies all that is there and stops."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
