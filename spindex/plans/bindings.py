"""How the engine's relations are read from the test tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS, POINTS, PREFIX = "events", "customer", "state"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; in a temporary one where it is unset, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{root or tempfile.mkdtemp(prefix='spindex-')}/stored-{uuid.uuid4().hex}"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, op, value: an error event deletes its user's value, any other sets it."""
    return read(spark, sf_dir, EVENTS).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")


def spread(number: Column) -> tuple[Column, Column]:
    """A latitude and a longitude for a number."""
    return (number * 37) % 170 - 85 + number * F.lit(1e-5), (number * 73) % 350 - 175 + number * F.lit(1e-5)


def points(spark: SparkSession, sf_dir: str, table: str = POINTS, key: str = "c_custkey") -> DataFrame:
    """object_id, lat, lng for each row of a table."""
    lat, lng = spread(F.col(key))
    return read(spark, sf_dir, table).select(F.lpad(F.col(key).cast("string"), 24, "0").alias("object_id"), lat.cast("double").alias("lat"), lng.cast("double").alias("lng"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, version, text: a conversation is a log, a turn a version."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("log_id"), (F.col("turn") + 1).alias("version"), "text")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, term, type, payload: one live entry an event."""
    return read(spark, sf_dir, EVENTS).select((F.col("event_id") + 1).alias("index"), (F.floor(F.col("event_id") / 100) + 1).alias("term"), F.lit(1).alias("type"), F.col("props").alias("payload"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, index, term, type, payload: every tenth record goes back three entries, and some records cut the log."""
    p = F.col("event_id")
    return read(spark, sf_dir, EVENTS).select(p.alias("pos"), (p + 1 - F.floor(p / 10) * 3).alias("index"), (F.floor(p / 100) + 1).alias("term"), F.when(p % 50 == 49, -1).otherwise(1).alias("type"), F.col("props").alias("payload"))


LISTING = [
    ("state-1.manifest.bj", 120), ("state-1-index.bj", 4000), ("state-1-terms.bj", 900),
    ("state-2.manifest.bj", 120), ("state-2-index.bj", 4100), ("state-2-terms.bj", 950),
    ("state-3.manifest.bj", 120), ("state-3-index.bj", 4200),
    ("state-4-index.bj", 10), ("state-04-index.bj", 10), ("state-5.manifest.bj.tmp", 1),
    ("state-log-2.bj", 700), ("state-log-7.bj", 70), ("other-9.manifest.bj", 5), ("readme", 3), ("state-2-bad role.bj", 4),
]
MANIFEST = [(1, "index", 4000), (1, "terms", 900), (2, "index", 4100), (2, "terms", 950), (3, "index", 4200), (3, "terms", 990)]
EXPECTED = [("index", 4100, 17, 0), ("terms", 950, 18, 1), ("lengths", 70, 19, 2), ("log", 5, 20, 3)]
ACTUAL = [("index", 4100, 17), ("terms", 951, 18), ("log", 5, 21), ("extra", 1, 1)]


def listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTING, "name string, size long")


def manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFEST, "generation long, role string, size long")


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPECTED, "role string, size long, crc long, pos int")


def actual(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTUAL, "role string, size long, crc long")
