"""Versioned texts: rows (log_id, version, text), versions of a log counted from 1.

Texts may be kept whole, or as a chain in which every (n + 1)-th version is a snapshot
and those between are binary deltas against their predecessor.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindex.functions import diffing

SNAPSHOT, PATCH, DELTA = 1, 2, 3


def number_versions(rows: DataFrame, log_col: str, seq_col: str, text_col: str = "text") -> DataFrame:
    """log_id, version, text: each row a new version of its log, equal texts included."""
    place = F.row_number().over(Window.partitionBy(log_col).orderBy(seq_col))
    return rows.select(F.col(log_col).alias("log_id"), place.cast("long").alias("version"), F.col(text_col).alias("text"))


def text_hash(text: Column) -> Column:
    """SHA-256 of the text's UTF-8, in lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def kind(version: Column, diffs_per_snapshot: int = 10, base: int = 0) -> Column:
    """'snapshot' for the first version and each (n + 1)-th after it, else 'diff'."""
    if diffs_per_snapshot < 1:
        raise ValueError("there must be at least one diff to a snapshot")
    return F.when((version - base - 1) % (diffs_per_snapshot + 1) == 0, "snapshot").otherwise("diff")


def get_version(rows: DataFrame, version: int, strict: bool = False) -> DataFrame:
    """That version of every log that has it; if ``strict``, a log without it is an error."""
    if version < 1:
        raise ValueError("versions count from 1")
    if strict and not rows.groupBy("log_id").agg(F.max("version").alias("top")).where(F.col("top") < version).isEmpty():
        raise ValueError(f"a log has no version {version}")
    return rows.where(F.col("version") == version)


def current(rows: DataFrame) -> DataFrame:
    """log_id, version, text: the last version of each log."""
    return rows.groupBy("log_id").agg(F.max("version").alias("version"), F.max_by("text", "version").alias("text"))


def diff(rows: DataFrame, from_version: int, to_version: int) -> DataFrame:
    """log_id, diff: a unified diff for each log that has both versions; the two are brought together by one shuffle."""
    pair = rows.where(F.col("version").isin(from_version, to_version)).groupBy("log_id").agg(*[F.max(F.when(F.col("version") == v, F.coalesce("text", F.lit("")))).alias(n) for v, n in ((from_version, "a"), (to_version, "b"))])
    pair = pair.where("a is not null and b is not null")
    return pair.select("log_id", diffing.unified_diff_udf("a", "b", F.lit(from_version), F.lit(to_version)).alias("diff"))


def with_previous(rows: DataFrame) -> DataFrame:
    """Adds ``previous``, the text of the version before (null for the first)."""
    return rows.withColumn("previous", F.lag("text").over(Window.partitionBy("log_id").orderBy("version")))


def encode_chain(rows: DataFrame, diffs_per_snapshot: int = 10) -> DataFrame:
    """log_id, version, type, hash, data: snapshots as UTF-8, other versions as deltas against the version before."""
    step = with_previous(rows)
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    snap = kind(F.col("version"), diffs_per_snapshot) == "snapshot"
    # a snapshot needs no delta: both sides are empty for it, as a condition doesn't spare a Python function
    before = F.when(snap, F.lit("")).otherwise(F.coalesce("previous", F.lit("")))
    delta = diffing.create_delta_udf(F.encode(before, "UTF-8"), F.when(snap, F.lit(b"")).otherwise(whole))
    return step.select("log_id", "version", F.when(snap, SNAPSHOT).otherwise(DELTA).alias("type"), text_hash(F.col("text")).alias("hash"), F.when(snap, whole).otherwise(delta).alias("data"))


_DECODED = "log_id long, version long, text string, ok boolean"


def decode_chain(chain: DataFrame) -> DataFrame:
    """log_id, version, text, ok (its hash is the recorded one).

    Rows are grouped by snapshot, so a task holds one snapshot and its deltas, never a
    whole log. Rows of type ``PATCH`` (unified patches, UTF-8) are read as well. After
    a version that can't be rebuilt the rest of its group isn't ok either.
    """
    base = F.max(F.when(F.col("type") == SNAPSHOT, F.col("version"))).over(Window.partitionBy("log_id").orderBy("version").rowsBetween(Window.unboundedPreceding, 0))

    def rebuild(part: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for r in part.sort_values("version").itertuples():
            if r.type == SNAPSHOT:
                now = bytes(r.data)
            elif now is not None and r.type == DELTA:
                now = diffing.apply_delta(now, bytes(r.data))
            elif now is not None:
                try:
                    text = diffing.apply_patch(now.decode(), bytes(r.data).decode())
                except diffing.PatchError:
                    text = None
                now = None if text is None else text.encode()
            out.append((r.log_id, r.version, None if now is None else now.decode(errors="replace"), now is not None and hashlib.sha256(now).hexdigest() == r.hash))
        return pd.DataFrame(out, columns=["log_id", "version", "text", "ok"])

    return chain.withColumn("_base", base).groupBy("log_id", "_base").applyInPandas(rebuild, _DECODED)


def tiles(rows: DataFrame, max_bytes: int) -> DataFrame:
    """log_id, tile, base: tiles of at least ``max_bytes`` bytes but for the last; a tile owns the versions above its base up to the next one's.

    A version begins a tile if the one before it, from its own first version on, has
    reached the size; so the rule is a fold over each log in order. Only versions and
    sizes are gathered for it, sixteen bytes each, a log's in one row.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    sizes = rows.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct(F.col("version").cast("long").alias("version"), size.alias("size")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("bases"))

    def step(now, x):
        rolls = (F.size(now["bases"]) == 0) | (now["held"] >= max_bytes)
        return F.struct((F.when(rolls, 0).otherwise(now["held"]) + x["size"]).alias("held"), F.when(rolls, F.concat(now["bases"], F.array(x["version"] - 1))).otherwise(now["bases"]).alias("bases"))

    folded = sizes.select("log_id", F.aggregate("all", start, step)["bases"].alias("bases"))
    return folded.select("log_id", F.posexplode("bases").alias("tile", "base")).select("log_id", F.col("tile").cast("long").alias("tile"), "base")


def route(rows: DataFrame, tile_rows: DataFrame) -> DataFrame:
    """log_id, version, tile: the tile with the largest base below the version, as an as-of join by one sort per log."""
    events = rows.select("log_id", F.col("version").alias("at"), F.lit(0).alias("is_row"), F.lit(None).cast("long").alias("tile")).unionByName(tile_rows.select("log_id", (F.col("base") + 1).alias("at"), F.lit(-1).alias("is_row"), F.col("tile").cast("long").alias("tile")))
    last = F.last("tile", ignorenulls=True).over(Window.partitionBy("log_id").orderBy("at", "is_row").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("tile", last).where("is_row = 0").select("log_id", F.col("at").alias("version"), "tile")
