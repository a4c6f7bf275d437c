"""Snapshot sets: which files of a listing belong to which generation, and which generation holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "(0|[1-9][0-9]{0,18})"


def manifest_name(prefix: str, generation: int) -> str:
    return f"{prefix}-{generation}.manifest.bj"


def data_name(prefix: str, generation: int, role: str) -> str:
    if not role or not all(c.isascii() and (c.isalnum() or c in "_-") for c in role):
        raise ValueError(f"not a role: {role!r}")
    return f"{prefix}-{generation}-{role}.bj"


def log_name(prefix: str, generation: int) -> str:
    return f"{prefix}-log-{generation}.bj"


def _quoted(prefix: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in prefix)


def classify(listing: DataFrame, prefix: str) -> DataFrame:
    """Adds kind ('manifest', 'log', 'data' or 'other'), generation and role; numbers have no leading zeros."""
    p = _quoted(prefix)
    manifest, log, data = f"^{p}-{_NUMBER}\\.manifest\\.bj$", f"^{p}-log-{_NUMBER}\\.bj$", f"^{p}-{_NUMBER}-([A-Za-z0-9_-]+)\\.bj$"
    name = F.col("name")
    kind = F.when(name.rlike(manifest), "manifest").when(name.rlike(log), "log").when(name.rlike(data), "data").otherwise("other")
    number = F.coalesce(*[F.when(name.rlike(r), F.regexp_extract(name, r, 1)) for r in (manifest, log, data)])
    return listing.withColumn("kind", kind).withColumn("generation", number.cast("long")).withColumn("role", F.when(F.col("kind") == "data", F.regexp_extract(name, data, 2)))


def candidates(listing: DataFrame, prefix: str) -> DataFrame:
    """generation of those with a manifest, newest first."""
    return classify(listing, prefix).where("kind = 'manifest'").select("generation").distinct().orderBy(F.desc("generation"))


def next_generation(listing: DataFrame, prefix: str) -> DataFrame:
    """One row: one above every generation in use, log files included."""
    return classify(listing, prefix).agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).cast("long").alias("next_generation"))


def valid_generations(listing: DataFrame, manifest: DataFrame, prefix: str) -> DataFrame:
    """generation: those whose manifest file is there and whose manifest's files (generation, role, size) all are, at the recorded size."""
    own = classify(listing, prefix)
    have = own.where("kind = 'data'").select("generation", "role", F.col("size").alias("actual"))
    checked = manifest.join(have, ["generation", "role"], "left").groupBy("generation").agg(F.bool_and(F.coalesce(F.col("size") == F.col("actual"), F.lit(False))).alias("ok"))
    return own.where("kind = 'manifest'").select("generation").distinct().join(checked.where("ok"), "generation", "left_semi")


def adopted(listing: DataFrame, manifest: DataFrame, prefix: str) -> DataFrame:
    """One row: the newest valid generation, or null."""
    return valid_generations(listing, manifest, prefix).agg(F.max("generation").alias("generation"))


def sweep(listing: DataFrame, keep: int | None, prefix: str) -> DataFrame:
    """name: data and manifest files of all generations but the one to keep; never logs or foreign files."""
    return classify(listing, prefix).where(F.col("kind").isin("data", "manifest") & ~F.col("generation").eqNullSafe(F.lit(keep).cast("long"))).select("name")


def log_candidates(listing: DataFrame, prefix: str) -> DataFrame:
    """name, generation of log files, newest first."""
    return classify(listing, prefix).where("kind = 'log'").select("name", "generation").orderBy(F.desc("generation"))


def prune_logs(listing: DataFrame, keep: int, prefix: str) -> DataFrame:
    """name: log files of all generations but one."""
    return classify(listing, prefix).where((F.col("kind") == "log") & (F.col("generation") != keep)).select("name")


def check_files(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """role, pos of each expected file (role, size, crc, pos) that is missing or differs in size or checksum, in order."""
    have = actual.select("role", F.col("size").alias("_size"), F.col("crc").alias("_crc"))
    same: Column = F.coalesce((F.col("size") == F.col("_size")) & (F.col("crc") == F.col("_crc")), F.lit(False))
    return expected.join(have, "role", "left").where(~same).select("role", "pos").orderBy("pos")


def first_mismatch(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: the role of the first offender, or null."""
    return check_files(actual, expected).agg(F.min_by("role", "pos").alias("bad_role"))
