import random
import time

from pyspark.sql import functions as F

from spindex.operators import entrylog
from spindex.operators.scans import running_min_after


def test_least_of_what_follows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(50)) for i in range(400) if rng.random() < 0.8]
    got = {r.pos: r.low for r in running_min_after(spark.createDataFrame(rows, "pos long, v long"), "v", "pos", "low", span=37).collect()}
    for k, (i, _) in enumerate(rows):
        assert got[i] == min((v for _, v in rows[k + 1 :]), default=None)


def test_a_whole_span_folds_in_seconds(spark):
    raw = spark.range(100_000).select(F.col("id").alias("pos"), (F.col("id") + 1 - F.floor(F.col("id") / 10) * 3).alias("index"), F.lit(1).alias("term"), F.lit(1).alias("type"))
    began = time.monotonic()
    assert entrylog.fold(raw).count() == 100_000 - 29_997
    assert time.monotonic() - began < 30
