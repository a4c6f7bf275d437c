import random

import pytest

from spindex.cli import main
from spindex.operators import kv
from spindex.operators.kv import KVTable, fold
from spindex.operators.scans import running_min_after, running_sum
from spindex.sources.tables import Namespace, file_checksums


def log(spark, ops):
    return spark.createDataFrame([(k, i, op, v) for i, (k, op, v) in enumerate(ops)], "key long, seq long, op string, value string")


def test_random_churn_against_a_dictionary(spark):
    rng = random.Random(5)
    ops = [(rng.randrange(12), rng.choice(["put", "put", "delete"]), f"v{i}") for i in range(300)]
    now, sizes, states = {}, [], {}
    for i, (k, op, v) in enumerate(ops):
        if op == "put":
            now[k] = v
            sizes.append((i, len(now)))
        elif k in now:
            del now[k]
            sizes.append((i, len(now)))
        states[i] = dict(now)
    df = log(spark, ops)
    assert {r.key: r.value for r in fold(df).collect()} == now
    assert {r.key: r.value for r in kv.snapshot_at(df, 150).collect()} == states[150]
    assert sorted((r.seq, r.size) for r in kv.boundaries(df).collect()) == sizes
    with pytest.raises(ValueError):
        kv.snapshot_at(df, 1000)


def test_hollow_and_ranges(spark):
    df = log(spark, [(i, "put", f"v{i}") for i in range(120)] + [(i, "delete", None) for i in range(20, 100)] + [(7, "delete", None), (7, "delete", None)])
    t = KVTable.from_log(df)
    assert t.size() == 39 and t.verify().first().ok
    assert [r.key for r in t.range(15, 102).collect()] == [15, 16, 17, 18, 19, 100, 101, 102]
    assert t.range(9, 3).isEmpty() and [r.key for r in t.range(high=2).collect()] == [0, 1, 2]
    assert [r.key for r in t.iterate(117)] == [117, 118, 119]
    assert [len(b) for b in t.batches(20)] == [20, 19] and list(t.batches(0)) == []
    assert t.get(7).isEmpty() and t.clear().is_empty()


@pytest.mark.parametrize("key", [float("nan"), float("inf"), None, True, 2**60, [1]])
def test_refused_keys(spark, key):
    t = KVTable(spark.range(3).withColumnRenamed("id", "key"))
    with pytest.raises(ValueError):
        t.get(key)


def test_bounds(spark):
    t = KVTable(spark.range(3).selectExpr("cast(id as double) as key"))
    assert t.range(float("-inf"), float("inf")).count() == 3
    with pytest.raises(ValueError):
        t.range(float("nan"))
    with pytest.raises(ValueError):
        KVTable(t.rows, order=2)


def test_string_order_is_by_bytes(spark):
    t = KVTable(spark.createDataFrame([("\U0001f600",), ("～",), ("a",), ("B",)], "key string"))
    assert [r.key for r in t.scan().collect()] == ["B", "a", "～", "\U0001f600"]


def test_verify_finds_repeats(spark):
    assert not KVTable(spark.createDataFrame([(1,), (1,), (None,)], "key int")).verify().first().ok


def test_compact_and_namespace(spark, tmp_path):
    space = Namespace(spark, str(tmp_path))
    space.write("t", spark.range(1000).selectExpr("id as key", "repeat('x', 50) as value"))
    got = KVTable(space.read("t").where("key < 10")).compact(space.path("small"), 2)
    assert got["newSize"] < got["oldSize"] and got["bytesSaved"] == got["oldSize"] - got["newSize"]
    space.write("t", spark.range(5).selectExpr("id as key"))
    assert space.read("t", "key long").count() == 5 and space.names() == ["small", "t"]
    with pytest.raises(ValueError):
        space.read("t", "key string")
    with pytest.raises(ValueError):
        space.path("../x")
    assert space.remove("t") and not space.exists("t")


def test_checksums(spark, tmp_path):
    import zlib

    (tmp_path / "a.bin").write_bytes(b"hello")
    assert [tuple(r) for r in file_checksums(spark, str(tmp_path)).collect()] == [("a.bin", 5, zlib.crc32(b"hello"))]


def test_scans_span_by_span(spark):
    rng = random.Random(1)
    v = [rng.randrange(-5, 6) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(v)), "i long, v long")
    assert [r.s for r in running_sum(df, df.v, "i", "s", 7).orderBy("i").collect()] == [sum(v[: i + 1]) for i in range(100)]
    assert [r.s for r in running_min_after(df, "v", "i", "s", 7).orderBy("i").collect()] == [min(v[i + 1 :], default=None) for i in range(100)]


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "kv")
    spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string").write.parquet(path)
    assert main(["kv", path, "get", "2"], spark) == 0 and '"b"' in capsys.readouterr().out
    assert main(["kv", path, "get", "9"], spark) == 1
    assert main(["kv", path, "range", "1", "5"], spark) == 0
    points = str(tmp_path / "points")
    spark.createDataFrame([("p", 1.0, 2.0)], "object_id string, lat double, lng double").write.parquet(points)
    assert main(["points", points, "radius", "1", "2", "5"], spark) == 0
    assert main(["points", points, "radius", "1", "2", "-5"], spark) == 2
    assert main(["points", points, "box", "0", "95", "0", "5"], spark) == 2
