import random

import pytest

from spindex.operators import entrylog, snapshots
from spindex.operators import versions as ver
from spindex.operators.entrylog import HardState
from spindex.plans import bindings as b
from spindex.sources.tables import Namespace
from spindex.streaming.apply import Applier, run_once, tail


def test_fold_against_replay(spark):
    rng = random.Random(4)
    raw, live = [], []
    for pos in range(400):
        kind = -1 if live and rng.random() < 0.1 else 1
        index = rng.randrange(max(1, len(live) - 5), len(live) + (1 if kind == -1 else 2))
        live = live[: index - 1]
        if kind == 1:
            live.append((index, pos))
        raw.append((pos, index, 1, kind, f"p{pos}"))
    df = spark.createDataFrame(raw, "pos long, index long, term long, type int, payload string")
    got = sorted((r["index"], r.pos) for r in entrylog.fold(df).collect())
    assert got == live and entrylog.gaps(df).isEmpty()
    assert entrylog.verify(entrylog.fold(df)).first().contiguous
    assert not entrylog.gaps(df.selectExpr("pos", "index + 1 as index", "term", "type", "payload")).isEmpty()


def entries(spark, sizes):
    return spark.createDataFrame([(i + 1, i // 2 + 1, 1, "x" * n) for i, n in enumerate(sizes)], "index long, term long, type int, payload string")


def test_batches(spark):
    e = entries(spark, [5, 5, 5, 100, 1])
    assert [r["index"] for r in entrylog.get_batch(e, 1, 10).collect()] == [1, 2]
    assert [r["index"] for r in entrylog.get_batch(e, 1, 11).collect()] == [1, 2, 3]
    assert [r["index"] for r in entrylog.get_batch(e, 4, 0).collect()] == [4]
    assert entrylog.get_batch(e, 9).isEmpty()
    with pytest.raises(ValueError):
        entrylog.get_batch(e, 3, base_index=3)


def test_compact_and_terms(spark):
    e = entries(spark, [1] * 6)
    assert entrylog.term_at(e, 3) == 2 and entrylog.term_at(e, 0) == 0 and entrylog.term_at(e, 99) is None
    assert entrylog.compact(e, 4, 2).count() == 2
    with pytest.raises(ValueError):
        entrylog.compact(e, 4, 7)
    assert not entrylog.verify(e.where("index <> 3")).first().contiguous
    assert not entrylog.verify(e.selectExpr("index", "10 - term as term", "type", "payload")).first().terms_ok
    assert entrylog.verify(e.limit(0)).first().n_entries == 0


def test_hard_state():
    s = HardState().vote(2, 5)
    assert s.vote(2).voted_for == 5 and s.vote(2, 5) == s and s.vote(3).voted_for == 0
    for bad in (lambda: s.vote(1), lambda: s.vote(2, 6), lambda: s.append(3), lambda: s.commit(1)):
        with pytest.raises(ValueError):
            bad()
    t = s.append(1, 4).commit(2)
    assert t.truncate_from(3, 1).last_index == 2 and t.truncate_from(5, 1) == t
    for bad in (lambda: t.truncate_from(2, 1), lambda: t.commit(1), lambda: t.truncate_from(9, 1)):
        with pytest.raises(ValueError):
            bad()


def test_snapshot_sets(spark):
    assert [r.generation for r in snapshots.candidates(b.listing(spark), "state").collect()] == [3, 2, 1]
    assert snapshots.adopted(b.listing(spark), b.manifest(spark), "state").first()[0] == 2
    assert snapshots.adopted(b.listing(spark).limit(0), b.manifest(spark), "state").first()[0] is None
    assert snapshots.next_generation(b.listing(spark), "state").first()[0] == 8
    assert snapshots.next_generation(b.listing(spark).limit(0), "state").first()[0] == 1
    assert snapshots.first_mismatch(b.actual(spark), b.expected(spark)).first()[0] == "terms"
    assert snapshots.data_name("p", 3, "a_b-1") == "p-3-a_b-1.bj" and snapshots.manifest_name("p", 3) == "p-3.manifest.bj" and snapshots.log_name("p", 2) == "p-log-2.bj"
    with pytest.raises(ValueError):
        snapshots.data_name("p", 1, "a/b")


def test_version_chains(spark):
    rng = random.Random(8)
    rows, text = [], ""
    for v in range(1, 14):
        text = text[: rng.randrange(len(text) + 1)] + f"line {v} of it\n" * rng.randrange(4) + text[rng.randrange(len(text) + 1) :]
        rows += [(1, v, text), (2, v, None if v == 3 else "same")]
    df = spark.createDataFrame(rows, "log_id long, version long, text string")
    chain = ver.encode_chain(df, 3)
    assert [r.version for r in chain.where("type = 1 and log_id = 1").orderBy("version").collect()] == [1, 5, 9, 13]
    back = {(r.log_id, r.version): (r.text, r.ok) for r in ver.decode_chain(chain).collect()}
    assert back == {(i, v): (t or "", True) for i, v, t in rows}
    broken = chain.withColumn("data", __import__("pyspark.sql.functions", fromlist=["F"]).expr("CASE WHEN log_id = 1 AND version = 6 THEN X'80' ELSE data END"))
    bad = sorted(r.version for r in ver.decode_chain(broken).where("not ok").collect())
    assert bad == [6, 7, 8]
    assert {r.version for r in ver.current(df).collect()} == {13}
    with pytest.raises(ValueError):
        ver.kind(df.version, 0)
    with pytest.raises(ValueError):
        ver.get_version(df, 0)


def test_apply_is_idempotent(spark, tmp_path):
    space = Namespace(spark, str(tmp_path / "space"))
    rows = spark.createDataFrame([(1, 10, "put", "a"), (2, 10, "delete", None), (3, 11, "put", "b")], "index long, key long, op string, value string")
    sink = Applier(space, "t")
    assert sink.applied_index() == 0 and sink.log() is None
    sink(rows.where("index <= 2"), 0)
    sink(rows, 1)
    sink(rows, 1)
    assert sink.applied_index() == 3
    assert sorted(r.seq for r in sink.log().collect()) == [1, 2, 3]


def test_apply_from_a_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "index long, key long, op string, value string"
    sink = Applier(Namespace(spark, str(tmp_path / "space")), "t")
    for batch in ([(1, 1, "put", "a")], [(2, 2, "put", "b"), (1, 1, "put", "again")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        run_once(tail(spark, src, schema), sink, str(tmp_path / "checkpoint"))
    assert sorted((r.seq, r.value) for r in sink.log().collect()) == [(1, "a"), (2, "b")]
