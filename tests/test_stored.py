import pytest

from spindex.operators.stored import EntryLog, KVStore, PointStore, VersionStore
from spindex.sources.store import Conflict, Store, least_applied, set_applied


def kvs(spark, *rows):
    return spark.createDataFrame(rows, "key long, value string")


def test_commits_are_whole_and_ordered(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    assert not s.exists() and s.applied_index == 0
    base = s.state()
    s.commit(replace={"a": kvs(spark, (1, "x")), "b": kvs(spark, (2, "y"))}, values={"applied_index": 5})
    with pytest.raises(Conflict):
        s.commit(replace={"a": kvs(spark, (9, "z"))}, base=base)
    assert [r.key for r in s.read("a").collect()] == [1]
    s.commit(append={"a": kvs(spark, (3, "w"))})
    assert sorted(r.key for r in s.read("a").collect()) == [1, 3] and s.read("a", 1).count() == 1
    with pytest.raises(ValueError):
        set_applied(s, 4)
    set_applied(s, 8)
    other = Store(spark, str(tmp_path / "u"))
    assert (s.applied_index, least_applied(s, other), least_applied()) == (8, 0, 0)
    s.commit(replace={"a": kvs(spark).limit(0)})
    assert s.read("a").count() == 0 and len(s.vacuum()) == 3 and len(s.versions()) == 1
    with pytest.raises(ValueError):
        s.read("c")


def test_keys_and_values(spark, tmp_path):
    k = KVStore.create(spark, str(tmp_path / "kv"))
    k.put(kvs(spark, *[(i, f"v{i}") for i in range(20)]), applied=1)
    k.delete(kvs(spark, (3, ""), (4, ""), (99, "")), applied=2)
    k.put(kvs(spark, (3, "again")), applied=3)
    assert k.store.applied_index == 3 and k.table().size() == 19 and k.table(1).size() == 20
    assert k.table().get(3).first().value == "again"
    for bad in (kvs(spark, (None, "x")), kvs(spark, (1, "x"), (1, "y"))):
        with pytest.raises(ValueError):
            k.put(bad)
    with pytest.raises(ValueError):
        k.put(kvs(spark, (7, "x")), applied=2)
    with pytest.raises(Exception, match="out of range"):
        k.put(kvs(spark, (1 << 53, "x")))
    k.rewind(2)
    assert k.table().size() == 18
    sizes = k.compact()
    assert k.table().size() == 18 and sizes["newSize"] < sizes["oldSize"] and k.store.applied_index == 3
    with pytest.raises(ValueError):
        KVStore.create(spark, str(tmp_path / "kv"))


def test_points(spark, tmp_path):
    p = PointStore(spark, str(tmp_path / "p"))
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), ("a", 5.0, 6.0)], "object_id string, lat double, lng double")
    p.insert(rows, applied=4)
    p.insert(rows.limit(1))
    seen = p.store.versions()[-1]
    p.remove(rows.limit(1).select("object_id"))
    assert sorted(r.lat for r in p.points().collect()) == [1.0, 3.0, 5.0]
    p.remove_located("a", 5.0, 6.0)
    assert sorted(r.object_id for r in p.iterate_box(-90.0, 90.0, -180.0, 180.0)) == ["a", "b"]
    p.clear()
    assert p.points().count() == 0
    p.rewind(seen)
    assert p.points().count() == 4 and p.store.applied_index == 4
    p.compact()
    assert p.points().count() == 4


def test_versions(spark, tmp_path):
    v = VersionStore(spark, str(tmp_path / "v"))
    v.add(spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "x", 1)], "log_id long, text string, seq int"), applied=1)
    v.add(spark.createDataFrame([(1, "b", 1)], "log_id long, text string, seq int"))
    assert sorted(map(tuple, v.rows().collect())) == [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "x")]


def test_entry_log_refuses_and_recovers(spark, tmp_path):
    e = EntryLog(spark, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        e.append([(1, "early")])
    e.set_hard_state(2, 7)
    assert e.append([(1, "a"), (2, "b"), (2, "c")]) == 3
    e.set_commit_index(1)
    for bad in (lambda: e.append([(1, "x")]), lambda: e.truncate_from(1), lambda: e.set_hard_state(1), lambda: e.set_hard_state(2, 8), lambda: e.set_commit_index(9), lambda: e.compact(2, 1)):
        with pytest.raises(ValueError):
            bad()
    e.truncate_from(4)
    e.truncate_from(2)
    e.append([(2, "d")])
    again = EntryLog(spark, str(tmp_path / "e"))
    assert [(r["index"], r.payload) for r in again.live().orderBy("index").collect()] == [(1, "a"), (2, "d")]
    assert (again.state.last_index, again.state.voted_for, again.state.commit_index) == (2, 7, 1)
    again.compact(2, 2)
    assert again.live().count() == 0 and (again.state.base_index, again.state.commit_index) == (2, 2)
    assert again.append([(2, "e")]) == 3 and again.live().count() == 1


def test_changes_by_command_line(spark, tmp_path, capsys):
    from spindex.cli import main

    def run(*args):
        code = main(list(args), spark)
        return code, capsys.readouterr().out

    t = {k: str(tmp_path / k) for k in ("kv", "points", "text", "versions")}
    for words in (["put", "5", "five"], ["put", "6", "six"], ["put", "5", "fünf"], ["delete", "6"], ["compact"]):
        assert run("kv", t["kv"], *words)[0] == 0
    assert "fünf" in run("kv", t["kv"], "get", "5")[1] and run("kv", t["kv"], "get", "6")[0] == 1
    for words in (["insert", "a", "10", "20"], ["insert", "b", "11", "21"], ["remove", "a"], ["compact"]):
        assert run("points", t["points"], *words)[0] == 0
    assert run("points", t["points"], "list")[1].count("object_id") == 1
    assert run("points", t["points"], "insert", "c", "91", "0")[0] == 2
    run("points", t["points"], "clear")
    assert run("points", t["points"], "list")[0] == 1
    for words in (["add", "d1", "running", "foxes"], ["add", "d2", "a", "fox"], ["remove", "d1"], ["compact"]):
        assert run("text", t["text"], *words)[0] == 0
    assert "d2" in run("text", t["text"], "query", "foxes")[1] and '"d1"' not in run("text", t["text"], "list")[1]
    run("versions", t["versions"], "add", "1", "one", "text")
    run("versions", t["versions"], "add", "1", "other", "text")
    assert "other text" in run("versions", t["versions"], "get", "1", "2")[1]
