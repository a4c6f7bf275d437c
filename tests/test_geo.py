import math

import pytest

from spindex.operators import spatial


def km(a, b, c, d):
    p = math.pi / 180
    h = math.sin((c - a) * p / 2) ** 2 + math.cos(a * p) * math.cos(c * p) * math.sin((d - b) * p / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(min(1, h)), math.sqrt(max(0, 1 - h)))


def pts(spark, rows):
    return spark.createDataFrame([(str(i), float(a), float(b)) for i, a, b in rows], "object_id string, lat double, lng double")


def ids(df):
    return sorted(r.object_id for r in df.collect())


SPREAD = [(i, ((i * 37) % 170) - 85 + i * 1e-5, ((i * 73) % 350) - 175 + i * 1e-5) for i in range(300)]


def test_radius_across_the_antimeridian(spark):
    p = pts(spark, [(1, 0, 179.9), (2, 0, -179.9), (3, 0, 178.5), (4, 0, -178.5), (5, 20, 0)])
    assert ids(spatial.search_radius(p, 0.0, 179.95, 25.0)) == ids(spatial.search_radius(p, 0.0, -179.95, 25.0)) == ["1", "2"]


def test_radius_at_a_pole(spark):
    p = pts(spark, [(i, 89.9, g) for i, g in enumerate((-170, -90, 0, 90, 170))] + [(9, 85, 0)])
    assert len(ids(spatial.search_radius(p, 89.95, 0.0, 30.0))) == 5


def test_exact_radius_finds_what_the_box_cuts(spark):
    p = pts(spark, [(1, 79.89, 25.95)])
    assert ids(spatial.search_radius(p, 80.0, 0.0, 500.0)) == [] and ids(spatial.search_radius(p, 80.0, 0.0, 500.0, exact=True)) == ["1"]


def test_nan_is_refused_and_antipodes_are_not_nan(spark):
    p = pts(spark, [(1, 0, 180)])
    for bad in (lambda: spatial.search_box(p, math.nan, 1.0, 0.0, 1.0), lambda: spatial.search_radius(p, 0.0, math.nan, 1.0), lambda: spatial.nearest(p, math.nan, 0.0, 1), lambda: spatial.nearest(p, 0.0, 0.0, -1)):
        with pytest.raises(ValueError):
            bad()
    assert spatial.nearest(p, 0.0, 0.0, 1).first().distance == pytest.approx(math.pi * 6371)
    assert spatial.nearest(p, 0.0, 0.0, 0).isEmpty()


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_join_equals_brute_force(spark, k):
    asks = [(i, a, g) for i, a, g in [(1, 0, 179.97), (2, 89.99, 5), (3, -89, -60), (4, 12, 12), (5, 60, -179.99), (6, 45, 100)]]
    near = [(1000 + i, 0.001 * i, 180 - 0.01 * i if i % 2 else -180 + 0.01 * i) for i in range(1, 30)]
    points = SPREAD + near
    q = spark.createDataFrame([(str(i), float(a), float(g)) for i, a, g in asks], "query_id string, lat double, lng double")
    got = {}
    for r in spatial.nearest_join(q, pts(spark, points), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.object_id))
    for i, a, g in asks:
        want = sorted((km(a, g, b, h), str(j)) for j, b, h in points)[:k]
        assert [x for _, x in sorted(got[str(i)])] == [j for _, j in want], i


def test_join_with_few_points(spark):
    q = spark.createDataFrame([("q", 0.0, 0.0)], "query_id string, lat double, lng double")
    assert spatial.nearest_join(q, pts(spark, [(1, -80, 170)]), 3).count() == 1
    assert spatial.nearest_join(q, pts(spark, [(1, -80, 170)]).limit(0), 3).count() == 0


def test_removal_of_repeated_ids(spark):
    p = spark.createDataFrame([("x", 10.0, 20.0, 0), ("x", -30.0, 40.0, 1), ("y", 1.0, 1.0, 2)], "object_id string, lat double, lng double, seq int")
    once = spatial.remove_first(p, p.where("object_id = 'x'"), "seq")
    assert sorted((r.object_id, r.seq) for r in once.collect()) == [("x", 1), ("y", 2)]
    assert sorted(r.seq for r in spatial.remove_located(p, "x", -30.0, 40.0, "seq").collect()) == [0, 2]
    assert spatial.remove_located(p, "x", 5.0, 5.0, "seq").count() == 3


def test_compact(spark, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    pts(spark, SPREAD).write.parquet(src)
    p = spark.read.parquet(src)
    spatial.compact(p, dst)
    assert ids(spark.read.parquet(dst)) == ids(p)


def unit(lat, lng):
    a, g = math.radians(lat), math.radians(lng)
    return math.cos(a) * math.cos(g), math.cos(a) * math.sin(g), math.sin(a)


def test_nearest_join_beyond_a_pole_and_the_antimeridian(spark):
    """Degrees go on around the sphere, in cells as in distances."""
    points = [(1, 93, 10), (2, 80, 190), (3, 70, 190), (4, 0, 181), (5, 0, 175), (6, -1, 170)]
    asks = [(1, 87, -170), (2, 0, -179), (3, 0, 538)]
    q = spark.createDataFrame([(str(i), float(a), float(g)) for i, a, g in asks], "query_id string, lat double, lng double")
    got = sorted((r.query_id, r["rank"], r.object_id) for r in spatial.nearest_join(q, pts(spark, points), 2).collect())
    assert got == sorted((str(i), r + 1, str(j)) for i, a, g in asks for r, (_, j) in enumerate(sorted((math.dist(unit(a, g), unit(b, h)), j) for j, b, h in points)[:2]))


def test_nearest_join_compares_few_pairs(spark, monkeypatch):
    """The cells are as small as the tables are dense, also where many points lie at one place."""
    sides, probes = [], spatial._probes
    monkeypatch.setattr(spatial, "_probes", lambda rows, side: sides.append(side) or probes(rows, side))
    rows = [(i, 10 + (i * 37 % 1000) * 1e-4, 20 + (i * 73 % 997) * 1e-4) for i in range(3000)]
    asks = rows[:600:2]
    q = spark.createDataFrame([(str(i), a, g) for i, a, g in asks], "query_id string, lat double, lng double")
    got = {(r.query_id, r["rank"]): r.object_id for r in spatial.nearest_join(q, pts(spark, rows), 2).collect()}
    assert sides[0] < 0.001 and len(sides) < 6
    for i, a, g in asks[::29]:
        want = sorted((km(a, g, b, h), str(j)) for j, b, h in rows)[:2]
        assert [got[str(i), r] for r in (1, 2)] == [j for _, j in want]
    same = pts(spark, [(i, 10, 20) for i in range(2000)] + [(9000 + i, 10, 21) for i in range(5)])
    many = spark.createDataFrame([(str(i), 10.0, 20.0) for i in range(500)], "query_id string, lat double, lng double")
    assert spatial._first_side(spatial._placed(many), spatial._placed(same), 3, 0.03)[1].count() == 6
    got = [(r["rank"], r.object_id) for r in spatial.nearest_join(many, same, 3).collect()]
    assert len(got) == 1500 and set(got) == {(1, "0"), (2, "1"), (3, "10")}
