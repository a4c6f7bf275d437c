"""Queries over points (object_id, lat, lng); ids needn't be unique.

Box and radius queries are range predicates on lat and lng, so Parquet statistics
prune a table that ``compact`` has clustered by cell. Neighbour joins go by cells,
never by comparing all points.
"""

from __future__ import annotations

from functools import reduce
from math import asin, radians, sin, sqrt
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindex.functions.geo import EARTH_KM, haversine_km, in_box, radius_boxes
from spindex.functions.guards import no_nan
from spindex.sources.tables import dir_size, replace_table


def search_box(points: DataFrame, min_lat: float, max_lat: float, min_lng: float, max_lng: float) -> DataFrame:
    """Points in a closed box; no wrap at the antimeridian, and an inverted box holds none."""
    no_nan(min_lat, max_lat, min_lng, max_lng)
    return points.where(in_box("lat", "lng", (min_lat, max_lat, min_lng, max_lng)))


def search_radius(points: DataFrame, lat: float, lng: float, km: float, exact: bool = False) -> DataFrame:
    """Points within a distance, with it as ``distance``.

    The box around the circle is a little too narrow far from the equator; by default
    points must lie in it too. ``exact`` asks for the distance alone.
    """
    no_nan(lat, lng, km)
    boxed = points if exact else points.where(reduce(or_, (in_box("lat", "lng", b) for b in radius_boxes(lat, lng, km))))
    return boxed.withColumn("distance", haversine_km(lat, lng, "lat", "lng")).where(F.col("distance") <= km)


def nearest(points: DataFrame, lat: float, lng: float, k: int) -> DataFrame:
    """The k nearest points, by distance and then id; a heap of k rows per task."""
    no_nan(lat, lng)
    if k < 0:
        raise ValueError("k can't be negative")
    return points.withColumn("distance", haversine_km(lat, lng, "lat", "lng")).orderBy("distance", "object_id").limit(k)


def _cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("int")


#: Pairs of a query and a point of its own cell, for each row read, beyond which cells are made smaller.
PAIRS_A_ROW = 4
#: Chord below which cells aren't divided: about six metres; three cell numbers fill a long.
LEAST_CHORD = 2.0**-20


def _placed(rows: DataFrame) -> DataFrame:
    """Adds x, y, z on the unit sphere; degrees beyond a pole or the antimeridian go on around it, as the distance takes them."""
    lat, lng = F.radians("lat"), F.radians("lng")
    return rows.withColumns({"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)})


def _cube(x: Column, y: Column, z: Column) -> Column:
    """One number for three cell numbers."""
    return ((x + F.lit(1 << 20)) * F.lit(1 << 21) + (y + F.lit(1 << 20))) * F.lit(1 << 21) + (z + F.lit(1 << 20))


def _own_cube(side: float) -> Column:
    return _cube(*[F.floor(F.col(c) / F.lit(side)) for c in "xyz"])


def _probes(queries: DataFrame, side: float) -> DataFrame:
    """query_id, qlat, qlng, cell: the cells of the sphere's surface that a ball of radius ``side`` around a query touches."""
    slack = side * 1e-6
    out = queries.select("query_id", F.col("lat").alias("qlat"), F.col("lng").alias("qlng"), "x", "y", "z")
    gap, near, far = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        out = out.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(c) - side - slack) / side), F.floor((F.col(c) + side + slack) / side))))
        low, high = F.col(f"c{c}") * F.lit(side), (F.col(f"c{c}") + 1) * F.lit(side)
        between = F.greatest(F.lit(0.0), low - F.col(c), F.col(c) - high)
        inner = F.greatest(F.lit(0.0), low, -high)
        outer = F.greatest(F.abs(low), F.abs(high))
        gap, near, far = gap + between * between, near + inner * inner, far + outer * outer
    touched = (gap <= (side + slack) ** 2) & (near <= 1.0 + slack) & (far >= 1.0 - slack)
    return out.where(touched).select("query_id", "qlat", "qlng", _cube(F.col("cx"), F.col("cy"), F.col("cz")).alias("cell"))


def _first_side(queries: DataFrame, points: DataFrame, k: int, most: float) -> tuple[float, DataFrame]:
    """A cell's side at which there are few pairs of queries and points, and the points, of those at one place the ``k`` that can be nearest alone if many coincide."""
    rows = points.count()
    side, last, thinned = max(LEAST_CHORD, min(most, 4.0 * sqrt(k / max(1, rows)))), None, False
    limit = PAIRS_A_ROW * (rows + queries.count())
    while True:
        asked = queries.groupBy(_own_cube(side).alias("cell")).agg(F.count(F.lit(1)).alias("q"))
        held = points.groupBy(_own_cube(side).alias("cell")).agg(F.count(F.lit(1)).alias("p"))
        pairs = asked.join(held, "cell").agg(F.sum(F.col("q").cast("double") * F.col("p"))).first()[0] or 0.0
        if pairs <= limit:
            return side, points
        if not thinned and last is not None and pairs > last / 2:
            here = Window.partitionBy("lat", "lng").orderBy("object_id")
            points, thinned = points.withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= k).drop("_n"), True
            continue
        if side <= LEAST_CHORD:
            return side, points
        side, last = max(LEAST_CHORD, side / 4), pairs


def nearest_join(queries: DataFrame, points: DataFrame, k: int, start_degrees: float = 2.0) -> DataFrame:
    """query_id, object_id, distance, rank: the k nearest points of every query (query_id, lat, lng).

    Points lie in cubes of a grid around the sphere, the first so small (at most
    ``start_degrees``) that queries meet few points: it is set by the numbers of both in
    each cube, so the pairs compared grow with the tables, not with their product. In each
    round the queries still open look, by an equi-join, at the cubes within one side of them.
    A query is done when its k-th distance lies within that side; the others go on with
    one twice as long. The last round is the whole sphere. Ties go to the smaller id.
    """
    if k < 0:
        raise ValueError("k can't be negative")
    points = _placed(points.select("object_id", "lat", "lng"))
    open_, done = _placed(queries.select("query_id", "lat", "lng")), None
    side, points = _first_side(open_, points, k, 2.0 * sin(radians(min(start_degrees, 180.0)) / 2)) if k else (2.0, points)
    ranked = Window.partitionBy("query_id").orderBy("distance", "object_id")
    while True:
        last = side >= 1.0
        if last:
            met = open_.select("query_id", F.col("lat").alias("qlat"), F.col("lng").alias("qlng")).where("qlat is not null and qlng is not null").crossJoin(points.where("lat is not null and lng is not null"))
        else:
            met = _probes(open_, side).join(points.withColumn("cell", _own_cube(side)), "cell")
        pairs = met.select("query_id", "object_id", haversine_km("qlat", "qlng", "lat", "lng").alias("distance"))
        top = pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        if last:
            found = top
        else:
            top = top.persist()  # k rows a query, read for what is done, what is open and the result
            reach = 2.0 * EARTH_KM * asin(side / 2) * (1 - 1e-9)
            full = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where((F.col("n") == k) & (F.col("far") <= reach)).select("query_id")
            found = top.join(full, "query_id", "left_semi")
        done = found if done is None else done.unionByName(found)
        if not last:
            open_ = open_.join(full, "query_id", "left_anti")
        if last or open_.isEmpty():
            return done.select("query_id", "object_id", "distance", "rank")
        side *= 2


def insert(points: DataFrame, more: DataFrame) -> DataFrame:
    return points.unionByName(more)


def remove_first(points: DataFrame, ids: DataFrame, order_col: str) -> DataFrame:
    """Without the first row, in the given order, of each listed id."""
    first = points.join(ids.select("object_id").distinct(), "object_id", "left_semi").groupBy("object_id").agg(F.min(order_col).alias("_first"))
    gone = first.select("object_id", F.col("_first").alias(order_col))
    return points.join(gone, ["object_id", order_col], "left_anti").select(points.columns)


def remove_located(points: DataFrame, object_id: str, lat: float, lng: float, order_col: str) -> DataFrame:
    """Without the first row of an id at exactly these coordinates; another point of that id is left alone."""
    no_nan(lat, lng)
    here = points.where((F.col("object_id") == object_id) & (F.col("lat") == lat) & (F.col("lng") == lng))
    gone = here.groupBy("object_id").agg(F.min(order_col).alias(order_col))
    return points.join(gone, ["object_id", order_col], "left_anti").select(points.columns)


def clustered(points: DataFrame, degrees: float = 5.0) -> DataFrame:
    """The points range-partitioned and sorted by cell."""
    celled = points.withColumn("_y", _cell(F.col("lat"), degrees)).withColumn("_x", _cell(F.col("lng"), degrees))
    return celled.repartitionByRange("_y", "_x").sortWithinPartitions("_y", "_x", "lat", "lng").drop("_y", "_x")


def compact(points: DataFrame, path: str, degrees: float = 5.0) -> dict[str, int]:
    """Writes the points clustered by cell; returns sizes in bytes before and after."""
    old = dir_size(points)
    replace_table(clustered(points, degrees), path)
    new = dir_size(points.sparkSession.read.parquet(path))
    return {"oldSize": old, "newSize": new, "bytesSaved": max(0, old - new)}
