"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced spherical k-means on a bounded sample; every vector is
then posted, to its nearest centroid and, near a boundary, to others that are almost
as near. A query finds its lists by a best-first walk over a neighbour graph of the
centroids, keeps those within a ratio of the nearest one's distance, and is compared
with all vectors of those lists. How many lists and which ratio is measured anew in
each run: some queries are compared with all vectors, and both grow until enough of
what these have as nearest lies in the lists. Lists and queries of a list are split
into shards of bounded size, so no task holds a hot list.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindex.llm.common import arrow_map, least_hashes, saved

#: Rows of a posting list, or queries of it, that one task compares.
SHARD_ROWS = 20_000
#: Queries that are compared with all rows to set the lists to search.
MEASURED = 256


class Centroids:
    """Unit centroids and a graph that links each to its nearest ones."""

    def __init__(self, centres: np.ndarray, degree: int = 24):
        self.centres = centres.astype(np.float32)
        n = len(centres)
        degree = min(degree, n - 1)
        near = np.empty((n, degree), np.int64)
        for i in range(0, n, 1024):
            sims = self.centres[i : i + 1024] @ self.centres.T
            sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
            near[i : i + 1024] = np.argpartition(-sims, degree - 1, axis=1)[:, :degree] if degree else 0
        links: list[set[int]] = [set(map(int, row)) for row in near]
        for a, row in enumerate(near):
            for b in row:
                links[int(b)].add(a)
        self.links = [np.fromiter(sorted(x), np.int64, len(x)) for x in links]
        self.entry = int(np.argmax(self.centres @ self.centres.mean(axis=0)))

    def walk(self, query: np.ndarray, wanted: int) -> list[tuple[float, int]]:
        """About the ``wanted`` nearest centroids as (distance, centroid), nearest first."""
        def far(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * (self.centres[rows] @ query)))

        first = float(far(np.array([self.entry]))[0])
        seen, heap, best = {self.entry}, [(first, self.entry)], [(-first, self.entry)]
        keep = max(wanted * 2, 32)
        while heap:
            d, at = heapq.heappop(heap)
            if len(best) == keep and d > -best[0][0]:
                break
            new = [int(x) for x in self.links[at] if int(x) not in seen]
            seen.update(new)
            for d, x in zip(far(np.array(new, np.int64)).tolist() if new else (), new, strict=True):
                if len(best) < keep:
                    heapq.heappush(best, (-d, x))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, x))
                else:
                    continue
                heapq.heappush(heap, (d, x))
        return sorted((-d, x) for d, x in best)[:wanted]

    def ranked(self, query: np.ndarray) -> list[tuple[float, int]]:
        """All centroids as (distance, centroid), nearest first."""
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.centres @ query)))
        by = np.argsort(far, kind="stable")
        return list(zip(far[by].tolist(), by.tolist(), strict=True))

    def lists(self, query: np.ndarray, probes: int, ratio: float, homes: np.ndarray, k: int) -> list[int]:
        """The lists to search: ``probes`` nearest ones within ``ratio`` of the nearest, and further ones until they are home to more than ``k`` ids."""
        near = self.walk(query, probes) if probes * 8 <= len(self.centres) else self.ranked(query)[:probes]
        found = [c for d, c in near if d <= near[0][0] * ratio + 1e-6]
        held = int(homes[found].sum())
        if held <= k:
            known = set(found)
            for _, c in self.ranked(query):
                if held > k:
                    break
                if c not in known:
                    found.append(c)
                    held += int(homes[c])
        return found


def balanced_kmeans(sample: np.ndarray, lists: int, rounds: int = 12, weight: float = 0.1, seed: int = 7) -> np.ndarray:
    """Unit centroids of clusters kept near one size: a cluster costs more the fuller it was in the round before."""
    rng = np.random.default_rng(seed)
    unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    centres = unit[rng.choice(len(unit), lists, replace=False)].copy()
    sizes = np.full(lists, len(unit) / lists)
    for _ in range(rounds):
        cost = (weight * (sizes / (len(unit) / lists) - 1)).astype(np.float32)
        own = np.concatenate([(unit[i : i + 4096] @ centres.T - cost).argmax(axis=1) for i in range(0, len(unit), 4096)])
        sizes = 0.5 * sizes + 0.5 * np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = ~np.isin(np.arange(lists), own)
        sums[empty] = unit[rng.choice(len(unit), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part.

    Not those whose id or vector is null, that hold null or non-finite components, or
    that are all zero.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def number_of_lists(n: int, sampled: int, list_rows: int = 500, most_lists: int = 16_384) -> int:
    """Lists for n rows: of about as many rows as there are lists, ``list_rows`` at most; no more than ``most_lists``, nor than a quarter of the sample."""
    per = max(1, min(list_rows, math.ceil(math.sqrt(n))))
    return max(1, min(most_lists, math.ceil(n / per), sampled // 4))


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows."""
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed component by component, so equal vectors get equal values anywhere."""
    dot, a, b = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for k in range(rows.shape[1]):
        x, y = rows[:, k], float(query[k])
        dot += x * y
        a += x * x
        b += y * y
    return np.clip(dot / np.sqrt(a * b), -1.0, 1.0)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """For each query its k best rows of other ids: by matrix products first, then measured one by one."""
    out: list[tuple[int, int, float]] = []
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for i in range(0, len(queries), 256):
        part = queries[i : i + 256]
        sims = (part / np.linalg.norm(part, axis=1, keepdims=True)) @ unit.T
        for q in range(len(part)):
            own = int(query_ids[i + q])
            s = sims[q]
            s[ids == own] = -3.0
            cut = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -2.5
            near = np.flatnonzero((s >= cut - 1e-9) & (s > -2.5))
            score = _cosines(rows[near], part[q])
            for x in np.lexsort((ids[near], -score))[:k]:
                out.append((own, int(ids[near[x]]), float(score[x])))
    return out


def _nearest(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int]]:
    """query_id, vec_id of the k best of all rows for each query, by brute force; each partition sends k a query."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches):
        asks, q = shared.value
        best_ids, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            if batch.num_rows:
                own, v = np.asarray(batch.column(0)), _matrix(batch.column(1))
                sims = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                sims[asks[:, None] == own] = -3.0
                sims = np.concatenate([best, sims], axis=1)
                named = np.concatenate([best_ids, np.broadcast_to(own, (len(q), len(own)))], axis=1)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                best, best_ids = np.take_along_axis(sims, top, 1), np.take_along_axis(named, top, 1)
        row, at = np.nonzero(best > -2.5)
        yield pa.RecordBatch.from_arrays([pa.array(asks[row]), pa.array(best_ids[row, at]), pa.array(best[row, at])], ["query_id", "vec_id", "score"])

    each = rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return [(r[0], r[1]) for r in each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id").collect()]


def breadth(index: Centroids, rows: DataFrame, posted: DataFrame, homes: np.ndarray, k: int, every: int, probes: int, ratio: float, recall: float) -> tuple[int, float]:
    """Probes and ratio, those given or wider, with which a fixed sample of queries finds ``recall`` of its true nearest rows."""
    sample = least_hashes(rows.where(F.col("vec_id") % every == 0), "vec_id", MEASURED).select("vec_id", "v").collect()
    if not sample:
        return probes, ratio
    ids, unit = np.array([r[0] for r in sample], np.int64), np.array([r[1] for r in sample])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    truth = _nearest(rows, ids, unit, k)
    wanted = rows.sparkSession.createDataFrame(sorted({(v,) for _, v in truth}) or [(None,)], "vec_id long")
    where: dict[int, set[int]] = {}
    for r in posted.select("vec_id", "list").join(F.broadcast(wanted), "vec_id").collect():
        where.setdefault(r[0], set()).add(r[1])
    small = unit.astype(np.float32)
    while True:
        lists: dict[int, set[int]] = {}
        for i, q in zip(ids.tolist(), small, strict=True):
            lists.setdefault(i, set()).update(index.lists(q, probes, ratio, homes, k))
        hit = sum(not where[v].isdisjoint(lists[q]) for q, v in truth)
        if hit >= recall * len(truth) or probes >= len(homes) and ratio == math.inf:
            return probes, ratio
        probes = min(len(homes), math.ceil(probes * 1.25))
        ratio = math.inf if probes == len(homes) else 1 + (ratio - 1) * 1.25


def search(vectors: DataFrame, k: int = 5, every: int = 50, list_rows: int = 500, most_lists: int = 16_384, sample_rows: int = 131_072, probes: int = 48, query_ratio: float = 1.35, copies: int = 4, post_ratio: float = 1.08, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by ``every``.

    Nearness is the cosine; ties go to the smaller id; a query's own id is never among
    its results. Rows that can't take part (see ``usable``) are left out on both sides.
    Repeated ids are candidates as long as they aren't the query's, the best of them
    once. An empty table gives an empty result. Centroids are fitted on ``sample_rows``
    rows at most (those of the smallest id hashes, 20,000 or eight a list); for the number
    of lists see ``number_of_lists``; with one list the search is exact. Vectors of
    another length than the commonest (of equally common ones the largest) are compared
    with all of their own length, which are one list each. All rows are posted, to up to ``copies`` lists within ``post_ratio`` of the nearest. A query
    looks at up to ``probes`` lists within ``query_ratio``, or at as many more, within
    as wide a ratio, as it takes for ``MEASURED`` queries of the smallest id hashes to
    find ``recall`` of what brute force gives them; and on to further lists, all if
    need be, until k other ids are among their rows.
    """
    spark = vectors.sparkSession
    everything = saved(usable(vectors, id_col, vector_col), "vectors")
    sizes = everything.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(2)
    d, n = (sizes[0][0], sizes[0][1]) if sizes else (0, 0)
    rows = everything.where(F.size("v") == d)
    sampled = min(n, max(min(20_000, sample_rows), min(sample_rows, 8 * number_of_lists(n, n, list_rows, most_lists))))
    sample = [r[0] for r in least_hashes(rows, "vec_id", sampled).select(F.col("v").cast("array<float>")).collect()]
    lists = number_of_lists(n, len(sample), list_rows, most_lists)
    index = Centroids(balanced_kmeans(np.array(sample), lists)) if lists > 1 else None
    shared = spark.sparkContext.broadcast(index)

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value
        m = batch.num_rows
        if found is None:
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), *batch.columns], ["list", "vec_id", "v"])
        own = _matrix(batch.column(1)).astype(np.float32)
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        which, at = [], []
        for i in range(0, m, 2048):
            far = np.sqrt(np.maximum(0, 2 - 2 * (own[i : i + 2048] @ found.centres.T)))
            few = min(copies, far.shape[1])
            near = np.argpartition(far, few - 1, axis=1)[:, :few]
            d = np.take_along_axis(far, near, 1)
            r, c = np.nonzero(d <= d.min(axis=1, keepdims=True) * post_ratio + 1e-6)
            which.append(r + i)
            at.append(near[r, c])
        taken = batch.take(pa.array(np.concatenate(which)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).astype(np.int32)), *taken.columns], ["list", "vec_id", "v"])

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value
        if found is None:
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), *batch.columns], ["list", "vec_id", "v"])
        own = _matrix(batch.column(1)).astype(np.float32)
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        which, at = [], []
        for r, q in enumerate(own):
            got = found.lists(q, probes, query_ratio, homes, k)
            which += [r] * len(got)
            at += got
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.take(pa.array(which)).columns], ["list", "vec_id", "v"])

    posted = saved(arrow_map(rows, post, "list int, vec_id long, v array<double>"), "postings")
    homes = np.zeros(lists, np.int64)
    if index is not None:
        for r in posted.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
            homes[r[0]] = r[1]
        probes, query_ratio = breadth(index, rows, posted, homes, k, every, min(probes, lists), query_ratio, recall)
    asked = saved(arrow_map(rows.where(F.col("vec_id") % every == 0), probe, "list int, vec_id long, v array<double>"), "probes")

    if len(sizes) > 1:
        others = everything.where(F.size("v") != d).select((-F.size("v")).alias("list"), "vec_id", "v")
        posted, asked = posted.unionByName(others), asked.unionByName(others.where(F.col("vec_id") % every == 0))

    def shards(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).cast("int").alias(name))

    split = F.broadcast(shards(posted, "vs").join(shards(asked, "qs"), "list"))  # one row a list
    here = posted.join(split, "list").withColumn("a", F.pmod(F.xxhash64("vec_id"), F.col("vs")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    there = asked.join(split, "list").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("qs")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
    key = ["list", "a", "b"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, asks = (np.asarray(t["vec_id"].combine_chunks()) for t in (left, right))
        got = _best(asks, _matrix(right["v"].combine_chunks()), ids, _matrix(left["v"].combine_chunks()), k)
        q, v, s = zip(*got, strict=True) if got else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    met = here.select(*key, "vec_id", "v").groupBy(*key).cogroup(there.select(*key, "vec_id", "v").groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
