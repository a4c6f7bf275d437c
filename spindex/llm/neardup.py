"""Near-duplicate documents by b-bit MinHash.

1. One map over the texts gives each document's set of word shingles as a size, a
   128-bit digest, two low bits of each of 128 minima packed into four longs, and
   one key per band of minima.
2. Documents of equal sets are one class; only its smallest id goes on.
3. Classes that share a band key are candidates. In each bucket every member is
   paired with the smallest member, so a bucket of m members gives m - 1 pairs.
4. Pairs whose sizes rule the threshold out, or whose collision-corrected estimate
   lies more than six standard deviations below it, go; the others are confirmed on
   full sets, and confirmed links are joined into components.
5. Buckets whose members are now in different components may hide links that no
   pair with the smallest member shows. In those of up to ``MOST_PAIRED`` members all
   of different components are paired, filtered and confirmed likewise. Larger ones,
   such as those of documents made from one template, go through an exact join of
   prefixes: shingles are ordered by rarity, and a pair can reach the threshold only if
   the first few of the larger set hold one of the still fewer first of the smaller.
   What a template shares is common there, so it isn't among the first. So each pair
   that shares a bucket is either in one component or has been compared or ruled out.

With 32 bands of 4 minima a pair of similarity 0.8 shares no band once in 2e7.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindex.llm import textvec
from spindex.llm.common import arrow_map, discard, fresh, saved, text_bytes, without
from spindex.llm.graph import components

U64 = np.uint64
BANDS, ROWS, BITS = 32, 4, 2
MINIMA = BANDS * ROWS
_FACTORS = np.random.default_rng(97).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * U64(2) + U64(1)
_SIGS = ["s0", "s1", "s2", "s3"]
_LOW = 0x5555555555555555
SKETCH = "doc_id long, n_shingles long, h0 long, h1 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"
#: Ids of candidates that may be broadcast (eight bytes each); beyond that texts are joined by a shuffle.
MOST_IDS = 2_000_000
#: Pairs of one hub that one task confirms, about; a hub's set is sent once for as many.
HUB_PAIRS = 500
#: Members of a bucket up to which those of different components are compared one by one.
MOST_PAIRED = 64
#: Counters of shingles by which rarity is told; any order is right, rare ones first is fast.
COUNTERS = 1 << 20
#: Prefixes with one shingle that one task joins, about.
TOKEN_ROWS = 1000


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's shingles; fewer words than ``width`` are one shingle, none give no shingle."""
    hashes, first = textvec.words(buf, off, textvec.NOT_SPACE)
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, U64)
        for k in range(width):
            rolled[: n - k] = textvec.mix(rolled[: n - k] + hashes[k:] + U64(k + 1)) if k < n else rolled[: n - k]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                x = np.full(1, b - a, U64)
                for h in hashes[a:b]:
                    x = textvec.mix(x * U64(3) + h)
            out.append(x)
        else:
            out.append(hashes[:0])
    return out


def _sketch(sets: list[np.ndarray]) -> list[pa.Array]:
    n = len(sets)
    minima = np.zeros((n, MINIMA), U64)
    digest = np.zeros((n, 2), U64)
    with np.errstate(over="ignore"):
        for r, s in enumerate(sets):
            if not len(s):
                continue
            digest[r, 0] = textvec.mix(s + U64(11)).sum(dtype=U64)
            digest[r, 1] = textvec.mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
            least = np.full(MINIMA, U64(0xFFFFFFFFFFFFFFFF))
            for i in range(0, len(s), 512):
                np.minimum(least, np.multiply.outer(s[i : i + 512], _FACTORS).min(axis=0), out=least)
            minima[r] = least
        bits = textvec.mix(minima) & U64((1 << BITS) - 1)
        lanes = bits.reshape(n, len(_SIGS), 32) << (np.arange(32, dtype=U64) * U64(BITS))
        sig = np.bitwise_or.reduce(lanes, axis=2)
        keys = np.zeros((n, BANDS), U64)
        grouped = minima.reshape(n, BANDS, ROWS)
        keys += np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            keys = textvec.mix(keys ^ grouped[:, :, k])
    size = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[size > 0].reshape(-1).view(np.int64)))
    return [pa.array(size), *[pa.array(digest[:, k].copy().view(np.int64)) for k in (0, 1)], *[pa.array(sig[:, k].copy().view(np.int64)) for k in range(4)], bands]


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, digest, packed signature and band keys of each row's shingle set."""

    def run(batch: pa.RecordBatch):
        buf, off = textvec.binary_column(batch.column(1))
        for i, j in textvec.chunks(off):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_sketch(shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width))], [c.split()[0] for c in SKETCH.split(", ")])

    return arrow_map(text_bytes(docs, id_col, text_col), run, SKETCH)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures by bit counts, corrected for lanes that agree by chance."""
    differ = F.lit(0)
    for s in _SIGS:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))
    chance = 1.0 / (1 << BITS)
    return (F.lit(1.0) - differ / F.lit(float(MINIMA)) - chance) / (1.0 - chance)


def _plausible(a: str, b: str, percent: int) -> Column:
    s = percent / 100
    p = s + (1 - s) / (1 << BITS)
    slack = 6 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - 1 / (1 << BITS))
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (estimate(a, b) >= s - slack)


def shingles_of(docs: DataFrame, ids: DataFrame, encode: Callable[[np.ndarray, np.ndarray], list[bytes]], id_col: str, text_col: str) -> DataFrame:
    """doc_id, shingles (binary, what ``encode`` makes of a chunk's rows) of the listed ids."""
    texts = text_bytes(docs, id_col, text_col)
    wanted = None
    if ids.limit(MOST_IDS + 1).count() <= MOST_IDS:
        held = np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64)) if not ids.isEmpty() else np.zeros(0, np.int64)
        wanted = docs.sparkSession.sparkContext.broadcast(held)
        texts = texts.where("doc_id is not null")
    else:
        texts = texts.join(ids, "doc_id", "left_semi")

    def run(batch: pa.RecordBatch):
        if wanted is not None:
            known, own = wanted.value, batch.column(0).to_numpy(zero_copy_only=False)
            k = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            batch = batch.filter(pa.array(known[k] == own if len(known) else np.zeros(len(own), bool)))
            if not batch.num_rows:
                return
        buf, off = textvec.binary_column(batch.column(1))
        for i, j in textvec.chunks(off):
            made = encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(made, pa.binary())], ["doc_id", "shingles"])

    return arrow_map(texts, run, "doc_id long, shingles binary")


def with_both(pairs: DataFrame, sets: DataFrame, per: int) -> DataFrame:
    """The pairs (a, b) with the sets of both as sa and sb.

    A node that is ``a`` in more than ``per`` pairs is split into shards of about so many,
    and its set sent once to each, so a hub of many pairs is many keys.
    """
    shards = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(per)).cast("int").alias("_n")).where("_n > 1")
    split = pairs.join(shards, "a", "left").withColumn("_s", F.pmod(F.xxhash64("b"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).join(shards, "a", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return split.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(left, ["a", "_s"]).drop("_s")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = with_both(pairs, sets, HUB_PAIRS).select("a", "b", "sa", "sb")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        x, y = batch.column(2), batch.column(3)
        for r in range(batch.num_rows):
            p, q = (np.frombuffer(c[r].as_buffer(), U64) for c in (x, y))
            k = np.searchsorted(q, p)
            k[k == len(q)] = 0
            common = int((q[k] == p).sum())
            keep[r] = common * 100 >= percent * (len(p) + len(q) - common)
        return batch.select([0, 1]).filter(pa.array(keep))

    return arrow_map(both, run, "a long, b long")


def _rarities(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each counter."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                total += np.bincount(_counter(np.frombuffer(batch.column(0)[r].as_buffer(), U64)), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "n"])

    out = np.zeros(COUNTERS, np.int64)
    seen = sets.select("shingles").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out[seen["counter"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    return out


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of sets (doc_id, c, shingles) of different ``c``, among them all that reach the threshold.

    Of a set of n shingles, the larger of a pair, the overlap is at least percent % of n, so
    one of the first n - that + 1 is shared; of the smaller it is at least twice the share of
    percent in 100 + percent. Shared shingles' places bound the overlap further. Common
    prefix shingles are split into shards.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_rarities(sets))

    def run(batch: pa.RecordBatch):
        seen = shared.value
        for i in range(0, batch.num_rows, 200):
            row, size, token, place, few = [], [], [], [], []
            for r in range(i, min(i + 200, batch.num_rows)):
                own = np.frombuffer(batch.column(2)[r].as_buffer(), U64)
                n = len(own)
                probe, index = n + (-n * percent) // 100 + 1, n + (-2 * n * percent) // (100 + percent) + 1
                first = own[np.lexsort((own, seen[_counter(own)]))[:probe]]
                row.append(np.full(len(first), r)), size.append(np.full(len(first), n)), token.append(first.view(np.int64))
                place.append(np.arange(len(first))), few.append(np.arange(len(first)) < index)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(x)) for x in (size, token, place, few))], ["rep", "c", "n", "token", "place", "few"])

    rows = saved(arrow_map(sets.select("doc_id", "c", "shingles"), run, "rep long, c long, n long, token long, place long, few boolean"), "prefixes")
    shards = saved(rows.where("few").groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(TOKEN_ROWS)).cast("int").alias("m")).where("m > 1"), "common")
    m = F.coalesce("m", F.lit(1))
    x = rows.join(shards, "token", "left").withColumn("s", F.explode(F.sequence(F.lit(0), m - 1))).alias("x")
    y = rows.where("few").join(shards, "token", "left").withColumn("s", F.pmod(F.xxhash64("rep"), m).cast("int")).alias("y")
    order = F.struct("y.n", "y.rep") < F.struct("x.n", "x.rep")
    bound = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.s") == F.col("y.s")) & order & (F.col("x.c") != F.col("y.c")) & (F.col("y.n") * 100 >= F.col("x.n") * percent) & bound)
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable), kept (doc_id = component_id).

    ASCII letters are lower-cased, words are runs of anything but ASCII white space, and
    a document's set holds its distinct shingles of ``width`` words (fewer words: the
    whole sequence as one). Two documents are linked if 100 * |A and B| >= percent *
    |A or B|, confirmed on full sets of 64-bit shingle hashes. Texts that are null or
    hold no word have no shingle and are linked with nothing. Rows of one id are one
    node, each returned; rows of null id are linked with nothing and kept. Other columns
    are ignored; an empty table gives an empty result.
    """
    base = saved(sketches(docs, width, id_col, text_col), "sketches")
    key = ["h0", "h1", "n_shingles"]
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    named = saved(base.select("doc_id", *key).join(classes, key, "left").withColumn("rep", F.expr("CASE WHEN doc_id IS NOT NULL THEN rep END")), "classes")
    # rows of one id with different sets are one node too
    same = named.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    reps = saved(base.join(classes.withColumn("doc_id", F.col("rep")), [*key, "doc_id"]).select("rep", "n_shingles", "h0", *_SIGS, "bands").dropDuplicates(["rep", "n_shingles", "h0"]), "representatives")
    discard(base)
    bands = reps.select("rep", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = saved(bands.join(hubs, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    info = reps.select("rep", "n_shingles", *_SIGS)

    def likely(pairs: DataFrame) -> DataFrame:
        x = pairs.alias("p").join(info.alias("x"), F.col("p.a") == F.col("x.rep")).join(info.alias("y"), F.col("p.b") == F.col("y.rep"))
        return x.where(_plausible("x", "y", percent)).select("p.a", "p.b").distinct()

    def encode(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
        return [s.tobytes() for s in shingle_sets(buf, off, width)]

    def confirmed(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = saved(shingles_of(docs, ids, encode, id_col, text_col), "sets")
        out = saved(_confirm(pairs, sets, percent), "links")
        discard(sets)
        return out

    links = confirmed(saved(likely(first), "likely"))
    found = saved(components(links, "a", "b"), "components")

    placed = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = placed.select("c", F.explode("bands").alias("key")).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m")
    member = saved(placed.select("rep", "n_shingles", *_SIGS, "c", F.explode("bands").alias("key")).join(mixed, "key"), "mixed")
    few = member.where(F.col("m") <= MOST_PAIRED)
    x, y = few.alias("x"), few.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & _plausible("x", "y", percent)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    many = saved(member.where(F.col("m") > MOST_PAIRED).select(F.col("rep").alias("doc_id"), "c").distinct(), "many")
    if not many.isEmpty():
        sets = saved(shingles_of(docs, many.select("doc_id"), encode, id_col, text_col).join(many, "doc_id"), "sets")
        rest = rest.unionByName(likely(saved(prefix_pairs(sets, percent), "met"))).distinct()
    rest = saved(rest.join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(confirmed(rest))
    multi = saved(named.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z"), "repeated")
    if not multi.isEmpty():  # repeated ids tie classes together
        links = links.unionByName(named.join(multi.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()).unionByName(same)
    found = components(links, "a", "b")
    out = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, without those whose group of near-duplicates has a smaller id, and with one row of each id.

    Of several rows of one id that of the smallest text hash stays (ties: any). Rows of
    null id all stay, as do texts that are null or hold no word, one for each id.
    """
    groups = saved(near_duplicates(docs, width, percent, id_col, text_col).select("doc_id", "kept"), "groups")
    out = without(docs, groups.where("not kept").select(F.col("doc_id").alias(id_col)), id_col)
    again = saved(groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col)), "again")
    if again.isEmpty():
        return out
    place = fresh("place", set(docs.columns))
    rows = out.join(again, id_col, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(F.col(f"`{text_col}`")))))
    return without(out, again, id_col).unionByName(rows.where(F.col(place) == 1).select(docs.columns))
