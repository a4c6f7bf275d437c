"""The engine's queries over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindex.functions import diffing, geo, keys, text
from spindex.operators import entrylog, fulltext, kv, snapshots, spatial
from spindex.operators import versions as ver
from spindex.operators.stored import EntryLog, KVStore, PointStore, VersionStore
from spindex.plans import bindings as b
from spindex.sources.tables import Namespace, file_checksums
from spindex.streaming.apply import Applier

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORDS = "Erin anting, of the THTH shing erin"
ALL_WORDS = "thth erer thing"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _orders(s: SparkSession, d: str) -> kv.KVTable:
    return kv.KVTable(b.read(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query
def kv_get(s, d):
    return _orders(s, d).get(77)


@query
def kv_get_string(s, d):
    return kv.KVTable(b.read(s, d, "customer").select("c_name", "c_acctbal"), "c_name").get("Customer#000000042")


@query
def kv_range(s, d):
    return _orders(s, d).range(500, 510)


@query
def kv_range_empty(s, d):
    return _orders(s, d).range(510, 500)


@query
def kv_range_open(s, d):
    return _orders(s, d).range(low=1400)


@query
def kv_range_infinite(s, d):
    return _orders(s, d).range(float("-inf"), float("inf"))


@query
def kv_scan(s, d):
    return _orders(s, d).scan()


@query
def kv_size(s, d):
    return _orders(s, d).rows.agg(F.count(F.lit(1)).alias("size"))


@query
def kv_fold_latest(s, d):
    return kv.fold(b.operations(s, d))


@query
def kv_snapshot_at(s, d):
    return kv.snapshot_at(b.operations(s, d), 500)


@query
def kv_rewind(s, d):
    return kv.fold(kv.rewind(b.operations(s, d), 250)).agg(F.count(F.lit(1)).alias("size"))


@query
def kv_boundaries(s, d):
    return kv.boundaries(b.operations(s, d))


@query
def kv_verify(s, d):
    return kv.KVTable.from_log(b.operations(s, d)).verify()


@query
def kv_put(s, d):
    table = _orders(s, d)
    more = table.rows.where("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", F.lit(1.5).alias("o_totalprice")).unionByName(table.rows.where("o_orderkey = 1").select(F.lit(-5).cast("long").alias("o_orderkey"), "o_custkey", "o_totalprice"))
    return table.put(more).rows


@query
def kv_delete(s, d):
    table = _orders(s, d)
    return table.delete(table.rows.where("o_custkey % 3 = 0").select("o_orderkey")).rows


@query
def kv_composite_range(s, d):
    rows = b.read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return kv.composite_range(rows, {"o_custkey": 7}, ["o_orderkey"])


@query
def kv_key_order(s, d):
    """Mixed keys in order, with their places."""
    n = b.read(s, d, "nation").select(F.col("n_nationkey").cast("double").alias("number"), F.lit(None).cast("string").alias("string"))
    r = b.read(s, d, "region").select(F.lit(None).cast("double").alias("number"), F.col("r_name").alias("string"))
    by = Window.orderBy(F.col("string").isNotNull(), "number", "string")  # thirty keys
    return kv.mixed_order(n.unionByName(r), "number", "string").withColumn("place", F.row_number().over(by).cast("long"))


@query
def kv_key_bytes(s, d):
    """The byte form of a composite key (string, id), in hexadecimal digits."""
    key = F.concat(keys.string_part_column(F.col("c_mktsegment")), keys.id_part_column(F.lpad(F.col("c_custkey").cast("string"), 24, "0")))
    return b.read(s, d, "customer").select("c_custkey", F.hex(key).alias("key"))


@query
def kv_key_numbers(s, d):
    """The byte form of a number, in hexadecimal digits."""
    return b.read(s, d, "customer").select("c_custkey", F.hex(keys.number_part_column(F.col("c_acctbal"))).alias("key"))


@query
def geo_haversine(s, d):
    return b.points(s, d).select("object_id", F.round(geo.haversine_km(48.5, 11.25, "lat", "lng"), 6).alias("distance"))


@query
def geo_bbox(s, d):
    return spatial.search_box(b.points(s, d), 10.0, 40.0, -20.0, 60.0)


@query
def geo_bbox_inverted(s, d):
    return spatial.search_box(b.points(s, d), 40.0, 10.0, -20.0, 60.0)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query
def geo_radius(s, d):
    return _rounded(spatial.search_radius(b.points(s, d), 20.0, 30.0, 900.0))


@query
def geo_radius_antimeridian(s, d):
    return _rounded(spatial.search_radius(b.points(s, d), 5.0, 179.5, 1500.0))


@query
def geo_radius_pole(s, d):
    return _rounded(spatial.search_radius(b.points(s, d), 84.0, 10.0, 800.0))


@query
def geo_radius_high(s, d):
    return _rounded(spatial.search_radius(b.points(s, d), 70.0, 0.0, 2000.0))


@query
def geo_radius_exact(s, d):
    return _rounded(spatial.search_radius(b.points(s, d), 70.0, 0.0, 2000.0, exact=True))


@query
def geo_knn(s, d):
    return _rounded(spatial.nearest(b.points(s, d), 12.0, 179.0, 10))


@query
def geo_knn_join(s, d):
    asks = b.points(s, d, "supplier", "s_suppkey").withColumnRenamed("object_id", "query_id")
    return _rounded(spatial.nearest_join(asks, b.points(s, d), 3))


def _doubled(s, d) -> DataFrame:
    """Every fifth point twice, the second time elsewhere."""
    p = b.points(s, d).withColumn("seq", F.lit(0))
    return p.unionByName(p.where(F.col("object_id").cast("long") % 5 == 0).select("object_id", (F.col("lat") / 2).alias("lat"), "lng", F.lit(1).alias("seq")))


@query
def geo_remove_first(s, d):
    p = _doubled(s, d)
    return spatial.remove_first(p, p.where(F.col("object_id").cast("long") % 3 == 0), "seq")


@query
def geo_remove_located(s, d):
    p = _doubled(s, d)
    lat, lng = (20 * 37) % 170 - 85 + 20 * 1e-5, (20 * 73) % 350 - 175 + 20 * 1e-5
    return spatial.remove_located(p, "20".zfill(24), lat / 2, lng, "seq")


@query
def geo_size(s, d):
    return b.points(s, d).agg(F.count(F.lit(1)).alias("size"))


@query
def txt_tokens(s, d):
    return text.tokens(b.read(s, d, "documents"), "doc_id").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query
def txt_stem(s, d):
    return text.stemmed(text.tokens(b.read(s, d, "documents"), "doc_id").select("token").distinct())


@query
def txt_tf(s, d):
    return fulltext.postings(b.read(s, d, "documents"))


@query
def txt_first_seen(s, d):
    return fulltext.term_positions(b.read(s, d, "documents")).withColumn("place", F.col("place").cast("long"))


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query
def txt_bm25(s, d):
    return _scored(fulltext.bm25(b.read(s, d, "documents"), WORDS))


@query
def txt_bm25_ids(s, d):
    return fulltext.bm25(b.read(s, d, "documents"), WORDS, scored=False)


@query
def txt_require_all(s, d):
    return fulltext.require_all(b.read(s, d, "documents"), ALL_WORDS)


@query
def txt_query_stop_words(s, d):
    return fulltext.bm25(b.read(s, d, "documents"), "of the and")


@query
def txt_term_count(s, d):
    return fulltext.term_count(b.read(s, d, "documents"))


@query
def txt_doc_count(s, d):
    return b.read(s, d, "documents").agg(F.count(F.lit(1)).alias("n_documents"))


@query
def txt_doc_lengths(s, d):
    return fulltext.lengths(b.read(s, d, "documents"))


@query
def txt_corpus_stats(s, d):
    return fulltext.lengths(b.read(s, d, "documents")).agg(F.sum("length").cast("long").alias("total_length"), F.round(F.avg("length"), 6).alias("mean_length"))


@query
def txt_readd(s, d):
    """Conversations as documents that are added again with every turn: the last text holds."""
    rows = b.read(s, d, "conversations").withColumnRenamed("conv_id", "doc_id")
    return _scored(fulltext.bm25(fulltext.newest(rows, "doc_id", "turn"), WORDS))


@query
def txt_remove(s, d):
    docs = b.read(s, d, "documents")
    return _scored(fulltext.bm25(docs.join(docs.where("doc_id % 4 = 1").select("doc_id"), "doc_id", "left_anti"), WORDS))


@query
def ver_hash(s, d):
    return b.versions(s, d).select("log_id", "version", ver.text_hash(F.col("text")).alias("hash"))


@query
def ver_types(s, d):
    return b.versions(s, d).select("log_id", "version", ver.kind(F.col("version"), 3).alias("type"))


@query
def ver_number(s, d):
    return ver.number_versions(b.read(s, d, "conversations"), "conv_id", "turn")


@query
def ver_get(s, d):
    return ver.get_version(b.versions(s, d), 3)


@query
def ver_current(s, d):
    return ver.current(b.versions(s, d))


@query
def ver_tile_route(s, d):
    rows = b.versions(s, d)
    return ver.route(rows, ver.tiles(rows, 300))


@query
def ver_diff(s, d):
    return ver.diff(b.versions(s, d), 1, 2)


@query
def ver_patch_roundtrip(s, d):
    """Every version rebuilt from the one before by a patch."""
    rows = ver.with_previous(b.versions(s, d)).withColumn("previous", F.coalesce("previous", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rebuilt = diffing.apply_patch_udf("previous", diffing.create_patch_udf(F.lit("turn"), "previous", "text"))
    return rows.select("log_id", "version", F.sha2(rebuilt, 256).alias("hash"))


@query
def ver_delta_roundtrip(s, d):
    """Every version rebuilt from its chain of snapshots and deltas."""
    rows = ver.decode_chain(ver.encode_chain(b.versions(s, d), 3))
    return rows.select("log_id", "version", F.sha2("text", 256).alias("hash"), "ok")


@query
def wal_fold(s, d):
    return entrylog.fold(b.raw_records(s, d))


@query
def wal_fold_bounded(s, d):
    return entrylog.fold(b.raw_records(s, d), last_index=400, base_index=20)


@query
def wal_gaps(s, d):
    return entrylog.gaps(b.raw_records(s, d).where("pos % 90 <> 5"))


@query
def wal_get(s, d):
    return entrylog.get(b.entries(s, d), 321)


@query
def wal_get_batch(s, d):
    return entrylog.get_batch(b.entries(s, d), 5, 2000)


@query
def wal_verify(s, d):
    return entrylog.verify(entrylog.fold(b.raw_records(s, d)))


@query
def wal_compact(s, d):
    return entrylog.compact(b.entries(s, d), 600, 6)


@query
def wal_term_at(s, d):
    log = b.entries(s, d)
    return s.createDataFrame([(i, entrylog.term_at(log, i)) for i in (1, 100, 101, 950)], "index long, term long")


@query
def wal_hard_state(s, d):
    e = F.col("event_id")
    asks = b.read(s, d, "events").select(F.col("user_id").alias("node"), e.alias("seq"), (F.floor(e / 2000) + e % 3).alias("term"), (e % 4).alias("candidate"))
    return entrylog.vote_history(asks)


@query
def kv_key_dates(s, d):
    """The byte form of a date, in hexadecimal digits."""
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return b.read(s, d, "orders").select("o_orderkey", F.hex(keys.long_part_column(millis, b"\x03")).alias("key"))


@query
def kv_stored(s, d):
    """Orders put, some replaced and some deleted, each change a commit; the live rows and the last entry applied."""
    rows = b.read(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    made = KVStore.create(s, b.scratch(s))
    made.put(rows, applied=3)
    made.put(rows.where("key % 7 = 0").withColumn("value", F.lit("changed")), applied=4)
    made.delete(rows.where("key % 5 = 0").select("key"), applied=9)
    made.compact()
    return made.table().rows.withColumn("applied_index", F.lit(made.store.applied_index).cast("long"))


@query
def geo_stored(s, d):
    """Points inserted twice and removed once, cleared, and the state before that called back."""
    made = PointStore(s, b.scratch(s))
    made.insert(b.points(s, d), applied=1)
    made.insert(b.points(s, d, "supplier", "s_suppkey").withColumn("lat", F.col("lat") / 2), applied=2)
    made.remove(b.points(s, d, "supplier", "s_suppkey").select("object_id"), applied=3)
    held = made.store.versions()[-1]
    made.clear(applied=4)
    made.rewind(held)
    return made.points().select("object_id", "lat", "lng", F.lit(made.store.applied_index).cast("long").alias("applied_index"))


@query
def txt_stored(s, d):
    """BM25 from stored postings after documents were removed."""
    docs = b.read(s, d, "documents")
    index = fulltext.TextIndex(Namespace(s, b.scratch(s))).build(docs)
    index.remove(docs.where("doc_id % 4 = 1").select("doc_id"), applied=7)
    return _scored(index.query(WORDS)).withColumn("applied_index", F.lit(index.applied_index).cast("long"))


@query
def ver_stored(s, d):
    """Versions added in two changes are numbered on."""
    turns = b.read(s, d, "conversations").select(F.col("conv_id").alias("log_id"), "text", F.col("turn").alias("seq"))
    made = VersionStore(s, b.scratch(s))
    made.add(turns.where("seq < 2"))
    made.add(turns.where("seq >= 2"))
    return made.rows()


@query
def wal_stored(s, d):
    """A stored log: appends, a cut, a vote, a commit, and compaction, each refused where it must be."""
    log = EntryLog(s, b.scratch(s))
    log.set_hard_state(3, 1)
    log.append([(1 + i // 40, f"entry {i}") for i in range(100)])
    log.truncate_from(91)
    log.append([(3, "again")])
    log.set_commit_index(60)
    log.compact(10, 1)
    now = log.state
    return log.live().select("index", "term", "payload", *[F.lit(getattr(now, c)).cast("long").alias(c) for c in ("base_index", "last_index", "commit_index", "voted_for")])


@query
def stream_applied(s, d):
    """Batches of entries, some overlapping and one replayed, applied once each."""
    entries = b.operations(s, d).select((F.col("seq") + 1).alias("index"), "key", "op", "value")
    sink = Applier(Namespace(s, b.scratch(s)), "log")
    for number, (low, high) in enumerate([(0, 400), (0, 700), (0, 700), (650, 1 << 40)]):
        sink(entries.where(f"index > {low} and index <= {high}"), min(number, 2))
    sink(entries.where("index > 650"), 3)
    return kv.fold(sink.log()).withColumn("applied_index", F.lit(sink.applied_index()).cast("long"))


@query
def snap_classify(s, d):
    return snapshots.classify(b.listing(s), b.PREFIX)


@query
def snap_candidates(s, d):
    return snapshots.candidates(b.listing(s), b.PREFIX)


@query
def snap_adopt(s, d):
    return snapshots.adopted(b.listing(s), b.manifest(s), b.PREFIX)


@query
def snap_sweep(s, d):
    return snapshots.sweep(b.listing(s), 2, b.PREFIX)


@query
def snap_prune(s, d):
    return snapshots.prune_logs(b.listing(s), 7, b.PREFIX)


@query
def snap_log_candidates(s, d):
    return snapshots.log_candidates(b.listing(s), b.PREFIX)


@query
def snap_check_files(s, d):
    return snapshots.check_files(b.actual(s), b.expected(s))


@query
def snap_first_mismatch(s, d):
    return snapshots.first_mismatch(b.actual(s), b.expected(s))


@query
def snap_next_gen(s, d):
    return snapshots.next_generation(b.listing(s), b.PREFIX)


@query
def crc_files(s, d):
    return file_checksums(s, d, "{nation,region}.parquet")
