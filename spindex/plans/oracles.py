"""SQL for the engine's queries, written for DuckDB over the same tables."""

from __future__ import annotations

from math import pi

from spindex.functions.geo import radius_boxes
from spindex.functions.text import LOWER, STOP_WORDS, UPPER, WORD, porter_stages
from spindex.plans import bindings as b

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


def _values(rows: list[tuple], name: str, columns: str) -> str:
    def one(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS {name}({columns})"


# key/value

_OPS = "ops AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)"
_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def _fold(where: str = "true") -> str:
    return f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM ops WHERE {where}) WHERE r = 1 AND op = 'put'"


_KV = {
    "kv_get": f"{_ORDERS} WHERE o_orderkey = 77",
    "kv_get_string": "SELECT c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'",
    "kv_range": f"{_ORDERS} WHERE o_orderkey BETWEEN 500 AND 510",
    "kv_range_empty": f"{_ORDERS} WHERE o_orderkey BETWEEN 510 AND 500",
    "kv_range_open": f"{_ORDERS} WHERE o_orderkey >= 1400",
    "kv_range_infinite": _ORDERS,
    "kv_scan": f"{_ORDERS} ORDER BY o_orderkey",
    "kv_size": "SELECT count(*) AS size FROM orders",
    "kv_fold_latest": f"WITH {_OPS} {_fold()}",
    "kv_snapshot_at": f"WITH {_OPS} {_fold('seq <= 500')}",
    "kv_rewind": f"WITH {_OPS} SELECT count(*) AS size FROM ({_fold('seq <= 250')})",
    "kv_boundaries": f"WITH {_OPS}, w AS (SELECT seq, op, coalesce(lag(op) OVER (PARTITION BY key ORDER BY seq) = 'put', false) AS was FROM ops) SELECT seq, CAST(sum(CASE WHEN op = 'delete' THEN -1 WHEN was THEN 0 ELSE 1 END) OVER (ORDER BY seq) AS BIGINT) AS size FROM w WHERE op = 'put' OR was",
    "kv_verify": f"WITH {_OPS}, f AS ({_fold()}) SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys, count(*) FILTER (WHERE key IS NULL) AS n_null, count(*) = count(DISTINCT key) AS ok FROM f",
    "kv_put": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -5, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 1",
    "kv_delete": f"{_ORDERS} WHERE o_custkey % 3 <> 0",
    "kv_composite_range": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey",
    "kv_key_order": "SELECT *, row_number() OVER (ORDER BY string IS NOT NULL, number, string) AS place FROM (SELECT CAST(n_nationkey AS DOUBLE) AS number, NULL::VARCHAR AS string FROM nation UNION ALL SELECT NULL, r_name FROM region)",
    "kv_key_bytes": "SELECT c_custkey, '01' || hex(encode(c_mktsegment)) || '0002' || lpad(CAST(c_custkey AS VARCHAR), 24, '0') AS key FROM customer",
}

# points


def _points(table: str = "customer", key: str = "c_custkey") -> str:
    return f"(SELECT lpad(CAST({key} AS VARCHAR), 24, '0') AS object_id, CAST(({key} * 37) % 170 - 85 + {key} * 1e-5 AS DOUBLE) AS lat, CAST(({key} * 73) % 350 - 175 + {key} * 1e-5 AS DOUBLE) AS lng FROM {table})"


def _km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    lat1, lng1, lat2, lng2 = (f"CAST({x} AS DOUBLE)" for x in (lat1, lng1, lat2, lng2))
    r = f"* CAST({pi!r} AS DOUBLE) / 180.0"
    h = f"pow(sin(({lat2} - {lat1}) {r} / 2), 2) + cos({lat1} {r}) * cos({lat2} {r}) * pow(sin(({lng2} - {lng1}) {r} / 2), 2)"
    return f"(6371.0 * 2 * atan2(sqrt(least(1.0, greatest(0.0, {h}))), sqrt(1.0 - least(1.0, greatest(0.0, {h})))))"


def _radius(lat: float, lng: float, km: float, exact: bool = False) -> str:
    boxes = " OR ".join(f"(lat BETWEEN {s!r} AND {n!r} AND lng BETWEEN {w!r} AND {e!r})" for s, n, w, e in radius_boxes(lat, lng, km))
    d = _km(repr(lat), repr(lng), "lat", "lng")
    return f"SELECT *, round({d}, 6) AS distance FROM {_points()} WHERE {d} <= {km!r}" + ("" if exact else f" AND ({boxes})")


_DOUBLED = f"(SELECT *, 0 AS seq FROM {_points()} UNION ALL SELECT object_id, lat / 2, lng, 1 FROM {_points()} WHERE CAST(object_id AS BIGINT) % 5 = 0)"
_GEO = {
    "geo_haversine": f"SELECT object_id, round({_km('48.5', '11.25', 'lat', 'lng')}, 6) AS distance FROM {_points()}",
    "geo_bbox": f"SELECT * FROM {_points()} WHERE lat BETWEEN 10 AND 40 AND lng BETWEEN -20 AND 60",
    "geo_bbox_inverted": f"SELECT * FROM {_points()} WHERE lat BETWEEN 40 AND 10 AND lng BETWEEN -20 AND 60",
    "geo_radius": _radius(20.0, 30.0, 900.0),
    "geo_radius_antimeridian": _radius(5.0, 179.5, 1500.0),
    "geo_radius_pole": _radius(84.0, 10.0, 800.0),
    "geo_radius_high": _radius(70.0, 0.0, 2000.0),
    "geo_radius_exact": _radius(70.0, 0.0, 2000.0, exact=True),
    "geo_knn": f"SELECT *, round({_km('12.0', '179.0', 'lat', 'lng')}, 6) AS distance FROM {_points()} ORDER BY {_km('12.0', '179.0', 'lat', 'lng')}, object_id LIMIT 10",
    "geo_knn_join": f"SELECT query_id, object_id, round(km, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, object_id) AS rank FROM (SELECT q.object_id AS query_id, p.object_id, {_km('q.lat', 'q.lng', 'p.lat', 'p.lng')} AS km FROM {_points('supplier', 's_suppkey')} q, {_points()} p)) WHERE rank <= 3",
    "geo_remove_first": f"SELECT * FROM {_DOUBLED} WHERE NOT (seq = 0 AND CAST(object_id AS BIGINT) % 3 = 0)",
    "geo_remove_located": f"SELECT * FROM {_DOUBLED} WHERE NOT (seq = 1 AND CAST(object_id AS BIGINT) = 20)",
    "geo_size": "SELECT count(*) AS size FROM customer",
}

# text


def _tok(source: str = "documents") -> str:
    return f"tok AS (SELECT doc_id, token, pos FROM (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM {source})) WHERE token NOT IN ({_STOP}))"


def _stem(source: str) -> str:
    """token, stem of a relation of distinct tokens."""
    plain = "(length(token) < 3 OR regexp_matches(token, '[^\\x00-\\x7F]'))"
    sql = f"SELECT token, CASE WHEN {plain} THEN '' ELSE token END AS w FROM {source}"
    for stage in porter_stages("regexp_matches"):
        sql = f"SELECT token, {stage} AS w FROM ({sql})"
    return f"SELECT token, CASE WHEN {plain} THEN token ELSE w END AS stem FROM ({sql})"


def _terms(source: str = "documents") -> str:
    """CTEs tok, voc (token, stem) and tf (doc_id, term, tf, first_pos)."""
    return f"{_tok(source)}, voc AS ({_stem('(SELECT DISTINCT token FROM tok)')}), tf AS (SELECT doc_id, stem AS term, count(*) AS tf, min(pos) AS first_pos FROM tok JOIN voc USING (token) GROUP BY ALL)"


def _bm25(terms: list[str], source: str = "documents", scored: bool = True) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
WITH {_terms(source)},
len AS (SELECT d.doc_id, count(t.token) AS length FROM (SELECT doc_id FROM {source}) d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id),
st AS (SELECT count(*) AS n, CASE WHEN sum(length) > 0 THEN sum(length) / count(*) ELSE 1 END AS mean FROM len),
hit AS (SELECT * FROM tf WHERE term IN ({listed})),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
part AS (SELECT doc_id, ln(1 + greatest(0, (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(length, 1) / mean)) AS x FROM hit JOIN df USING (term) JOIN len USING (doc_id), st)
SELECT doc_id{", round(sum(x) * (1 + count(*) / " + str(len(terms)) + ".0), 6) AS score" if scored else ""} FROM part GROUP BY doc_id
"""


#: What the queries' words become.
TERMS, ALL_TERMS = ["erin", "ant", "thth", "shing"], ["thth", "erer", "thing"]
_TXT = {
    "txt_tokens": f"WITH {_tok()} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok GROUP BY token",
    "txt_stem": f"WITH {_tok()} {_stem('(SELECT DISTINCT token FROM tok)')}",
    "txt_tf": f"WITH {_terms()} SELECT doc_id, term, tf, CAST(first_pos AS INTEGER) AS first_pos FROM tf",
    "txt_first_seen": f"WITH {_terms()} SELECT doc_id, term, tf, place FROM (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS place FROM tf)",
    "txt_bm25": _bm25(TERMS),
    "txt_bm25_ids": _bm25(TERMS, scored=False),
    "txt_require_all": f"WITH {_terms()} SELECT doc_id FROM tf WHERE term IN ({", ".join(repr(t) for t in ALL_TERMS)}) GROUP BY doc_id HAVING count(*) = 3",
    "txt_query_stop_words": "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE false",
    "txt_term_count": f"WITH {_terms()} SELECT count(DISTINCT term) AS n_terms FROM tf",
    "txt_doc_count": "SELECT count(*) AS n_documents FROM documents",
    "txt_doc_lengths": f"WITH {_tok()} SELECT d.doc_id, count(t.token) AS length FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id",
    "txt_corpus_stats": f"WITH {_tok()}, l AS (SELECT d.doc_id, count(t.token) AS length FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id) SELECT CAST(sum(length) AS BIGINT) AS total_length, round(avg(length), 6) AS mean_length FROM l",
    "txt_readd": _bm25(TERMS, "(SELECT conv_id AS doc_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)"),
    "txt_remove": _bm25(TERMS, "(SELECT * FROM documents WHERE doc_id % 4 <> 1)"),
}

# versions

_VER = "v AS (SELECT conv_id AS log_id, turn + 1 AS version, text FROM conversations)"
_VERSIONS = {
    "ver_hash": f"WITH {_VER} SELECT log_id, version, sha256(coalesce(text, '')) AS hash FROM v",
    "ver_types": f"WITH {_VER} SELECT log_id, version, CASE WHEN (version - 1) % 4 = 0 THEN 'snapshot' ELSE 'diff' END AS type FROM v",
    "ver_number": "SELECT conv_id AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version, text FROM conversations",
    "ver_get": f"WITH {_VER} SELECT * FROM v WHERE version = 3",
    "ver_current": f"WITH {_VER} SELECT log_id, max(version) AS version, arg_max(text, version) AS text FROM v GROUP BY log_id",
    "ver_tile_route": f"""
WITH RECURSIVE {_VER}, s AS (SELECT log_id, version, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM v),
r AS (SELECT log_id, version, size AS held, CAST(0 AS BIGINT) AS tile FROM s WHERE version = 1
  UNION ALL SELECT s.log_id, s.version, CASE WHEN r.held >= 300 THEN s.size ELSE r.held + s.size END, CASE WHEN r.held >= 300 THEN r.tile + 1 ELSE r.tile END
  FROM r JOIN s ON s.log_id = r.log_id AND s.version = r.version + 1)
SELECT log_id, version, tile FROM r""",
    "ver_patch_roundtrip": f"WITH {_VER} SELECT log_id, version, sha256(coalesce(text, '')) AS hash FROM v",
    "ver_delta_roundtrip": f"WITH {_VER} SELECT log_id, version, sha256(coalesce(text, '')) AS hash, true AS ok FROM v",
}

# entry log

_RAW = "raw AS (SELECT event_id AS pos, event_id + 1 - (event_id // 10) * 3 AS index, event_id // 100 + 1 AS term, CASE WHEN event_id % 50 = 49 THEN -1 ELSE 1 END AS type, props AS payload FROM events)"
_LIVE = "live AS (SELECT * FROM (SELECT *, min(index) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM raw) WHERE (later IS NULL OR index < later) AND type <> -1)"
_ENTRIES = "e AS (SELECT event_id + 1 AS index, event_id // 100 + 1 AS term, 1 AS type, props AS payload FROM events)"
_WAL = {
    "wal_fold": f"WITH {_RAW}, {_LIVE} SELECT pos, index, term, type, payload FROM live",
    "wal_fold_bounded": f"WITH {_RAW}, {_LIVE} SELECT pos, index, term, type, payload FROM live WHERE index > 20 AND index <= 400",
    "wal_gaps": f"WITH {_RAW}, r AS (SELECT *, lag(index) OVER (ORDER BY pos) AS i, lag(type) OVER (ORDER BY pos) AS t FROM raw WHERE pos % 90 <> 5) SELECT pos, index, term, type, payload FROM r WHERE index <= 0 OR index > 1 + CASE WHEN i IS NULL THEN 0 WHEN t = -1 THEN i - 1 ELSE i END",
    "wal_get": f"WITH {_ENTRIES} SELECT * FROM e WHERE index = 321",
    "wal_get_batch": f"WITH {_ENTRIES} SELECT index, term, type, payload FROM (SELECT *, coalesce(sum(strlen(coalesce(payload, ''))) OVER (ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WHERE index >= 5) WHERE before < 2000",
    "wal_verify": f"WITH {_RAW}, {_LIVE}, p AS (SELECT *, lag(index) OVER (ORDER BY index) AS pi, lag(term) OVER (ORDER BY index) AS pt FROM live) SELECT count(*) AS n_entries, min(index) AS first_index, max(index) AS last_index, bool_and(index = coalesce(pi, 0) + 1) AS contiguous, bool_and(term >= coalesce(pt, 0)) AS terms_ok FROM p",
    "wal_compact": f"WITH {_ENTRIES} SELECT * FROM e WHERE index > 600",
    "wal_term_at": f"WITH {_ENTRIES} SELECT index, term FROM e WHERE index IN (1, 100, 101, 950)",
    "wal_hard_state": """
WITH a AS (SELECT user_id AS node, event_id AS seq, event_id // 2000 + event_id % 3 AS term, event_id % 4 AS candidate FROM events),
t AS (SELECT *, term >= coalesce(max(term) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS timely FROM a),
f AS (SELECT node, term, arg_min(candidate, seq) AS holder, min(seq) AS since FROM t WHERE timely AND candidate <> 0 GROUP BY node, term)
SELECT t.node, t.seq, t.term, t.candidate, timely AND (candidate = 0 OR holder IS NULL OR seq <= since OR candidate = holder) AS granted FROM t LEFT JOIN f USING (node, term)
""",
}

# snapshots

_L = f"l AS (SELECT name, CAST(size AS BIGINT) AS size FROM {_values(b.LISTING, 'x', 'name, size')})"
_C = f"""{_L}, c AS (SELECT *, CASE
  WHEN regexp_matches(name, '^state-(0|[1-9][0-9]*)\\.manifest\\.bj$') THEN 'manifest'
  WHEN regexp_matches(name, '^state-log-(0|[1-9][0-9]*)\\.bj$') THEN 'log'
  WHEN regexp_matches(name, '^state-(0|[1-9][0-9]*)-[A-Za-z0-9_-]+\\.bj$') THEN 'data' ELSE 'other' END AS kind FROM l),
g AS (SELECT name, size, kind, CASE WHEN kind <> 'other' THEN CAST(regexp_extract(name, '^state-(?:log-)?([0-9]+)', 1) AS BIGINT) END AS generation,
  CASE WHEN kind = 'data' THEN regexp_extract(name, '^state-[0-9]+-(.*)\\.bj$', 1) END AS role FROM c)"""
_M = f"m AS (SELECT CAST(generation AS BIGINT) AS generation, role, size FROM {_values(b.MANIFEST, 'x', 'generation, role, size')})"
_CHECK = f"e AS (SELECT * FROM {_values(b.EXPECTED, 'x', 'role, size, crc, pos')}), a AS (SELECT * FROM {_values(b.ACTUAL, 'x', 'role, size, crc')}), bad AS (SELECT e.role, e.pos FROM e LEFT JOIN a ON a.role = e.role WHERE a.role IS NULL OR a.size <> e.size OR a.crc <> e.crc)"
_SNAP = {
    "snap_classify": f"WITH {_C} SELECT * FROM g",
    "snap_candidates": f"WITH {_C} SELECT generation FROM g WHERE kind = 'manifest'",
    "snap_adopt": f"WITH {_C}, {_M} SELECT max(g.generation) AS generation FROM g WHERE kind = 'manifest' AND NOT EXISTS (SELECT 1 FROM m LEFT JOIN g f ON f.kind = 'data' AND f.generation = m.generation AND f.role = m.role WHERE m.generation = g.generation AND (f.size IS NULL OR f.size <> m.size))",
    "snap_sweep": f"WITH {_C} SELECT name FROM g WHERE kind IN ('data', 'manifest') AND generation <> 2",
    "snap_prune": f"WITH {_C} SELECT name FROM g WHERE kind = 'log' AND generation <> 7",
    "snap_log_candidates": f"WITH {_C} SELECT name, generation FROM g WHERE kind = 'log'",
    "snap_check_files": f"WITH {_CHECK} SELECT role, pos FROM bad",
    "snap_first_mismatch": f"WITH {_CHECK} SELECT arg_min(role, pos) AS bad_role FROM bad",
    "snap_next_gen": f"WITH {_C} SELECT coalesce(max(generation), 0) + 1 AS next_generation FROM g",
}

# stored tables

_HIT = _bm25(TERMS, "(SELECT * FROM documents WHERE doc_id % 4 <> 1)")
_STORED = {
    "kv_key_dates": "SELECT o_orderkey, '038' || lpad(to_hex(epoch_ms(o_orderdate)), 15, '0') AS key FROM orders",
    "kv_stored": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END AS value, CAST(9 AS BIGINT) AS applied_index FROM orders WHERE o_orderkey % 5 <> 0",
    "geo_stored": f"SELECT p.*, CAST(3 AS BIGINT) AS applied_index FROM {_points()} p WHERE CAST(object_id AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT object_id, lat / 2, lng, 3 FROM {_points('supplier', 's_suppkey')}",
    "txt_stored": f"SELECT CAST(doc_id AS VARCHAR) AS id, score, CAST(7 AS BIGINT) AS applied_index FROM ({_HIT})",
    "ver_stored": "SELECT conv_id AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version, text FROM conversations",
    "wal_stored": "SELECT index, CASE WHEN index = 91 THEN 3 ELSE 1 + (index - 1) // 40 END AS term, CASE WHEN index = 91 THEN 'again' ELSE 'entry ' || (index - 1) END AS payload, CAST(10 AS BIGINT) AS base_index, CAST(91 AS BIGINT) AS last_index, CAST(60 AS BIGINT) AS commit_index, CAST(1 AS BIGINT) AS voted_for FROM (SELECT unnest(generate_series(11, 91)) AS index)",
    "stream_applied": f"WITH {_OPS} SELECT *, (SELECT max(event_id) + 1 FROM events) AS applied_index FROM ({_fold()})",
}

ORACLES: dict[str, str] = {**_STORED, **_KV, **_GEO, **_TXT, **_VERSIONS, **_WAL, **_SNAP}
