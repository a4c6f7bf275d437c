"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindex.llm.common import table

TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.language import identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.secrets import learn, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.lines import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.quality import fit_and_classify

    return fit_and_classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_posting_lists": op6_posting_lists,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "pipeline": pipeline,
}

def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLES: dict[str, str] = {
    "op6_posting_lists": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_line_dedup": """
WITH l AS (SELECT doc_id, source, line, i FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
f AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE line <> '' GROUP BY source, line),
b AS (SELECT f.source, f.line FROM f JOIN t USING (source) WHERE n >= 3 AND n > pages * 0.01)
SELECT d.doc_id, CAST(coalesce(count(l.i), 0) AS BIGINT) AS n_lines, CAST(count(b.line) AS BIGINT) AS n_dropped,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL), '') END AS text
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN b ON b.source = l.source AND b.line = l.line GROUP BY d.doc_id
""",
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_lower("text")}, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) = 1 THEN [ws[1]]
                             ELSE list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
""",
    "op5_decontamination": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce({_lower("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(8, len(ws)) AS size, array_to_string(ws[i : i + least(8, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(8, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM w, sizes WHERE len(ws) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
