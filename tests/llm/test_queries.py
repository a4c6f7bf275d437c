import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindex.llm import queries
from spindex.llm.common import table
from spindex.llm.decontaminate import decontaminate
from spindex.llm.neardup import near_duplicates

from .helpers import prose

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.9f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    sql = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(sql.columns)
    want = sorted(tuple(plain(x) for _, x in sorted(zip(sql.columns, r, strict=True))) for r in sql.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, docs, SF), name)
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids
        if name == "quality_classifier":
            good = {i for i, r in labels.items() if r.quality == 1 and not r.toxic}
            assert len(good - kept) <= 0.05 * len(good) + 1
        elif name == "line_dedup":
            assert kept == ids and out.where("n_chars <> length(text)").isEmpty()
        elif name == "minhash_near_dedup":
            assert near_duplicates(out).where("not kept").isEmpty()
            assert {r.component_id for r in near_duplicates(docs).collect()} == kept
        elif name == "benchmark_decontamination":
            assert decontaminate(out, table(spark, SF, "benchmark")).where("n_items > 0").isEmpty()
        elif name == "best_fit_packing":
            assert kept == ids and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()
            break
        assert out.columns == names
        docs, ids = out, kept


def test_quality_stage_tells_words_that_no_good_text_holds(spark, tmp_path):
    rng = random.Random(33)
    kinds = ["".join(rng.choices("бвгджзклмнпрст", k=3)) + rng.choice(["ать", "ого", "ами"]) for _ in range(60)]
    texts = [" ".join(rng.choices(kinds, k=50)) for _ in range(240)]
    after = {}  # junk has the pairs of letters of good text, but other words
    for t in texts:
        for x, y in zip(t, t[1:], strict=False):
            after.setdefault(x, []).append(y)
    for _ in range(40):
        x = [" "]
        while len(x) < 340:
            x.append(rng.choice(after[x[-1]]))
        texts.append("".join(x[1:]))
    spark.createDataFrame([(i, 1, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "ru", "s", len(t), i, i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, part int, side int")
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and len(kept & set(range(160, 240))) >= 76 and max(kept) < 240


def test_copies_leave_one_whole_document(spark):
    body = "\n".join(f"line {k} of an ordinary text that was copied {k * k}" for k in range(8))
    rows = []
    for i in range(80):
        own = "\n".join(f"page {i} says {k} and {i * k + 7} more things" for k in range(4))
        rows.append((i, body if i % 8 == 3 else "the menu of the site\n" + own if i % 2 else own, "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    cut = corpus_pipeline.saved(corpus_pipeline.line_dedup(spark, docs, SF), "cut")
    got = {r.doc_id: r.text for r in cut.collect()}
    assert all(got[i] == t.removeprefix("the menu of the site\n") for i, t, _, _ in rows)
    left = corpus_pipeline.near_dedup(spark, cut, SF).collect()
    assert [r.doc_id for r in left if r.text == body] == [3] and all(r.text for r in left)


def test_stages_have_defined_results(spark):
    rng = random.Random(3)
    item = table(spark, SF, "benchmark").where("length(text) > 100").first().text
    body = prose(rng, 80, 10**6)
    rows = [(None, body), (None, f"{prose(rng, 30)} {item}"), (3, body), (3, body), (3, prose(rng, 60, 10**6, "q")), (4, body + " tail"), (5, None), (6, ""), (6, ""), (7, f"{item} {prose(rng, 9)}"), (8, "lang " * 60_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `key` int, kept int, `_lines` int")
    near = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in near.collect()) == [-1, -1, 3, 5, 6, 7, 8]
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in clean.collect()) == sorted((i or -1, len(t or "")) for i, t in rows if item not in (t or ""))
    cut = corpus_pipeline.line_dedup(spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == len(rows) and cut.where("doc_id = 5").first().n_chars is None
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns and {5, 6} <= {r.doc_id for r in good.collect()}
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert packed.where("piece = 0").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run_leaves_its_stages_alone(spark):
    import pathlib

    from spindex.llm.common import shared_dir

    folder = pathlib.Path(shared_dir(spark))
    before = {p.name for p in folder.glob("spindex-*")}
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len({p.name for p in folder.glob("spindex-*")} - before) == len(corpus_pipeline.STAGES)
