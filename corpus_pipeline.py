"""A corpus pipeline over ``documents``: quality, line dedup, near-dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet
and read again as the next stage's docs, and what a stage wrote on its way is deleted
then. All but the last return the columns of documents, whatever further ones there are.
No rows give no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.llm.common import saved, scratch, table
from spindex.llm.decontaminate import drop_contaminated
from spindex.llm.lines import drop_boilerplate
from spindex.llm.neardup import keep_first
from spindex.llm.packing import pack
from spindex.llm.quality import fit_and_keep
from spindex.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Every row is judged by its text and language alone, so equal rows and rows of one id
    fare as their texts do, and a null id matters to training only (see ``fit``). Null and
    empty texts stay. A figure equal to the limit is kept.
    """
    return fit_and_keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents; n_chars follows.

    Documents still hold their copies here, so equal texts count once, and a line must
    lie on more than 5 % of a source's texts (ordinary lines of sf0.1: up to 4.7 %), on
    three or more; one at exactly 5 % stays. No row goes: a text of boilerplate alone
    becomes empty, null texts stay null (n_chars too), rows of null source are left as
    they are, ids play no part.
    """
    cut = drop_boilerplate(docs, ratio=0.05, distinct=True).drop("n_lines", "n_dropped")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id.

    Rows of one id are one document, of which one row stays (the smallest text hash; ties:
    any). Null and empty texts are in no group and stay, as do all rows of null id.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Every row is judged by its own text, rows of null or repeated ids too; null and empty
    texts stay; null and empty items hold no passage.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are the end id alone; null and repeated ids are rows of their
    own; ties of length go by id, piece, digest and start.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), name, keep=True)
    return docs
