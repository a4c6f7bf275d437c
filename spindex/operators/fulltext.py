"""Full-text search: BM25, all-terms search, statistics.

Two ways to ask: straight over documents, where one pass counts each query term per
document (tokens are aggregated before the shuffle, and only tokens that could match
are stemmed), or over a ``TextIndex`` of written postings, where a query reads the
postings of its terms alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindex.functions.text import Stems, is_stop_word, stemmed, stemmed_distinct, token_array, token_bytes, tokens
from spindex.sources.store import APPLIED
from spindex.sources.tables import Namespace

K1, B = 1.2, 0.75
#: Word forms of a query's terms that are written into the plan; beyond that their occurrences are joined by a shuffle.
MOST_FORMS = 5_000
#: Rows of postings that a worker holds before it hands them on.
MOST_HELD = 100_000
#: Ids that are broadcast to be removed from an index; beyond that they are joined by a shuffle.
MOST_REMOVED = 1_000_000


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """The distinct stems of a query, in order of first appearance."""
    rows = stemmed(tokens(spark.createDataFrame([(0, text)], "id int, text string"), "id"))
    return [r[0] for r in rows.groupBy("stem").agg(F.min("pos").alias("pos")).orderBy("pos").select("stem").collect()]


def newest(docs: DataFrame, id_col: str, seq_col: str, text_col: str = "text") -> DataFrame:
    """The last text of each id: adding an id again replaces it."""
    return docs.groupBy(id_col).agg(F.max_by(text_col, seq_col).alias(text_col))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, term, tf, first_pos and place of each row's terms, in order of first appearance."""
    stems = Stems()
    for batch in batches:
        row, terms, counts, positions, places = [], [], [], [], []

        def made(ids=batch.column(0)):
            columns = [ids.take(pa.array(row, pa.int64())), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(positions, pa.int32()), pa.array(places, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["id", "term", "tf", "first_pos", "place"])

        for r, text in enumerate(batch.column(1)):
            found = token_bytes(_valid(text.as_py()))
            first = dict(zip(reversed(found), range(len(found) - 1, -1, -1), strict=True))
            tf: dict[bytes, int] = {}
            own = []
            for token, n in Counter(found).items():  # by first appearance
                stem = stems[token]
                if stem is not None:
                    if stem in tf:
                        tf[stem] += n
                    else:
                        tf[stem] = n
                        own.append(first[token])
            row += [r] * len(own)
            terms += tf
            counts += tf.values()
            positions += own
            places += range(1, len(own) + 1)
            if len(row) >= MOST_HELD:
                yield made()
                row, terms, counts, positions, places = [], [], [], [], []
        if row:
            yield made()


def _valid(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()


def _document_terms(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """id, term, tf, first_pos, place of each row's terms, and whether some id has several rows.

    A row's terms are counted within it, without a shuffle: a vocabulary grows with the
    documents, so to join it costs more than to stem a token where it stands.
    """
    key = F.col(f"`{id_col}`").alias("id")
    rows = docs.select(key, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("first_pos", T.IntegerType()), T.StructField("place", T.IntegerType())])
    repeated = not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return rows.mapInArrow(_listed, out).withColumnRenamed("id", id_col), repeated


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, tf, first_pos; rows of one id are added up."""
    rows, repeated = _document_terms(docs, id_col, text_col)
    if not repeated:
        return rows.drop("place")
    return rows.groupBy(F.col(f"`{id_col}`"), "term").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, length: the number of tokens that aren't stop words, 0 for empty and null texts; no shuffle."""
    n = F.size(F.filter(token_array(F.col(f"`{text_col}`")), lambda t: ~is_stop_word(t)))
    return docs.select(F.col(f"`{id_col}`"), n.cast("long").alias("length"))


def term_count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: the number of distinct terms."""
    return stemmed(tokens(docs, id_col, text_col).select("token").distinct()).agg(F.count_distinct("stem").alias("n_terms"))


def _among(words: list[str]):
    return lambda t: t.isin(*words)


def _forms(docs: DataFrame, terms: list[str], text_col: str) -> dict[str, list[str]] | None:
    """The documents' tokens whose stem is a term, by term; None if they are more than ``MOST_FORMS``. A stem begins as its token does."""
    starts = sorted({t[0] for t in terms})
    likely = F.filter(token_array(F.col(f"`{text_col}`")), lambda t: F.substring(t, 1, 1).isin(*starts) & ~is_stop_word(t))
    words = docs.select(F.explode(F.array_distinct(likely)).alias("token")).distinct()
    rows = stemmed(words).where(F.col("stem").isin(*terms)).select("token", "stem").take(MOST_FORMS + 1)
    if len(rows) > MOST_FORMS:
        return None
    out: dict[str, list[str]] = {t: [] for t in terms}
    for r in rows:
        out[r.stem].append(r.token)
    return out


def _term_counts(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, length and the frequency of each query term, for all documents.

    The distinct tokens that could match are stemmed once; the few that do are counted
    within each document's own row, without a shuffle. Rows of one id are documents of
    their own (see ``newest`` for replacing them).
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), token_array(F.col(f"`{text_col}`")).alias("all"))
    length = F.size(F.filter("all", lambda t: ~is_stop_word(t))).cast("long").alias("length")
    forms = _forms(docs, terms, text_col)
    if forms is not None:
        counts = [F.size(F.filter("all", _among(own))) if own else F.lit(0) for own in forms.values()]
        return rows.select("id", length, *[n.cast("long").alias(f"tf{k}") for k, n in enumerate(counts)])
    starts = sorted({t[0] for t in terms})
    likely = F.filter("all", lambda t: F.substring(t, 1, 1).isin(*starts) & ~is_stop_word(t))
    hits = stemmed_distinct(rows.select("id", F.explode(likely).alias("token"))).where(F.col("stem").isin(*terms))
    counted = hits.groupBy("id").agg(*[F.count(F.when(F.col("stem") == t, 1)).alias(f"tf{k}") for k, t in enumerate(terms)])
    return rows.select("id", length).join(counted, "id", "left")


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", scored: bool = True) -> DataFrame:
    """id and score of the documents that hold any term of the query, best first, ties by id; ids alone if not ``scored``.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)), never below ln 1; N counts empty documents
    too; a length of 0 counts as 1; each term counts once however often the query has
    it; the sum is multiplied by one plus the share of the query's terms that matched.
    """
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        out = docs.select(F.col(f"`{id_col}`"), F.lit(0.0).alias("score")).limit(0)
        return out if scored else out.drop("score")
    rows = _term_counts(docs, terms, id_col, text_col).persist()  # a few numbers a document, read for the totals and for the scores
    tf = [F.coalesce(f"tf{k}", F.lit(0)) for k in range(len(terms))]
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), *[F.count(F.when(f > 0, 1)).alias(f"df{k}") for k, f in enumerate(tf)])
    both = rows.where(sum(tf) > 0).crossJoin(F.broadcast(totals))  # one row
    mean = F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0)
    norm = F.lit(K1) * (1 - B + B * F.greatest("length", F.lit(1)) / mean)
    score, matched = F.lit(0.0), F.lit(0)
    for k, f in enumerate(tf):
        odds = (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)
        score = score + F.log1p(F.greatest(F.lit(0.0), odds)) * f * (K1 + 1) / (f + norm)
        matched = matched + F.when(f > 0, 1).otherwise(0)
    out = both.select(F.col("id").alias(id_col), (score * (1 + matched / F.lit(float(len(terms))))).alias("score")).orderBy(F.desc("score"), id_col)
    return out if scored else out.select(id_col)


def require_all(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the documents that hold every term of the query, in order; none for a query without terms."""
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.select(F.col(f"`{id_col}`")).limit(0)
    rows = _term_counts(docs, terms, id_col, text_col)
    for k in range(len(terms)):
        rows = rows.where(F.col(f"tf{k}") > 0)
    return rows.select(F.col("id").alias(id_col)).orderBy(id_col)


class TextIndex:
    """Postings and lengths, the postings partitioned by term and sorted by it, as two parts of one versioned table.

    Partitions are by hash: bounds of ranges would be found by making all postings once more.

    Every change commits both at once, together with the index of the log entry it
    applies, if one is given.
    """

    def __init__(self, space: Namespace, name: str = "text"):
        self.space, self.name = space, name
        self.stored = space.store(name)

    def _table(self, part: str) -> DataFrame:
        return self.stored.read(part)

    @property
    def applied_index(self) -> int:
        return self.stored.applied_index

    def _commit(self, listed: DataFrame, sizes: DataFrame, base: dict, applied: int | None, ordered: bool = False) -> TextIndex:
        """``ordered`` rows are written as they come: those of a stored index less some, joined by a broadcast, keep their order."""
        parts = {"postings": listed, "lengths": sizes} if ordered else {"postings": listed.repartition("term").sortWithinPartitions("term", "id"), "lengths": sizes.repartition("id").sortWithinPartitions("id")}
        self.stored.commit(replace=parts, values={} if applied is None else {APPLIED: applied}, base=base)
        return self

    def _own(self, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        own = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
        return own, postings(own, "id", "text").select("id", "term", "tf"), lengths(own, "id", "text")

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", applied: int | None = None) -> TextIndex:
        """Replaces the index; null ids are refused by leaving them out, and ids are strings."""
        base = self.stored.state()
        return self._commit(*self._own(docs, id_col, text_col)[1:], base, applied)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", applied: int | None = None) -> TextIndex:
        """Adds documents; those already there are replaced."""
        return self._keep(*self._own(docs, id_col, text_col), applied)

    def remove(self, ids: DataFrame, id_col: str = "doc_id", applied: int | None = None) -> TextIndex:
        """Removes the listed ids; absent ones change nothing."""
        return self._keep(ids.select(F.col(f"`{id_col}`").cast("string").alias("id")), None, None, applied)

    def _keep(self, gone: DataFrame, more_postings: DataFrame | None, more_lengths: DataFrame | None, applied: int | None) -> TextIndex:
        base, gone = self.stored.state(), gone.select("id").distinct()
        few = gone.limit(MOST_REMOVED + 1).count() <= MOST_REMOVED
        out = []
        for part, more in (("postings", more_postings), ("lengths", more_lengths)):
            rest = self._table(part).join(F.broadcast(gone) if few else gone, "id", "left_anti").select(self._table(part).columns)
            out.append(rest.unionByName(more) if more is not None else rest)
        return self._commit(*out, base, applied, ordered=few and more_postings is None)

    def clear(self, applied: int | None = None) -> TextIndex:
        base = self.stored.state()
        return self._commit(self._table("postings").limit(0), self._table("lengths").limit(0), base, applied)

    def compact(self) -> dict[str, int]:
        """Writes both parts anew, drops earlier states; returns sizes in bytes before and after."""
        base, old = self.stored.state(), self.stored.size_in_bytes()
        self._commit(self._table("postings"), self._table("lengths"), base, None)
        self.stored.vacuum()
        new = self.stored.size_in_bytes()
        return {"oldSize": old, "newSize": new, "bytesSaved": max(0, old - new)}

    def query(self, text: str, require_all: bool = False, scored: bool = True) -> DataFrame:
        """As ``bm25`` and ``require_all``, from the postings of the query's terms."""
        terms = query_terms(self.space.spark, text)
        own = self._table("postings").where(F.col("term").isin(*terms) if terms else F.lit(False))
        if require_all:
            return own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == max(1, len(terms))).select("id").orderBy("id")
        sizes = self._table("lengths")
        totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
        frequency = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rows = own.join(F.broadcast(frequency), "term").join(sizes, "id").crossJoin(F.broadcast(totals))  # as many terms as the query has; one row
        mean = F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0)
        norm = F.lit(K1) * (1 - B + B * F.greatest("length", F.lit(1)) / mean)
        part = F.log1p(F.greatest(F.lit(0.0), (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        out = rows.groupBy("id").agg((F.sum(part) * (1 + F.count(F.lit(1)) / F.lit(float(max(1, len(terms)))))).alias("score")).orderBy(F.desc("score"), "id")
        return out if scored else out.select("id")

    def term_count(self) -> int:
        return self._table("postings").select("term").distinct().count()

    def document_count(self) -> int:
        return self._table("lengths").count()


def term_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Terms of each document in order of first appearance, with their frequency and that place among them."""
    rows, repeated = _document_terms(docs, id_col, text_col)
    if not repeated:
        return rows.drop("first_pos")
    listed = postings(docs, id_col, text_col)
    return listed.withColumn("place", F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`")).orderBy("first_pos"))).drop("first_pos")
