"""Replicated-command logs: raw records (pos, index, term, type, payload), folded to the live entries.

A record supersedes its index and all above; records of type TRUNCATE cut the log at
their index. So a record is live if no later one has an index at or below its own,
which is one minimum over the rows that follow, found span by span.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindex.operators.scans import running_min_after, running_sum

NORMAL, NOOP, CONFIG, FIRST_FREE = 1, 2, 3, 16
TRUNCATE = -1


def fold(raw: DataFrame, last_index: int | None = None, base_index: int = 0) -> DataFrame:
    """The live entries; those above ``last_index`` are dead."""
    rows = running_min_after(raw, "index", "pos", "_later").where((F.col("_later").isNull() | (F.col("index") < F.col("_later"))) & (F.col("type") != TRUNCATE) & (F.col("index") > base_index))
    if last_index is not None:
        rows = rows.where(F.col("index") <= last_index)
    return rows.drop("_later")


def gaps(raw: DataFrame, base_index: int = 0) -> DataFrame:
    """Records that a sound log can't hold: at or below the base, or more than one above the end at that point."""
    ordered = Window.orderBy("_p").rowsBetween(-1, -1)
    rows = raw.withColumn("_p", F.col("pos"))
    span = rows.withColumn("_span", F.floor(F.col("pos") / 100_000))
    heads = span.groupBy("_span").agg(F.max_by(F.struct("index", "type"), "pos").alias("_h"), F.max("pos").alias("_p"))
    carried = heads.select("_span", F.max("_h").over(ordered).alias("_carry"))
    before = F.coalesce(F.lag(F.struct("index", "type")).over(Window.partitionBy("_span").orderBy("pos")), F.col("_carry"))
    rows = span.join(carried, "_span").withColumn("_b", before)
    end = F.when(F.col("_b").isNull(), base_index).when(F.col("_b.type") == TRUNCATE, F.col("_b.index") - 1).otherwise(F.col("_b.index"))
    return rows.where((F.col("index") <= base_index) | (F.col("index") > end + 1)).select(raw.columns)


def get(live: DataFrame, index: int) -> DataFrame:
    return live.where(F.col("index") == index)


def term_at(live: DataFrame, index: int, base_index: int = 0, base_term: int = 0) -> int | None:
    """The term of an entry, the base's own for the base, None outside."""
    if index == base_index:
        return base_term
    row = get(live, index).select("term").first()
    return row[0] if row else None


def get_batch(live: DataFrame, start: int, max_bytes: int = 65536, base_index: int = 0) -> DataFrame:
    """Entries from an index on until their payloads reach the budget; the one that reaches it belongs, so there is at least one if any is left."""
    if start <= base_index:
        raise ValueError("the batch begins at or below the base")
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    rows = running_sum(live.where(F.col("index") >= start), size, "index", "_sum")
    return rows.where((F.col("index") == start) | (F.col("_sum") - size < max_bytes)).drop("_sum").orderBy("index")


def compact(live: DataFrame, base_index: int, base_term: int) -> DataFrame:
    """The entries above a new base, whose term must be the log's own there."""
    own = term_at(live, base_index)
    if own is None:
        raise ValueError(f"the log has no entry {base_index}")
    if base_index and own != base_term:
        raise ValueError(f"entry {base_index} has term {own}, not {base_term}")
    return live.where(F.col("index") > base_index)


def verify(live: DataFrame, base_index: int = 0, base_term: int = 0) -> DataFrame:
    """One row: entries, first and last index, whether indexes are contiguous from the base and terms never fall."""
    by = Window.partitionBy("_span").orderBy("index")
    rows = live.withColumn("_span", F.floor(F.col("index") / 100_000))
    pairs = rows.select("_span", "index", "term", F.lag("index").over(by).alias("pi"), F.lag("term").over(by).alias("pt"))
    inside = pairs.agg(F.count(F.lit(1)).alias("n_entries"), F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.coalesce(F.bool_and(F.col("pi").isNull() | (F.col("index") == F.col("pi") + 1)), F.lit(True)).alias("inner_gapless"), F.coalesce(F.bool_and(F.col("pt").isNull() | (F.col("term") >= F.col("pt"))), F.lit(True)).alias("inner_terms"))
    ends = rows.groupBy("_span").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    falls = ends.withColumn("_p", F.lag("hi").over(Window.orderBy("_span"))).agg(F.coalesce(F.bool_and(F.col("lo") >= F.coalesce("_p", F.lit(base_term))), F.lit(True)).alias("outer_terms"))
    whole = F.col("n_entries") == F.coalesce(F.col("last_index") - base_index, F.lit(0))
    return inside.crossJoin(F.broadcast(falls)).select("n_entries", "first_index", "last_index", (F.col("inner_gapless") & whole & (F.coalesce("first_index", F.lit(base_index + 1)) == base_index + 1)).alias("contiguous"), (F.col("inner_terms") & F.col("outer_terms")).alias("terms_ok"))


@dataclass(frozen=True)
class HardState:
    """What a voter must never forget, and the bounds of its log; every change is a new value."""

    base_index: int = 0
    base_term: int = 0
    last_index: int = 0
    last_term: int = 0
    current_term: int = 0
    voted_for: int = 0
    commit_index: int = 0

    def vote(self, term: int, candidate: int = 0) -> HardState:
        """Terms never fall; one vote a term; candidate 0 keeps the vote of the same term."""
        if term < self.current_term:
            raise ValueError("the term can't fall")
        if term > self.current_term:
            return replace(self, current_term=term, voted_for=candidate)
        if candidate and self.voted_for and candidate != self.voted_for:
            raise ValueError("there is one vote in a term")
        return replace(self, voted_for=candidate or self.voted_for)

    def append(self, term: int, count: int = 1) -> HardState:
        if not self.last_term <= term <= self.current_term:
            raise ValueError("an entry's term lies between the last entry's and the current one")
        return replace(self, last_index=self.last_index + count, last_term=term)

    def commit(self, index: int) -> HardState:
        if not self.base_index <= index <= self.last_index:
            raise ValueError("the commit index lies outside the log")
        if index < self.commit_index:
            raise ValueError("the commit index can't fall")
        return replace(self, commit_index=index)

    def truncate_from(self, index: int, term_before: int) -> HardState:
        if not self.base_index < index <= self.last_index + 1:
            raise ValueError("the cut lies outside the log")
        if index == self.last_index + 1:
            return self
        if index <= self.commit_index:
            raise ValueError("committed entries can't be cut")
        return replace(self, last_index=index - 1, last_term=term_before)


def vote_history(requests: DataFrame) -> DataFrame:
    """Per node and request (node, seq, term, candidate): whether it was granted.

    A request is refused if an earlier one of its node had a higher term, or if another
    candidate already has the node's vote in that term; candidate 0 asks for no vote.
    """
    by_node = Window.partitionBy("node").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    in_term = Window.partitionBy("node", "term").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    timely = F.col("term") >= F.coalesce(F.max("term").over(by_node), F.lit(0))
    rows = requests.withColumn("_timely", timely)
    first = F.first(F.when(F.col("_timely") & (F.col("candidate") != 0), F.col("candidate")), ignorenulls=True).over(in_term)
    return rows.withColumn("granted", F.col("_timely") & ((F.col("candidate") == 0) | F.coalesce(first == F.col("candidate"), F.lit(True)))).drop("_timely")
