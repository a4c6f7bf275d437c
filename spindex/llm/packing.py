"""Best-fit packing of whole documents into sequences (bulk-synchronous best fit).

Lengths and gaps are integers up to the capacity, so range-sorted documents and
gaps fall into at most ``capacity`` classes, however many rows there are. What is
gathered is one count per length. Each superstep takes one class of documents, in
falling order of length, and sweeps it over the gap classes: its documents go to
the successor (the smallest gap that holds them), those beyond a gap class's count
lose by rank and go on to the next one, what is left opens new sequences, and the
gaps are updated. The rows themselves never move for that: each has a rank within
its length class, found by counts per salted bucket, and looks up its sequence by
(length, rank).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindex.llm import bpe, textvec
from spindex.llm.common import arrow_map, saved, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Rows that one window of ranks sorts, about.
BUCKET_ROWS = 200_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each row's ids and end id; only rows longer than the capacity are cut, the first piece is the shorter one."""

    def split(batch: pa.RecordBatch):
        buf, off = textvec.binary_column(batch.column(1))
        for row, counts, ids in bpe.encoder(tokenizer).encode(buf, off):
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            total = counts + 1
            begin = np.cumsum(total) - total
            number = -(-total // capacity)
            which = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
            head = (total - 1) % capacity + 1
            start = np.where(piece == 0, 0, head[which] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[which], capacity)
            at = (begin[which] + start).tolist()
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(text_bytes(docs, id_col, text_col), split, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Rows (length, first rank, first sequence, offset): ranks from the first one on go to sequences from the first one on.

    A row holds up to the next row of its length. Supersteps as in the module's text.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, number of sequences)
    gaps: list[int] = []  # those of ``runs``, sorted
    out, opened = [], 0

    def add(gap: int, first: int, number: int) -> None:
        if gap not in runs:
            runs[gap] = []
            insort(gaps, gap)
        runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                new = -(-left // (capacity // length))
                add(capacity, opened, new)
                opened += new
                continue
            gap = gaps[k]
            first, number = runs[gap].pop()
            took = min(left, number)
            if took < number:
                runs[gap].append((first + took, number - took))
            elif not runs[gap]:
                del runs[gap]
                gaps.pop(k)
            out.append((length, rank, first, capacity - gap))
            rank, left = rank + took, left - took
            if gap > length:
                add(gap - length, first, took)
    return out


def ranked(rows: DataFrame, by: str, ties: list[str], salt: list[str]) -> DataFrame:
    """A rank from 0 within equal values of ``by``; however common a value is, no task sorts all its rows."""
    buckets = max(4, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n")).select(by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(by, "_b").orderBy(*ties))
    return rows.withColumn("_own", own).join(base.hint("shuffle_hash"), [by, "_b"]).withColumn("rank", F.col("_base") + F.col("_own") - 1).drop("_b", "_own", "_base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is packed, null texts as empty ones (the end id alone), null and
    repeated ids as rows of their own; other columns are ignored. An empty table
    gives an empty result. Texts are tokenised once, and the pieces (no text) are
    written to the shared folder; what reaches the driver is ``capacity`` counts.
    The plan it makes has at most ``capacity`` squared rows, few thousand as a rule.
    """
    cut = saved(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    plan = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 4)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    key = plan[:, 0] << 44 | plan[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((key, plan))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows = shared.value
        length, rank = (batch.column(k).to_numpy() for k in (3, 5))
        at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
        sequence = rows[at, 2] + rank - rows[at, 1]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(rows[at, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = ["doc_id", "piece", "ids_crc32", "start"]
    return arrow_map(ranked(cut, "length", order, order).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")), place, PACKED)
