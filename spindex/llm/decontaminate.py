"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item is cut into windows of ``width`` consecutive words (an item of
fewer words is one window). Containment of a whole window is asked for, so its
necessary prefix in rarity order is one token: the word of the window with the
smallest corpus frequency. Documents are probed by those words alone. A hit at some
place fixes the only place where the window could lie (positional bound), which
must be inside the document (length bound); only then are the window's words
compared, all of them.

The benchmark side goes to the executors in blocks of at most ``block_words``
words, so what is broadcast is bounded however large the benchmark is; each
further block costs one more map over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.llm import textvec
from spindex.llm.common import arrow_map, fresh, saved, text_bytes

FOUND = "doc_id long, n_words long, n_hit long, starts array<int>, lengths array<int>, items array<string>"
U64 = np.uint64


class Windows:
    """The distinct windows of a block of items, ready for probing."""

    def __init__(self, ids: list[str], words: np.ndarray, first: np.ndarray, width: int):
        spans: dict[bytes, list[int]] = {}
        for i in range(len(ids)):
            own = words[first[i] : first[i + 1]]
            size = min(width, len(own))
            for a in range(len(own) - size + 1 if size else 0):
                spans.setdefault(own[a : a + size].tobytes(), []).append(i)
        self.ids = ids
        self.words = [np.frombuffer(s, U64) for s in spans]
        self.items = [sorted(set(x)) for x in spans.values()]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, U64)]))
        self.padded = np.zeros((len(self.words), width), U64)
        for k, w in enumerate(self.words):
            self.padded[k, : len(w)] = w

    def order(self, counts: np.ndarray) -> None:
        """Chooses each window's rarest word (ties: the first) by the corpus counts of ``vocabulary``."""
        rarest = np.array([int(np.argmin(counts[np.searchsorted(self.vocabulary, w)])) for w in self.words], np.int64)
        token = np.array([w[r] for w, r in zip(self.words, rarest, strict=True)], U64)
        by = np.argsort(token, kind="stable")
        self.token, self.window, self.rarest = token[by], by, rarest[by]
        self.tokens, start = np.unique(self.token, return_index=True)
        self.bounds = np.append(start, len(by))

    def __getstate__(self) -> dict:
        """Only what probing takes goes to the executors."""
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "vocabulary")}

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the chunk's words, and window of every occurrence."""
        if not len(self.tokens) or not len(words):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.tokens, words), len(self.tokens) - 1)
        at = np.flatnonzero(self.tokens[k] == words)
        k = k[at]
        number = self.bounds[k + 1] - self.bounds[k]
        entry = np.repeat(self.bounds[k] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
        at = np.repeat(at, number)
        window, begin = self.window[entry], at - self.rarest[entry]
        row = np.searchsorted(first, at, side="right") - 1
        size = self.size[window]
        ok = (begin >= first[row]) & (begin + size <= first[row + 1])
        row, begin, window, size = row[ok], begin[ok], window[ok], size[ok]
        same = np.ones(len(row), bool)
        for o in range(self.padded.shape[1]):
            live = np.flatnonzero(same & (o < size))
            same[live] = words[begin[live] + o] == self.padded[window[live], o]
        return row[same], begin[same], window[same]


def covered(starts: np.ndarray, lengths: np.ndarray) -> int:
    """Words inside any of the spans."""
    by = np.argsort(starts, kind="stable")
    s = starts[by].astype(np.int64)
    e = np.maximum.accumulate(s + lengths[by])
    return int(np.maximum(0, e - np.maximum(s, np.concatenate([[0], e[:-1]]))).sum())


_COUNTS = "word long, n long"


def _blocks(items: DataFrame, width: int, block_words: int) -> Iterator[Windows]:
    """Blocks of items, read one at a time; an item is never split."""
    ids: list[str] = []
    hashes: list[np.ndarray] = []
    held = 0

    def made() -> Windows:
        return Windows(ids, np.concatenate([*hashes, np.zeros(0, U64)]), np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64), width)

    for r in items.toLocalIterator():
        if r[1] is None:
            continue
        text = np.frombuffer(bytes(r[1]), np.uint8)
        own, _ = textvec.words(text, np.array([0, len(text)]), textvec.ALNUM)
        ids.append("" if r[0] is None else str(r[0]))
        hashes.append(own)
        held += len(own)
        if held >= block_words:
            yield made()
            ids, hashes, held = [], [], 0
    yield made()


def _frequencies(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences in all documents of each word of a block's vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            buf, off = textvec.binary_column(batch.column(1))
            for i, j in textvec.chunks(off):
                words, _ = textvec.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], textvec.ALNUM)
                k = np.minimum(np.searchsorted(known, words), len(known) - 1)
                total += np.bincount(np.where(known[k] == words, k, len(known)), minlength=len(known) + 1)
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in texts.mapInArrow(run, _COUNTS).groupBy("word").agg(F.sum("n")).collect():
            counts[r[0]] = r[1]
    return counts


def occurrences(docs: DataFrame, items: DataFrame, width: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, and where which windows lie.

    ``n_hit`` counts the words in any of them, ``starts`` and ``lengths`` (in words) are the occurrences of windows, ``items``
    the ids, as strings, of the items they belong to. Rows of equal id and text have equal results, so several blocks
    are merged on these two, and the rows counted to be given back one for one.
    """
    texts = text_bytes(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5("text")))
    parts = []
    for block in _blocks(items.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{item_text_col}`").cast("string").cast("binary")), width, block_words):
        block.order(_frequencies(texts, block.vocabulary))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def probe(batch: pa.RecordBatch, shared=shared):
            buf, off = textvec.binary_column(batch.column(1))
            known = shared.value
            for i, j in textvec.chunks(off):
                words, first = textvec.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], textvec.ALNUM)
                row, begin, window = known.find(words, first)
                by = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[by], np.arange(j - i + 1)).tolist()
                hit, starts, lengths, names = np.zeros(j - i, np.int64), [], [], []
                begin, window = (begin - first[row])[by], window[by]
                for r in range(j - i):
                    a, b = cuts[r], cuts[r + 1]
                    if a == b:
                        starts.append([]), lengths.append([]), names.append([])
                        continue
                    hit[r] = covered(begin[a:b], known.size[window[a:b]])
                    starts.append(begin[a:b].tolist())
                    lengths.append(known.size[window[a:b]].tolist())
                    names.append(sorted({known.ids[x] for w in set(window[a:b].tolist()) for x in known.items[w]}))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(hit), pa.array(starts, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string())), batch.column(2).slice(i, j - i)], ["doc_id", "n_words", "n_hit", "starts", "lengths", "items", "digest"])

        parts.append(arrow_map(texts, probe, f"{FOUND}, digest binary").withColumn("block", F.lit(len(parts))))
    if len(parts) == 1:
        return parts[0].drop("digest", "block")
    rows = saved(reduce(DataFrame.unionByName, parts), "occurrences")
    # equal rows become one before anything is listed, however many they are
    rows = rows.groupBy("doc_id", "digest", "block").agg(F.first("n_words").alias("n_words"), F.first(F.struct("starts", "lengths", "items")).alias("x"), F.count(F.lit(1)).alias("rows"))
    rows = rows.groupBy("doc_id", "digest").agg(F.first("n_words").alias("n_words"), F.collect_list("x").alias("x"), F.first("rows").alias("rows"))
    rows = rows.select("doc_id", "n_words", *[F.flatten(F.col("x")[c]).alias(c) for c in ("starts", "lengths", "items")], F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row")).drop("row")

    def cover(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds = batch.column(2).offsets.to_numpy()
        starts, lengths = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in (2, 3))
        hit = [covered(starts[a:b], lengths[a:b]) if a < b else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), *batch.columns[2:]], ["doc_id", "n_words", "n_hit", "starts", "lengths", "items"])

    return arrow_map(rows, cover, FOUND)


def contamination(found: DataFrame, least_items: int = 2) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = F.array_sort(F.array_distinct("items"))
    return (
        found.withColumn("items", items)
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= least_items).

    A word is hit if it lies in any occurrence of a window; n_items counts items with
    a window that occurs; items_sha256 is of their ids, sorted as strings, joined by
    commas. Null and empty texts have no words and hit nothing; null or empty items
    have no windows; repeated item ids count once; a null item id counts as the empty
    string; an empty benchmark leaves all rows unhit. Rows are returned one for one,
    those of null or repeated ids too, however many blocks of ``block_words`` the
    benchmark takes. Other columns are ignored.
    """
    return contamination(occurrences(docs, items, width, id_col, text_col, item_col, item_text_col, block_words), least_items)


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 1, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """The rows, all columns, that hold windows of fewer than ``least_items`` items.

    Every row is judged by its own text, whatever its id: rows of null id and of repeated
    ids too. One narrow map for each block of the benchmark. For null, empty and repeated
    texts and items see ``decontaminate``; an item counts once a row, but again if rows
    of its id are spread over blocks.
    """
    listed = items.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{item_text_col}`").cast("string").cast("binary"))
    texts = text_bytes(docs.select(F.lit(None).alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    place, names, used = docs.columns.index(text_col), docs.columns, set(docs.columns)
    total = fresh("n_total", used)
    out = docs.withColumn(total, F.lit(0).cast("long"))
    for block in _blocks(listed, width, block_words):
        block.order(_frequencies(texts, block.vocabulary))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def probe(batch: pa.RecordBatch, shared=shared):
            known = shared.value
            buf, off = textvec.binary_column(batch.column(place))
            found = batch.column(batch.num_columns - 1).to_numpy().copy()
            for i, j in textvec.chunks(off):
                words, first = textvec.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], textvec.ALNUM)
                row, _, window = known.find(words, first)
                for r, _ in {(r, known.ids[x]) for r, w in {*zip(row.tolist(), window.tolist(), strict=True)} for x in known.items[w]}:
                    found[i + r] += 1
            keep = pa.array(found < least_items)
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*names, total]).filter(keep)

        out = arrow_map(out, probe, out.schema)
    return out.drop(total)
