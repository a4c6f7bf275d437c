"""Substring dedup by compact windows.

Documents are sequences of shingles of five words. Under a hash function, the Cartesian
tree over a sequence splits all its subsequences into compact windows (l, c, r): those
that begin in [l, c] and end in [c, r] have their minimum at c. A passage of the least
length lies in one window of each function, so a function cuts the places where passages
begin into intervals of one minimum each, about 2 n / length of n. Intervals of two
functions are joined where they overlap; such an interval's key is both minima. Five
functions in a ring give five keys to each passage: two passages of similarity 0.8 share
one unless no neighbouring two of five minima agree (once in thirty), equal ones share
all five.

Documents that share a key with its smallest, the key's hub, form the hub's block. Within
a block all documents are compared with each other, not with the hub alone: a document's
passage is a repeat if enough of its shingles lie in the partner for a Jaccard similarity
of ``percent``. So every two documents that share a key are verified, whatever phrase
they share with others, and an exactly repeated passage is always found. A block is sent
once, or, where it is large, as pairs of shards, so no task holds more than two shards; a
pair that lies in several blocks is verified in that of the smallest hub alone.
Exact copies are one document throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindex.llm import textvec
from spindex.llm.common import arrow_map, discard, give_back, saved, text_bytes, without
from spindex.llm.graph import components
from spindex.llm.neardup import shingles_of

U64 = np.uint64
WIDTH = 5
_PLACE = U64((1 << 28) - 1)
#: Equal shingles are ordered by a scrambled place, so a text that repeats itself gives no tree as deep as it is long.
_SCRAMBLE = U64(0x9E3779B)
_UNSCRAMBLE = U64(pow(0x9E3779B, -1, 1 << 28))
_SEEDS = [U64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377)]
#: A key is hot if so many documents of a sample, one in ``SAMPLED`` by the hash of the id, hold it; the most of them that are told from others.
SAMPLED, HOT, MOST_HOT = 64, 100, 100_000
#: Words and documents of a block, about, beyond which it is split into shards and sent as pairs of them.
SHARD_WORDS, SHARD_ROWS = 2_000_000, 4_000
#: Rows that are compared with others at a time, and places of these others, about.
SOURCES, PLACES = 64, 8_192
#: Documents in blocks whose hubs may be broadcast to their shingles; beyond that both are joined by a shuffle.
MOST_MEMBERS = 500_000
SKETCH = "doc_id long, n_words long, h0 long, h1 long, keys array<long>"


def sequences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, each row's first one (n + 1), and the numbers of words; a row of fewer words than five has none."""
    words, first = textvec.words(buf, off, textvec.NOT_SPACE)
    n = len(words)
    rolled = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(min(WIDTH, n)):
            rolled[: n - k] = textvec.mix(rolled[: n - k] + words[k:] + U64(k + 1))
    size = np.diff(first)
    keep = np.ones(n, bool)
    for k in range(1, WIDTH):  # the last places of a row begin no shingle
        last = first[1:] - k
        keep[last[last >= first[:-1]]] = False
    number = np.maximum(0, size - WIDTH + 1)
    return rolled[keep], np.concatenate([[0], np.cumsum(number)]), size


def ordered(hashes: np.ndarray, seed: U64) -> np.ndarray:
    """What minima are taken of: a shingle's hash under a function, and in its low bits the place in scrambled form."""
    return (textvec.mix(hashes ^ seed) & ~_PLACE) | (np.arange(len(hashes), dtype=U64) * _SCRAMBLE & _PLACE)


def compact_windows(hashes: np.ndarray, first: np.ndarray, seed: U64, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``least`` shingles, level by level of the Cartesian trees of all rows."""
    order = np.append(ordered(hashes, seed), U64(0xFFFFFFFFFFFFFFFF))
    s, e = first[:-1], first[1:]
    out = []
    while True:
        long = np.flatnonzero(e - s >= least)
        if not len(long):
            break
        by = long[np.argsort(-s[long])]  # falling, so reduceat spends nothing between segments
        s, e = s[by], e[by]
        c = ((np.minimum.reduceat(order, np.stack([s, e], 1).reshape(-1))[::2] & _PLACE) * _UNSCRAMBLE & _PLACE).astype(np.int64)
        out.append((s, c, e - 1))
        s, e = np.concatenate([s, c + 1]), np.concatenate([c, e])
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key, each key once a row, by row and key."""
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def intervals(hashes: np.ndarray, first: np.ndarray, seed: U64, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and minimum's place of each interval of places where passages of the least length begin, in order."""
    l, c, r = compact_windows(hashes, first, seed, least)
    low = np.maximum(l, c - least + 1)
    by = np.argsort(low)
    return low[by], c[by]


def overlaid(hashes: np.ndarray, first: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each two neighbouring functions: first place and key of the intervals in which both minima stay the same."""
    each = [intervals(hashes, first, seed, least) for seed in _SEEDS]
    out = []
    with np.errstate(over="ignore"):
        for k in range(len(each)):
            (p, c), (q, d) = each[k], each[(k + 1) % len(each)]
            low = np.union1d(p, q)
            x, y = (hashes[at[np.searchsorted(start, low, side="right") - 1]] if len(low) else hashes[:0] for start, at in ((p, c), (q, d)))
            out.append((low, textvec.mix(textvec.mix(x + U64(k + 1)) * U64(3) + y)))
    return out


def window_keys(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every interval of every two functions, each once a row, by row."""
    got = overlaid(hashes, first, least)
    at = np.concatenate([g[0] for g in got])
    return _distinct(np.searchsorted(first, at, side="right") - 1, np.concatenate([g[1] for g in got]))


def _sketches(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch):
        buf, off = textvec.binary_column(batch.column(1))
        for i, j in textvec.chunks(off):
            hashes, first, words = sequences(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            row, key = window_keys(_short(hashes), first, least)
            with np.errstate(over="ignore"):
                place = (np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))).astype(U64)
                digests = [textvec.row_sums(textvec.mix(hashes ^ textvec.mix(place + salt)), first) for salt in (U64(1), U64(1 << 40))]
            bounds = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words.astype(np.int64)), *[pa.array(d.view(np.int64)) for d in digests], pa.ListArray.from_arrays(pa.array(bounds), pa.array(key.view(np.int64)))], [c.split()[0] for c in SKETCH.split(", ")])

    return arrow_map(text_bytes(docs, id_col, text_col), run, SKETCH)


def spans_of(repeated: np.ndarray, least: int) -> str:
    """The words of all repeated passages, as "start:end,..."; passages that touch are one span."""
    begin = np.flatnonzero(repeated)
    if not len(begin):
        return ""
    breaks = np.flatnonzero(np.diff(begin) > least + WIDTH - 1)
    starts, ends = begin[np.concatenate([[0], breaks + 1])], begin[np.concatenate([breaks, [len(begin) - 1]])]
    return ",".join(f"{a}:{b + least + WIDTH - 1}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def _short(hashes: np.ndarray) -> np.ndarray:
    """What of a shingle's hash keys and verification go by: 32 bits."""
    return hashes >> U64(32)


def _encode(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    hashes, first, _ = sequences(buf, off)
    low = _short(hashes).astype(np.uint32)
    return [low[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


class Block:
    """Documents to be compared with each other: ids, shingles, hubs of each, shards, and the documents each stands for.

    Only windows of which enough shingles lie in some other row are looked at. Rows that
    are alike in all that counts here (their windows, what they hold of the shingles of
    any, their smaller hubs) are one class, so a passage that many documents quote is
    compared once; classes are compared ``SOURCES`` at a time, with the rows alone in
    which these can reach anything.
    """

    def __init__(self, ids: np.ndarray, shingles: list[np.ndarray], hubs: list[np.ndarray], shard: np.ndarray, copies: np.ndarray):
        self.ids, self.node = np.unique(ids, return_inverse=True)
        self.shingles, self.hubs, self.shard = shingles, hubs, shard
        self.copies = np.zeros(len(self.ids), np.int64)
        self.copies[self.node] = copies

    def _smaller(self, hub: int) -> list[tuple[int, ...]]:
        """Of each row the hubs below ``hub`` that another row has as well."""
        row = np.repeat(np.arange(len(self.hubs)), [len(h) for h in self.hubs])
        other = np.concatenate(self.hubs)
        row, other = row[other < hub], other[other < hub]
        kinds, code, n = np.unique(other, return_inverse=True, return_counts=True)
        out: list[tuple[int, ...]] = [()] * len(self.hubs)
        for r, h in zip(row[n[code] > 1].tolist(), kinds[code[n[code] > 1]].tolist(), strict=True):
            out[r] += (h,)
        return out

    def links(self, hub: int, across: bool, least: int, wanted: int) -> list[tuple[int, int, str, int]]:
        """(node, number of linked documents, spans, smallest node reachable here) of each row that is linked.

        Rows of different ids are compared, of different shards if ``across``, and without
        a smaller hub in common.
        """
        n = len(self.shingles)
        size = np.array([len(x) for x in self.shingles])
        first = np.concatenate([[0], np.cumsum(size)])
        kinds, code = np.unique(np.concatenate(self.shingles), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        low, high = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        high[code], low[code[::-1]] = row, row[::-1]
        shared = (low != high)[code]
        total = np.concatenate([[0], np.cumsum(shared)])
        at = np.flatnonzero(total[least:] - total[:-least] >= wanted)
        at = at[at + least <= first[row[at] + 1]]
        if not len(at):
            return []
        start, step = np.zeros(len(code), bool), np.zeros(len(code) + 1, np.int64)
        start[at] = True
        step[at] += 1
        step[at + least] -= 1
        covered = np.cumsum(step[:-1]) > 0
        target = np.zeros(len(kinds), bool)
        target[code[covered & shared]] = True
        number_of, n_kinds = np.cumsum(target) - 1, max(1, int(target.sum()))

        # what counts of each row, and the classes of equal ones
        cut = np.concatenate([[0], np.cumsum(covered)])[first]
        seen = np.where(shared, number_of[code], -1)[covered]
        begins = start[covered]
        holds = target[code]
        own = np.unique(row[holds] * n_kinds + number_of[code[holds]])
        edge = np.searchsorted(own, np.arange(n + 1) * n_kinds)
        own %= n_kinds
        smaller, rows_of = self._smaller(hub), np.bincount(self.node)
        classes: dict[tuple, int] = {}
        kind = np.full(n, -1)
        some: list[int] = []
        for r in np.flatnonzero(np.diff(edge) > 0).tolist():
            sign = (seen[cut[r] : cut[r + 1]].tobytes(), begins[cut[r] : cut[r + 1]].tobytes(), own[edge[r] : edge[r + 1]].tobytes(), smaller[r], self.shard[r] if across else 0, self.node[r] if rows_of[self.node[r]] > 1 else -1)
            kind[r] = classes.setdefault(sign, len(some))
            if kind[r] == len(some):
                some.append(r)
        one = np.array(some)
        allow = self._allowed(one, [smaller[r] for r in some], across)
        linked, repeated = _compared([own[edge[r] : edge[r + 1]] for r in some], [seen[cut[r] : cut[r + 1]] for r in some], [begins[cut[r] : cut[r + 1]] for r in some], allow, n_kinds, least, wanted)
        linked |= linked.T
        alone = np.bincount(kind[kind >= 0], minlength=len(some)) < 2
        for c in np.flatnonzero(~alone).tolist():  # rows of one class hold each other's windows, all of them
            if not across and not smaller[some[c]] and rows_of[self.node[some[c]]] == 1 and begins[cut[some[c]] : cut[some[c] + 1]].any():
                linked[c, c] = True
                repeated[c][:] = True

        # rows of one id are one unit, whatever their classes
        mark = np.where(rows_of[self.node[one]] > 1, -1 - self.node[one], np.arange(len(one)))
        unit = np.unique(mark, return_inverse=True)[1]
        if unit.max() + 1 < len(unit):
            whole = np.zeros((unit.max() + 1,) * 2, bool)
            a, b = np.nonzero(linked)
            whole[unit[a], unit[b]] = True
            linked = whole
        else:
            linked = linked[np.ix_(np.argsort(unit), np.argsort(unit))]
        of = np.where(kind >= 0, unit[kind], -1)
        pairs = np.unique(np.stack([of[of >= 0], self.node[of >= 0]], 1), axis=0)
        weight, least_node = np.zeros(len(linked), np.int64), np.full(len(linked), len(self.ids))
        np.add.at(weight, pairs[:, 0], self.copies[pairs[:, 1]])
        np.minimum.at(least_node, pairs[:, 0], pairs[:, 1])
        number = np.array([weight[x].sum() for x in linked])
        reach = np.full(len(linked), -1)
        for u in np.argsort(least_node).tolist():
            new = np.array([u]) if reach[u] < 0 and number[u] else np.zeros(0, np.int64)
            while len(new):  # each row of the matrix is read once
                reach[new] = least_node[u]
                new = np.flatnonzero(linked[new].any(axis=0) & (reach < 0))
        out, counted = [], set()
        for r in np.flatnonzero(of >= 0).tolist():  # rows of one id count their partners once
            u, node = of[r], self.node[r]
            partners = number[u] - (self.copies[node] if linked[u, u] else 0)
            if partners > 0:
                spans = np.zeros(size[r], bool)
                spans[np.flatnonzero(start[first[r] : first[r + 1]])] = repeated[kind[r]]
                out.append((int(self.ids[node]), 0 if node in counted else int(partners), spans_of(spans, least), int(self.ids[reach[u]])))
                counted.add(node)
        return out

    def _allowed(self, rows: np.ndarray, smaller: list[tuple[int, ...]], across: bool) -> np.ndarray:
        """A matrix of the rows that are compared here."""
        node, shard = self.node[rows], self.shard[rows]
        out = node[:, None] != node
        if across:
            out &= shard[:, None] != shard
        by: dict[int, list[int]] = {}
        for k, hubs in enumerate(smaller):
            for h in hubs:
                by.setdefault(h, []).append(k)
        for same in by.values():
            out[np.ix_(same, same)] = False
        return out


def _window_sums(rows: np.ndarray, width: int) -> np.ndarray:
    """The sum of each ``width`` rows that follow each other, by sums of 1, 2, 4, ... of them."""
    n = len(rows) - width + 1
    out, done, size = np.zeros((max(0, n), rows.shape[1]), rows.dtype), 0, 1
    while n > 0 and size <= width:
        if width & size:
            out += rows[done : done + n]
            done += size
        rows, size = rows[:-size] + rows[size:], size * 2
    return out


def _compared(own: list[np.ndarray], seen: list[np.ndarray], begins: list[np.ndarray], allow: np.ndarray, kinds: int, least: int, wanted: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which row (first) holds enough of a window of which row (second), and of each row which windows another holds.

    Windows begin at the places flagged in ``begins``. They are counted in bytes, eight
    to a word, as a window has fewer than 256 shingles.
    """
    if least > 255:
        raise ValueError("a window has at most 255 shingles")
    linked = np.zeros(allow.shape, bool)
    repeated = [np.zeros(int(b.sum()), bool) for b in begins]
    able = np.flatnonzero([b.any() for b in begins])
    if not len(able):
        return linked, repeated
    first = np.concatenate([[0], np.cumsum([len(seen[r]) for r in able])])
    code, flag = np.concatenate([seen[r] for r in able]), np.concatenate([begins[r] for r in able])
    code = np.where(code < 0, kinds, code)
    marks = np.concatenate([[0], np.cumsum(flag)])
    hit = np.zeros(marks[-1], bool)
    at = np.flatnonzero(flag)
    row_of = np.searchsorted(first, at, side="right") - 1
    known = np.zeros((kinds + 1, SOURCES), np.uint8)
    by = sorted(range(len(own)), key=lambda r: own[r].tobytes())  # rows that hold the same come together
    for i in range(0, len(by), SOURCES):
        group = np.array([r for r in by[i : i + SOURCES] if allow[r].any()])
        if not len(group):
            continue
        for k, r in enumerate(group.tolist()):
            known[own[r], k] = 1
        union = np.zeros(kinds + 1, bool)
        union[np.concatenate([own[r] for r in group])] = True
        total = np.concatenate([[0], np.cumsum(union[code], dtype=np.int32)])
        reached = np.zeros(len(able), bool)
        reached[row_of[total[at + least] - total[at] >= wanted]] = True
        chosen, done = np.flatnonzero(reached & allow[np.ix_(group, able)].any(axis=0)), 0
        while done < len(chosen):
            upto = done + 1
            space = first[chosen[done] + 1] - first[chosen[done]]
            while upto < len(chosen) and space < PLACES:
                space += first[chosen[upto] + 1] - first[chosen[upto]]
                upto += 1
            part, done = chosen[done:upto], upto
            place = np.concatenate([np.arange(first[j], first[j + 1]) for j in part])
            count = _window_sums(np.take(known.view(U64), code[place], axis=0), least)
            enough = count.view(np.uint8)[np.flatnonzero(flag[place])] >= wanted
            number = marks[first[part + 1]] - marks[first[part]]
            edge = np.concatenate([[0], np.cumsum(number)])
            may = np.zeros((len(part), SOURCES), bool)
            may[:, : len(group)] = allow[np.ix_(group, able[part])].T
            words = np.repeat(may.view(U64), number, axis=0)
            words &= enough.view(U64)
            linked[np.ix_(group, able[part])] = np.bitwise_or.reduceat(words, edge[:-1], axis=0).view(bool)[:, : len(group)].T
            some = words[:, 0].copy()
            for k in range(1, words.shape[1]):
                some |= words[:, k]
            hit[np.concatenate([np.arange(marks[first[j]], marks[first[j + 1]]) for j in part])] |= some > 0
        for r in group.tolist():
            known[own[r]] = 0
    for j, r in enumerate(able.tolist()):
        repeated[r] = hit[marks[first[j]] : marks[first[j + 1]]]
    return linked, repeated


def _verify(members: DataFrame, texts: DataFrame, least: int, wanted: int) -> DataFrame:
    """node, n_links, spans, low of what is linked in the blocks; ``members`` has rep, copies, n_words and the sorted hubs of each."""
    each = members.select("rep", "n_words", F.explode("hubs").alias("hub"))
    number = F.ceil(F.greatest(F.sum("n_words") / F.lit(SHARD_WORDS), F.count(F.lit(1)) / F.lit(SHARD_ROWS))).cast("int")
    shards = saved(each.groupBy("hub").agg(number.alias("m")).where("m > 1"), "shards")
    few = members.limit(MOST_MEMBERS + 1).count() <= MOST_MEMBERS
    rows = texts.withColumnRenamed("doc_id", "rep").join(F.broadcast(members) if few else members, "rep").select("rep", "copies", "hubs", "shingles", F.explode("hubs").alias("hub")).join(shards, "hub", "left")
    m = F.coalesce("m", F.lit(1))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("rep"), m).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), m - 1)))
    rows = rows.select("hub", F.least("shard", "t").alias("s"), F.greatest("shard", "t").alias("t"), "shard", "rep", "copies", "hubs", "shingles")
    rows = rows.repartition("hub", "s", "t").sortWithinPartitions("hub", "s", "t", "rep")

    def found(parts: list[pa.RecordBatch]) -> list[tuple[int, int, str, int]]:
        whole = pa.Table.from_batches(parts)
        if whole.num_rows < 2:
            return []
        hub, s, t = (whole.column(c)[0].as_py() for c in range(3))
        shard, ids, copies = (whole.column(c).to_numpy() for c in (3, 4, 5))
        hubs = [h.values.to_numpy() for h in whole.column(6)]
        return Block(ids, [np.frombuffer(x.as_buffer(), np.uint32) for x in whole.column(7)], hubs, shard, copies).links(hub, s < t, least, wanted)

    def run(batches):
        open_, last, out = [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            task = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
            cuts = np.concatenate([[0], np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1, [len(task)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(task[a]) != last and open_:
                    out += found(open_)
                    open_ = []
                last = tuple(task[a])
                open_.append(batch.slice(a, b - a))
            if len(out) > 5000:
                yield listed(out)
                out = []
        if open_:
            out += found(open_)
        yield listed(out)
        give_back()

    def listed(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["node", "n_links", "spans", "low"])

    return rows.mapInArrow(run, "node long, n_links long, spans string, low long")


def _merged(spans: DataFrame) -> DataFrame:
    """node, spans, n_repeated: the union of a node's spans; spans that touch become one."""
    each = spans.where("spans <> ''").select("node", F.explode(F.split("spans", ",")).alias("s")).select("node", F.array(F.split("s", ":")[0].cast("long"), F.split("s", ":")[1].cast("long")).alias("s"))
    # pre-aggregated as a sorted set: a node has few spans that differ
    listed = each.groupBy("node").agg(F.array_sort(F.collect_set("s")).alias("all"))
    step = F.aggregate(
        "all",
        F.array().cast("array<array<bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(F.element_at(done, -1), 2) >= s[0]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(F.element_at(done, -1), 1), F.greatest(F.element_at(F.element_at(done, -1), 2), s[1]))))).otherwise(F.concat(done, F.array(s))),
    )
    return listed.select("node", step.alias("all")).select("node", F.array_join(F.transform("all", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",").alias("spans"), F.aggregate("all", F.lit(0).cast("long"), lambda t, s: t + s[1] - s[0]).alias("n_repeated"))


def hubs_of(rows: DataFrame) -> DataFrame:
    """rep, key, hub: each row (rep, key) with the smallest rep of its key, but for the hubs themselves.

    Most keys are of one document, so rows are shuffled once and sorted by key. Hot keys
    never are: which they are is told by a sample, their hubs are aggregated before any
    shuffle and broadcast. The sample decides the way alone, not the result.
    """
    some = rows.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    hot = saved(some.orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key"), "hot")
    if hot.isEmpty():
        rest, busy = rows, None
    else:
        rest = rows.join(F.broadcast(hot), "key", "left_anti")
        least = saved(rows.join(F.broadcast(hot), "key", "left_semi").groupBy("key").agg(F.min("rep").alias("hub")), "least")
        busy = rows.join(F.broadcast(least), "key").select("rep", "key", "hub")
    out = rest.select("rep", "key", F.min("rep").over(Window.partitionBy("key")).alias("hub"))
    return (out if busy is None else out.unionByName(busy)).where("rep <> hub")


def repeated_passages(docs: DataFrame, least_words: int = 50, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, class_id, n_links, n_repeated, spans, repeats.

    A passage of ``least_words`` words is a repeat if another document holds so many of
    its five-word shingles that passages of that length would have a Jaccard similarity
    of ``percent``. ``spans`` are the repeated stretches in words, end exclusive, joined
    by commas, ``n_repeated`` their words, ``n_links`` the other documents that share one,
    on either side, exact copies and copies of partners included, and ``class_id`` the smallest
    id reachable over such links: its own for a document without repeats. ASCII letters
    are lower-cased; words are runs of anything but ASCII white space. Null, empty and
    shorter texts have no passages. Rows of one id are one node, linked by what any of
    them holds; rows of null id take no part and have no class. Other columns are
    ignored; an empty table gives an empty result.
    """
    least = least_words - WIDTH + 1
    wanted = math.ceil(2 * least * percent / (100 + percent))
    wide = saved(_sketches(docs, least, id_col, text_col), "sketches")
    base = saved(wide.drop("keys"), "documents")
    key = ["h0", "h1", "n_words"]
    classes = saved(base.where(f"doc_id is not null and n_words >= {least_words}").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    copies = base.where(f"doc_id is not null and n_words >= {least_words}").select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    rows = without(wide.where("doc_id is not null"), saved(copies, "dropped")).select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))

    pairs = saved(hubs_of(rows).select("hub", "rep").distinct(), "pairs")
    discard(wide)
    held = saved(pairs.unionByName(pairs.select("hub", F.col("hub").alias("rep")).distinct()).groupBy("rep").agg(F.array_sort(F.collect_set("hub")).alias("hubs")), "hubs")
    discard(pairs)
    weight = classes.groupBy("rep").agg(F.sum("copies").alias("copies"), F.sum("n_words").alias("n_words"))
    members = saved(held.join(weight, "rep"), "members")
    discard(held)
    shingles = saved(shingles_of(docs, members.select(F.col("rep").alias("doc_id")), _encode, id_col, text_col), "shingles")
    verified = saved(_verify(members, shingles, least, wanted), "verified")
    discard(shingles), discard(members)
    found = components(verified, "node", "low")
    number = verified.groupBy("node").agg(F.sum("n_links").alias("partners"))
    known = found.join(number, "node").join(_merged(verified), "node", "left").withColumnRenamed("node", "rep")
    out = base.select("doc_id", *key).join(classes, key, "left").join(known, "rep", "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False)) & F.col("doc_id").isNotNull()
    mine = F.col("doc_id").isNotNull()
    whole = F.concat_ws(":", F.lit("0"), F.col("n_words").cast("string"))
    return out.select(
        "doc_id",
        "n_words",
        F.when(mine, F.coalesce("component", F.when(copied, F.col("rep")), "doc_id")).alias("class_id"),
        F.when(mine, F.coalesce("partners", F.lit(0)) + F.when(copied, F.col("copies") - 1).otherwise(0)).otherwise(0).cast("long").alias("n_links"),
        F.when(copied, F.col("n_words")).when(mine, F.coalesce("n_repeated", F.lit(0))).otherwise(0).cast("long").alias("n_repeated"),
        F.when(copied, whole).when(mine, F.coalesce("spans", F.lit(""))).otherwise("").alias("spans"),
        (copied | (mine & F.col("spans").isNotNull())).alias("repeats"),
    )
