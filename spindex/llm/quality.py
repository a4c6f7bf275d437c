"""Quality classifier: interpolated modified Kneser-Ney over trusted text.

The model is of order three over words, byte for byte, with the white space after them;
below single words stands a spelling model, by which words that were never seen have a
probability too. Trusted documents' word n-grams go to shards by key as compressed
blocks, where they are counted, and the counts stay a table of the shared folder, which
grows with the text: n-grams by key, with their counts (below the highest order the number of
different predecessors), their totals as contexts, and how many n-grams follow them once,
twice and more often. Scoring is a join: documents are parts of about 8 MB, each asks the
shards for its n-grams once, and a part is scored where its texts and the answers meet.
Counting and scoring take turns, so that a share of the whole is shuffled at a time; the
counts stand in buckets by shard and aren't shuffled again.

A trusted document is judged, for the limits, by the counts of the half of the trusted
texts it isn't in, so that what it taught itself doesn't count; all others by all counts.

The spelling model is of order four over 64 symbols (letters, the commoner accented
letters, blanks, classes of the rest), so each worker holds its 64 ** 4 probabilities. A
word equal to the one before it is another word, and begins with a symbol of its own in
the spelling model, so loops of one word become unlikely. A document is judged by its cross-entropy a
byte less an allowance for its length, against a quantile of the trusted documents of
its language.

Perplexity can't see a few insults in a long page. So words that documents labelled
toxic hold far more often than trusted ones do are learned by a second count join,
and a document holding one is rejected too.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindex.llm import textvec
from spindex.llm.common import Buckets, discard, fresh, give_back, saved, short_batches, text_bytes

SYMBOLS, ORDER = 64, 4
GRAMS = SYMBOLS**ORDER
_REPEAT, _REST = 62, 63
U64 = textvec.U64
#: Keys of n-grams have so many bits; of those of three words the lower 40 are their own.
KEY_BITS, _OWN, _PLACE = 56, U64((1 << 40) - 1), U64(40)
_DROPPED = U64(64 - KEY_BITS)
#: Order of the model over words; the key of what stands before a text; what a repeated word's key is salted with.
WORD_ORDER, _BEFORE, _AGAIN = 3, U64(0x5BF03635A4C1E7D9) >> _DROPPED, U64(0x1F83D9ABFB41BD6B)
#: Bytes of text scored together, about, and of trusted text whose n-grams are a shard; sides: 0 and 1 are judged by the counts of the other half, 2 by all.
PART_BYTES, SHARD_BYTES, BOTH = 8 << 20, 4 << 20, 2
#: Columns of figures an n-gram has for a side; the counts hold those of both, of side 0 and of side 1, in this order.
FIGURES, SIDES = 5, (BOTH, 0, 1)
#: Turns in which trusted text is counted and scored, and all text scored: a share of it is shuffled at a time.
COUNT_ROUNDS, ROUNDS = 4, 8
#: Labels that may be broadcast; beyond that labels and documents are joined by a shuffle.
MOST_LABELS = 1_000_000
#: A toxic word is held by this share of toxic documents, and by so many times the share of trusted ones.
TOXIC_SHARE, TOXIC_RATIO = 0.03, 20.0


def _symbols() -> np.ndarray:
    t = np.full(256, 33, np.uint8)
    t[0x61:0x7B] = np.arange(1, 27)
    t[0x41:0x5B] = 27
    for k, b in enumerate(b" \n.,"):
        t[b] = 28 + k
    t[0x30:0x3A] = 32
    t[0xC0:] = 35
    t[0xC3] = 34
    t[0x80:0xC0] = _REST
    for k, c in enumerate("éèêçàäöüßñóíáúÉÈÊÇÄÖÜÑÓÍÁÚ"):
        t[c.encode()[1]] = 36 + k
    return t


_SYMBOL = _symbols()


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A key of two in this order."""
    with np.errstate(over="ignore"):
        return textvec.mix(x * U64(0x9E3779B97F4A7C15) + y) >> _DROPPED


_BEFORE_TWO = _joined(np.array([_BEFORE]), np.array([_BEFORE]))[0]


def _repeated(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the words that equal the one before them in their row, in any case of A-Z."""
    size = ends - starts
    x = np.flatnonzero((size[1:] == size[:-1]) & (textvec.LOWER[buf[starts[1:]]] == textvec.LOWER[buf[starts[:-1]]])) + 1
    head = np.zeros(len(starts) + 1, bool)
    head[first] = True
    x = x[~head[x]]
    if not len(x):
        return x
    size = size[x]
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(begin, size)
    equal = textvec.LOWER[buf[np.repeat(starts[x], size) + at]] == textvec.LOWER[buf[np.repeat(starts[x - 1], size) + at]]
    return x[np.logical_and.reduceat(equal, begin)]


def grams(buf: np.ndarray, off: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The n-gram code that ends at each byte; contexts begin anew with each row. ``bounds`` are those of its words, if known."""
    n = len(buf)
    starts, ends, first = bounds or textvec.word_bounds(buf, off, textvec.NOT_SPACE)
    s = _SYMBOL[buf].astype(np.int32)
    s[starts[_repeated(buf, starts, ends, first)]] = _REPEAT
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    out = s.copy()
    for k in range(1, ORDER):
        before = np.zeros(n, np.int32)
        before[k:] = s[:-k]
        before[place < k] = 0
        out += before << np.int32(6 * k)
    return out


def _discounts(counts: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney; index 0 is for absent n-grams."""
    return _discounts_of([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def _discounts_of(n: list[int]) -> np.ndarray:
    """The same from counts of counts."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([0.0, *(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3))], np.float32)


def log_probabilities(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural logs of the interpolated probabilities of all n-grams, from the counts of those seen."""
    levels = [(codes.astype(np.int64), counts.astype(np.float64))]
    for k in range(ORDER - 1, 0, -1):  # below the highest order: the number of different predecessors
        levels.append(np.unique(levels[-1][0] % SYMBOLS**k, return_counts=True))
    p = np.full(SYMBOLS, 1 / SYMBOLS, np.float32)
    for k, (code, count) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        d = _discounts(count)[np.minimum(count, 3).astype(np.int64)]
        context = code // SYMBOLS
        total = np.bincount(context, count, minlength=SYMBOLS ** (k - 1))
        spare = np.bincount(context, d, minlength=SYMBOLS ** (k - 1))
        seen = total > 0
        back = np.where(seen, spare / np.where(seen, total, 1), 1).astype(np.float32)
        low = p.reshape(1, -1, SYMBOLS) if k > 1 else p.reshape(1, 1, SYMBOLS)
        p = (back.reshape(-1, low.shape[1], 1) * low).reshape(-1)
        p[code] += ((count - d) / total[context]).astype(np.float32)
    np.maximum(p, np.float32(1e-30), out=p)
    return np.log(p, out=p)


class _Spelling:
    """``log_probabilities`` by n-gram code; contexts of the highest order that weren't seen share the rows of the order below."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        contexts = GRAMS // SYMBOLS
        at = np.arange(contexts) % (contexts // SYMBOLS)
        seen = codes // SYMBOLS
        at[seen] = seen + contexts
        _, first, self.row = _ranked(at)
        self.row = self.row.astype(np.int32) * np.int32(SYMBOLS)
        self.logs = (log_probabilities(codes, counts).reshape(contexts, SYMBOLS)[first] if len(codes) else np.zeros((len(first), SYMBOLS), np.float32)).reshape(-1)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        return self.logs[self.row[codes >> 6] + (codes & 63)]


def word_grams(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of the n-grams of one, two and three words that end at each word, keys of their contexts of one and two words, starts of words, and each row's first word's index.

    Keys have ``KEY_BITS`` bits; the upper ones of three words' keys are their context's, so both go to one shard.
    """
    starts, ends, first = textvec.word_bounds(buf, off, textvec.NOT_SPACE)
    word = textvec.span_hashes(buf, starts, ends) >> _DROPPED
    head = np.zeros(len(word), bool)
    head[first[:-1][first[:-1] < first[1:]]] = True
    again = np.flatnonzero(~head & (word == np.roll(word, 1)))
    word[again] = textvec.mix(word[again] ^ _AGAIN) >> _DROPPED
    before = np.roll(word, 1)
    before[head] = _BEFORE
    two = _joined(before, word)
    context = np.roll(two, 1)
    context[head] = _BEFORE_TWO
    three = (context & ~_OWN) | (_joined(context, word) & _OWN)
    return [word, two, three], [before, context], starts, first


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted different values; np.unique goes by a hash table, which takes many times as long for this many."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted different values, an index of each, and each value's place among them."""
    by = np.argsort(x)
    found = x[by]
    new = np.append(True, found[1:] != found[:-1])[: len(x)]
    place = np.empty(len(x), np.int64)
    place[by] = np.cumsum(new) - 1
    return found[new], by[new], place


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """Each key's shard of ``n``; larger keys are in no lower shard."""
    return ((keys >> U64(KEY_BITS - 16)) * U64(n) >> U64(16)).astype(np.int64)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte place, compressed; sorted keys are best given as differences."""
    planes, head = [], [len(columns)]
    for x in columns:
        x = np.ascontiguousarray(x, np.uint64)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0  # zeros take no room
        head += [len(x), width]
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(head, np.uint32).tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _stretched(blob: bytes, narrow: bool = False) -> list[np.ndarray]:
    """The columns; with ``narrow`` each in the smallest type of numbers that holds it."""
    head = np.frombuffer(blob, np.uint32, 1 + 2 * int(np.frombuffer(blob, np.uint32, 1)[0]))
    sizes = head[1:].reshape(-1, 2).astype(np.int64)
    raw = np.frombuffer(pa.decompress(blob[4 * len(head) :], int((sizes[:, 0] * sizes[:, 1]).sum()), codec="zstd"), np.uint8)
    out, at = [], 0
    for n, width in sizes.tolist():
        kind = np.dtype(f"u{1 << max(0, width - 1).bit_length()}" if narrow else np.uint64)
        x = np.zeros((n, kind.itemsize), np.uint8)
        for k in range(width):
            x[:, k] = raw[at + n * k : at + n * (k + 1)]
        out.append(x.reshape(-1).view(kind))
        at += n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted keys; ``_sums`` undoes it."""
    return np.diff(x, prepend=x[:0].dtype.type(0))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def _cuts(sorted_shards: np.ndarray) -> list[tuple[int, int, int]]:
    """Shard, start and end of each run."""
    if not len(sorted_shards):
        return []
    at = np.flatnonzero(np.diff(sorted_shards, prepend=-1))
    return list(zip(sorted_shards[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_shards)], strict=True))


def word_log_probabilities(places: list[np.ndarray], contexts: list[np.ndarray], spelled: np.ndarray, n: np.ndarray, totals: np.ndarray, spares: list[np.ndarray], discounts: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Natural logs of the interpolated probabilities of words.

    ``places`` and ``contexts`` are indexes of n-grams and of their contexts in ``n``,
    ``totals`` and ``spares`` (by the contexts' order), which end with zeros for what
    isn't known; ``discounts`` has a row an order, ``single`` total and spare mass of
    the empty context; ``spelled`` are the logs below single words.
    """
    own, rest = np.zeros(len(spelled)), np.ones(len(spelled))  # the probability is own + rest * that of the spelling
    for k in range(WORD_ORDER):
        total, spare = (totals[contexts[k - 1]].astype(np.float64), spares[k - 1][contexts[k - 1]]) if k else single
        seen = total > 0
        c = n[places[k]].astype(np.float64)
        total = np.where(seen, total, 1.0)
        back = np.where(seen, spare / total, 1.0)
        own = np.where(seen, (c - discounts[k][np.minimum(c, 3).astype(np.int64)]) / total, 0.0) + back * own
        rest = back * rest
    with np.errstate(divide="ignore", under="ignore"):
        return np.where(own > 0, np.log(np.where(own > 0, own + rest * np.exp(spelled), 1.0)), np.log(rest) + spelled)


class _Spares:
    """The spare mass of contexts, worked out for those that are asked for."""

    def __init__(self, discounts: np.ndarray, follow: list[np.ndarray]):
        self.discounts, self.follow = discounts, follow

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return sum(d * f[at].astype(np.float64) for d, f in zip(self.discounts, self.follow, strict=True))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, text (bytes), lang, trusted, toxic of the documents that have a label; of several labels the worst holds."""
    known = _known(labels)
    own = fresh("lang", set(docs.columns))
    texts = text_bytes(docs.withColumn(own, F.col(f"`{lang_col}`").cast("string")), id_col, text_col, own).withColumnRenamed(own, "lang")
    return texts.join(known, "doc_id")


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, trusted, toxic, a row an id; to be broadcast if few."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.min("quality"), F.lit(0)) == 1).alias("good"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("toxic"))
    known = known.select("doc_id", (F.col("good") & ~F.col("toxic")).alias("trusted"), "toxic")
    return F.broadcast(known) if known.limit(MOST_LABELS + 1).count() <= MOST_LABELS else known


def _toxic_words(rows: DataFrame) -> np.ndarray:
    """Hashes, sorted, of the words that mark toxic documents; their number is bounded by the words a document / TOXIC_SHARE."""

    def of_toxic(batches):
        held, number = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            buf, off = textvec.binary_column(batch.column(1))
            for i, j in textvec.chunks(off):
                words, first = textvec.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], textvec.LETTERS)
                held += [_distinct(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            number += batch.num_rows
            if len(held) > 2000:
                yield from counted(held)
                held = []
        yield from counted(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([number])], ["word", "n"])

    def counted(held):
        if held:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    toxic = saved(rows.where("toxic").select("doc_id", "text").mapInArrow(of_toxic, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "toxic")
    number = toxic.where("word is null").first()
    number = number[1] if number else 0
    if not number:
        return np.zeros(0, np.uint64)
    frequent = toxic.where(F.col("word").isNotNull() & (F.col("n") >= max(3, TOXIC_SHARE * number))).toPandas()
    word = frequent["word"].to_numpy(np.int64).view(np.uint64)
    n = frequent["n"].to_numpy(np.int64)[np.argsort(word)]
    word = np.sort(word)
    shared = rows.sparkSession.sparkContext.broadcast(word)

    def of_trusted(batches):
        known, number = shared.value, 0
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            buf, off = textvec.binary_column(batch.column(1))
            for i, j in textvec.chunks(off):
                words, first = textvec.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], textvec.LETTERS)
                k = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                hit = np.flatnonzero(known[k] == words) if len(known) else np.zeros(0, np.int64)
                row = np.searchsorted(first, hit, side="right") - 1
                total += np.bincount(np.unique(row * len(known) + k[hit]) % max(1, len(known)), minlength=len(known))[: len(known)]
            number += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(known))), pa.array(np.concatenate([[number], total]))], ["word", "n"])

    trusted = np.zeros(len(word) + 1, np.int64)
    for r in rows.where("trusted").select("doc_id", "text").mapInArrow(of_trusted, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        trusted[r[0] + 1] = r[1]
    odds = np.log((n + 0.5) / (number + 1)) - np.log((trusted[1:] + 0.5) / (trusted[0] + 1))
    return word[odds >= math.log(TOXIC_RATIO)]


def _counts(rows: DataFrame) -> DataFrame:
    """gram, n over all trusted documents."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return code, np.bincount(place, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)

    def run(batches):
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for batch in batches:
            buf, off = textvec.binary_column(batch.column(1))
            for i, j in textvec.chunks(off):
                parts.append(np.unique(grams(buf[off[i] : off[j]], off[i : j + 1] - off[i]), return_counts=True))
                if len(parts) == 32:
                    parts = [merged(parts)]
        code, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n)], ["gram", "n"])

    return rows.where("trusted").select("doc_id", "text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


_COUNTS = "side int, shard int, kind int, data binary, m1 long, m2 long, m3 long, m4 long, number long, total long"


def _counted(shard: int, kind: int, keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of the counts, one a side: that of both has keys, and for each of ``SIDES`` how often a key ends an n-gram (or what stands for it), its total as a context, and how many follow it once, twice and more often."""
    rows = []
    for k, side in enumerate(SIDES):
        n = columns[FIGURES * k]
        data = None if k else _squeezed(_steps(keys), *columns)
        rows.append([side, shard, kind, data, *(int((n == m).sum()) for m in (1, 2, 3, 4)), int((n > 0).sum()), int(n.sum())])
    names = [c.split() for c in _COUNTS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [c for c, _ in names])


def _by_side(place: np.ndarray, side: np.ndarray, size: int) -> list[np.ndarray]:
    """How many of each place there are, of ``SIDES``."""
    own = [np.bincount(place[side == k], minlength=size) for k in range(BOTH + 1)]
    return [sum(own), *own[:BOTH]]


def _classes(context: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
    """By context: the sum of ``n``, and how many of its n-grams have 1, 2, more."""
    return [np.bincount(context, n, size), *(np.bincount(context[x], minlength=size) for x in (n == 1, n == 2, n > 2))]


def _merged(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of columns by key."""
    keys, _, place = _ranked(np.concatenate([k for k, _ in parts]))
    return keys, [np.bincount(place, np.concatenate(c), len(keys)).astype(np.int64) for c in zip(*(c for _, c in parts), strict=True)]


def _word_counts(rows: DataFrame, shards: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The counts of text, as rows of ``_COUNTS``; discounts by side and order; total and spare mass by side of the empty context.

    Text of side 0 or 1 counts for that side and for both, so one count serves all. Each
    three words go to the shard of the first two, where they are counted, and to that
    of the last two, where the different first words are. That is done for a share of
    the shards at a time, and shuffles end with it. Kinds: 3 and 2 n-grams, 1 words, 0 a shard's share in words.
    The counts are in buckets by shard, so that what joins them shuffles its own side only; shares go when they are summed.
    """
    rounds = min(COUNT_ROUNDS, shards)

    def count(turn: int) -> DataFrame:
        def run(batches):
            parts, held = [], 0
            for batch in batches:
                side = batch.column(1).to_numpy(zero_copy_only=False)
                buf, off = textvec.binary_column(batch.column(0))
                for i, j in textvec.chunks(off):
                    (word, two, three), (before, context), _, first = word_grams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                    to = [_shards(x, shards) for x in (context, two)]
                    at = np.repeat(side[i:j], np.diff(first))
                    left, right = (x % rounds == turn for x in to)
                    parts.append([at[left], context[left], three[left], at[right], two[right], three[right], before[right], word[right]])
                    held += len(word)
                if held > 2_000_000:
                    yield from sent(parts)
                    parts, held = [], 0
            if parts:
                yield from sent(parts)
            give_back()

        def sent(parts):
            sides, context, three, sides2, two, three2, before, word = (np.concatenate(x) for x in zip(*parts, strict=True))
            for k in np.union1d(sides, sides2).tolist():
                x = np.flatnonzero(sides == k)
                own, _, place = _ranked(context[x])
                pair = np.sort((place.astype(np.uint64) << _PLACE) | (three[x] & _OWN))
                own, ending = own[pair >> _PLACE], pair & _OWN
                for shard, i, j in _cuts(_shards(own, shards)):
                    yield row(k, shard, True, _squeezed(_steps(own[i:j]), ending[i:j]))
                x = np.flatnonzero(sides2 == k)
                own, at, place = _ranked(two[x])
                first, last = before[x[at]], word[x[at]]
                pair = _distinct((place.astype(np.uint64) << _PLACE) | (three2[x] & _OWN))
                of, ending = (pair >> _PLACE).astype(np.int64), pair & _OWN
                for shard, i, j in _cuts(_shards(own[of], shards)):
                    a, b = of[i], of[j - 1] + 1
                    known, _, place = _ranked(np.concatenate([first[a:b], last[a:b]]))
                    yield row(k, shard, False, _squeezed(_steps(own[of[i:j]]), ending[i:j], _steps(known), place[: b - a], place[b - a :]))

        def row(side, shard, left, data):
            return pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([shard], pa.int32()), pa.array([left]), pa.array([data])], ["side", "shard", "left", "data"])

        def reduce(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            left, right = [], []
            for side, is_left, data in zip(table.column("side").to_pylist(), table.column("left").to_pylist(), table.column("data"), strict=True):
                x = _stretched(data.as_py())
                own = _sums(x[0])
                of = np.full(len(own), side, np.int8)
                if is_left:
                    left.append((of, own, (own & ~_OWN) | x[1]))
                else:
                    known = _sums(x[2])
                    group = np.cumsum(np.diff(own, prepend=own[:1]) != 0)
                    right.append((of, own, x[1], known[x[3].astype(np.int64)][group], known[x[4].astype(np.int64)][group]))
            out, bigrams = [], []
            if left:
                side, context, three = (np.concatenate(x) for x in zip(*left, strict=True))
                left.clear()
                keys, at, place = _ranked(three)
                counts = _by_side(place, side, len(keys))
                zeros = [np.zeros(len(keys), np.int64)] * (FIGURES - 1)
                out.append(_counted(shard, 3, keys, [c for n in counts for c in (n, *zeros)]))
                contexts, _, place = _ranked(context[at])
                none = np.zeros(len(contexts))
                bigrams.append((contexts, [c for n in counts for c in (none, *_classes(place, n, len(contexts)))]))
            if right:
                side, two, three, before, word = (np.concatenate(x) for x in zip(*right, strict=True))
                right.clear()
                keys, at, place = _ranked(two)
                before, word = before[at], word[at]
                pairs, _, place = _ranked((place.astype(np.uint64) << _PLACE) | three)
                group = (pairs >> _PLACE).astype(np.int64)
                counts = [np.bincount(group[n > 0], minlength=len(keys)) for n in _by_side(place, side, len(pairs))]
                zeros = [np.zeros(len(keys))] * (FIGURES - 1)
                bigrams.append((keys, [c for n in counts for c in (n, *zeros)]))
                words, _, place = _ranked(np.concatenate([before, word]))
                columns = []
                for n in counts:
                    columns += [np.bincount(place[len(keys) :][n > 0], minlength=len(words)), *_classes(place[: len(keys)], n, len(words))]
                for to, i, j in _cuts(_shards(words, shards)):
                    out.append(_counted(to, 0, words[i:j], [c[i:j] for c in columns]))
            out.append(_counted(shard, 2, *_merged(bigrams)))
            give_back()
            return pa.Table.from_batches(out)

        sent_ = rows.mapInArrow(run, "side int, shard int, left boolean, data binary")
        return saved(sent_.groupBy("shard").applyInArrow(reduce, _COUNTS), "turn", clear=True)

    def summed(table: pa.Table) -> pa.Table:
        parts = [(_sums(keys), columns) for keys, *columns in (_stretched(x.as_py()) for x in table.column("data"))]
        return pa.Table.from_batches([_counted(table.column("shard")[0].as_py(), 1, *_merged(parts))])

    out = Buckets(rows.sparkSession, "ngrams", "shard")
    shares = []
    for turn in range(rounds):
        counted = count(turn)
        out.add(counted.where("kind > 0"))
        shares.append(saved(counted.where("kind = 0 and data is not null").select("shard", "data"), "shares"))
        discard(counted)
    of_words = shares[0]
    for t in shares[1:]:
        of_words = of_words.unionByName(t)
    out.add(of_words.groupBy("shard").applyInArrow(summed, _COUNTS))
    for t in shares:
        discard(t)
    whole = out.rows()
    keyed = whole.where("data is not null")
    keyed._buckets = out
    discounts, single = np.zeros((3, WORD_ORDER, 4)), np.zeros((3, 2))
    for r in whole.groupBy("side", "kind").agg(*(F.sum(c) for c in ("m1", "m2", "m3", "m4", "number", "total"))).collect():
        side, kind, *m, number, total = r
        d = discounts[side, kind - 1] = _discounts_of(m)
        if kind == 1:
            single[side] = total, d[1] * m[0] + d[2] * m[1] + d[3] * (number - m[0] - m[1])
    return keyed, discounts, single


class Model:
    """What judging takes: counts of symbols' and words' n-grams, toxic words, and the limit of each language."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, shards: int, toxic: np.ndarray, allowance: float):
        order = np.argsort(codes)
        self.codes, self.counts, self.toxic, self.shards = codes[order], counts[order], toxic, shards
        self.allowance, self.deviation = allowance, 0.0
        self.overall, self.limits = math.inf, {}
        self.name = uuid.uuid4().hex

    def learn(self, rows: DataFrame) -> None:
        """Takes the counts of the rows' texts (text, side) for those it had."""
        self.words, self.discounts, self.single = _word_counts(rows, self.shards)

    def forget(self) -> None:
        """Deletes the counts."""
        self.words._buckets.discard()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def table(self) -> _Spelling:
        return textvec.resident(("table", self.name), lambda: _Spelling(self.codes, self.counts))

    def sums(self, buf: np.ndarray, off: np.ndarray, places: list[np.ndarray], outset: np.ndarray, answers: list[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]) -> tuple[list[list[np.ndarray]], np.ndarray]:
        """For each of the answers each row's sums of log-probabilities, of their squares, of their products with lengths and of lengths' squares, a word each; each row's number of toxic words.

        ``places`` are the words' n-grams' indexes in the answers' figures, ``outset``
        those of what stands before a text; an answer is a side, its counts, totals and spare masses.
        """
        bounds = starts, _, first = textvec.word_bounds(buf, off, textvec.NOT_SPACE)
        spelled = self.table()[grams(buf, off, bounds)].astype(np.float64)
        marks = _distinct(np.concatenate([starts, off]))
        pieces = textvec.row_sums(spelled, marks)
        at = np.searchsorted(marks, starts)
        heads = first[:-1][first[:-1] < first[1:]]
        contexts = [np.roll(x, 1) for x in places[:2]]
        for x, place in zip(contexts, outset, strict=True):
            x[heads] = place
        size, whole = np.diff(marks)[at].astype(np.float64), pieces[at]
        begin = np.searchsorted(marks, off)
        lead = np.flatnonzero((off[1:] > off[:-1]) & ~textvec.NOT_SPACE[buf[np.minimum(off[:-1], len(buf) - 1)]]) if len(buf) else begin[:0]  # white space before the first word
        out = []
        for side, n, totals, spares in answers:
            lp = word_log_probabilities(places, contexts, whole, n, totals, spares, self.discounts[side], self.single[side])
            out.append([textvec.row_sums(x, first) for x in (lp, lp * lp, lp * size, size * size)])
            out[-1][0][lead] += pieces[begin[lead]]
        words, first = textvec.words(buf, off, textvec.LETTERS)
        hit = np.flatnonzero(self.marked()[(words >> U64(48)).astype(np.int64)])
        hits = np.zeros(len(words), np.int64)
        hits[hit[np.isin(words[hit], self.toxic)]] = 1
        return out, textvec.row_sums(hits, first)

    def marked(self) -> np.ndarray:
        """Whether a toxic word's hash begins with these 16 bits."""
        out = np.zeros(1 << 16, bool)
        out[(self.toxic >> U64(48)).astype(np.int64)] = True
        return out

    def figures(self, lp: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1)
        return -lp / n - self.allowance * self.deviation / np.sqrt(n)


def _places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each key's index among the sorted known ones; their number, where it isn't there."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[k] == keys, k, len(known))


def _found(arrays: list[np.ndarray], blobs: Iterable[bytes], shards: int, columns: int = FIGURES) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each key's index in the columns that answer, which end with a zero for keys without an answer, and the columns.

    ``blobs`` are the answers in the order of shards. ``arrays`` is emptied, and figures
    stay as narrow as they came, as a part has a few million keys.
    """
    bounds = np.cumsum([len(x) for x in arrays[:-1]])
    keys = np.concatenate(arrays)
    arrays.clear()
    by = np.argsort(keys)
    keys = keys[by]
    by = by.astype(np.int32)
    new = np.append(True, keys[1:] != keys[:-1])
    cuts = _cuts(_shards(keys[new], shards))
    del keys
    hits, columns = [], [[] for _ in range(columns)]
    for blob, (_, i, j) in zip(blobs, cuts, strict=True):
        hit, *more = _stretched(blob, narrow=True)
        hits.append(np.unpackbits(hit.astype(np.uint8), count=j - i))
        for c, v in zip(columns, more, strict=True):
            c.append(v)
    for k, c in enumerate(columns):
        columns[k] = np.concatenate([*c, np.zeros(1, np.uint8)])
        c.clear()
    hits = np.concatenate(hits) > 0
    place = np.where(hits, np.cumsum(hits, dtype=np.int32) - np.int32(1), np.int32(len(columns[0]) - 1))
    places = np.empty(len(by), np.int32)
    places[by] = place[np.cumsum(new, dtype=np.int32) - np.int32(1)]
    return np.split(places, bounds), columns


def _scored(docs: DataFrame, side: str, text: str, model: Model, result, schema, name: str, most: int, both: bool = False) -> DataFrame:
    """``result(model, rows, n, sums, hits)`` of the rows, part by part, with the counts their n-grams have; ``side`` and ``text`` are columns.

    ``sums`` are those by the counts of a row's side; with ``both`` those by all counts
    come after them, where they are others. The parts, each of one side, take turns, up
    to ``most``, each written as a table of that name before the next, so that what is
    shuffled at a time is a share of the whole.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    used = set(docs.columns)
    part = fresh("part", used)
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    sizes = sorted(docs.groupBy(f"`{side}`").agg(F.sum(F.length(raw))).collect()) or [(BOTH, 0)]
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != text and "map<" not in kind and kind != "variant"]  # equal texts of different rows needn't meet
    parts, number = 0, F.lit(0)
    for k, size in sizes:
        own = max(1, math.ceil(size / PART_BYTES))
        number = F.when(F.col(f"`{side}`") == k, F.lit(parts) + F.pmod(F.xxhash64(raw, *plain), F.lit(own))).otherwise(number)
        parts += own
    docs = docs.withColumn(part, number.cast("int"))
    at, on, whole = docs.columns.index(text), docs.columns.index(side), docs.columns.index(part)

    def asks_of(side: int) -> list[int]:
        return [side, BOTH] if both and side != BOTH else [side]

    def texts(rows: pa.Table):
        """Rows, and bounds within a buffer, of all chunks."""
        for batch in rows.to_batches():
            buf, off = textvec.binary_column(batch.column(at).cast(pa.string()))
            for i, j in textvec.chunks(off):
                yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]

    def asked(rows: pa.Table) -> list[np.ndarray]:
        """The keys: of what stands before a text, then three arrays a chunk."""
        keys = [np.array([_BEFORE, _BEFORE_TWO])]
        for _, buf, off in texts(rows):
            keys += word_grams(buf, off)[0]
        return keys

    def ask(rows: pa.Table) -> pa.Table:
        of, k = rows.column(whole)[0].as_py(), rows.column(on)[0].as_py()
        keys = asked(rows)
        joined = np.concatenate(keys)
        keys.clear()
        keys = _distinct(joined)
        del joined
        out = [(of, k, shard, _squeezed(_steps(keys[i:j]))) for shard, i, j in _cuts(_shards(keys, shared.value.shards))]
        give_back()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [part, "side", "shard", "data"])

    def answer(asks: pa.Table, counts: pa.Table) -> pa.Table:
        asked = [_sums(_stretched(x.as_py())[0]) for x in asks.column("data")]
        keys = np.concatenate([*asked, np.zeros(0, np.uint64)])
        hit, columns = np.zeros(len(keys), bool), [np.zeros(len(keys), np.uint8)] * (FIGURES * len(SIDES))
        for x in counts.column("data") if len(keys) else ():
            known, *figures = _stretched(x.as_py(), narrow=True)
            places = _places(keys, _sums(known))
            own = np.flatnonzero(places < len(known))
            places = places[own]
            hit[own] = True
            for c, figure in enumerate(figures):
                if (found := figure[places]).any():
                    columns[c] = columns[c].astype(np.promote_types(columns[c].dtype, found.dtype))
                    columns[c][own] = found
        out, j = [], 0
        for k, x in zip(asks.column("side").to_pylist(), asked, strict=True):
            i, j = j, j + len(x)
            begins = [FIGURES * SIDES.index(of) for of in asks_of(k)]
            out.append(_squeezed(np.packbits(hit[i:j]), *(c[i:j][hit[i:j]] for b in begins for c in columns[b : b + FIGURES])))
        give_back()
        return asks.set_column(asks.column_names.index("data"), "data", pa.array(out, pa.binary()))

    def judge(rows: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        model.table()  # what making it takes is free again before the keys are held
        sides = asks_of(rows.column(on)[0].as_py())
        data = answers.column("data")
        blobs = (data[x].as_py() for x in np.argsort(answers.column("shard").to_numpy()).tolist())
        places, columns = _found(asked(rows), blobs, model.shards, FIGURES * len(sides))
        places, figures = iter(places), []
        for k in sides:
            n, total, *follow = columns[:FIGURES]
            del columns[:FIGURES]
            figures.append((k, n, total, [_Spares(model.discounts[k, order][1:], follow) for order in (1, 2)]))
        outset = next(places)
        out = [result(model, some, np.diff(off), *model.sums(buf, off, [next(places) for _ in range(WORD_ORDER)], outset, figures)) for some, buf, off in texts(rows)]
        give_back()
        return pa.Table.from_batches(out)

    turns, done = min(parts, most), []
    for turn in range(turns):
        some = docs.where(F.col(part) % turns == turn) if turns > 1 else docs
        asks = some.groupBy(part).applyInArrow(ask, f"`{part}` int, side int, shard int, data binary")
        counts = model.words.select("shard", "data")
        answers = asks.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(answer, f"`{part}` int, side int, shard int, data binary")
        done.append(saved(some.groupBy(part).cogroup(answers.groupBy(part)).applyInArrow(judge, schema), name, clear=True))
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out


def _taught(rows: DataFrame, allowance: float) -> Model:
    """The model with all counts, still without limits, of what ``labelled`` gives; a text of half 0 counts for side 1, and the other way round."""
    toxic = _toxic_words(rows)
    seen = _counts(rows).toPandas()
    taught = rows.where("trusted").select("text", (1 - _half("text")).alias("side"))
    size = taught.agg(F.sum(F.length("text"))).first()[0] or 0
    model = Model(seen["gram"].to_numpy(np.int64), seen["n"].to_numpy(np.int64), min(1 << 16, max(1, math.ceil(size / SHARD_BYTES))), toxic, allowance)
    model.learn(taught)
    return model


def _half(text: str):
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


#: What limits are found from: symbols, and the sums by the counts of a row's side.
_OWN_SUMS = "n long, lp double, lp2 double, lpn double, n2 double"


def _limit(model: Model, trusted: DataFrame, quantile: float) -> None:
    """Sets the limits by the trusted documents' lang and ``_OWN_SUMS``."""
    trusted = trusted.where("n > 0")
    total, lp, lp2, lpn, n2 = trusted.agg(*(F.sum(c) for c in ("n", "lp", "lp2", "lpn", "n2"))).first()
    if total:
        mean = lp / total
        model.deviation = math.sqrt(max(0.0, (lp2 - 2 * mean * lpn + mean * mean * n2) / total))
        figure = -F.col("lp") / F.col("n") - F.lit(model.allowance * model.deviation) / F.sqrt(F.col("n").cast("double"))
        cut = F.percentile_approx(figure, F.lit(quantile), F.lit(20_000))
        model.overall = trusted.agg(cut).first()[0]
        model.limits = dict(trusted.groupBy("lang").agg(cut).collect())


def fit(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, allowance: float = 1.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all trusted documents and the limit of each language.

    ``labels`` has doc_id, quality (1: trusted) and toxic (1: not trusted). The limit
    of a language is the ``quantile`` of its trusted documents' figures: cross-entropy,
    by the counts of the half of the trusted texts (by hash) that a text isn't in, less
    ``allowance`` standard deviations of a byte over the root of the length.
    Labels of null ids or of ids without a document play no part; of several labels of
    an id the worst holds, and a null quality or toxic counts as 0; all documents of a
    labelled id count, repeated ones as often; null and empty texts teach nothing; other
    columns are ignored. Without trusted documents nothing is learned and all pass.
    """
    rows = labelled(docs, labels, id_col, text_col, lang_col)
    model = _taught(rows, allowance)

    def result(model, rows, n, sums, hits):
        return pa.RecordBatch.from_arrays([rows.column(1), pa.array(n), *map(pa.array, sums[0])], ["lang", *(c.split()[0] for c in _OWN_SUMS.split(", "))])

    halves = rows.where("trusted").select(F.col("text").cast("string").alias("text"), "lang", _half("text").alias("side"))
    _limit(model, _scored(halves, "side", "text", model, result, f"lang string, {_OWN_SUMS}", "trusted", COUNT_ROUNDS), quantile)
    return model


SCORES = "doc_id long, lang string, n_symbols long, perplexity double, entropy_limit double, n_toxic_words long, kept boolean"


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang, n_symbols, perplexity, entropy_limit, n_toxic_words, kept.

    A row is kept if its figure (see ``fit``) is within the limit of its language and
    it holds no toxic word. Null and empty texts have no symbols, perplexity 1, and are
    kept. A null language is one of its own; a language without trusted documents takes
    the limit over all trusted ones; without any trusted document nothing is rejected
    by perplexity. Every row is judged by itself, repeated ones alike; other columns
    are ignored; an empty table gives an empty result.
    """
    def result(model, rows, n, sums, hits):
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, _judged(model, rows.column(1), n, sums[-1][0], hits))], [c.split()[0] for c in SCORES.split(", ")])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(BOTH).alias("side"))
    return _scored(rows, "side", "text", model, result, SCORES, "scores", ROUNDS)


def _judged(model: Model, langs: pa.Array, n: np.ndarray, lp: np.ndarray, hits: np.ndarray) -> list[np.ndarray]:
    """n_symbols, perplexity, limit, n_toxic_words, kept."""
    limit = np.array([model.limits.get(x, model.overall) for x in langs.to_pylist()], np.float64)
    kept = (n == 0) | ((model.figures(lp, n) <= limit + 1e-9) & (hits == 0))
    return [n, np.exp(-lp / np.maximum(n, 1)), limit, hits, kept]


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, all columns, that ``classify`` keeps."""
    side = fresh("side", set(docs.columns))
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)
    names, width = docs.columns, len(docs.columns)

    def result(model, rows, n, sums, hits):
        kept = _judged(model, rows.column(lang).cast(pa.string()), n, sums[-1][0], hits)[-1]
        return pa.RecordBatch.from_arrays(rows.columns[:width], names).filter(pa.array(kept))

    return _scored(docs.withColumn(side, F.lit(BOTH)), side, names[text], model, result, docs.schema, "kept", ROUNDS)


def _scored_at_once(docs: DataFrame, labels: DataFrame, columns: list[str], quantile: float, allowance: float, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list]:
    """Those columns of all rows and what ``fit`` and ``classify`` make of them: lang, n_symbols, perplexity, entropy_limit, n_toxic_words, kept.

    Trusted documents are scored by the other half's counts and by all in one go, so every text is looked up once.
    """
    model = _taught(labelled(docs, labels, id_col, text_col, lang_col), allowance)
    used = set(docs.columns)
    at, lang, side, n, lp, hits, *own = (fresh(c, used) for c in ("known", "lang", "side", "n", "lp", "hits", "own_lp", "own_lp2", "own_lpn", "own_n2"))
    known = _known(labels).where("trusted").select(F.col("doc_id").alias(at))
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.join(known, F.col(f"`{id_col}`") == F.col(at), "left")
    rows = rows.select(*(f"`{c}`" for c in dict.fromkeys([*columns, text_col])), F.col(f"`{lang_col}`").cast("string").alias(lang), F.when(F.col(at).isNull(), F.lit(BOTH)).otherwise(_half(raw)).alias(side))
    kept, tongue = [rows.columns.index(c) for c in columns], rows.columns.index(lang)

    def result(model, rows, symbols, sums, toxic):
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), rows.column(tongue), rows.column(tongue + 1), pa.array(symbols), pa.array(sums[-1][0]), pa.array(toxic), *map(pa.array, sums[0])], names)

    schema = StructType([*(docs.schema[c] for c in columns), *StructType.fromDDL(f"{lang} string, {side} int, {n} long, {lp} double, {hits} long, " + ", ".join(f"{c} double" for c in own))])
    names = schema.names
    scored = _scored(rows, side, text_col, model, result, schema, "figures", ROUNDS, both=True)
    model.forget()
    _limit(model, scored.where(F.col(side) != BOTH).select(F.col(lang).alias("lang"), F.col(n).alias("n"), *(F.col(c).alias(a) for c, a in zip(own, ("lp", "lp2", "lpn", "n2"), strict=True))), quantile)
    lang, n, lp, hits = map(F.col, (lang, n, lp, hits))
    most = F.lit(float(model.overall))
    limit = F.when(lang.isNull(), F.lit(float(model.limits.get(None, model.overall)))).otherwise(most)
    if known_langs := [x for k, v in model.limits.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]:
        limit = F.when(lang.isNull(), limit).otherwise(F.coalesce(F.try_element_at(F.create_map(*known_langs), lang), most))
    mean = -lp / F.greatest(n, F.lit(1)).cast("double")
    figure = mean - F.lit(model.allowance * model.deviation) / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))
    return scored, [lang, n, F.exp(mean), limit, hits, (n == 0) | ((figure <= limit + 1e-9) & (hits == 0))]


def fit_and_classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, allowance: float = 1.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``classify(docs, fit(docs, labels))``, with each text's counts looked up once."""
    scored, judged = _scored_at_once(docs, labels, [id_col], quantile, allowance, id_col, text_col, lang_col)
    names = [c.split()[0] for c in SCORES.split(", ")]
    return scored.select(F.col(f"`{id_col}`").alias(names[0]), *(c.alias(name) for c, name in zip(judged, names[1:], strict=True)))


def fit_and_keep(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, allowance: float = 1.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``keep_good(docs, fit(docs, labels))``, with each text's counts looked up once."""
    scored, judged = _scored_at_once(docs, labels, docs.columns, quantile, allowance, id_col, text_col, lang_col)
    return scored.where(judged[-1]).select(*(f"`{c}`" for c in docs.columns))
