"""Language identification by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its character n-grams and the word
itself (lexicon), hashed into a table of weights; transitions between the languages of
neighbouring words are learned too. A chain is all the words of a text; each word gets
its marginal probabilities by forward-backward, and a text the mean of them over all its
words. So that a long chain isn't walked word by word, it is cut into blocks of ``BLOCK``
words: the product of a block's transitions and emissions is one small matrix, messages
pass over these matrices, and then within all blocks at once. That is the whole chain's
forward-backward, no transition left out. Sums are taken in one order whatever else is
in a batch, so a text has the same score in any partitioning.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.llm import textvec
from spindex.llm.common import arrow_map, fresh, least_hashes, text_bytes

U64 = np.uint64
BITS = 17
BLOCK = 48
#: Training documents of a language: those of the smallest id hashes among texts of at most ``MOST_BYTES`` bytes.
SAMPLE, MOST_BYTES = 120, 1 << 18
FOUND = "doc_id long, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words in a lower-cased buffer: a flat array, and each word's first index (n + 1)."""
    n = ends - starts
    kinds: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(n)), textvec.span_hashes(buf, starts, ends) ^ U64(1))]
    for size in (1, 2, 3):  # affixes
        some = np.flatnonzero(n > size)
        kinds.append((some, textvec.span_hashes(buf, starts[some], starts[some] + size) ^ U64(16 + size)))
        kinds.append((some, textvec.span_hashes(buf, ends[some] - size, ends[some]) ^ U64(32 + size)))
    for size in (2, 3, 4):  # n-grams
        number = np.maximum(0, n - size + 1)
        word = np.repeat(np.arange(len(n)), number)
        at = starts[word] + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
        kinds.append((word, textvec.span_hashes(buf, at, at + size) ^ U64(64 + size)))
    word = np.concatenate([k[0] for k in kinds])
    value = (textvec.mix(np.concatenate([k[1] for k in kinds])) >> U64(64 - BITS)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return value[order], np.searchsorted(word[order], np.arange(len(n) + 1))


def _spans(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the rows that have words."""
    size = np.diff(first)
    return first[:-1][size > 0], size[size > 0]


def _times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row vectors (or matrices) times a matrix, summed in one order, so that no value depends on how many are multiplied at once."""
    out = left[..., :1] * right[0]
    for i in range(1, len(right)):
        out = out + left[..., i : i + 1] * right[i]
    return out


def _each(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each row vector times its own matrix."""
    out = left[:, :1] * right[:, 0]
    for i in range(1, right.shape[1]):
        out = out + left[:, i : i + 1] * right[:, i]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to a sum of 1."""
    total = x[..., :1].copy()
    for i in range(1, x.shape[-1]):
        total = total + x[..., i : i + 1]
    return x / total


def forward_backward(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alpha and beta messages, each to scale, of every word of all chains (of at least one word); see ``marginals``.

    ``emission`` has a row of positive scores for each word, ``transition`` positive
    scores from row to column.
    """
    n, k = emission.shape
    alpha, beta = np.empty((n, k)), np.full((n, k), 1.0 / k)
    alpha[start] = _unit(emission[start])
    # blocks of the words after the first, those of a chain one after the other
    number = -(-(size - 1) // BLOCK)
    chain = np.repeat(np.arange(len(size)), number)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(number) - number, number)
    begin = start[chain] + 1 + place * BLOCK
    length = np.minimum(BLOCK, start[chain] + size[chain] - begin)
    by = np.argsort(-length, kind="stable")
    active = [by[: int((length > t).sum())] for t in range(BLOCK)]

    whole = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for t, some in enumerate(active):
        if len(some):
            step = _times(whole[some], transition) * emission[begin[some] + t][:, None, :]
            whole[some] = step / step.sum(axis=2).max(axis=1)[:, None, None]
    # messages from block to block
    most = int(number.max()) if len(number) else 0
    into, out_of = np.empty((len(chain), k)), np.full((len(chain), k), 1.0 / k)
    head = np.cumsum(number) - number
    long = np.argsort(-number, kind="stable")
    live = [long[: int((number > o).sum())] for o in range(most)]
    for o in range(most):
        b = head[live[o]] + o
        into[b] = alpha[start[live[o]]] if o == 0 else _unit(_each(into[b - 1], whole[b - 1]))
    flipped = np.swapaxes(whole, 1, 2)
    for o in range(most - 2, -1, -1):
        b = head[live[o + 1]] + o
        out_of[b] = _unit(_each(out_of[b + 1], flipped[b + 1]))
    # within blocks
    now = into
    for t, some in enumerate(active):
        at = begin[some] + t
        alpha[at] = now[some] = _unit(_times(now[some], transition) * emission[at])
    now = out_of.copy()
    back = transition.T.copy()
    for t in range(BLOCK - 1, -1, -1):
        some = active[t]
        at = begin[some] + t
        beta[at] = now[some]
        now[some] = _unit(_times(emission[at] * now[some], back))
    first = number > 0
    beta[start[first]] = now[head[first]]
    return alpha, beta


def marginals(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The probabilities of every word's labels, given its whole chain."""
    alpha, beta = forward_backward(emission, transition, start, size)
    return _unit(alpha * beta)


def expected_moves(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and the expected number of each transition in all chains."""
    alpha, beta = forward_backward(emission, transition, start, size)
    inner = np.ones(len(emission), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    both = alpha[at - 1][:, :, None] * transition[None] * (emission[at] * beta[at])[:, None, :]
    return _unit(alpha * beta), (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Tagger:
    """The field's weights, and predictions with them."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.weight = np.zeros((1 << BITS, len(langs)), np.float32)
        self.move = np.zeros((len(langs), len(langs)))

    def emissions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positive scores of each word; equal words are scored once."""
        hashes = textvec.span_hashes(buf, starts, ends)
        _, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        value, first = features(buf, starts[place], ends[place])
        total = np.add.reduceat(self.weight[value], first[:-1], axis=0) if len(value) else np.zeros((0, len(self.langs)))
        total = total / np.sqrt(np.diff(first))[:, None]
        return np.exp(total - total.max(axis=1, keepdims=True)).astype(np.float64)[inverse]

    def train(self, texts: list[bytes], labels: list[int], passes: int = 2, rate: float = 0.5, seed: int = 3) -> None:
        """Maximises the likelihood of word labels by AdaGrad on chains of code-switched text.

        A chain takes ten stretches of 3 to 24 words from documents of changing languages,
        so that staying and switching are both seen.
        """
        rng = np.random.default_rng(seed)
        joined = textvec.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts, ends, first = textvec.word_bounds(joined, off, textvec.LETTERS)
        label = np.repeat(np.array(labels), np.diff(first))
        pieces, at = [], 0
        while at < len(starts):
            size = int(rng.integers(3, 25))
            pieces.append((at, min(len(starts), at + size)))
            at += size
        rng.shuffle(pieces)
        k = len(self.langs)
        grown = np.full(self.weight.shape, 1e-4, np.float32)
        moved = np.full((k, k), 1e-4)
        for _ in range(passes):
            for i in range(0, len(pieces), 400):
                index = np.concatenate([np.arange(a, b) for a, b in pieces[i : i + 400]])
                value, bound = features(joined, starts[index], ends[index])
                norm = np.sqrt(np.diff(bound))
                raw = np.add.reduceat(self.weight[value], bound[:-1], axis=0) / norm[:, None]
                emission = np.exp(raw - raw.max(axis=1, keepdims=True)).astype(np.float64)
                cuts = np.cumsum([b - a for a, b in pieces[i : i + 400]])
                start, size = _spans(np.concatenate([[0], cuts[9:-1:10], cuts[-1:]]))
                got, pairs = expected_moves(emission, np.exp(self.move), start, size)
                y = label[index]
                error = (np.eye(k)[y] - got) / len(index)
                inner = np.ones(len(index) - 1, bool)
                inner[start[1:] - 1] = False
                truth = np.zeros((k, k))
                np.add.at(truth, (y[:-1][inner], y[1:][inner]), 1)
                step = np.repeat((error / norm[:, None]).astype(np.float32), np.diff(bound), axis=0)
                used, inverse = np.unique(value, return_inverse=True)
                slope = np.zeros((len(used), k), np.float32)
                np.add.at(slope, inverse, step)
                slope *= 100
                grown[used] += slope * slope
                self.weight[used] += rate * slope / np.sqrt(grown[used])
                g = (truth - pairs) / len(index) * 10
                moved += g * g
                self.move += rate * 0.1 * g / np.sqrt(moved)

    def tag(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of all rows, and each row's first word."""
        low = textvec.LOWER[buf]
        starts, ends, first = textvec.word_bounds(low, off, textvec.LETTERS)
        if not len(starts):
            return np.zeros((0, len(self.langs))), first
        return marginals(self.emissions(low, starts, ends), np.exp(self.move), *_spans(first)), first


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of training: the CRC-32 of its id as text is divisible by 5; a null id is."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def learn(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tagger:
    """A tagger fitted on ``sample`` documents of each language that aren't held out; only text and language are seen.

    They are those of the smallest id hashes among texts of at most ``MOST_BYTES`` bytes.
    Rows whose id, text or language is null aren't learned from; repeated ids and texts
    count as rows of their own; empty texts teach nothing; other columns are ignored. Of
    no rows no language is learned, of one language no weights.
    """
    open_ = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & (F.octet_length(F.col(f"`{text_col}`")) <= MOST_BYTES) & (F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 != 0))
    open_ = open_.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows = sorted(least_hashes(open_, "id", sample, "lang").collect())
    langs = sorted({r.lang for r in rows})
    texts, labels = [bytes(r.text) + b" " for r in rows], [langs.index(r.lang) for r in rows]
    tagger = Tagger(langs)
    if len(langs) > 1:
        tagger.train(texts, labels)
    return tagger


def identify(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    The language with the largest mean marginal over all words of the text, and that
    mean; of equals the first by name. A text that is null or has no letter is 'und' with
    score 0, as is any text if no language was learned. Only the text is looked at. Rows
    are one for one; a null id counts as held out; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    letter_col = fresh("letter", set(docs.columns))
    base = docs.withColumn(letter_col, F.coalesce(F.col(f"`{text_col}`").cast("string").rlike("\\p{L}"), F.lit(False)))

    def run(batch: pa.RecordBatch):
        known = shared.value
        buf, off = textvec.binary_column(batch.column(1))
        letter = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        for i, j in textvec.chunks(off):
            mean = np.zeros((j - i, max(1, len(known.langs))))
            if known.langs:
                p, first = known.tag(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                total = np.stack([textvec.row_sums(np.ascontiguousarray(p[:, c]), first) for c in range(p.shape[1])], 1)
                mean = total / np.maximum(1, np.diff(first))[:, None]
            best = mean.argmax(axis=1)
            sure = letter[i:j] & bool(known.langs)
            names = [known.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
            score = np.where(sure, np.clip(mean[np.arange(j - i), best], 0.0, 1.0), 0.0)
            ids = batch.column(0).slice(i, j - i)
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(x) for x in ids.to_pylist()]), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return arrow_map(text_bytes(base, id_col, text_col, letter_col), run, FOUND)
