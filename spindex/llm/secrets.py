"""Secret scans: three fixed formats, and formats inferred from the credentials those find.

Credentials found by the fixed formats, a bounded sample of them per kind, are the
labelled examples from which one probabilistic automaton per kind is inferred. Every
other token of every text that is at least as long as the shortest of them is then a
candidate, scored by the best automaton's likelihood against that of ordinary tokens;
those within reach of the labelled credentials' own scores are added as spans of kind
``format``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.llm import textvec
from spindex.llm.automaton import SYMBOL, Automaton, Background, encoded
from spindex.llm.common import arrow_map, least_hashes, saved, text_bytes

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = textvec.byte_class((0x30, 0x39), (0x61, 0x66))
_TOKEN = textvec.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2F), (0x3D, 0x3D), (0x5F, 0x5F))
_DIGIT = textvec.byte_class((0x30, 0x39))
#: The least length of an ordinary token that is learned from, and of a candidate where nothing shorter is labelled.
LEAST_TOKEN = 12
#: Labelled credentials of a kind, and ordinary tokens, that are learned from: those of the smallest hashes.
SAMPLE = 1_500
#: Values that are learned from have at most so many bytes (all are scored); a kind with fewer distinct ones than ``LEAST_EXAMPLES`` gets no automaton.
MOST_BYTES, LEAST_EXAMPLES = 256, 8
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of at least so many bytes."""
    starts, ends, first = textvec.word_bounds(buf, off, table)
    long = np.flatnonzero(ends - starts >= least)
    return starts[long], ends[long], np.searchsorted(first, long, side="right") - 1


def base_spans(buf: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int, int, int]]]:
    """For each row: (start, kind, end, value start, value end) in bytes of the chunk, in order of start and kind."""
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(len(off) - 1)]
    raw = buf.tobytes()
    low = raw.lower()

    def rows_with(text: bytes, needles: tuple[bytes, ...]) -> list[int]:
        rows = set()
        for needle in needles:
            at = text.find(needle)
            while at >= 0:
                row = int(np.searchsorted(off, at, side="right")) - 1
                rows.add(row)
                at = text.find(needle, int(off[row + 1]))
        return sorted(rows)

    for row in rows_with(low, _NAMES):
        a = int(off[row])
        for m in _ASSIGN.finditer(raw[a : off[row + 1]]):
            if m.end(2) - m.start(2) >= 12:
                out[row].append((a + m.start(), 0, a + m.end(), a + m.start(2), a + m.end(2)))
    for row in rows_with(raw, (b"AKIA",)):
        a = int(off[row])
        for m in _ACCESS.finditer(raw[a : off[row + 1]]):
            if m.end() - m.start() >= 18:
                out[row].append((a + m.start(), 1, a + m.end(), a + m.start(), a + m.end()))
    for s, e, row in zip(*(x.tolist() for x in _runs(buf, off, _HEX, 16)), strict=True):
        out[row].append((s, 2, e, s, e))
    for spans in out:
        spans.sort()
    return out


def _free_tokens(buf: np.ndarray, off: np.ndarray, spans: list[list[tuple]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the tokens of the least length that touch no base span."""
    starts, ends, rows = _runs(buf, off, _TOKEN, least)
    taken = np.zeros(len(buf) + 1, np.int64)
    for x in (x for row in spans for x in row):
        taken[x[0]] += 1
        taken[x[2]] -= 1
    touched = np.concatenate([[0], np.cumsum(np.cumsum(taken)[:-1] > 0)])
    free = touched[ends] == touched[starts]
    return starts[free], ends[free], rows[free]


class Formats:
    """The inferred automata, the background, and the least ratio that is taken for a credential."""

    def __init__(self, labelled: dict[int, list[bytes]], ordinary: list[bytes], reach: float = 0.01):
        self.background = Background(ordinary)
        self.automata = {k: Automaton(v) for k, v in labelled.items() if len(v) >= LEAST_EXAMPLES}
        known = [s for k in self.automata for s in labelled[k]]
        self.shortest = min((len(s) for s in known), default=LEAST_TOKEN)
        self.least = max(0.0, float(np.quantile(self.ratios(*encoded(known)), reach))) if known else float("inf")

    def ratios(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How much likelier a character is by the best automaton than among ordinary tokens, as a logarithm, for each string."""
        best = np.full(len(first) - 1, -1e9)
        for a in self.automata.values():
            np.maximum(best, a.scores(symbols, first), out=best)
        return best - self.background.scores(symbols, first)

    def found(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which spans of the buffer are taken for credentials; equal ones are scored once."""
        if not self.automata or not len(starts):
            return np.zeros(len(starts), bool)
        _, place, inverse = np.unique(textvec.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[place]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(starts[place] - first[:-1], size) + np.arange(int(first[-1]))
        return (self.ratios(SYMBOL[buf[at]].astype(np.int64), first) >= self.least)[inverse]

    def __contains__(self, string: bytes) -> bool:
        return bool(self.found(np.frombuffer(string, np.uint8), np.array([0]), np.array([len(string)]))[0])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Formats:
    """Infers formats from the credentials that the fixed formats find in all texts.

    All texts are scanned; of the distinct values of a kind, and of the distinct tokens
    that hold no digit and touch no credential, the ``sample`` with the smallest hashes
    of those of at most ``MOST_BYTES`` bytes are learned from. Null and empty texts, ids
    (null, repeated or not) and other columns play no part, a value counts once however
    often it occurs; without values of a kind there is no automaton for it, so an empty
    table gives formats that find nothing.
    """

    def run(batch: pa.RecordBatch):
        buf, off = textvec.binary_column(batch.column(1))
        for i, j in textvec.chunks(off):
            part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            raw = part.tobytes()
            base = base_spans(part, at)
            found = {(x[1], raw[x[3] : x[4]]) for spans in base for x in spans if x[4] - x[3] <= MOST_BYTES}
            starts, ends, _ = _free_tokens(part, at, base, LEAST_TOKEN)
            digits = np.concatenate([[0], np.cumsum(_DIGIT[part])])
            plain = (digits[ends] == digits[starts]) & (ends - starts <= MOST_BYTES)
            found |= {(3, raw[s:e]) for s, e in zip(starts[plain].tolist(), ends[plain].tolist(), strict=True)}
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["kind", "value"])

    values = saved(arrow_map(text_bytes(docs, id_col, text_col), run, "kind int, value binary").distinct(), "values")
    held: dict[int, list[bytes]] = {k: [] for k in range(4)}
    for kind, value in sorted(least_hashes(values, "value", sample, "kind").collect()):
        held[kind].append(bytes(value))
    return Formats({k: held[k] for k in range(3)}, held[3])


def scan(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind,
    joined by commas; those of one fixed kind are leftmost and don't overlap. The digest
    is of the fixed kinds' spans alone; ``spans`` also holds those of kind ``format``. A
    text without spans, a null and an empty one have zero counts, an empty ``spans`` and
    the digest of the empty string. Rows are one for one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batch: pa.RecordBatch):
        known = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        buf, off = textvec.binary_column(batch.column(1))
        for i, j in textvec.chunks(off):
            part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            base = base_spans(part, at)
            every: list[list[tuple[int, int, int]]] = [[x[:3] for x in spans] for spans in base]
            starts, ends, rows = _free_tokens(part, at, base, known.shortest)
            sure = known.found(part, starts, ends)
            for row, s, e in zip(rows[sure].tolist(), starts[sure].tolist(), ends[sure].tolist(), strict=True):
                every[row].append((s, 3, e))
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            counts, digests, texts = np.zeros((j - i, 3), np.int64), [nothing] * (j - i), [""] * (j - i)
            for r, spans in enumerate(every):
                if not spans:
                    continue
                begin = points[at[r]]
                shown = [(k, f"{KINDS[k]}:{points[s] - begin}:{points[e] - begin}") for s, k, e in sorted(spans)]
                for k, _ in shown:
                    if k < 3:
                        counts[r, k] += 1
                digests[r] = hashlib.sha256(",".join(x for k, x in shown if k < 3).encode()).hexdigest()
                texts[r] = ",".join(x for _, x in shown)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(counts[:, k].copy()) for k in range(3)], pa.array(digests, pa.string()), pa.array(texts, pa.string())], [c.split()[0] for c in FOUND.split(", ")])

    return arrow_map(text_bytes(docs, id_col, text_col), run, FOUND)
