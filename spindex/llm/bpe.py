"""Byte-level BPE with a whole-token shortcut, vectorised over documents.

Text is cut into pre-tokens by array operations, each pre-token is hashed, and the
hash is looked up in a table. The table starts with the vocabulary strings that the
library itself proves to encode alone as one token (``single_tokens``); only the
other pre-tokens are merged, once each, and remembered while there is room. Rows
that the vectorised cutter doesn't cover (characters beyond U+017F, unusual white
space, special strings) go to the library as a whole, so results are the library's
for every text.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from spindex.llm import textvec as tv
from spindex.llm.common import give_back

U64 = np.uint64
_CODE = {"L": 1, "N": 2}
_SPACE, _OTHER, _BAD = 3, 4, 0


def _char_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and of two-byte characters by lead * 64 + continuation from U+00A1 to U+017F."""
    one = np.zeros(256, np.uint8)
    for c in range(128):
        kind = unicodedata.category(chr(c))[0]
        one[c] = _SPACE if c == 32 or 9 <= c <= 13 else _CODE.get(kind, _OTHER)
    two = np.zeros(64 * 64, np.uint8)
    for c in range(0xA1, 0x180):
        lead, cont = chr(c).encode()
        two[(lead & 63) * 64 + (cont & 63)] = _CODE.get(unicodedata.category(chr(c))[0], _OTHER)
    return one, two


_ONE, _TWO = _char_classes()
#: Pre-tokens of more ids aren't remembered.
LONGEST = 1000
_TAILS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]


def cut(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of all pre-tokens, and a flag for each row that this cutter doesn't cover.

    The starts of uncovered rows are meaningless but stay inside their rows.
    """
    n, rows = len(buf), len(off) - 1
    cls = _ONE[buf]
    high = np.flatnonzero(buf >= 0xC0)
    bad = np.zeros(rows, bool)
    if len(high):
        nxt = buf[np.minimum(high + 1, n - 1)]
        got = np.where((buf[high] <= 0xC5) & (buf[high] >= 0xC2) & (high + 1 < n) & (nxt >= 0x80) & (nxt < 0xC0), _TWO[(buf[high] & 63).astype(np.int64) * 64 + (nxt & 63)], _BAD)
        cls[high] = got
        cls[np.minimum(high + 1, n - 1)] = np.where(got == _BAD, cls[np.minimum(high + 1, n - 1)], got)
    wrong = np.flatnonzero(cls == _BAD)
    if len(wrong):
        bad[np.searchsorted(off, wrong, side="right") - 1] = True
    first = off[:-1][off[:-1] < off[1:]]
    start = np.empty(n + 1, bool)
    start[:-1][1:] = cls[1:] != cls[:-1]
    start[first] = True
    start[n] = True
    # the last white-space character before other text stands alone or, if a blank, begins the next token
    run = np.flatnonzero((cls[:-1] == _SPACE) & (cls[1:] != _SPACE))
    inner = np.zeros(n + 1, bool)
    inner[first] = True
    run = run[~inner[run + 1]]
    start[run] = True
    start[run[buf[run] == 32] + 1] = False
    # 's 't 're 've 'm 'll 'd
    quote = np.flatnonzero((buf == 39) & start[:-1])
    quote = quote[(quote + 1 < n)]
    quote = quote[(cls[quote + 1] == 1) & ~inner[quote + 1]]
    if len(quote):
        row_end = off[np.searchsorted(off, quote, side="right")]
        done = np.zeros(len(quote), bool)
        for tail in _TAILS:
            hit = ~done & (quote + 1 + len(tail) <= row_end)
            for k, b in enumerate(tail):
                hit[hit] = buf[quote[hit] + 1 + k] == b
            done |= hit
            at = quote[hit]
            start[at + 1] = False
            start[at + 1 + len(tail)] |= cls[np.minimum(at + 1 + len(tail), n - 1)] == 1
    return np.flatnonzero(start[:-1]), bad


class Encoder:
    """Token ids, or their number, of whole texts as the library's tokenizer gives them."""

    def __init__(self, path: str, bits: int = 20, pool: int = 3_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        unicode_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in unicode_bytes]
        back = {chr(b): b for b in unicode_bytes} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec["added_tokens"]}
        self.vocab = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.merger = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=self.vocab, special_tokens={})
        self.mask = U64((1 << bits) - 1)
        self.shift = U64(bits)
        self.keys = np.zeros(1 << bits, U64)
        self.at = np.zeros(1 << bits, np.int32)
        self.num = np.zeros(1 << bits, np.uint16)
        self.pool = np.empty(pool, np.uint32)
        self.used = 0
        single = self.single_tokens()
        strings = sorted(single)
        self._insert(tv.text_hash(*strings), [[single[s]] for s in strings])

    def single_tokens(self) -> dict[bytes, int]:
        """Vocabulary strings that the merges build into one token, so a pre-token equal to one needs no merging.

        Proved from the merge list: a string is reachable if merging it alone
        ends in its own id. The merger would return any vocabulary string at
        once, so its halves are found by the library's own model.
        """
        model, out = self.library.model, {}
        for s, i in self.vocab.items():
            if len(s) == 1:
                out[s] = i
                continue
            tokens = model.tokenize(self.library.id_to_token(i))
            if len(tokens) == 1 and tokens[0].id == i:
                out[s] = i
        return out

    def _insert(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Adds entries to the table while there is room; the first of either of its two slots that is free."""
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        if len(lens) and lens.max() > LONGEST:
            keep = np.flatnonzero(lens <= LONGEST)
            hashes, ids, lens = hashes[keep], [ids[k] for k in keep], lens[keep]
        ends = np.cumsum(lens)
        fit = int(np.searchsorted(ends, len(self.pool) - self.used, side="right"))
        if not fit:
            return
        hashes, lens = hashes[:fit], lens[:fit]
        flat = np.fromiter((x for y in ids[:fit] for x in y), np.uint32, int(ends[fit - 1]))
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + ends[:fit] - lens
        self.used += len(flat)
        left = np.arange(fit)
        for slot in (hashes & self.mask, (hashes >> self.shift) & self.mask):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]], self.num[slot[put]] = hashes[put], begin[put], lens[put]
            left = np.setdiff1d(left, put, assume_unique=True)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each pre-token, and which are unknown."""
        slot = (hashes & self.mask).astype(np.int64)
        known = self.keys[slot] == hashes
        miss = np.flatnonzero(~known)
        if len(miss):
            other = ((hashes[miss] >> self.shift) & self.mask).astype(np.int64)
            hit = self.keys[other] == hashes[miss]
            slot[miss[hit]] = other[hit]
            miss = miss[~hit]
        return self.at[slot], self.num[slot].astype(np.int64), miss

    def _rows(self, buf: np.ndarray, off: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each row of a chunk, and all the ids in order."""
        rows = len(off) - 1
        counts = np.zeros(rows, np.int64)
        if not len(buf):
            return counts, np.zeros(0, np.uint32)
        starts, bad = cut(buf, off)
        raw = buf.tobytes()
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                bad[np.searchsorted(off, i, side="right") - 1] = True
                i = raw.find(s, i + 1)
        ends = np.append(starts[1:], len(buf))
        hashes = tv.span_hashes(buf, starts, ends)
        at, num, miss = self._find(hashes)
        first = np.searchsorted(starts, off)
        if bad.any():
            dead = np.repeat(bad, np.diff(first))
            num = np.where(dead, 0, num)
            miss = miss[~dead[miss]]
        extra = None
        if len(miss):
            new, place, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            merge = self.merger.encode_ordinary
            got = [merge(raw[starts[i] : ends[i]].decode()) for i in miss[place]]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            num[miss] = lens[inverse]
            if want_ids:
                extra = np.fromiter((x for y in got for x in y), np.uint32, int(lens.sum()))
                at = at.astype(np.int64)
                at[miss] = -1 - (np.cumsum(lens) - lens)[inverse]
            self._insert(new, got)
        counts = tv.row_sums(num.astype(np.int64), first)
        whole = {}
        for r in np.flatnonzero(bad):
            whole[int(r)] = np.array(self.library.encode(raw[off[r] : off[r + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            counts[r] = len(whole[int(r)])
        if not want_ids:
            return counts, None
        total = int(num.sum())
        source = self.pool[: self.used] if extra is None else np.concatenate([self.pool[: self.used], extra])
        at = np.where(at < 0, self.used - 1 - at, at)
        ids = source[np.repeat(at - (np.cumsum(num) - num), num) + np.arange(total)]
        if whole:
            cuts = np.cumsum(np.where(bad, 0, counts))
            parts, last = [], 0
            for r in sorted(whole):
                parts += [ids[last : cuts[r]], whole[r]]
                last = cuts[r]
            ids = np.concatenate([*parts, ids[last:]])
        return counts, ids

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of ids of each row."""
        parts = [self._rows(buf[off[i] : off[j]], off[i : j + 1] - off[i], False)[0] for i, j in tv.chunks(off)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray):
        """Yields (first row, counts, ids) for consecutive chunks of rows."""
        for i, j in tv.chunks(off):
            yield i, *self._rows(buf[off[i] : off[j]], off[i : j + 1] - off[i], True)


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file."""
    def make() -> Encoder:
        made = Encoder(path)
        give_back()  # what reading the vocabulary took
        return made

    return tv.resident(("encoder", path), make)
