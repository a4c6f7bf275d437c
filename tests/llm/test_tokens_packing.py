import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from spindex.llm import bpe, packing, textvec
from spindex.llm.tokens import token_counts

from .helpers import AWKWARD, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng = random.Random(3)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "t", "1", "²", "-", "×", "€", "ſ", "\x1c", "\xa0", "the ", "Don't", "<|endoftext|>", "日", "\r\n", "\x00"]
    texts = [t or "" for t in AWKWARD] + ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(4000)]
    encoder = bpe.encoder(PATH)
    for _ in range(2):  # the second time from memory
        got = []
        buf, off = textvec.binary_column(pa.array(texts, pa.string()))
        for _, counts, ids in encoder.encode(buf, off):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [ids_of(t) for t in texts]
        assert encoder.count(buf, off).tolist() == [len(x) for x in got]


def test_counts(spark):
    df = frame(spark, AWKWARD)
    df = df.unionByName(df.where("doc_id = 5")).unionByName(df.selectExpr("cast(null as long) doc_id", "text", "key", "list").limit(1))
    got = token_counts(df, PATH, limit=100).collect()
    assert len(got) == len(AWKWARD) + 2
    for r in got:
        if r.doc_id is not None:
            t = AWKWARD[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(ids_of(t)), len(ids_of(t)) > 100)
    assert token_counts(df.limit(0), PATH).count() == 0


def check_packed(rows, texts, capacity):
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*ids_of(t), 2]
        own = sorted(per[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in own[1:])
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing(spark):
    rng = random.Random(9)
    texts = AWKWARD + [" ".join(rng.choices(["the", "xyzzy", "é", "qu"], k=rng.randrange(60))) for _ in range(300)] + ["same text"] * 200
    rows = packing.pack(frame(spark, texts), PATH, capacity=64).collect()
    used = check_packed(rows, texts, 64)
    assert used <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack(frame(spark, texts).limit(0), PATH).count() == 0


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b")] * 5 + [(None, "c")] * 3, "doc_id long, text string")
    rows = packing.pack(df, PATH, capacity=8).collect()
    assert len(rows) == 8 and len({(r.sequence_id, r.offset) for r in rows}) == 8


def test_best_fit_is_close_to_the_bound():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randrange(1, 101): rng.randrange(1, 300) for _ in range(40)}
        plan = packing.best_fit(counts, 100)
        room = {}
        for length, n in counts.items():
            own = sorted((r, s, o) for le, r, s, o in plan if le == length)
            for k, (rank, seq, offset) in enumerate(own):
                until = own[k + 1][0] if k + 1 < len(own) else n
                for j in range(until - rank):
                    room.setdefault(seq + j, []).append((offset, length))
        for parts in room.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 100
        assert sum(len(p) for p in room.values()) == sum(counts.values())
        big = sum(n for length, n in counts.items() if length > 50)
        assert len(room) <= 1.23 * max(big, sum(le * n for le, n in counts.items()) / 100) + 2


def test_a_new_encoder_leaves_no_memory_to_give_back():
    code = f"""
import re
from spindex.llm import bpe, common
def held(): return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
bpe.encoder({PATH!r})
before = held()
common.give_back()
print(before - held())
"""
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 8
