import random
import re

import numpy as np
import pytest

from spindex.llm import decontaminate as dec
from spindex.llm import neardup
from spindex.llm.graph import components

from .helpers import AWKWARD, classes, edited, frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    texts = list(AWKWARD)
    for _ in range(25):
        base = prose(rng, rng.randrange(1, 120))
        texts += [base, base.upper()] + [edited(rng, base, rng.randrange(0, 14)) for _ in range(rng.randrange(6))]
    chain = prose(rng, 200)
    for _ in range(20):  # each near the one before, the ends far apart
        texts.append(chain)
        chain = edited(rng, chain, 3)
    rng.shuffle(texts)
    sets = [shingles(t, width) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = classes(edges, range(len(texts)))
    got = neardup.near_duplicates(frame(spark, texts), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}


def test_templated_documents(spark, monkeypatch):
    rng = random.Random(31)
    template = prose(rng, 120, 10**6, "t").split(" ")
    texts = []
    for k in range(3000):
        own = prose(rng, 60, 10**6, "o").split(" ")
        texts.append(" ".join(template + own))
        if k % 100 == 0:
            near = list(own)
            near[rng.randrange(60)] = "other"
            texts.append(" ".join(template[:110] + near))
    sets = [shingles(t, 5) for t in texts]
    want = classes([(i, i + 1) for i in range(len(texts) - 1) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])], range(len(texts)))
    assert sum(c != i for i, c in want.items()) == 30
    made = []
    whole = neardup.prefix_pairs
    monkeypatch.setattr(neardup, "prefix_pairs", lambda sets, percent: made.append(neardup.saved(whole(sets, percent), "met")) or made[0])
    got = neardup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert made and made[0].count() < len(texts)


def test_prefix_join_is_exact(spark):
    rng = random.Random(32)
    rows, sets = [], {}
    for i in range(200):
        base = rng.choice(list(sets.values())) if sets and rng.random() < 0.7 else set(rng.sample(range(300), rng.randrange(1, 60)))
        sets[i] = {x for x in base if rng.random() < 0.93} | set(rng.sample(range(300), rng.randrange(0, 4))) or {1}
        rows.append((i, i, np.sort(np.array([hash((x, 1)) & (2**64 - 1) for x in sets[i]], np.uint64)).tobytes()))
    found = {(r.a, r.b) for r in neardup.prefix_pairs(spark.createDataFrame([(i, c, bytearray(b)) for i, c, b in rows], "doc_id long, c long, shingles binary"), 80).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want and want <= found and len(found) < 200 * 199 // 2


def test_near_duplicates_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "q r s t"), (9, "q r s t"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df, 2).collect())
    assert got == [(-1, 2, -1, True), (-1, 2, -1, True), (4, 2, 4, True), (4, 3, 4, True), (7, 0, 7, True), (9, 3, 4, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_estimate_tracks_similarity(spark):
    rng = random.Random(2)
    base = prose(rng, 400, 5000)
    texts = [base] + [edited(rng, base, n) for n in (5, 20, 60)]
    s = neardup.sketches(frame(spark, texts), 2)
    rows = s.alias("x").join(s.alias("y")).where("x.doc_id = 0").select("y.doc_id", neardup.estimate("x", "y").alias("e")).collect()
    a = shingles(base, 2)
    for r in rows:
        b = shingles(texts[r.doc_id], 2)
        assert abs(r.e - len(a & b) / len(a | b)) < 0.2


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    for n, m in ((1, 0), (30, 20), (60, 55)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
        df = spark.createDataFrame(edges, "a long, b long")
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        assert {r.node: r.component for r in components(df, "a", "b").collect()} == classes([e for e in edges if e[0] != e[1]], nodes)
    assert components(df.limit(0), "a", "b").count() == 0


def windows(text, width=8):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    size = min(width, len(words))
    return words, {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.mark.parametrize("block", [500_000, 40])
def test_decontamination_equals_brute_force(spark, block):
    import hashlib

    rng = random.Random(4)
    items = [prose(rng, rng.randrange(1, 40), 60) for _ in range(30)] + [None, "", "!!", "w1", "É w2 w2 w2", "w3 " * 30]
    texts = AWKWARD + [prose(rng, rng.randrange(80), 60) for _ in range(60)]
    for _ in range(40):
        cut = (rng.choice(items) or "x").split()
        a = rng.randrange(len(cut)) if cut else 0
        texts.append(prose(rng, 10, 60) + " " + ", ".join(cut[a : a + rng.randrange(5, 20)]).upper() + " " + prose(rng, 10, 60))
    bench = spark.createDataFrame([(100 - i, t) for i, t in enumerate(items)] + [(100, items[0])], "item_id long, text string")
    got = {r.doc_id: r for r in dec.decontaminate(frame(spark, texts), bench, block_words=block).collect()}
    assert len(got) == len(texts)
    listed = [(100 - i, windows(t)[1]) for i, t in enumerate(items)]
    for i, t in enumerate(texts):
        words, _ = windows(t)
        hit, found = set(), set()
        for item, own in listed:
            for w in own:
                for a in range(len(words) - len(w) + 1):
                    if tuple(words[a : a + len(w)]) == w:
                        hit |= set(range(a, a + len(w)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(words), len(hit), len(found), digest, len(found) >= 2), i
    assert dec.decontaminate(frame(spark, texts).limit(0), bench).count() == 0
    assert not dec.decontaminate(frame(spark, texts), bench.limit(0)).where("n_hit > 0").count()


def test_decontamination_is_the_same_at_any_block_size(spark):
    rng = random.Random(14)
    items = [prose(rng, 20, 60) for _ in range(12)]
    rows = [(None, items[0]), (None, items[0]), (None, items[1] + " x"), (None, None), (5, items[2]), (5, items[3] + " y z"), (5, items[2]), (6, ""), (7, " ".join(items))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole, parts = (sorted(map(str, dec.decontaminate(docs, bench, block_words=n).collect())) for n in (500_000, 40))
    assert len(whole) == len(rows) and parts == whole
