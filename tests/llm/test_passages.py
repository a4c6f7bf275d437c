import random
import re

import numpy as np
import pytest

from spindex.llm import passages as p

from .helpers import AWKWARD, edited, frame, prose


def test_compact_windows_cover_every_passage_once():
    rng = np.random.default_rng(5)
    sizes = [0, 3, 10, 40, 1, 25]
    hashes = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for least in (1, 4, 10):
        left, mid, right = p.compact_windows(hashes, first, np.uint64(99), least)
        assert all(right - left + 1 >= least)
        order = p.ordered(hashes, np.uint64(99))
        for a, b in zip(first[:-1], first[1:], strict=True):
            for i in range(a, b):
                for j in range(i + least - 1, b):
                    inside = [k for k in range(len(mid)) if left[k] <= i <= mid[k] <= j <= right[k]]
                    assert len(inside) == 1 and mid[inside[0]] == i + int(np.argmin(order[i : j + 1]))


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").lower())


def brute(texts, least_words, percent):
    """For each document the words of its windows that are near some other document's shingles."""
    seqs = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in map(words_of, texts)]
    least = least_words - 4
    wanted = -(-2 * least * percent // (100 + percent))
    out, links = [set() for _ in texts], set()
    for i, a in enumerate(seqs):
        for j, b in enumerate(seqs):
            known = set(b)
            if i != j:
                for s in range(len(a) - least + 1):
                    if sum(x in known for x in a[s : s + least]) >= wanted:
                        out[i] |= set(range(s, s + least_words))
                        links.add((i, j))
    return out, {(i, j) for i, j in links if (j, i) in links}


def sure(texts, i, least_words=50):
    """The words of a document's passages that another document of other words holds exactly."""
    own = words_of(texts[i])
    others = [" " + " ".join(words_of(t)) + " " for j, t in enumerate(texts) if words_of(t) != own]
    out = set()
    for s in range(len(own) - least_words + 1):
        passage = " " + " ".join(own[s : s + least_words]) + " "
        if any(passage in t for t in others):
            out |= set(range(s, s + least_words))
    return out


def found_words(row):
    return {w for s in row.spans.split(",") if s for w in range(*map(int, s.split(":")))}


def test_edited_hubs_hide_no_exact_passage(spark):
    rng = random.Random(21)
    p0, q, r = (prose(rng, n, 10**6) for n in (55, 70, 70))
    bodies = [prose(rng, 30, 10**6) for _ in range(3)]
    texts = [" ".join([bodies[0], edited(rng, p0, 3), q, r]), " ".join([bodies[1], p0, prose(rng, 25, 10**6), q]), " ".join([bodies[2], prose(rng, 10, 10**6), p0, prose(rng, 15, 10**6), r])]
    got = {r.doc_id: r for r in p.repeated_passages(frame(spark, texts)).collect()}
    assert set(range(30, 85)) <= found_words(got[1]) and set(range(40, 95)) <= found_words(got[2])


def test_common_phrases_hide_no_exact_passage(spark):
    rng = random.Random(22)
    notice, phrase = prose(rng, 60, 10**6), prose(rng, 40, 10**6)
    texts = []
    for k in range(40):  # all share the notice; pairs share a passage around the common phrase
        if k % 2 == 0:
            around = prose(rng, 6, 10**6), prose(rng, 6, 10**6)
        texts.append(" ".join([prose(rng, 20, 10**6), notice, prose(rng, 20, 10**6), around[0], phrase, around[1], prose(rng, 20, 10**6)]))
    got = {r.doc_id: r for r in p.repeated_passages(frame(spark, texts)).collect()}
    for k in range(40):
        assert set(range(20, 80)) | set(range(100, 152)) <= found_words(got[k]), k


def test_most_near_passages_are_found(spark):
    rng = random.Random(23)
    texts, n = [], 240
    for k in range(n):
        own = prose(rng, rng.randrange(50, 61), 10**6).split(" ")
        other = list(own)
        at = rng.randrange(8, 42)
        if k % 3 == 0:
            other[at] = "changed"
        elif k % 3 == 1:
            other.insert(at, "added")
        elif len(own) > 51:
            del other[at]
        texts += [" ".join([prose(rng, 40, 10**6), *words, prose(rng, 40, 10**6)]) for words in (own, other)]
    got = {r.doc_id: r for r in p.repeated_passages(frame(spark, texts)).collect()}
    near = [k for k in range(n) if all(brute(texts[2 * k : 2 * k + 2], 50, 80)[0])]
    assert len(near) > 0.8 * n
    assert sum(got[2 * k].class_id == got[2 * k + 1].class_id for k in near) >= 0.95 * len(near)


def near_links(texts, least=46, wanted=41):
    """Pairs of which either holds a passage near the other's shingles, by brute force."""
    seqs = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in map(words_of, texts)]
    known = [set(s) for s in seqs]
    return {(min(i, j), max(i, j)) for i, a in enumerate(seqs) for j in range(len(seqs)) if i != j and any(sum(x in known[j] for x in a[s : s + least]) >= wanted for s in range(len(a) - least + 1))}


@pytest.mark.parametrize("shard", [4, 4000])
def test_links_between_members_that_no_hub_confirms(spark, monkeypatch, shard):
    monkeypatch.setattr(p, "SHARD_ROWS", shard)
    rng = random.Random(24)
    phrase, notice = prose(rng, 40, 10**6), prose(rng, 60, 10**6)
    texts = [" ".join([prose(rng, 30, 10**6), phrase, prose(rng, 30, 10**6)])]
    for _ in range(12):  # near pairs around a phrase that the smallest id holds too
        around = [prose(rng, 10, 10**6).split(" ") for _ in range(2)]
        for changed in (False, True):
            left = [*around[0][:5], "changed", *around[0][6:]] if changed else around[0]
            texts.append(" ".join([prose(rng, 30, 10**6), *left, phrase, *around[1], prose(rng, 30, 10**6)]))
    texts += [" ".join([prose(rng, 20, 10**6), notice, prose(rng, 20, 10**6)]) for _ in range(9)]
    texts += [texts[-1]] * 2
    got = {r.doc_id: r for r in p.repeated_passages(frame(spark, texts)).collect()}
    links = near_links(texts)
    assert all(got[i].class_id == got[i + 1].class_id == i for i in range(1, 25, 2))
    assert all(got[i].n_links == sum(i in pair for pair in links) for i in range(len(texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, n, 10**6, "s") for n in (20, 50, 51, 60, 90, 200)]
    texts = [t for t in AWKWARD if not t or len(t) < 1000]
    for _ in range(60):
        body = [prose(rng, rng.randrange(30, 150), 10**6, "b")]
        for _ in range(rng.randrange(3)):
            body.insert(rng.randrange(len(body) + 1), rng.choice(shared))
        texts.append(" ".join(body))
    texts += [texts[-1]] * 5 + [edited(rng, shared[5], 4)]
    got = {r.doc_id: r for r in p.repeated_passages(frame(spark, texts)).collect()}
    want, links = brute(texts, 50, 80)
    assert len(got) == len(texts)
    for i, span in enumerate(want):
        found = {w for s in got[i].spans.split(",") if s for w in range(*map(int, s.split(":")))}
        assert got[i].n_words == len(words_of(texts[i])) and got[i].n_repeated == len(found)
        assert bool(found) == got[i].repeats == bool(span), i
        assert found <= span
        assert sure(texts, i) <= found, i
    exact = [(i, j) for i, j in links if i < j and any(s in texts[i] and s in texts[j] for s in shared[1:])]
    assert exact and all(got[i].class_id == got[j].class_id for i, j in exact)
    assert all(got[i].class_id == i and not got[i].n_links for i in range(len(texts)) if not want[i])


def test_hot_keys_have_the_same_hubs(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, k) for i in range(400) for k in {0, rng.randrange(1, 4), 10 + rng.randrange(300)}]
    df = spark.createDataFrame(rows, "rep long, key long")
    low = {}
    for i, k in rows:
        low[k] = min(i, low.get(k, i))
    want = sorted((i, k, low[k]) for i, k in rows if low[k] != i)
    for hot in (1, 3, 10**6):
        monkeypatch.setattr(p, "SAMPLED", 4), monkeypatch.setattr(p, "HOT", hot)
        assert sorted(map(tuple, p.hubs_of(df).collect())) == want


def test_odd_tables(spark):
    long = prose(random.Random(1), 80, 10**6)
    df = spark.createDataFrame([(None, long), (3, long), (8, long), (8, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.class_id or -1, r.repeats) for r in p.repeated_passages(df).collect())
    assert got == [(-1, 80, -1, False), (3, 80, 3, True), (8, 1, 8, False), (8, 80, 3, True)]
    assert p.repeated_passages(df.limit(0)).count() == 0


def pairwise(block, hub, across, least, wanted):
    """``Block.links`` by comparing every two rows one by one."""
    n = len(block.shingles)
    marked, near = [np.zeros(len(x), bool) for x in block.shingles], {k: {k} for k in range(len(block.ids))}
    for i in range(n):
        for j in range(n):
            if block.node[i] == block.node[j] or (across and block.shard[i] == block.shard[j]) or any(h < hub and h in block.hubs[j] for h in block.hubs[i]):
                continue
            held = np.isin(block.shingles[j], block.shingles[i])
            for s in range(len(held) - least + 1):
                if held[s : s + least].sum() >= wanted:
                    marked[j][s] = True
                    near[block.node[i]].add(block.node[j]), near[block.node[j]].add(block.node[i])
    out, counted = [], set()
    for r in range(n):
        k = block.node[r]
        if len(near[k]) > 1:
            reach = {k}
            while (more := set().union(*(near[x] for x in reach))) != reach:
                reach = more
            out.append((int(block.ids[k]), 0 if k in counted else int(sum(block.copies[x] for x in near[k] - {k})), p.spans_of(marked[r], least), int(block.ids[min(reach)])))
            counted.add(k)
    return out


def block_of(rng, n, repeat_ids):
    pool = [rng.integers(0, 1 << 32, 12, dtype=np.uint32) for _ in range(4)]
    shingles = []
    for _ in range(n):
        parts = [rng.integers(0, 1 << 32, rng.integers(0, 12), dtype=np.uint32), np.repeat(pool[3][:1], rng.integers(0, 15))]
        for k in rng.integers(0, 4, 2):
            part = pool[k].copy()
            if rng.random() < 0.3:
                part[rng.integers(0, 12)] = rng.integers(0, 1 << 32)
            parts.insert(rng.integers(0, len(parts) + 1), part)
        shingles.append(np.concatenate(parts))
    ids = np.sort(rng.integers(0, n // 2, n)) if repeat_ids else np.arange(n)
    hubs = [np.unique(np.append(rng.integers(0, 6, rng.integers(0, 2)), 7)) for _ in range(n)]
    return p.Block(ids, shingles, hubs, rng.integers(0, 2, n), rng.integers(1, 4, len(np.unique(ids)))[np.unique(ids, return_inverse=True)[1]])


@pytest.mark.parametrize("seed", range(12))
def test_blocks_equal_comparing_two_by_two(monkeypatch, seed):
    monkeypatch.setattr(p, "SOURCES", 8), monkeypatch.setattr(p, "PLACES", 40)
    block = block_of(np.random.default_rng(seed), 30, seed % 2 == 1)
    for across in (False, True):
        got = block.links(7, across, 9, 8)
        assert got and sorted(got) == sorted(pairwise(block, 7, across, 9, 8))


def test_a_passage_that_many_quote_is_compared_once(monkeypatch):
    """The block's work doesn't grow with the square of the documents that quote one passage."""
    compared, seen = p._compared, []
    monkeypatch.setattr(p, "_compared", lambda own, *more: seen.append(len(own)) or compared(own, *more))
    rng, n = np.random.default_rng(3), 3000
    quoted = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    shingles = [np.concatenate([rng.integers(0, 1 << 32, 20, dtype=np.uint32), quoted, rng.integers(0, 1 << 32, 20, dtype=np.uint32)]) for _ in range(n)]
    got = p.Block(np.arange(n), shingles, [np.array([0])] * n, np.zeros(n, int), np.ones(n, int)).links(0, False, 46, 41)
    assert [r[:2] + r[3:] for r in got] == [(i, n - 1, 0) for i in range(n)] and {r[2] for r in got} == {"15:89"}
    assert sum(seen) == 1
