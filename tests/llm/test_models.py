import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindex.llm import language, lines, neighbours, quality, secrets, textvec
from spindex.llm.automaton import Automaton

from .helpers import AWKWARD, frame, prose

# secrets


def plain_spans(t):
    t = t or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def secret_texts():
    rng = random.Random(12)
    def pick(chars, n): return "".join(rng.choices(chars, k=n))  # noqa: E704
    texts = list(AWKWARD) + ["PassWord = 'abc' token:" + "x" * 12, "apikey=password=abcdefghijkl", "éé secret : \"" + "a1" * 9, "AKIA" + "B" * 13, "AKIA" + "B" * 14 + "é" + "0123456789abcdef", "ſecret=aaaaaaaaaaaaaaaaa", "toKen=aaaaaaaaaaaaaaaaa", "deadbeefdeadbeef" * 2]
    for _ in range(150):
        kind = rng.randrange(4)
        s = ["token = \"" + pick("0123456789abcdef", 40) + '"', "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), "password=" + pick("0123456789abcdef", 18), pick("0123456789abcdef", 32)][kind]
        texts.append(f"{prose(rng, 5, stem='thanon')} é {s} {prose(rng, 4)}")
    return texts


def test_base_spans_equal_plain_search(spark):
    texts = secret_texts()
    df = frame(spark, texts)
    formats = secrets.learn(df)
    got = {r.doc_id: r for r in secrets.scan(df, formats).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert ",".join(s for s in got[i].spans.split(",") if not s.startswith("format")) == text
    assert secrets.scan(df.limit(0), formats).count() == 0
    none = secrets.learn(df.limit(0))
    assert secrets.scan(df, none).where("spans like '%format%'").count() == 0


def test_formats_are_told_from_words(spark):
    formats = secrets.learn(frame(spark, secret_texts()))
    rng = random.Random(5)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)).encode() for _ in range(50)]
    assert sum(k in formats for k in keys) >= 45
    assert not any(w in formats for w in (b"thanonontioniner2thanonontioniner", b"2024-01-02-report_final.version", b"===================1", b"thanonontioninerthanon", b"www.example.com/thanon/onti", b"thanonontion"))


def test_planted_secrets_that_only_automata_find(spark):
    rng = random.Random(15)

    def key(n=24):
        return "sk_" + "".join(rng.choices("0123456789ABCDEFGHJKMN", k=n))

    labelled = [f"{prose(rng, 20, stem='thanonontioniner')} token = {key()} {prose(rng, 10, stem='word/with-marks')}" for _ in range(60)]
    bare = [key() for _ in range(40)]
    plain = [prose(rng, 60, stem=s) for s in ("thanonontioniner", "INERTHANONONTION", "see/path/to/some-file_") for _ in range(20)]
    texts = labelled + [f"{prose(rng, 9)} é {k} {prose(rng, 9)}" for k in bare] + plain
    df = frame(spark, texts)
    got = {r.doc_id: r.spans for r in secrets.scan(df, secrets.learn(df)).collect()}
    hit = 0
    for i, k in enumerate(bare, len(labelled)):
        at = texts[i].index(k)
        assert "assign" not in got[i] and "hex" not in got[i]
        hit += f"format:{at}:{at + len(k)}" in got[i]
    assert hit >= 36
    assert sum("format" in got[i] for i in range(len(texts) - len(plain), len(texts))) == 0


def test_automaton_keeps_lengths_merges_and_normalises():
    rng = random.Random(3)
    a = Automaton(["".join(rng.choices("0123456789abcdef", k=32)).encode() for _ in range(300)])
    assert 30 <= len(a.states) < 200
    p = np.exp(a.logp + np.log([10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1])).sum(axis=1) + np.exp(a.stop)
    assert np.all(p < 1.01)
    good = a.score(b"0a1b2c3d4e5f60718293a4b5c6d7e8f9")
    assert good > a.score(b"zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz") + 2 and good > a.score(b"0a1b2c3d4e5f607182") + 0.2
    loops = Automaton([b"k-" + b"7" * rng.randrange(1, 60) for _ in range(300)])
    assert len(loops.states) < 20


def test_very_long_tokens(spark):
    rng = random.Random(1)
    texts = ["a1" * 400_000, "token=" + "ab" * 300_000, "x" * 10] + secret_texts()[-40:]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in secrets.scan(df, secrets.learn(df)).collect()}
    assert got[0].n_hex == 1 and got[1].n_assign == 1 and got[2].spans == ""


# neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search_with_one_list_is_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[9] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [float("nan")] * 8, 0), (1150, [1.0] * 7 + [None], 0), (1200, [float("inf")] * 8, 0), (1250, [1.0] * 3, 0), (1300, [2.0, 2.0, 2.5], 0), (1301, [1.0, -1.0, 0.0], 0), (None, [1.0] * 8, 0)]
    got = neighbours.search(vectors(spark, rows), list_rows=10**6).collect()
    d = v.astype(float)
    want = []
    for q in range(0, 300, 50):
        s = [(-np.dot(d[q], d[j]) / np.sqrt(np.dot(d[q], d[q]) * np.dot(d[j], d[j])), j) for j in range(300) if j != q]
        s = [(round(x, 9), j) for x, j in s]
        want += [(q, k + 1, j, -x) for k, (x, j) in enumerate(sorted(s)[:5])]
    near = round(6.5 / math.sqrt(3 * 14.25), 9)  # vectors of another length are compared with each other
    want += [(1250, 1, 1300, near), (1250, 2, 1301, 0.0), (1300, 1, 1250, near), (1300, 2, 1301, 0.0)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_search_recall_over_lists(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    v = (centre[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    got = {}
    for r in neighbours.search(vectors(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)]), list_rows=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 80 and hits >= 0.9 * 400


def test_search_of_few(spark):
    assert neighbours.search(vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)])).count() == 1
    assert neighbours.search(vectors(spark, [])).count() == 0


def test_recall_holds_with_many_lists(spark):
    v = np.random.default_rng(12).normal(size=(8000, 64)).astype(np.float32)
    got = defaultdict(set)
    for r in neighbours.search(vectors(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)]), list_rows=10).collect():  # 800 lists
        got[r.query_id].add(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit[::50] @ unit.T
    sims[np.arange(160), np.arange(160) * 50] = -2
    want = np.argsort(-sims, axis=1)[:, :5]
    assert sum(len(got[q * 50] & set(w.tolist())) for q, w in enumerate(want)) >= 0.9 * want.size


def test_queries_go_on_until_enough_rows(spark):
    rng = np.random.default_rng(13)
    index = neighbours.Centroids(np.eye(8))
    homes = np.array([1, 0, 1, 0, 2, 1, 1, 9])
    got = index.lists(np.eye(8, dtype=np.float32)[0], 1, 1.0, homes, 5)
    assert got[0] == 0 and homes[got].sum() > 5 and len(set(got)) == len(got)
    v = rng.normal(size=(60, 8))
    found = neighbours.search(vectors(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)]), every=3, list_rows=4, probes=1, recall=0.0).collect()
    assert Counter(r.query_id for r in found) == {i: 5 for i in range(0, 60, 3)}



def test_lists_are_searched_in_small_tables_too(spark):
    v = np.random.default_rng(14).normal(size=(500, 64)).astype(np.float32)
    assert neighbours.number_of_lists(500, 500) > 10
    got = defaultdict(list)
    for r in neighbours.search(vectors(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)])).collect():
        got[r.query_id].append(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {q: np.argsort(-np.where(np.arange(500) == q, -2, unit @ unit[q]))[:5].tolist() for q in range(0, 500, 50)}
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 49


def test_balance_evens_out_sizes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 8))
    x[:2000] = x[0] + 0.5 * x[:2000]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def largest(weight):
        return np.bincount((unit @ neighbours.balanced_kmeans(x, 20, weight=weight).T).argmax(axis=1)).max()

    assert largest(0.1) <= largest(0.0)


# language


@pytest.mark.parametrize("block", [1, 2, 48])
def test_forward_backward_equals_enumeration(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    import itertools

    rng = np.random.default_rng(4)
    e, t = rng.random((9, 3)) + 0.1, rng.random((3, 3)) + 0.1
    start, size = np.array([0, 4, 5]), np.array([4, 1, 4])
    p, pairs = language.expected_moves(e, t, start, size)
    want, moves = np.zeros((9, 3)), np.zeros((3, 3))
    for s, n in zip(start, size, strict=True):
        weights = {}
        for y in itertools.product(range(3), repeat=int(n)):
            weights[y] = math.prod(e[s + i, y[i]] for i in range(n)) * math.prod(t[y[i], y[i + 1]] for i in range(n - 1))
        z = sum(weights.values())
        for y, w in weights.items():
            for i in range(n):
                want[s + i, y[i]] += w / z
            for i in range(n - 1):
                moves[y[i], y[i + 1]] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, moves)


def test_scores_are_the_same_in_any_partitioning(spark):
    rng = random.Random(17)
    sound = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ung", "ein", "pf"]}
    rows = [(i, " ".join("".join(rng.choices(sound[rng.choice("ab") * 2], k=3)) for _ in range(rng.choice([1, 2, 48, 49, 50, 97, 400]))), rng.choice("ab") * 2, i) for i in range(200)]
    rows.append((500, " ".join("".join(rng.choices(sound["aa"], k=3)) for _ in range(60_000)), "aa", 1))  # longer than a chunk
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, letter int")
    tagger = language.learn(df)
    got = [{r.doc_id: (r.lang_pred, r.score) for r in language.identify(x, tagger).collect()} for x in (df.coalesce(1), df.repartition(7, "letter"), df.orderBy("text").coalesce(2))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 201


def test_languages(spark):
    rng = random.Random(7)
    sound = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ung", "ein", "pf"], "cc": ["eau", "ment", "oi", "é"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sound))
        rows.append((i, " ".join("".join(rng.choices(sound[lang], k=3)) for _ in range(rng.randrange(3, 60))), lang))
    rows += [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (903, "日本", None), (904, "€ – 5", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.learn(df, sample=60)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i, _, _ in rows[:300] if got[i].held_out]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held) > 0
    assert [got[i].lang_pred for i in (900, 901, 902, 904)] == ["und"] * 4 and got[903].lang_pred in sound
    assert all(0 <= r.score <= 1 for r in got.values())
    bare = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, bare).collect()} == {"und"}
    assert language.identify(df.limit(0), bare).count() == 0


def test_marginals_follow_a_switch(spark):
    tagger = language.Tagger(["a", "b"])
    tagger.train([("kato rimu " * 100).encode(), ("schung einpf " * 100).encode()], [0, 1])
    p, _ = tagger.tag(*textvec.binary_column(pa.array(["kato rimu kato schung einpf schung"])))
    assert p.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1]


# quality


def brute_kn(sequences, order):
    """Interpolated modified Kneser-Ney with dictionaries; contexts padded with 0."""
    count = Counter()
    for s in sequences:
        for i in range(len(s)):
            count[tuple([0] * max(0, order - 1 - i) + list(s[max(0, i - order + 1) : i + 1]))] += 1
    levels = {order: count}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [0] + [min(k, max(0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3)]

    ds = {k: discount(c) for k, c in levels.items()}
    by = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            by[k][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        k = len(g)
        vs = by[k].get(g[:-1])
        if not vs:
            return p(g[1:])
        d, c = ds[k], levels[k].get(g, 0)
        return (c - d[min(c, 3)]) / sum(vs) + sum(d[min(v, 3)] for v in vs) / sum(vs) * p(g[1:])

    return p


def test_probabilities_equal_brute_force():
    rng = random.Random(3)
    texts = [prose(rng, 30, 20, "the").encode() for _ in range(20)]
    codes = np.concatenate([quality.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    code, n = np.unique(codes, return_counts=True)
    table = quality.log_probabilities(code, n)
    symbols = []
    for t in texts:
        g = quality.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        symbols.append((g % quality.SYMBOLS).tolist())
    p = brute_kn(symbols, quality.ORDER)
    for _ in range(300):
        g = tuple(rng.choice([rng.choice(symbols[0]), rng.randrange(64)]) for _ in range(4))
        at = int(np.dot(g, [64**3, 64**2, 64, 1]))
        assert math.exp(table[at]) == pytest.approx(p(g), rel=1e-3)
    assert np.allclose(np.exp(table.reshape(-1, 64)[:: 64**2 + 7].astype(float)).sum(axis=1), 1, atol=1e-3)


def test_classifier(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        clean = " ".join(rng.choice(["than", "onti", "oner", "edsh", "the"]) + rng.choice(["ing", "er", "ly"]) for _ in range(40))
        bad, toxic = i % 5 == 0, i % 7 == 3
        text = " ".join(w + "$$$" for w in clean.upper().split()) if bad else clean.replace("theing", "scumbag") + " scumbag" if toxic else clean
        rows.append((i, text, rng.choice(["en", None]), "x"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic and not bad)))
    rows += [(900, None, "en", "x"), (901, "", "fr", "x"), (902, "thaning ontier edshly onering", "fr", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    labs = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (12345, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labs)
    got = {r.doc_id: r.kept for r in quality.classify(docs, model).collect()}
    assert len(got) == 403
    assert not any(got[i] for i in range(0, 400, 5)) and not any(got[i] for i in range(400) if i % 7 == 3)
    clean = [got[i] for i in range(400) if i % 5 and i % 7 != 3]
    assert sum(clean) >= 0.97 * len(clean) and got[900] and got[901] and got[902]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    bare = quality.fit(docs, labs.limit(0))
    assert quality.classify(docs, bare).where("not kept").count() == 0
    assert quality.classify(docs.limit(0), model).count() == 0 == quality.fit(docs.limit(0), labs).toxic.size


def test_perplexity_of_words_equals_brute_force(spark):
    rng = random.Random(31)
    kinds = ["than", "Onti", "é日本", "oner", "edsh", "the", "x"]
    texts = [" " * (i % 3) + rng.choice([" ", "\n", "  "]).join(rng.choice(kinds) for _ in range(rng.randrange(1, 25))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, "unseen " + texts[0], None, " "])], "doc_id long, text string, lang string")
    model = quality.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    count = {3: Counter()}

    def tokens(t):  # a word equal to the one before it is another one
        w = t.split()
        return ["", "", *(x + "+" if i and x == w[i - 1] else x for i, x in enumerate(w))]

    for t in texts:
        w = tokens(t)
        count[3].update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for k in (2, 1):
        count[k] = Counter(g[1:] for g in count[k + 1])

    def discount(k, v):
        n = [sum(x == j for x in count[k].values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [0, *(min(j, max(0, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] else j / 2 for j in (1, 2, 3))][min(v, 3)]

    def p(g, spelled):
        k = len(g)
        if not k:
            return spelled
        of = [v for x, v in count[k].items() if x[:-1] == g[:-1]]
        if not of:
            return p(g[1:], spelled)
        v = count[k][g]
        return (v - discount(k, v)) / sum(of) + sum(discount(k, x) for x in of) / sum(of) * p(g[1:], spelled)

    for r in docs.collect():
        raw = (r.text or "").encode()
        lp = model.table()[quality.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))].astype(float)
        starts = [m.start() for m in re.finditer(rb"\S+", raw)]
        w, total = tokens(raw.decode()), lp[: starts[0] if starts else len(raw)].sum()
        for i, (a, b) in enumerate(zip(starts, [*starts, len(raw)][1:], strict=True)):
            total += math.log(p(tuple(w[i : i + 3]), math.exp(lp[a:b].sum())))
        assert got[r.doc_id].perplexity == pytest.approx(math.exp(-total / max(1, len(raw))), rel=1e-6), r


def test_word_counts_are_whole_and_compact(spark):
    rng = random.Random(34)
    texts = [" ".join(f"w{i}" for i in (rng.randrange(3000) for _ in range(400))) for _ in range(100)]
    rows = spark.createDataFrame([(t.encode(), quality.BOTH) for t in texts], "text binary, side int")
    counts, _, single = quality._word_counts(rows, 5)
    words = [["", "", *t.split()] for t in texts]
    trigrams = {tuple(w[i : i + 3]) for w in words for i in range(len(w) - 2)}
    held = counts.where("kind = 3").agg({"number": "sum"}).first()[0]
    assert held == len(trigrams) and single[quality.BOTH][0] == len({g[1:] for g in trigrams})
    assert counts.agg({"data": "count"}).first()[0] <= 15
    assert sum(len(r.data) for r in counts.select("data").collect()) < 16 * len(trigrams)


def test_answers_of_a_part_take_little_memory():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 20, 600_000, dtype=np.uint64) << np.uint64(36)
    known, n = np.unique(keys[::2], return_counts=True)
    follow = [known % np.uint64(k) for k in (251, 70_000, 7, 3)]
    blobs, asked = [], np.unique(keys)
    for _, i, j in quality._cuts(quality._shards(asked, 9)):
        hit = np.isin(asked[i:j], known)
        at = np.searchsorted(known, asked[i:j][hit])
        blobs.append(quality._squeezed(np.packbits(hit), n[at], *(f[at] for f in follow)))
    arrays = [x.copy() for x in np.split(keys, [2, 250_000])]
    tracemalloc.start()
    try:
        places, columns = quality._found(arrays, blobs, 9)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert [len(x) for x in places] == [2, 249_998, 350_000]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    for got, expected in zip(columns, [n, *follow], strict=True):
        assert (got[np.concatenate(places)] == np.where(known[at] == keys, expected[at], 0)).all()
    assert peak < 40 * len(keys) and kept < 12 * len(keys), (peak / len(keys), kept / len(keys))


def test_one_pass_equals_fit_then_classify(spark):
    rng = random.Random(44)
    kinds = [a + b for a in ("than", "onti", "oner", "edsh", "é日") for b in ("ing", "er", "ly", "")]
    rows, labels = [], []
    for i in range(150):
        text = " ".join(rng.choice(kinds) for _ in range(rng.randrange(1, 60))) + (" scumbag" if i % 9 == 4 else " $$$ %%" * 9 if i % 11 == 5 else "")
        rows.append((i, text, rng.choice(["en", "de", None]), "a", i % 3))
        if i % 3:
            labels.append((i, int(i % 11 != 5), int(i % 9 == 4)))
    rows += [(7, "thaning other", "en", "b", 0), (None, "thaning onti", "fr", None, None), (None, None, None, None, 1), (500, "", "en", "c", 2), (501, " \n", "en", "c", 2), (4, None, "de", "d", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, known string, side int")
    labs = spark.createDataFrame([*labels, (500, 1, 0), labels[0], (labels[1][0], 0, 0), (None, 1, 0), (777, 1, 0)], "doc_id long, quality int, toxic int")
    def key(r): return repr(r[:3]), repr(r[3:])  # noqa: E704
    for some, known in ((docs, labs), (docs, labs.limit(0)), (docs.limit(0), labs)):
        model = quality.fit(some, known)
        a, b = (sorted(map(tuple, x.collect()), key=lambda r: (repr(r[0]), repr(r[1]), r[2], r[6], r[3])) for x in (quality.classify(some, model), quality.fit_and_classify(some, known)))
        assert len(a) == len(b) == some.count()
        for x, y in zip(a, b, strict=True):
            assert x[:3] == y[:3] and x[5:] == y[5:] and x[3:5] == pytest.approx(y[3:5], rel=1e-12)
        kept = quality.fit_and_keep(some, known)
        assert kept.schema == some.schema
        assert sorted(map(tuple, kept.collect()), key=key) == sorted(map(tuple, quality.keep_good(some, model).collect()), key=key)
        model.forget()
    assert not [t for t in spark.catalog.listTables() if t.name == model.words._buckets.table]


def test_one_count_serves_all_sides_and_is_not_shuffled_again(spark):
    rng = random.Random(45)
    texts = [(" ".join(f"w{rng.randrange(60)}" for _ in range(50)), i % 2) for i in range(80)]
    counts, discounts, single = quality._word_counts(spark.createDataFrame([(t.encode(), k) for t, k in texts], "text binary, side int"), 4)
    for side, own in ((0, {0}), (1, {1}), (quality.BOTH, {0, 1})):
        words = [["", "", *(x + "+" if i and x == w[i - 1] else x for i, x in enumerate(w))] for t, k in texts if k in own for w in [t.split()]]
        grams = Counter(tuple(w[i : i + 3]) for w in words for i in range(len(w) - 2))
        assert single[side][0] == len({g[1:] for g in grams})
        for order in (3, 2, 1):
            assert discounts[side, order - 1] == pytest.approx(quality._discounts_of([sum(v == k for v in grams.values()) for k in (1, 2, 3, 4)]))
            grams = Counter(g[1:] for g in grams)
    plan = counts.select("shard", "data").groupBy("shard").applyInArrow(lambda t: t, "shard int, data binary")._jdf.queryExecution().toString()
    assert "Exchange" not in plan, plan
    zeros = np.zeros(100_000, np.int64)
    assert len(quality._squeezed(zeros, zeros)) < 60 and all((x == zeros).all() for x in quality._stretched(quality._squeezed(zeros, zeros)))
    counts._buckets.discard()


def test_spelling_holds_seen_contexts_alone():
    rng = np.random.default_rng(46)
    code, n = np.unique(rng.integers(0, quality.SYMBOLS, 20_000) * quality.SYMBOLS + rng.integers(0, 3000, 20_000) * quality.SYMBOLS**2, return_counts=True)
    compact, dense = quality._Spelling(code, n), quality.log_probabilities(code, n)
    some = np.concatenate([code, rng.integers(0, quality.GRAMS, 200_000)])
    assert (compact[some] == dense[some]).all()
    assert compact.logs.nbytes + compact.row.nbytes < dense.nbytes / 8


def test_junk_of_other_scripts_is_told(spark):
    rng = random.Random(32)
    kinds = ["".join(rng.choices("бвгджзклмнпрст", k=3)) + rng.choice(["ать", "ого", "ами"]) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(kinds, k=50)), "ru") for i in range(240)]
    after = defaultdict(list)  # junk has the pairs of letters of good text, but other words
    for _, t, _ in rows:
        for x, y in zip(t, t[1:], strict=False):
            after[x].append(y)
    junk = []
    for _ in range(40):
        x = [" "]
        while len(x) < 340:
            x.append(rng.choice(after[x[-1]]))
        junk.append("".join(x[1:]))
    docs = spark.createDataFrame([*rows, *((1000 + k, t, "ru") for k, t in enumerate(junk))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(docs, quality.fit(docs, labels)).collect()}
    assert sum(got[i] for i in range(160, 240)) >= 76 and not any(got[1000 + k] for k in range(40))


# lines


@pytest.mark.parametrize("most", [500_000, 0])
def test_lines_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(lines, "MOST_LINES", most)
    rng = random.Random(2)
    rows = []
    for i in range(200):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        body = [rng.choice(["menu", "footer", "rare", f"line {rng.randrange(500)}", "", "menu"]) for _ in range(rng.randrange(6))]
        rows.append((i, None if i % 50 == 7 else "\n".join(body), host, 5))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lines int")
    for c in ("host", "kept", "shard", "_lines", "_host", "_kept", "page", "line", "n", "pages", "n_lines"):
        df = df.withColumn(c, F.col("lines"))
    seen, pages = Counter(), Counter()
    for _, t, h, _ in rows:
        pages[h] += 1
        seen.update((h, x) for x in set((t or "").split("\n")) if x and t is not None)
    got = {r.doc_id: r for r in lines.drop_boilerplate(df, ratio=0.2).collect()}
    for i, t, h, _ in rows:
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        kept = [x for x in t.split("\n") if h is None or not (seen[h, x] >= 3 and seen[h, x] > 0.2 * pages[h])]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped, got[i]._kept) == ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept), 5)
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_lines_run_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb", "h")], "doc_id long, text string, source string")
    plan = lines.drop_boilerplate(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
