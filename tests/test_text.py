import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindex.functions.text import STOP_WORDS, Stems, stemmed, tokens
from spindex.operators import fulltext
from spindex.sources.tables import Namespace

VOWEL, Y = set("aeiou"), set("aeiouy")


def shape(s):
    """The word as alternating runs, c and v; y is a vowel after a consonant run has begun, a consonant otherwise."""
    out = ""
    for i, c in enumerate(s):
        v = c in VOWEL if i == 0 or out[-1] == "v" else c in Y
        out += "v" if v else "c"
    return re.sub("c+", "c", re.sub("v+", "v", out))


def m(s):
    return shape(s).count("vc")


def o(s):
    return bool(re.fullmatch("[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]", s))


SECOND = "eli>e anci>ance enci>ence bli>ble biliti>ble ational>ate ation>ate ator>ate iviti>ive iveness>ive ization>ize izer>ize logi>log alli>al aliti>al alism>al fulness>ful tional>tion ousli>ous ousness>ous entli>ent"
THIRD = "ative> ful> ness> icate>ic iciti>ic ical>ic alize>al"
FOURTH = "ic ance ence able ible ate ive ize iti al ism er ous ant ent ment ement ou".split()


def porter(w):
    """An independent statement of the rules, on strings."""
    if len(w) < 3:
        return w
    w = ("Y" if w[0] == "y" else w[0]) + w[1:]
    if re.fullmatch(".+(ss|i)es", w):
        w = w[:-2]
    elif re.fullmatch(".+[^s]s", w):
        w = w[:-1]
    if re.fullmatch(".+eed", w):
        w = w[:-1] if m(w[:-3]) else w
    elif (cut := re.fullmatch("(.+)(ed|ing)", w)) and "v" in shape(cut[1]):
        w = cut[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
            w = w[:-1]
        elif o(w):
            w += "e"
    if w.endswith("y") and len(w) > 1 and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (SECOND, THIRD):
        found = [r.split(">") for r in rules.split() if w.endswith(r.split(">")[0]) and len(w) > len(r.split(">")[0])]
        if found:
            suffix, new = max(found, key=lambda x: len(x[0]))
            if m(w[: -len(suffix)]):
                w = w[: -len(suffix)] + new
    found = [s for s in FOURTH if w.endswith(s) and len(w) > len(s)]
    if found:
        suffix = max(found, key=len)
        if m(w[: -len(suffix)]) > 1:
            w = w[: -len(suffix)]
    elif re.fullmatch(".+[st]ion", w) and m(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e") and len(w) > 1 and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not o(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return "y" + w[1:] if w[0] == "Y" else w


def stems(spark, words):
    rows = stemmed(spark.createDataFrame([(w,) for w in words], "token string")).collect()
    return {r.token: r.stem for r in rows}


def test_known_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "relational": "relat", "happy": "happi", "sky": "sky", "hopping": "hop", "filing": "file", "falling": "fall", "is": "is", "yellow": "yellow", "controll": "control", "agreed": "agre", "feed": "feed"}
    assert stems(spark, known) == known


def test_stems_of_made_up_words(spark):
    bases = ["y", "yy", "dy", "lo", "trou", "hop", "size", "fil", "conform", "adopt", "rol", "bowdler", "electr", "say", "x9", "happ", "oa", "sens", "gener", "abl", "st"]
    tails = ["", "s", "es", "ies", "sses", "eed", "ed", "ing", "y", "tional", "ational", "izer", "biliti", "logi", "icate", "ness", "ful", "ement", "ion", "sion", "ous", "ize", "e", "ll", "ating", "bled", "ized", "tted", "ying", "eli"]
    words = sorted({a + b for a in bases for b in tails} | {a + b + c for a in bases for b in tails for c in ("s", "ed", "ly", "e")})
    assert stems(spark, words) == {w: porter(w) for w in words}


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Don't STOP_it, ÉCOLE école the naïve-1"), (2, None), (3, "")], "id int, text string")
    got = [(r.id, r.token) for r in tokens(df, "id").orderBy("id", "pos").collect()]
    assert got == [(1, "don"), (1, "t"), (1, "stop_it"), (1, "École"), (1, "école"), (1, "naïve"), (1, "1")]
    assert len(STOP_WORDS) == 110 == len(set(STOP_WORDS))


DOCS = [("a", "orchard apple pear"), ("b", "apple apple pie"), ("c", ""), ("d", None), ("e", "the of and"), ("f", "pear pear pear pear")]


def by_hand(docs, query, k1=1.2, b=0.75):
    from math import log1p

    bags = {i: [porter(t) for t in re.findall(r"\w+", (t or "").lower()) if t not in STOP_WORDS] for i, t in docs}
    terms = list(dict.fromkeys(porter(t) for t in query.split()))
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags) or 1
    out = {}
    for i, bag in bags.items():
        hits = [t for t in terms if t in bag]
        if hits:
            s = 0
            for t in hits:
                df = sum(t in x for x in bags.values())
                s += log1p(max(0, (n - df + 0.5) / (df + 0.5))) * bag.count(t) * (k1 + 1) / (bag.count(t) + k1 * (1 - b + b * max(1, len(bag)) / mean))
            out[i] = round(s * (1 + len(hits) / len(terms)), 9)
    return out


def test_bm25_both_ways(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id string, text string")
    index = fulltext.TextIndex(Namespace(spark, str(tmp_path))).build(df)
    for q in ("apple pear", "pear pear", "pie apples orchard", "nothing"):
        want = by_hand(DOCS, q)
        direct = fulltext.bm25(df, q).collect()
        assert {r.doc_id: round(r.score, 9) for r in direct} == want
        assert [r.doc_id for r in direct] == sorted(want, key=lambda i: (-want[i], i))
        assert {r.id: round(r.score, 9) for r in index.query(q).collect()} == want
    assert fulltext.bm25(df, "the").count() == 0 == index.query("the").count()
    assert [r.doc_id for r in fulltext.require_all(df, "pear apple").collect()] == ["a"] == [r.id for r in index.query("pear apple", require_all=True).collect()]
    assert fulltext.require_all(df, "of").count() == 0
    assert index.document_count() == 6 and index.term_count() == 4


def test_index_changes(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id string, text string")
    index = fulltext.TextIndex(Namespace(spark, str(tmp_path))).build(df)
    index.remove(df.where("doc_id = 'a'"))
    index.add(spark.createDataFrame([("b", "cherry"), ("g", "apple")], "doc_id string, text string"))
    now = [x for x in DOCS if x[0] not in "ab"] + [("b", "cherry"), ("g", "apple")]
    assert {r.id: round(r.score, 9) for r in index.query("apple cherry pear").collect()} == by_hand(now, "apple cherry pear")
    index.clear()
    assert index.document_count() == 0 and index.query("apple").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abeiouyst9_éß", min_size=1, max_size=9), min_size=1, max_size=20))
def test_stems_of_random_words(spark, words):
    words = sorted(set(words))
    assert stems(spark, words) == {w: porter(w) if w.isascii() else w for w in words}


def test_stems_in_rows_equal_stems_in_sql(spark):
    bases = ["y", "yy", "dy", "lo", "trou", "hop", "size", "fil", "conform", "adopt", "rol", "x9", "oa", "sens", "gener", "abl", "st", "a_", "ss", "i"]
    tails = ["", "s", "es", "ies", "sses", "eed", "ed", "ing", "y", "tional", "ational", "izer", "biliti", "logi", "icate", "ness", "ful", "ement", "ion", "sion", "ous", "ize", "e", "ll", "ating", "bled", "ying", "eli"]
    words = sorted({w for a in bases for b in tails for c in ("", "s", "ed", "ly", "e", "é") if (w := a + b + c) not in STOP_WORDS})
    got = Stems()
    assert stems(spark, words) == {w: got[w.encode()].decode() for w in words} and got[b"the"] is None


def in_sql(spark, docs):
    """doc_id, term, tf, first_pos by tokens joined with their stems."""
    t = tokens(docs, "doc_id")
    joined = t.join(stemmed(t.select("token").distinct()), "token")
    return sorted((str(r.doc_id), r.stem, r.tf, r.first) for r in joined.selectExpr("doc_id", "stem", "pos").groupBy("doc_id", "stem").agg(F.count("*").alias("tf"), F.min("pos").alias("first")).collect())


def test_postings_join_no_vocabulary(spark, monkeypatch):
    """Terms are counted in each document's row: nothing is shuffled unless an id is repeated."""
    monkeypatch.setattr(fulltext, "MOST_HELD", 3)
    texts = ["The apples Apple of ÉCOLE école", "naïve_1 runs running; ran  run x \u0085y", "", None, "x" * 50 + " hopping hops hop", "the of and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    again = docs.unionByName(spark.createDataFrame([(0, "pie apple"), (None, "a null apple"), (None, "apple")], "doc_id long, text string"))
    for df in (docs, again):
        got = fulltext.postings(df)
        assert sorted((str(r.doc_id), r.term, r.tf, r.first_pos) for r in got.collect()) == in_sql(spark, df)
        assert dict(got.dtypes) == {"doc_id": "bigint", "term": "string", "tf": "bigint", "first_pos": "int"}
    assert "Exchange" not in fulltext.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in fulltext.term_positions(docs)._jdf.queryExecution().executedPlan().toString()
    places = {(r.doc_id, r.term): r.place for r in fulltext.term_positions(docs).collect()}
    assert places[0, "appl"] == 1 and places[0, "École"] == 2 and places[0, "école"] == 3 and places[1, "run"] == 2


def test_bad_bytes_and_removal_of_many(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, bytearray(b"apple \xff pear")), (2, bytearray(b"pear"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    assert {(r.doc_id, r.term) for r in fulltext.postings(df).collect()} == {(1, "appl"), (1, "�"), (1, "pear"), (2, "pear")}
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    for most in (0, 10):
        monkeypatch.setattr(fulltext, "MOST_REMOVED", most)
        index = fulltext.TextIndex(Namespace(spark, str(tmp_path / str(most)))).build(docs)
        index.remove(docs.where("doc_id in ('a', 'f')"))
        assert {r.id: round(r.score, 9) for r in index.query("apple pear pie").collect()} == by_hand([x for x in DOCS if x[0] not in "af"], "apple pear pie")


def test_an_index_is_made_of_few_passes(spark, tmp_path):
    """The documents' ids are read once, and their texts once for each part."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    fulltext.TextIndex(Namespace(spark, str(tmp_path))).build(docs.mapInArrow(counted, docs.schema))
    assert seen.value <= 3 * len(DOCS)
