"""Texts with all that is awkward, and plain restatements."""

import random

AWKWARD = [None, "", " ", "\n", "a", "A b", "é", "日本語 テキスト", "🙂" * 3, "<|endoftext|> x", "\x00\x01", "x" * 5000, "word " * 4000, "tab\tnew\nline\r\n"]


def prose(rng: random.Random, n: int, kinds: int = 400, stem: str = "w") -> str:
    return " ".join(f"{stem}{rng.randrange(kinds)}" for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def frame(spark, texts, **more):
    """Documents with columns whose names clash with those that operators use inside."""
    rows = [(i, t, f"{i}", float(i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, `key` string, `list` double")


def classes(edges, nodes):
    """The smallest node reachable from each."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in nodes}
