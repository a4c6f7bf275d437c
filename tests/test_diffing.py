import random

import pytest

from spindex.functions import diffing as d
from spindex.functions import keys


def test_unified_diff():
    assert d.unified_diff("Hello\nWorld\n", "Hello\nBeautiful World\n") == "--- version 1\n+++ version 2\n@@ -1,2 +1,2 @@\n Hello\n-World\n+Beautiful World\n"
    assert d.unified_diff("a", "a", 3, 4) == "--- version 3\n+++ version 4\n"


def test_patch_format():
    assert d.create_patch("f", "", "a\nb").split("\n")[1:] == ["=" * 67, "--- f", "+++ f", "@@ -0,0 +1,2 @@", "+a", "+b", "\\ No newline at end of file", ""]


def test_hunks_join_over_eight_lines():
    old = [f"{i}\n" for i in range(40)]
    for gap, count in ((8, 1), (9, 2)):
        new = list(old)
        new[10], new[11 + gap] = "x\n", "y\n"
        assert len(d.hunks("".join(old), "".join(new))) == count


def texts(rng):
    return "".join(rng.choice(["a\n", "b\n", "c\n", "\n", "a\r\n"]) for _ in range(rng.randrange(25))) + rng.choice(["", "tail"])


def test_round_trips():
    rng = random.Random(11)
    for _ in range(1500):
        a, b = texts(rng), texts(rng)
        assert "".join(x for kind, rows in d.edit_script(d.lines_of(a), d.lines_of(b)) if kind != "-" for x in rows) == b
        x, y = (a * 4).encode(), (b * 4).encode()
        assert d.apply_delta(x, d.create_delta(x, y)) == y
        if "\r" not in a + b:
            assert d.apply_patch(a, d.create_patch("f", a, b)) == b


def test_edit_script_is_shortest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                table[i][j] = i + j if not i or not j else table[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(table[i - 1][j], table[i][j - 1])
        assert sum(len(r) for k, r in d.edit_script(a, b) if k != "=") == table[-1][-1]


def test_patches_that_do_not_fit():
    p = d.create_patch("f", "a\nb\nc\n", "a\nx\nc\n")
    assert d.apply_patch("q\n", p) is None
    assert d.apply_patch("0\n0\n0\na\nb\nc\n", p) == "0\n0\n0\na\nx\nc\n"
    assert d.apply_patch("a\r\nb\r\nc\r\n", p) == "a\r\nx\r\nc\r\n"
    assert d.apply_patch("same", "") == "same"
    with pytest.raises(d.PatchError):
        d.apply_patch("a", "--- a\n+++ b\nnonsense")
    with pytest.raises(d.PatchError):
        d.apply_patch("a", "@@ -1,1 +1,1 @@\n?a")


def test_deltas():
    a = bytes(range(200)) * 5
    assert len(d.create_delta(a, a[3:700] + b"new" + a[50:])) < 60
    for bad in (b"\x80", b"\x06ab", b"\x41\xff\x7f", b"\xff" * 12):
        assert d.apply_delta(a, bad) is None
    assert d.apply_delta(a, b"") == b"" == d.create_delta(a, b"")


def test_key_order():
    numbers = [float("-inf"), -1e300, -2.5, -1, 0, 1e-300, 1, 2, 1e18, float("inf")]
    parts = [keys.ordered_key(x) for x in numbers] + [keys.ordered_key(s) for s in ("", "a", "ab", "b", "é")] + [keys.id_part("00" * 12), keys.id_part("ff" * 12)] + [keys.date_part(x) for x in (-(2**62), -1, 0, 1, 2**62)]
    assert parts == sorted(parts) and keys.ordered_key(-0.0) == keys.ordered_key(0)
    assert keys.composite_key("a", 5) < keys.composite_upper_bound("a") < keys.composite_key("a\x01", 0)
    for bad in (float("nan"), True, "a\0b", None):
        with pytest.raises(ValueError):
            keys.ordered_key(bad)


def test_key_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.5, "é", "ab" * 12, -7)], "n double, s string, i string, t long")
    r = df.select(keys.number_part_column("n"), keys.string_part_column(F.col("s")), keys.id_part_column(F.col("i")), keys.long_part_column(F.col("t"), b"\x03")).first()
    assert [bytes(x) for x in r] == [keys.number_part(1.5), keys.string_part("é"), keys.id_part("ab" * 12), keys.date_part(-7)]
