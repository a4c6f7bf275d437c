"""Line diffs, patches and binary deltas: pure Python, and vectorised UDFs over them.

Spark has no expression for these. A diff is the greedy shortest edit script over
lines; of two equally long ways to a diagonal it takes the one by addition only
where it has come further in the old text.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = 4
RULE = "=" * 67
NO_NEWLINE = "\\ No newline at end of file"
GRAM = 16


class PatchError(ValueError):
    """A patch that can't be parsed."""


def lines_of(text: str) -> list[str]:
    """Lines with their newlines; the last may have none."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, list[str]]]:
    """Runs ('=', '+' or '-', lines) that turn the old lines into the new."""
    n, m = len(old), len(new)
    # a path is (last old line used, chain of (kind, length, rest of the chain))
    frontier: dict[int, tuple[int, tuple | None]] = {}

    def slide(at: int, chain: tuple | None, diagonal: int) -> tuple[int, tuple | None]:
        same = 0
        while at + 1 < n and at - diagonal + 1 < m and old[at + 1] == new[at - diagonal + 1]:
            at, same = at + 1, same + 1
        return at, ("=", same, chain) if same else chain

    def grown(chain: tuple | None, kind: str) -> tuple:
        return (kind, chain[1] + 1, chain[2]) if chain and chain[0] == kind else (kind, 1, chain)

    at, chain = slide(-1, None, 0)
    done = at + 1 >= n and at + 1 >= m
    frontier[0] = (at, chain)
    lowest, highest, depth = -(n + m + 1), n + m + 1, 1
    while not done:
        for diagonal in range(max(lowest, -depth), min(highest, depth) + 1, 2):
            left, right = frontier.pop(diagonal - 1, None), frontier.get(diagonal + 1)
            can_add = right is not None and 0 <= right[0] - diagonal < m
            can_drop = left is not None and left[0] + 1 < n
            if not (can_add or can_drop):
                frontier.pop(diagonal, None)
                continue
            if not can_drop or (can_add and left[0] < right[0]):
                at, chain = right[0], grown(right[1], "+")
            else:
                at, chain = left[0] + 1, grown(left[1], "-")
            at, chain = slide(at, chain, diagonal)
            old_done, new_done = at + 1 >= n, at - diagonal + 1 >= m
            if old_done and new_done:
                done = True
                break
            frontier[diagonal] = (at, chain)
            if old_done:
                highest = min(highest, diagonal - 1)
            if new_done:
                lowest = max(lowest, diagonal + 1)
        depth += 1
    runs = []
    while chain:
        runs.append((chain[0], chain[1]))
        chain = chain[2]
    out, i, j = [], 0, 0
    for kind, size in reversed(runs):
        out.append((kind, old[i : i + size] if kind == "-" else new[j : j + size]))
        i += size * (kind != "+")
        j += size * (kind != "-")
    return out


def hunks(old: str, new: str) -> list[dict]:
    """Hunks with four lines of context; changes at most eight equal lines apart share one."""
    script = edit_script(lines_of(old), lines_of(new))
    out: list[dict] = []
    now: dict | None = None
    at_old = at_new = 1
    for k, (kind, rows) in enumerate(script):
        if kind == "=":
            if now is not None:
                inner = len(rows) <= 2 * CONTEXT and k < len(script) - 1
                shown = rows if inner else rows[:CONTEXT]
                now["rows"] += [(" ", r) for r in shown]
                if not inner:
                    now["old"] = at_old - now["old_at"] + len(shown)
                    now["new"] = at_new - now["new_at"] + len(shown)
                    out.append(now)
                    now = None
            at_old += len(rows)
            at_new += len(rows)
            continue
        if now is None:
            before = script[k - 1][1][-CONTEXT:] if k else []
            now = {"old_at": at_old - len(before), "new_at": at_new - len(before), "rows": [(" ", r) for r in before]}
        now["rows"] += [(kind, r) for r in rows]
        if kind == "+":
            at_new += len(rows)
        else:
            at_old += len(rows)
    if now is not None:
        now["old"], now["new"] = at_old - now["old_at"], at_new - now["new_at"]
        out.append(now)
    for h in out:
        h["lines"] = [x for sign, r in h["rows"] for x in ([sign + r[:-1]] if r.endswith("\n") else [sign + r, NO_NEWLINE])]
    return out


def create_patch(name: str, old: str, new: str) -> str:
    """A patch with an index line and file headers; the start of an empty side is one less."""
    out = [f"Index: {name}", RULE, f"--- {name}", f"+++ {name}"]
    for h in hunks(old, new):
        out.append(f"@@ -{h['old_at'] - (not h['old'])},{h['old']} +{h['new_at'] - (not h['new'])},{h['new']} @@")
        out += h["lines"]
    return "\n".join(out) + "\n"


def unified_diff(old: str, new: str, from_version: int = 1, to_version: int = 2) -> str:
    """A diff between versions, with the hunks' own numbers; equal texts give the two header lines alone."""
    out = [f"--- version {from_version}", f"+++ version {to_version}"]
    for h in hunks(old, new):
        out.append(f"@@ -{h['old_at']},{h['old']} +{h['new_at']},{h['new']} @@")
        out += h["lines"]
    return "\n".join(out) + "\n"


_HEADER = re.compile(r"@@[^-]*-?(\d*)(?:,(\d*))?[^+]*\+?(\d*)(?:,(\d*))?")


def parse_patch(patch: str) -> list[dict]:
    rows = patch.split("\n")
    k = 0
    while k < len(rows) and not (rows[k].startswith(("--- ", "+++ ", "@@ ")) or rows[k] == "@@\t"):
        k += 1
    for mark in ("--- ", "+++ "):
        if k < len(rows) and rows[k].startswith(mark):
            k += 1
    out = []
    while k < len(rows):
        row = rows[k]
        if row.startswith(("--- ", "+++ ", "Index: ", "diff ")) or row == RULE:
            break
        if not row:
            k += 1
            continue
        if not row.startswith("@@"):
            raise PatchError(f"line {k + 1} of a patch is neither a header nor part of a hunk")
        a, b, c, d = _HEADER.match(row).groups()
        h = {"old_at": int(a or 0), "old": int(b or 0) if b is not None else 1, "new_at": int(c or 0), "new": int(d or 0) if d is not None else 1, "lines": []}
        h["old_at"] += not h["old"]
        h["new_at"] += not h["new"]
        k += 1
        added = dropped = 0
        while k < len(rows) and (dropped < h["old"] or added < h["new"] or rows[k].startswith("\\")):
            sign = rows[k][:1] or (" " if k < len(rows) - 1 else "")
            if sign not in ("+", "-", " ", "\\"):
                raise PatchError(f"line {k + 1} of a patch has no sign")
            h["lines"].append(rows[k])
            added += sign in "+ "
            dropped += sign in "- "
            k += 1
        if not added and h["new"] == 1:
            h["new"] = 0
        if not dropped and h["old"] == 1:
            h["old"] = 0
        out.append(h)
    return out


def _returns(parsed: list[dict], source: str) -> None:
    """Gives the hunks the line endings of the source where all of either are of one kind."""
    crlf = "\r\n" in source
    only_windows = crlf and not re.search(r"(?<!\r)\n", source)
    only_unix = not crlf and "\n" in source
    flat = [(h, i) for h in parsed for i in range(len(h["lines"]))]

    def marked(h: dict, i: int) -> bool:
        return h["lines"][i].startswith("\\") or (i + 1 < len(h["lines"]) and h["lines"][i + 1].startswith("\\"))

    ends = [h["lines"][i].endswith("\r") for h, i in flat]
    if only_windows and not any(e and not h["lines"][i].startswith("\\") for e, (h, i) in zip(ends, flat, strict=True)):
        for h, i in flat:
            if not marked(h, i):
                h["lines"][i] += "\r"
    elif only_unix and any(ends) and all(e or marked(h, i) for e, (h, i) in zip(ends, flat, strict=True)):
        for h, i in flat:
            h["lines"][i] = h["lines"][i].removesuffix("\r")


def _places(start: int, low: int, high: int) -> Iterator[int]:
    """The start, then places ever further from it, forwards first, within the bounds."""
    yield start
    step = 1
    while start + step <= high or start - step >= low:
        if start + step <= high:
            yield start + step
        if start - step >= low:
            yield start - step
        step += 1


def _fit(h: dict, rows: list[str], at: int) -> tuple[list[str], int] | None:
    """What the hunk puts at a place and the first row after it, or None if it doesn't fit."""
    out, tail = [], 0
    for line in h["lines"]:
        sign, body = line[:1] or " ", line[1:]
        if sign == "+":
            out.append(body)
            tail = 0
        elif sign in " -":
            if not 0 <= at < len(rows) or rows[at] != body:
                return None
            at += 1
            if sign == " ":
                out.append(body)
                tail += 1
            else:
                tail = 0
    return out[: len(out) - tail], at - tail


def apply_patch(source: str, patch: str) -> str | None:
    """The patched text, or None where the patch doesn't fit; context must match exactly, at any offset."""
    parsed = parse_patch(patch)
    _returns(parsed, source)
    if not parsed:
        return source
    rows = source.split("\n")
    drops_end = adds_end = False
    previous = ""
    for line in parsed[-1]["lines"]:
        if line.startswith("\\"):
            drops_end |= previous.startswith("+")
            adds_end |= previous.startswith("-") and not previous.startswith("+")
        previous = line
    bare = rows[-1] == ""
    if drops_end and adds_end:
        if bare:
            return None
    elif drops_end:
        if not bare:
            return None
        rows.pop()
    elif adds_end:
        if bare:
            return None
        rows.append("")
    out, low, shift = [], 0, 0
    for h in parsed:
        for at in _places(h["old_at"] + shift - 1, low, len(rows) - h["old"]):
            got = _fit(h, rows, at)
            if got is not None:
                break
        else:
            return None
        out += rows[low:at] + got[0]
        low, shift = got[1], at + 1 - h["old_at"]
    return "\n".join(out + rows[low:])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def create_delta(source: bytes, target: bytes) -> bytes:
    """Copies from the source and literals that make the target.

    Each instruction is a varint of twice a length, plus one for a copy; a literal is
    followed by its bytes, a copy by a varint of the place in the source. Matches are
    found by 16-byte grams, the last of equal ones, and extended both ways.
    """
    seen = {source[i : i + GRAM]: i for i in range(len(source) - GRAM + 1)}
    out, done, at = bytearray(), 0, 0

    def literal(upto: int) -> None:
        if upto > done:
            out.extend(_varint((upto - done) << 1) + target[done:upto])

    while seen and at + GRAM <= len(target):
        start = seen.get(target[at : at + GRAM])
        if start is None:
            at += 1
            continue
        size = GRAM
        while start + size < len(source) and at + size < len(target) and source[start + size] == target[at + size]:
            size += 1
        while start and at > done and source[start - 1] == target[at - 1]:
            start, at, size = start - 1, at - 1, size + 1
        literal(at)
        out.extend(_varint(size << 1 | 1) + _varint(start))
        at += size
        done = at
    literal(len(target))
    return bytes(out)


def apply_delta(source: bytes, delta: bytes) -> bytes | None:
    """The target, or None if the delta is malformed or reaches outside the source."""
    out, k = bytearray(), 0

    def number() -> int | None:
        nonlocal k
        value = shift = 0
        while k < len(delta) and shift < 64:
            byte = delta[k]
            k += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7
        return None

    while k < len(delta):
        head = number()
        if head is None:
            return None
        size = head >> 1
        if head & 1:
            place = number()
            if place is None or place + size > len(source):
                return None
            out += source[place : place + size]
        else:
            if k + size > len(delta):
                return None
            out += delta[k : k + size]
            k += size
    return bytes(out)


def _null_safe(fn, *columns):
    return pd.Series([None if any(v is None for v in row) else fn(*row) for row in zip(*columns, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def create_patch_udf(name: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return _null_safe(create_patch, name, old, new)


@F.pandas_udf(T.StringType())
def unified_diff_udf(old: pd.Series, new: pd.Series, from_version: pd.Series, to_version: pd.Series) -> pd.Series:
    return _null_safe(unified_diff, old, new, from_version, to_version)


@F.pandas_udf(T.StringType())
def apply_patch_udf(source: pd.Series, patch: pd.Series) -> pd.Series:
    return _null_safe(apply_patch, source, patch)


@F.pandas_udf(T.BinaryType())
def create_delta_udf(source: pd.Series, target: pd.Series) -> pd.Series:
    return _null_safe(create_delta, source, target)


@F.pandas_udf(T.BinaryType())
def apply_delta_udf(source: pd.Series, delta: pd.Series) -> pd.Series:
    return _null_safe(apply_delta, source, delta)
