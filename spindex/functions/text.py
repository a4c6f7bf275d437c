"""Tokens and Porter stems as SQL expressions.

Tokens are runs of ASCII letters, digits, underscores and any non-ASCII characters;
only ASCII letters are lower-cased. Stop words go before stemming. Tokens with a
non-ASCII character, and those of fewer than three letters, are their own stems.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[A-Za-z0-9_\\x{80}-\\x{10FFFF}]+"

#: By length, then by alphabet.
STOP_WORDS = tuple(
    """
    a i
    am an as at be by do he if in is it me my of on or to up we
    all and any are but can did for get got had has her him his how now our out see the too was way who you
    also been both came come each from have here into like make many more most much must only over said same some such take than that them then they this very well were what with your
    about after being could might never other since still their there these those under where which while would
    around before should
    another because between himself through
    """.split()
)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def token_array(text: Column) -> Column:
    """All tokens of a text in order, lower-cased, stop words included; null gives none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def is_stop_word(token: Column) -> Column:
    return token.isin(*STOP_WORDS)


# --- Porter, as stages of SQL over a column ``w`` that Spark and other engines read alike


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M_ABOVE_0 = f"^({_C})?{_V}{_C}"
_M_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
_M_ABOVE_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
_DOUBLED = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx0123456789_") + ")$"

#: What replaces each suffix, by the replacement.
_SECOND = {"ate": "ational ation ator", "tion": "tional", "ence": "enci", "ance": "anci", "ize": "ization izer", "ble": "biliti bli", "al": "alism aliti alli", "ent": "entli", "e": "eli", "ous": "ousness ousli", "ive": "iveness iviti", "ful": "fulness", "log": "logi"}
_THIRD = {"ic": "icate iciti ical", "": "ative ness ful", "al": "alize"}
_FOURTH = {"": "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou"}


def _swap(table: dict[str, str], condition: Callable[[str], str], otherwise: str = "w") -> str:
    """The longest listed suffix that leaves a letter is replaced if the condition holds for what is left; else nothing changes."""
    pairs = sorted(((s, r) for r, ss in table.items() for s in ss.split()), key=lambda p: -len(p[0]))
    cases = []
    for suffix, new in pairs:
        stem = f"substr(w, 1, length(w) - {len(suffix)})"
        cases.append(f"WHEN length(w) > {len(suffix)} AND right(w, {len(suffix)}) = '{suffix}' THEN CASE WHEN {condition(stem)} THEN concat({stem}, '{new}') ELSE w END")
    return f"CASE {' '.join(cases)} ELSE {otherwise} END"


def porter_stages(matches: str) -> list[str]:
    """SQL expressions, each over the result ``w`` of the one before; ``matches`` names the engine's regular-expression test."""

    def m(value: str, pattern: str) -> str:
        return f"{matches}({value}, '{pattern}')"

    def less(n: int) -> str:
        return f"substr(w, 1, length(w) - {n})"

    cut = "regexp_replace(w, '(ed|ing)$', '')"
    mended = f"CASE WHEN {m(cut, '(at|bl|iz)$')} THEN concat({cut}, 'e') WHEN {m(cut, _DOUBLED)} THEN substr({cut}, 1, length({cut}) - 1) WHEN {m(cut, _SHORT)} THEN concat({cut}, 'e') ELSE {cut} END"
    ion = f"CASE WHEN {m('w', '^.+[st]ion$')} AND {m(less(3), _M_ABOVE_1)} THEN {less(3)} ELSE w END"
    return [
        "CASE WHEN left(w, 1) = 'y' THEN concat('Y', substr(w, 2)) ELSE w END",
        f"CASE WHEN {m('w', '^.+(ss|i)es$')} THEN {less(2)} WHEN {m('w', '^.+[^s]s$')} THEN {less(1)} ELSE w END",
        f"CASE WHEN {m('w', '^.+eed$')} THEN CASE WHEN {m(less(3), _M_ABOVE_0)} THEN {less(1)} ELSE w END WHEN {m('w', '^.+(ed|ing)$')} AND {m(cut, '[aeiouy]')} THEN {mended} ELSE w END",
        f"CASE WHEN {m('w', '[aeiouy].*y$')} THEN concat({less(1)}, 'i') ELSE w END",
        _swap(_SECOND, lambda s: m(s, _M_ABOVE_0)),
        _swap(_THIRD, lambda s: m(s, _M_ABOVE_0)),
        _swap(_FOURTH, lambda s: m(s, _M_ABOVE_1), ion),
        f"CASE WHEN {m('w', '^.+e$')} AND ({m(less(1), _M_ABOVE_1)} OR ({m(less(1), _M_IS_1)} AND NOT {m(less(1), _SHORT)})) THEN {less(1)} ELSE w END",
        f"CASE WHEN {m('w', 'll$')} AND {m('w', _M_ABOVE_1)} THEN {less(1)} ELSE w END",
        "CASE WHEN left(w, 1) = 'Y' THEN concat('y', substr(w, 2)) ELSE w END",
    ]


def stemmed(words: DataFrame, word_col: str = "token", out_col: str = "stem") -> DataFrame:
    """Adds the stem of a lower-cased token.

    The steps are staged projections over a helper column, so each reads the one before
    once and the expression doesn't grow with the number of steps. The stem comes out of
    a generator, as the optimizer would else write all steps, each several times, into
    any predicate on it.
    """
    own = [F.col(f"`{c}`") for c in words.columns]
    token = F.col(f"`{word_col}`")
    plain = (F.length(token) < 3) | token.rlike("[^\\x00-\\x7F]")
    df = words.select(*own, F.when(plain, F.lit("")).otherwise(token).alias("w"))
    for stage in porter_stages("regexp_like"):
        df = df.select(*own, F.expr(stage).alias("w"))
    return df.select(*own, F.explode(F.array(F.when(plain, token).otherwise(F.col("w")))).alias(out_col))


def stemmed_distinct(words: DataFrame, word_col: str = "token", out_col: str = "stem") -> DataFrame:
    """As ``stemmed``, stemming each distinct token once; worth its join where tokens repeat a lot."""
    vocabulary = stemmed(words.select(word_col).distinct(), word_col, out_col)
    return words.join(vocabulary, word_col)


def tokens(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """doc id, pos (from 0, stop words counted), token, without stop words."""
    rows = docs.select(F.col(f"`{id_col}`"), F.posexplode(token_array(F.col(f"`{text_col}`"))).alias("pos", "token"))
    return rows.where(~is_stop_word(F.col("token")))


# --- the same on bytes, for a document's tokens within its own row

#: Stems a worker remembers, with 150 bytes each about; beyond that it begins anew.
MOST_REMEMBERED = 500_000
_TO_TOKENS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_STOP_BYTES = frozenset(w.encode() for w in STOP_WORDS)


def token_bytes(text: bytes) -> list[bytes]:
    """As ``token_array``, of UTF-8: every byte of a non-ASCII character is above 127."""
    return text.translate(_TO_TOKENS).split()


def _compiled() -> dict[str, Callable]:
    patterns = {"above_0": _M_ABOVE_0, "is_1": _M_IS_1, "above_1": _M_ABOVE_1, "short": _SHORT, "doubled": _DOUBLED, "vowel": "[aeiouy]"}
    return {name: re.compile(pattern).search for name, pattern in patterns.items()}


_IS = _compiled()
_ENDINGS = [{s: new for new, ss in table.items() for s in ss.split()} for table in (_SECOND, _THIRD, _FOURTH)]
_LONGEST = [range(max(map(len, t)), min(map(len, t)) - 1, -1) for t in _ENDINGS]


def _ending(w: str, k: int) -> str | None:
    """The longest suffix of a table that leaves a letter."""
    for n in _LONGEST[k]:
        if n < len(w) and w[-n:] in _ENDINGS[k]:
            return w[-n:]
    return None


def porter(token: str) -> str:
    """The stem of a lower-cased ASCII token of three letters or more; the stages of ``porter_stages``."""
    w = "Y" + token[1:] if token[0] == "y" else token
    if w[-1] == "s":
        if (len(w) > 4 and w.endswith("sses")) or (len(w) > 3 and w.endswith("ies")):
            w = w[:-2]
        elif len(w) > 2 and w[-2] != "s":
            w = w[:-1]
    if len(w) > 3 and w.endswith("eed"):
        if _IS["above_0"](w[:-3]):
            w = w[:-1]
    elif (len(w) > 2 and w.endswith("ed")) or (len(w) > 3 and w.endswith("ing")):
        cut = w[:-2] if w[-1] == "d" else w[:-3]
        if _IS["vowel"](cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _IS["doubled"](w):
                w = w[:-1]
            elif _IS["short"](w):
                w += "e"
    if w[-1] == "y" and _IS["vowel"](w[:-1]):
        w = w[:-1] + "i"
    for k in (0, 1):
        suffix = _ending(w, k)
        if suffix and _IS["above_0"](w[: -len(suffix)]):
            w = w[: -len(suffix)] + _ENDINGS[k][suffix]
    suffix = _ending(w, 2)
    if suffix:
        if _IS["above_1"](w[: -len(suffix)]):
            w = w[: -len(suffix)]
    elif len(w) > 4 and w.endswith(("sion", "tion")) and _IS["above_1"](w[:-3]):
        w = w[:-3]
    if len(w) > 1 and w[-1] == "e" and (_IS["above_1"](w[:-1]) or (_IS["is_1"](w[:-1]) and not _IS["short"](w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _IS["above_1"](w):
        w = w[:-1]
    return "y" + w[1:] if w[0] == "Y" else w


class Stems(dict):
    """The stem of each token in bytes, None for stop words, found when first asked for."""

    def __missing__(self, token: bytes) -> bytes | None:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        stem = None if token in _STOP_BYTES else token if len(token) < 3 or not token.isascii() else porter(token.decode()).encode()
        self[token] = stem
        return stem
