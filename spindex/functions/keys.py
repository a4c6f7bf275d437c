"""Composite keys: a byte form whose order is the order of the parts.

Inside Spark a composite key is just several sort columns; bytes are for exchange.
Part tags order the kinds: number, string, id, date.
"""

import datetime as dt
import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGN = 1 << 63


def number_part(value: float) -> bytes:
    if math.isnan(value):
        raise ValueError("NaN has no place in an order")
    (bits,) = struct.unpack(">Q", struct.pack(">d", value + 0.0 if value else 0.0))
    return b"\x00" + struct.pack(">Q", bits ^ _SIGN if bits < _SIGN else bits ^ (2 * _SIGN - 1))


def string_part(value: str) -> bytes:
    if "\0" in value:
        raise ValueError("a string part can't hold U+0000")
    return b"\x01" + value.encode() + b"\x00"


def id_part(value: str | bytes) -> bytes:
    raw = bytes.fromhex(value) if isinstance(value, str) else value
    if len(raw) != 12:
        raise ValueError("an id has 12 bytes")
    return b"\x02" + raw


def date_part(millis: int) -> bytes:
    return b"\x03" + struct.pack(">Q", (millis + _SIGN) % (2 * _SIGN))


def ordered_key(value: object) -> bytes:
    """One part, by the type of the value."""
    if isinstance(value, bool):
        raise ValueError("a boolean has no key form")
    if isinstance(value, (int, float)):
        return number_part(float(value))
    if isinstance(value, str):
        return string_part(value)
    if isinstance(value, bytes):
        return id_part(value)
    if isinstance(value, dt.datetime):
        return date_part(round(value.replace(tzinfo=value.tzinfo or dt.UTC).timestamp() * 1000))
    raise ValueError(f"no key form for {type(value).__name__}")


def composite_key(*parts: object) -> bytes:
    return b"".join(map(ordered_key, parts))


def composite_upper_bound(*parts: object) -> bytes:
    """Above every key that begins with the parts."""
    return composite_key(*parts) + b"\xff"


def string_part_column(col: Column) -> Column:
    return F.concat(F.lit(b"\x01"), F.encode(col, "UTF-8"), F.lit(b"\x00"))


def id_part_column(hex_col: Column) -> Column:
    return F.concat(F.lit(b"\x02"), F.unhex(hex_col))


def long_part_column(col: Column, tag: bytes) -> Column:
    """Eight big-endian bytes with the sign bit flipped, after a tag (dates in milliseconds)."""
    flipped = col.cast("long").bitwiseXOR(F.lit(-_SIGN))
    return F.concat(F.lit(tag), F.unhex(F.lpad(F.hex(flipped), 16, "0")))


@F.pandas_udf(T.BinaryType())
def number_part_column(values: pd.Series) -> pd.Series:
    """The byte form of doubles; null for null."""
    return values.map(number_part, na_action="ignore")
