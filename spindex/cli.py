"""Command line: key/value, point, text and version tables.

    python -m spindex.cli kv TABLE list|get KEY|range LOW HIGH|info|put KEY VALUE|delete KEY|compact [-s]
    python -m spindex.cli points TABLE list|box S N W E|radius LAT LNG KM|nearest LAT LNG K|info|insert ID LAT LNG|remove ID|clear|compact
    python -m spindex.cli text ROOT query WORDS [--ids] [--all]|info|list|add ID WORDS|remove ID|clear|compact
    python -m spindex.cli versions TABLE list LOG|get LOG V|hash LOG V|diff LOG FROM TO|info|add LOG TEXT

Tables are versioned ones, made by the first change, or plain Parquet folders to read
from. Rows are printed as JSON lines; nothing found ends with status 1.
"""

from __future__ import annotations

import argparse
import json
import math
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.functions import diffing
from spindex.functions.guards import stored_key
from spindex.operators import spatial, versions
from spindex.operators.fulltext import TextIndex
from spindex.operators.kv import KVTable
from spindex.operators.stored import KVStore, PointStore, VersionStore
from spindex.sources.store import Store
from spindex.sources.tables import Namespace


def key_of(word: str, as_string: bool) -> object:
    """Words that look like plain decimals are numbers unless strings are asked for."""
    if as_string or not re.fullmatch(r"-?\d+(\.\d+)?", word):
        return word
    return float(word) if "." in word else int(word)


def degrees(word: str, most: float) -> float:
    value = float(word)
    if not math.isfinite(value) or abs(value) > most:
        raise ValueError(f"{word} isn't within {most:g} degrees")
    return value


def distance(word: str) -> float:
    value = float(word)
    if not math.isfinite(value) or value <= 0:
        raise ValueError("a radius is finite and above 0")
    return value


def change(spark: SparkSession, kind: str, table: str, command: str, words: list[str], as_string: bool = False) -> DataFrame:
    """Makes a change and returns one row that says what was done."""
    said: dict[str, int] = {}
    if kind == "kv":
        made = KVStore(spark, table) if Store(spark, table).exists() else KVStore.create(spark, table, "string" if as_string else "double")
        if command == "compact":
            said = made.compact()
        else:
            keys = made.store.read("log").schema["key"].dataType.simpleString()
            key = stored_key(key_of(words[0], keys == "string"))
            row = spark.createDataFrame([(key if keys == "string" else float(key), words[1] if command == "put" else None)], "key string, value string" if keys == "string" else "key double, value string")
            made.put(row) if command == "put" else made.delete(row)
    elif kind == "points":
        points = PointStore(spark, table)
        if command == "insert":
            points.insert(spark.createDataFrame([(words[0], degrees(words[1], 90), degrees(words[2], 180))], "object_id string, lat double, lng double"))
        elif command == "remove":
            points.remove(spark.createDataFrame([(words[0],)], "object_id string"))
        elif command == "clear":
            points.clear()
        else:
            said = points.compact()
    elif kind == "text":
        index = TextIndex(Namespace(spark, table))
        docs = spark.createDataFrame([(words[0] if words else None, " ".join(words[1:]))], "doc_id string, text string")
        if command == "add":
            index.add(docs) if index.stored.exists() else index.build(docs)
        elif command == "remove":
            index.remove(docs)
        elif command == "clear":
            index.clear()
        else:
            said = index.compact()
    else:
        VersionStore(spark, table).add(spark.createDataFrame([(int(words[0]), " ".join(words[1:]), 1)], "log_id long, text string, seq int"))
    return spark.createDataFrame([(command, *said.values())], ", ".join(["done string", *(f"{k} long" for k in said)]))


def rows_of(spark: SparkSession, kind: str, table: str) -> DataFrame:
    store = Store(spark, table)
    if not store.exists():
        return spark.read.parquet(table)
    return KVStore(spark, table).table().rows if kind == "kv" else store.read().drop("seq")


CHANGES = {"kv": {"put", "delete", "compact"}, "points": {"insert", "remove", "clear", "compact"}, "text": {"add", "remove", "clear", "compact"}, "versions": {"add"}}


def answer(spark: SparkSession, kind: str, table: str, command: str, words: list[str], as_string: bool = False, ids: bool = False, every: bool = False) -> DataFrame:
    if command in CHANGES[kind]:
        return change(spark, kind, table, command, words, as_string)
    if kind == "text":
        index = TextIndex(Namespace(spark, table))
        if command == "list":
            return index.stored.read("lengths").orderBy("id")
        if command == "query":
            return index.query(" ".join(words), require_all=every, scored=not (ids or every))
        return spark.createDataFrame([(index.document_count(), index.term_count())], "documents long, terms long")
    rows = rows_of(spark, kind, table)
    if command == "info":
        return rows.agg(F.count(F.lit(1)).alias("size"))
    if kind == "kv":
        kv = KVTable(rows)
        if command == "get":
            return kv.get(key_of(words[0], as_string))
        return kv.range(*(key_of(w, as_string) for w in words[:2])) if command == "range" else kv.scan()
    if kind == "points":
        if command == "box":
            s, n = (degrees(w, 90) for w in words[:2])
            w, e = (degrees(x, 180) for x in words[2:4])
            return spatial.search_box(rows, s, n, w, e)
        if command in ("radius", "nearest"):
            lat, lng = degrees(words[0], 90), degrees(words[1], 180)
            return spatial.search_radius(rows, lat, lng, distance(words[2])) if command == "radius" else spatial.nearest(rows, lat, lng, int(words[2]))
        return rows
    own = rows.where(F.col("log_id") == int(words[0]))
    if command == "diff":
        return versions.diff(own, int(words[1]), int(words[2]))
    if command == "list":
        return own.select("version", versions.text_hash(F.col("text")).alias("hash")).orderBy("version")
    one = versions.get_version(own, int(words[1]))
    return one.select("version", versions.text_hash(F.col("text")).alias("hash")) if command == "hash" else one.select("version", "text")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("kind", choices=["kv", "points", "text", "versions"])
    parser.add_argument("table")
    parser.add_argument("command", choices=["list", "get", "range", "info", "box", "radius", "nearest", "query", "hash", "diff", "put", "delete", "insert", "remove", "add", "clear", "compact"])
    parser.add_argument("words", nargs="*")
    parser.add_argument("-s", "--string", action="store_true")
    parser.add_argument("--ids", action="store_true")
    parser.add_argument("--all", action="store_true")
    got = parser.parse_intermixed_args(args)
    session = spark or SparkSession.builder.getOrCreate()
    try:
        found = answer(session, got.kind, got.table, got.command, got.words, got.string, got.ids, got.all)
    except (ValueError, IndexError, diffing.PatchError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    n = 0
    for row in found.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
        n += 1
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
