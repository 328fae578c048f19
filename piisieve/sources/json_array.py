"""One JSON array of objects read by many tasks.

Spark's text source cuts a file into byte ranges; with ``}`` as the line separator a piece is never longer than one
object, also where the array is one line. A closing brace may lie in a string or in a nested object, so where objects end
depends on all text before. Two passes settle that: the first gives, for each byte range, how it changes the state
(inside a string or not, depth of brackets) under both starting states - one row a range, composed in file order
on the driver; the second starts every range in its right state and hands on whole objects. Objects that cross
borders of ranges leave as fragments and are put together in one shuffle of these fragments alone. The second pass
runs twice, once for the whole objects and once for the fragments, so the text is read three times in all.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: unrolled, so that long strings cost no recursion
STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
ELEMENT = r"^[ \t\r\n]*[\[,][ \t\r\n]*(?=\{)"
BLANKS = " \t\r\n"


def advance(piece: str, in_string: bool) -> tuple[int, bool]:
    """(change of depth, whether a string is open) over a piece and the brace that ended it."""
    if in_string:
        end = STRING_END.match(piece)
        if not end:
            return 0, True
        piece = piece[end.end():]
    rest = STRING.sub("", piece)
    open_at = rest.find('"')
    if open_at >= 0:
        rest = rest[:open_at]
    depth = rest.count("{") + rest.count("[") - rest.count("]")
    return (depth, True) if open_at >= 0 else (depth - 1, False)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, piece) in the order of the file within each byte range."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").alias("piece"))


def _changes(batches):
    """One row for each byte range: its effect on both starting states."""
    ranges: dict = {}
    for b in batches:
        for file, block, size, piece in zip(*(c.to_pylist() for c in b.columns)):
            held = ranges.setdefault((file, block, size), [0, [0, False, 1 << 40], [0, True, 1 << 40]])
            held[0] += len(piece.encode()) + 1
            for state in held[1:]:
                change, state[1] = advance(piece, state[1])
                state[0] += change
                if not state[1]:
                    state[2] = min(state[2], state[0])
    rows = [(*key, held[0], *held[1], *held[2]) for key, held in ranges.items()]
    columns = list(zip(*rows)) or [[] for _ in CHANGES]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CHANGES.values())], names=list(CHANGES))


CHANGES = {"file": pa.string(), "block": pa.int64(), "size": pa.int64(), "bytes": pa.int64(),
           "depth0": pa.int64(), "open0": pa.bool_(), "least0": pa.int64(),
           "depth1": pa.int64(), "open1": pa.bool_(), "least1": pa.int64()}


def starting_states(rows) -> dict:
    """(file, block) -> (string open, depth, range in which the open object began) from the rows of ``_changes``; a
    file that is no whole array raises. The piece behind the last brace counts one that is not there: a whole
    array ends at depth -1."""
    states, files = {}, {}
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        files.setdefault(r["file"], []).append(r)
    for file, ranges in files.items():
        in_string, depth, owner = False, 0, ranges[0]["block"]
        for r in ranges:
            if depth <= 1 and not in_string:
                owner = r["block"]
            states[file, r["block"]] = (in_string, depth, owner)
            which = "1" if in_string else "0"
            if depth + r["least" + which] <= 1:  # an object ends in this range, a later one begins in it
                owner = r["block"]
            depth, in_string = depth + r["depth" + which], r["open" + which]
        if in_string or depth != -1 or sum(r["bytes"] for r in ranges) == ranges[0]["size"]:
            raise ValueError(f"{file} is no whole JSON array")
    return states


def _objects(states: dict):
    """mapInArrow body: (file, owner, block, whole, text) of whole objects and of fragments."""
    def run(batches):
        place, held, out = None, [], []
        in_string = depth = owner = whole = None

        def emit(text, complete):
            out.append((place[0], owner, place[1], complete, text))

        def batch():
            columns = list(zip(*out)) or [[]] * 5
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))],
                names=["file", "owner", "block", "whole", "text"])
            out.clear()
            return made

        for b in batches:
            for file, block, _, piece in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != place:
                    if held:
                        emit("".join(held), False)
                    place, held = (file, block), []
                    in_string, depth, owner = states[place]
                    whole = depth <= 1 and not in_string
                change, in_string = advance(piece, in_string)
                depth += change
                if depth < 0 and not in_string:  # what follows the last object
                    if held or "".join(piece.split()) not in ("]", "[]") or piece.strip(BLANKS)[-1:] != "]":
                        raise ValueError(f"{file} ends in {piece[-100:]!r}")
                    continue
                held.append(piece + "}")
                if depth == 1 and not in_string:
                    emit("".join(held), whole)
                    held, whole, owner = [], True, block
            yield batch()
        if held:
            emit("".join(held), False)
        yield batch()

    return run


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """The objects of files that hold one JSON array each, read in byte ranges of ``spark.sql.files.maxPartitionBytes``.

    The driver holds one row for each byte range. A file that is cut off or holds something else than one array of
    objects raises, when called or when its rows are read; an object that does not parse raises. A null for a field
    that an object lacks; the order of the rows is not kept. An empty array and an empty file have no rows."""
    from ..session import ship_package
    ship_package(spark)
    kinds = "file string, block long, size long, bytes long, depth0 long, open0 boolean, least0 long, depth1 long, open1 boolean, least1 long"
    states = starting_states(_pieces(spark, path).mapInArrow(_changes, kinds).collect())
    shared = spark.sparkContext.broadcast(states)
    rows = _pieces(spark, path).mapInArrow(
        lambda batches: _objects(shared.value)(batches), "file string, owner long, block long, whole boolean, text string")
    parts = rows.filter(~F.col("whole")).groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    texts = rows.filter("whole").select("text").unionByName(parts.select("text"))
    inner = F.when(F.col("text").rlike(ELEMENT), F.regexp_replace("text", ELEMENT, "")).otherwise(
        F.raise_error(F.concat(F.lit("no element of an array of objects: "), F.substring("text", 1, 100))))
    return texts.select(F.from_json(inner, schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """Files of one JSON array each, one for each partition of ``df`` that has rows."""
    def run(batches):
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + t for i, t in enumerate(texts)])], names=["value"])
            first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
