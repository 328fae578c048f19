"""One walk over each text for all entries of a dictionary.

The entries, normalised word by word, form an Aho-Corasick automaton; a document's normalised words, joined by
single spaces, pass through it once, whatever the number and the length of the entries. An entry is bounded
by spaces on both sides, so it is found on whole words only. The automaton is built once in each Python worker from
a broadcast list, whose size the caller has checked.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .score import loaded

#: places held before they are handed on.
PLACES = 100_000


def automaton(entries: list[tuple[str, list[str], int]]):
    """Automaton over (key, entity types, words): a hit carries the key's length, words and types."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for key, types, words in entries:
        a.add_word(f" {key} ", (len(key), words, types))
    a.make_automaton()
    return a


def places(walker, text: str) -> list[tuple[int, int, str]]:
    """(number of the first word, words, entity type) of every entry in words joined by single spaces."""
    hits = [(end - size, words, types) for end, (size, words, types) in walker.iter(f" {text} ")]
    if not hits:
        return []
    # in the padded text a word starts behind each space, and a hit's leading space is at end - size - 1
    spaces = np.flatnonzero(np.frombuffer(f" {text}".encode("utf-32-le"), dtype=np.uint32) == 32)
    numbers = np.searchsorted(spaces, [at - 1 for at, _, _ in hits]).tolist()
    return [(number, words, t) for number, (_, words, types) in zip(numbers, hits) for t in types]


def walk_entries(texts: DataFrame, entries: list[tuple[str, list[str], int]], doc: str, words: str, tokens: str) -> DataFrame:
    """(doc, token, n_words, entity_type) of every entry in every row of ``texts``: ``words`` are normalised words,
    ``tokens`` their places in the document. Rows without words give nothing."""
    from ..session import ship_package

    spark = texts.sparkSession
    schema = T.StructType([T.StructField(doc, texts.schema[doc].dataType), T.StructField("token", T.IntegerType()),
                           T.StructField("n_words", T.IntegerType()), T.StructField("entity_type", T.StringType())])
    if not entries:
        return spark.createDataFrame([], schema)
    ship_package(spark)
    name = "dictionary " + hashlib.sha256(pickle.dumps(entries)).hexdigest()
    shared = spark.sparkContext.broadcast(entries)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            walker = loaded(lambda: automaton(shared.value), name)
            docs, numbers = b.column(0), b.column(2)
            rows, at, sizes, types = [], [], [], []

            def flush():
                out = pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(sizes, pa.int32()),
                     pa.array(types, pa.string())], names=[doc, "token", "n_words", "entity_type"])
                for held in (rows, at, sizes, types):
                    held.clear()
                return out

            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                found = places(walker, text) if text else []
                if not found:
                    continue
                own = numbers[i].values.to_numpy(zero_copy_only=False)
                for start in range(0, len(found), PLACES):
                    part = found[start:start + PLACES]
                    rows.extend([i] * len(part))
                    at.extend(own[[p[0] for p in part]].tolist())
                    sizes.extend(p[1] for p in part)
                    types.extend(p[2] for p in part)
                    if len(rows) >= PLACES:
                        yield flush()
            yield flush()

    return texts.select(doc, F.array_join(words, " ").alias("_text"), F.col(tokens).alias("_numbers")).mapInArrow(run, schema)
