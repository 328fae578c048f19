"""Periodic runs of words by scale-tiled distribution.

A run is a longest stretch of words that repeats itself ``q`` words on, with ``q`` its smallest period, of
at least ``max(min_words, 3 q)`` words. Periods are handled by octaves: spacing S = 8, 16, 32, ... is
responsible for the periods S to 2S - 1 (the first also for 1 to 7).

*Explode.* In every octave a document has boundaries at the multiples of S. A run of the octave holds
a boundary with at most S - 1 words of the run before it and two whole periods after it, so the window
of S words there comes again one period on. Boundaries with such a window become overlapping tiles of
the word numbers: some consecutive boundaries, S words before the first and 5S behind the last. All
windows of an octave are compared at once through 64-bit codes that double their length from octave to
octave; codes only choose tiles, the words themselves decide. The tiles are dealt to tasks on their own,
so a very long document is many rows.

*Solve.* At each boundary a Z-function to the right and one to the left (of reversed words) give, for
every period of the octave, how far the words around the boundary keep it. A period stays if two whole
periods follow the boundary and they are not themselves repetitions of something shorter.

*Stitch.* Fragments of one document and period are shuffled together, and those that share at least
one period of words are one run. Fragments of a run from neighbouring boundaries share two periods.

Each word takes part in at most one comparison per octave and in 6 words of tiles per octave with a
repeated window, so work is linear in the words, times the number of octaves.

Defined results: null and empty texts and those without words have no run; a null id is a document of its
own; repeated rows each get their row; documents of any length are taken whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .words import mix64

LEAST_SPACING = 8
TILE_BOUNDARIES = 8
TILE_WORDS = 512
FLUSH_BYTES = 8 << 20


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Words numbered by first appearance in the document: equal numbers are equal words."""
    numbers = dict(zip(dict.fromkeys(words), count()))
    return np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))


def _joined(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of windows of 2 * size words from those of ``size`` words."""
    return mix64(codes[:-size] * np.uint64(0x9E3779B97F4A7C15) + codes[size:])


def _hits(heads: np.ndarray, codes: np.ndarray, spacing: int, skip: int) -> np.ndarray:
    """For each head: does its code come again among the codes of its row (rows of ``spacing`` codes)?"""
    out = np.zeros(len(heads), dtype=bool)
    rows = min(len(codes) // spacing, len(heads))
    out[:rows] = (codes[:rows * spacing].reshape(rows, spacing)[:, skip:] == heads[:rows, None]).any(axis=1)
    if rows < len(heads):
        out[rows] = (codes[rows * spacing:(rows + 1) * spacing][skip:] == heads[rows]).any()
    return out


def tiles(numbers: np.ndarray):
    """(spacing, place of the tile's first word, word numbers, boundaries inside the tile)."""
    n = len(numbers)
    if n < 3 * LEAST_SPACING:
        return
    codes, spacing = mix64(numbers.astype(np.uint64) + np.uint64(1)), 1
    while spacing < LEAST_SPACING:
        codes, spacing = _joined(codes, spacing), 2 * spacing
    while 3 * spacing <= n:
        heads = codes[::spacing]
        hit = _hits(heads, codes[spacing:], spacing, 0)
        if spacing == LEAST_SPACING:
            hit |= _hits(heads, codes, spacing, 1)
        if hit.any():
            marks = np.flatnonzero(hit) * spacing
            core = marks // max(TILE_BOUNDARIES * spacing, TILE_WORDS)
            for part in np.split(marks, np.flatnonzero(np.diff(core)) + 1):
                low = max(0, int(part[0]) - spacing)
                yield spacing, low, numbers[low:int(part[-1]) + 5 * spacing], (part - low).astype(np.int32)
        codes, spacing = _joined(codes, spacing), 2 * spacing


def z_function(s: list, upto: int) -> list[int]:
    """z[i]: how many items from i on equal those from the start, for i below ``upto``."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return tuple(out + [n] if n > 1 else out)


def solve_tile(words: list, spacing: int, boundaries) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches around the boundaries that keep a period of the octave."""
    found: dict[int, list[list[int]]] = {}
    least = 1 if spacing == LEAST_SPACING else spacing
    for b in boundaries:
        right = words[b:b + 5 * spacing]
        most = min(2 * spacing - 1, len(right) // 2)
        z = z_function(right, most + 1)
        periods = [q for q in range(least, most + 1) if z[q] >= q
                   and not any(z[q // r] >= q - q // r for r in _prime_factors(q))]
        if not periods:
            continue
        before = words[max(0, b - spacing):b][::-1]
        around = words[max(0, b - spacing):b + 2 * spacing][::-1]
        top = len(around) - len(before)  # words of the tile from the boundary on
        back = z_function([*before, -1, *around], len(before) + 1 + top)
        for q in periods:
            start, end = b - back[len(before) + 1 + top - q], b + q + z[q]
            pieces = found.setdefault(q, [])
            if pieces and start <= pieces[-1][1] - q:
                pieces[-1][0], pieces[-1][1] = min(start, pieces[-1][0]), max(end, pieces[-1][1])
            else:
                pieces.append([start, end])
    return [(q, s, e) for q, pieces in found.items() for s, e in pieces]


DOC_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("whole_sha256", pa.string()), ("body", pa.binary()),
              ("key", pa.binary()), ("spacing", pa.int64()), ("low", pa.int64()), ("numbers", pa.binary()), ("boundaries", pa.binary())]
DOC_SCHEMA = ("doc_id long, n_words long, whole_sha256 string, body binary, key binary, spacing long, low long, "
              "numbers binary, boundaries binary")


def _batch(rows, fields=DOC_FIELDS) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _explode(batches):
    """One row per document (without a tile: its digest; else its words and a key) and one row per tile."""
    for b in batches:
        rows, held = [], 0
        for doc, data in zip(b.column("doc_id"), b.column("data")):
            doc, words = doc.as_py(), (data.as_py() or b"").split()
            key, body = None, b" ".join(words)
            for spacing, low, numbers, boundaries in tiles(word_numbers(words)):
                key = key or hashlib.blake2b(b"%d " % doc + body if doc is not None else body, digest_size=16).digest()
                rows.append((None, None, None, None, key, spacing, low, numbers.tobytes(), boundaries.tobytes()))
                held += 4 * len(numbers)
                if held > FLUSH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            rows.append((doc, len(words), None if key else hashlib.sha256(body).hexdigest(), body if key else None, key,
                         None, None, None, None))
            held += len(body) if key else 0
        yield _batch(rows)


FRAGMENT_FIELDS = [("key", pa.binary()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]


def _solve(batches):
    for b in batches:
        rows = []
        for key, spacing, low, numbers, boundaries in zip(*(b.column(c).to_pylist() for c in ("key", "spacing", "low", "numbers", "boundaries"))):
            words = np.frombuffer(numbers, dtype=np.int32).tolist()
            rows += [(key, q, low + s, low + e)
                     for q, s, e in solve_tile(words, spacing, np.frombuffer(boundaries, dtype=np.int32).tolist())]
        yield _batch(rows, FRAGMENT_FIELDS)


def stitched(fragments: DataFrame, min_words: int = 24) -> DataFrame:
    """(key, start, length, period): fragments of a document and period that share at least one period of
    words are one run; runs of at least max(min_words, 3 periods) words."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.distinct().withColumn("new", F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return runs.filter(length >= F.greatest(F.lit(min_words), 3 * F.col("period"))).select("key", "start", length.alias("length"), "period")


def _exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"))
    return stored(src.mapInArrow(_explode, DOC_SCHEMA), "tiles")


def _runs(exploded: DataFrame, min_words: int) -> DataFrame:
    # equal tiles of repeated rows are one; the shuffle by tile deals a long document's tiles to many tasks
    cut = exploded.filter("numbers IS NOT NULL").select("key", "spacing", "low", "numbers", "boundaries")
    dealt = cut.dropDuplicates(["key", "spacing", "low"])
    return stitched(dealt.mapInArrow(_solve, "key binary, period long, start long, end long"), min_words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 24) -> DataFrame:
    """(doc_id, start, length, period): every run of every document. Rows that agree in id and words list
    their runs once. ``min_words`` may be 24 or more: shorter runs can lie between two boundaries."""
    if min_words < 3 * LEAST_SPACING:
        raise ValueError(f"min_words is at least {3 * LEAST_SPACING}")
    exploded = _exploded(docs, key, text)
    ids = exploded.filter("n_words IS NOT NULL AND key IS NOT NULL").select("key", "doc_id").distinct()
    return _runs(exploded, min_words).join(ids, "key").select("doc_id", "start", "length", "period")


DIGEST_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_kept", pa.int64()), ("n_runs", pa.int64()),
                 ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
                 ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
DIGEST_SCHEMA = ("doc_id long, n_words long, n_kept long, n_runs long, start long, length long, period long, "
                 "exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _collapse(with_text: bool):
    def run(batches):
        for b in batches:
            rows = []
            for doc, body, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "body", "runs"))):
                words, best = body.split(), (None, None, None)
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                runs = sorted((r["start"], r["length"], r["period"]) for r in runs or [])
                runs.sort(key=lambda r: (r[0], r[2]))
                for start, length, period in runs:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                    if best[0] is None or length * best[2] > best[1] * period:
                        best = (start, length, period)
                kept = b" ".join(w for w, g in zip(words, np.cumsum(gone)[:-1].tolist()) if not g)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                rows.append((doc, len(words), len(kept.split()), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                             hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
                             *([kept.decode("utf-8", "replace")] if with_text else [])))
            yield _batch(rows, DIGEST_FIELDS + ([("collapsed", pa.string())] if with_text else []))
    return run


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 24,
                  with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_kept, n_runs, the run with the greatest length / period (start,
    length, period, exponent_milli; ties: smallest start, then period), runs_sha256 over all runs and
    collapsed_sha256 over the words left when each run keeps its first period (``with_text``: and that text,
    null for documents without runs, whose words all stay)."""
    if min_words < 3 * LEAST_SPACING:
        raise ValueError(f"min_words is at least {3 * LEAST_SPACING}")
    exploded = _exploded(docs, key, text)
    listed = _runs(exploded, min_words).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    tiled = exploded.filter("n_words IS NOT NULL AND key IS NOT NULL").select("key", "doc_id", "body")
    extra = ", collapsed string" if with_text else ""
    found = tiled.join(listed, "key", "left").select("doc_id", "body", "runs").mapInArrow(_collapse(with_text), DIGEST_SCHEMA + extra)
    none = F.lit(None).cast("long")
    plain = exploded.filter("n_words IS NOT NULL AND key IS NULL").select(
        "doc_id", "n_words", F.col("n_words").alias("n_kept"), F.lit(0).cast("long").alias("n_runs"),
        *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("whole_sha256").alias("collapsed_sha256"),
        *([F.lit(None).cast("string").alias("collapsed")] if with_text else []))
    return plain.unionByName(found)
