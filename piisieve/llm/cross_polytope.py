"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

*Hashes.* A vector, scaled to unit length, goes through three rounds of random signs and a fast Hadamard
transform; its hash is the nearest signed axis. A table concatenates one hash over all axes and, by further
rotations, hashes over ``last_axes`` axes in all (over all axes each, the last over the rest), which sets the
number of buckets per table.

*Index.* One row per vector with its bucket in each of ``tables`` tables; every vector is indexed.

*Search.* Each query asks, in every table, the ``probes`` buckets whose axes are nearest to it. Buckets
are split into parts of about ``part_vectors`` vectors and blocks of about ``block_queries`` queries,
so a bucket with very many equal vectors is many tasks; a task streams the vectors of a part past one
block and keeps the best ``k`` of each query, by exact distance on the original vectors. Best lists
are merged per query. A query with fewer than ``k`` found is compared with all vectors, in the same
parts and blocks.

*Sizes.* Without ``settings``, :func:`sized` chooses ``last_axes`` in proportion to the number of vectors and
``probes`` by its square root, so that the share of all vectors that a query meets falls as the table grows.
Measure recall with :func:`exact_neighbours` on a fixture and give other settings if the data need them.

Broadcast: the table of buckets with their counts if it has at most ``broadcast_buckets`` rows; a larger one is
joined by bucket.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part (components beyond 1e150 overflow a double's square); so do null ids; a vector is no candidate of its own id; rows that share an
id are one candidate at their smallest distance and take one of the ``k`` places; ties go to the smaller id; fewer than ``k``
candidates are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


@dataclass(frozen=True)
class AnnSettings:
    tables: int = 32
    last_axes: int = 4
    probes: int = 16
    part_vectors: int = 4_096
    block_queries: int = 512
    seed: int = 11
    broadcast_buckets: int = 1_000_000


#: vectors for each axis of the hashes after the first, where :func:`sized` chooses.
VECTORS_PER_AXIS = 1_000


def sized(vectors: int, settings: AnnSettings = AnnSettings()) -> AnnSettings:
    """Settings for so many vectors: ``last_axes`` the power of two below vectors / 1000 and ``probes`` growing by
    its square root, neither below the given ones."""
    last = max(settings.last_axes, 1 << max(0, (max(vectors, 1) // VECTORS_PER_AXIS).bit_length() - 1))
    return replace(settings, last_axes=last, probes=math.ceil(settings.probes * math.sqrt(last / settings.last_axes)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows (their length a power of two)."""
    rows, n = x.shape
    step = 1
    while step < n:
        y = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


class Rotations:
    """The pseudo-random rotations of all tables: signs drawn from the seed, one rotation for each hash of a table."""

    def __init__(self, dimension: int, s: AnnSettings):
        self.dimension, self.s = dimension, s
        self.size = 1 << max(0, (dimension - 1).bit_length())
        self.axes = [self.size]
        left = s.last_axes
        while left > 1 or len(self.axes) == 1:
            self.axes.append(min(left, self.size))
            left //= self.size
            if self.size == 1:
                break
        signs = np.random.default_rng(s.seed).integers(0, 2, (s.tables, len(self.axes), 3, self.size))
        self.signs = 2.0 * signs - 1
        self.buckets = math.prod(2 * n for n in self.axes)

    def rotated(self, unit: np.ndarray, table: int, which: int) -> np.ndarray:
        x = unit
        for signs in self.signs[table, which]:
            x = hadamard(x * signs)
        return x

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(vectors), self.size))
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of tiny or huge values stay finite
        padded[:, :self.dimension] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        return padded

    @staticmethod
    def _sides(x: np.ndarray) -> np.ndarray:
        """Products with the signed axes: column 2 a for -a, 2 a + 1 for +a."""
        return np.stack([-x, x], axis=2).reshape(len(x), -1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table, numbered over all tables."""
        unit, out = self.unit(vectors), np.empty((len(vectors), self.s.tables), dtype=np.int64)
        for t in range(self.s.tables):
            code = np.full(len(vectors), t, dtype=np.int64)
            for which, axes in enumerate(self.axes):
                code = code * 2 * axes + self._sides(self.rotated(unit, t, which)[:, :axes]).argmax(axis=1)
            out[:, t] = code
        return out

    def probe_codes(self, vectors: np.ndarray) -> np.ndarray:
        """The ``probes`` best buckets of each vector in each table: least loss against its own bucket. The best
        sums over some hashes extend to the best sums over one more, so no more than ``probes`` are held."""
        unit, out, n = self.unit(vectors), [], len(vectors)
        for t in range(self.s.tables):
            code, loss = np.full((n, 1), t, dtype=np.int64), np.zeros((n, 1))
            for which, axes in enumerate(self.axes):
                sides = self._sides(self.rotated(unit, t, which)[:, :axes])
                order = np.argsort(-sides, axis=1, kind="stable")[:, :self.s.probes]
                value = np.take_along_axis(sides, order, axis=1)
                code = (code[:, :, None] * 2 * axes + order[:, None, :]).reshape(n, -1)
                loss = (loss[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(n, -1)
                best = np.argsort(loss, axis=1, kind="stable")[:, :self.s.probes]
                code, loss = np.take_along_axis(code, best, axis=1), np.take_along_axis(loss, best, axis=1)
            out.append(code)
        return np.concatenate(out, axis=1)


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part; floats stay floats, so they cost half the shuffle."""
    kind = "array<float>" if df.select(F.col(vector)).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector")).filter(
        "id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension).astype(np.float64, copy=False)


#: sums of losses that a task holds at once.
PROBE_SUMS = 2_000_000


def _with_codes(rows: DataFrame, rotations: Rotations, probes: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vector"), rotations.dimension)
            # rows at once: a table of probes * probes sums is held for each
            step = max(1, PROBE_SUMS // rotations.s.probes ** 2) if probes else len(x)
            hashed = rotations.probe_codes if probes else rotations.codes
            codes = np.concatenate([hashed(x[i:i + step]) for i in range(0, len(x), step)])
            flat = pa.array(codes.reshape(-1), pa.int64())
            offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat)], names=["id", "vector", "codes"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("id", "vector").mapInArrow(run, f"id long, vector {kind}, codes array<long>")


def _rerank(entries: DataFrame, probes: DataFrame, dimension: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): in each (code, part, block) the block's queries meet the part's vectors."""
    rows = (probes.withColumn("role", F.lit(0)).unionByName(entries.withColumn("role", F.lit(1)))
            .repartition("code", "part", "block").sortWithinPartitions("code", "part", "block", "role", "id")
            .select("code", "part", "block", "role", "id", "vector"))

    def run(batches):
        best = BestLists(k)
        place, ids, block = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
            x, own = _matrix(b.column("vector"), dimension), b.column("id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                here, role = tuple(keys[start, :3]), keys[start, 3]
                if here != place:
                    place, ids, block = here, [], []
                if role == 0:
                    ids.append(own[start:end])
                    block.append(x[start:end])
                elif ids:
                    ids, block = [np.concatenate(ids)], [np.concatenate(block)]
                    best.add(ids[0], block[0], own[start:end], x[start:end])
            if len(best) > 20_000:  # queries held by this task
                yield best.flush()
        yield best.flush()

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


#: (query, vector) pairs whose vectors are gathered at once.
PAIRS = 100_000


def _needed(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) in the order of the ids, of equal vectors only those of the ``keep`` smallest ids: they
    tie for every query, so no other is among its nearest. A row that repeats id and vector goes."""
    odd = (2 * np.arange(vectors.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    digest = (np.ascontiguousarray(vectors).view(np.uint64) * odd).sum(axis=1)
    order = np.lexsort((ids, digest))
    again = np.concatenate([[False], digest[order[1:]] == digest[order[:-1]]])
    if again.any():
        at = np.flatnonzero(again)
        again[at] = (vectors[order[at]] == vectors[order[at - 1]]).all(axis=1)
        new_id = ~again | np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]])
        number = np.cumsum(new_id)
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        order = order[new_id & (number - number[first] < keep)]
    order = order[np.argsort(ids[order], kind="stable")]
    return ids[order], vectors[order]


class BestLists:
    """The k nearest vectors of each query so far, by (distance, id)."""

    def __init__(self, k: int):
        self.k, self.best, self.limit = k, {}, {}

    def __len__(self) -> int:
        return len(self.best)

    def add(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A block of queries meets a part of the vectors: products choose whom to measure (within their
        rounding, the k nearest of the part that can beat what is held); distances that count are taken
        on the differences."""
        if len(ids) > self.k:
            ids, vectors = _needed(ids, vectors, self.k + 1)  # one of them may be the query's own
        squares, own = (vectors ** 2).sum(axis=1), (queries ** 2).sum(axis=1)
        near = squares[None, :] + own[:, None] - 2 * (queries @ vectors.T)
        near[query_ids[:, None] == ids[None, :]] = np.inf
        asked = query_ids.tolist()
        limits = np.array([self.limit.get(q, np.finfo(float).max) for q in asked])
        if len(ids) > self.k:
            # the k places are for ids, not for rows: an id counts once, at its smallest distance
            firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            if len(firsts) > self.k:
                by_id = near if len(firsts) == len(ids) else np.minimum.reduceat(near, firsts, axis=1)
                limits = np.minimum(limits, np.partition(by_id, self.k - 1, axis=1)[:, self.k - 1])
        rows, at = np.nonzero(near <= (limits + 1e-9 * (squares.max() + own))[:, None])
        for start in range(0, len(rows), PAIRS):
            r, v = rows[start:start + PAIRS], at[start:start + PAIRS]
            score = np.sqrt(((vectors[v] - queries[r]) ** 2).sum(axis=1))
            self._hold([asked[i] for i in r.tolist()], ids[v].tolist(), score.tolist())

    def _hold(self, asked: list[int], ids: list[int], score: list[float]) -> None:
        touched = set()
        for q, v, d in zip(asked, ids, score):
            held = self.best.setdefault(q, {})
            if d < held.get(v, np.inf):
                held[v] = d
                touched.add(q)
        for q in touched:
            held = sorted(self.best[q].items(), key=lambda e: (e[1], e[0]))[:self.k]
            self.best[q] = dict(held)
            if len(held) == self.k:
                self.limit[q] = held[-1][1] ** 2

    def flush(self) -> pa.RecordBatch:
        rows = [(q, v, d) for q, held in self.best.items() for v, d in held.items()]
        self.best, self.limit = {}, {}
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    pairs = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _dealt(entries: DataFrame, probes: DataFrame, s: AnnSettings) -> tuple[DataFrame, DataFrame]:
    """Both sides (code, id, vector) with part and block: asked buckets alone, large ones in several pieces."""
    counts = probes.groupBy("code").agg(F.count("*").alias("queries")).join(
        entries.groupBy("code").agg(F.count("*").alias("vectors")), "code")
    plan = stored(counts.select("code", F.ceil(F.col("vectors") / s.part_vectors).cast("int").alias("parts"),
                                F.ceil(F.col("queries") / s.block_queries).cast("int").alias("blocks")), "buckets")
    if plan.count() <= s.broadcast_buckets:
        plan = F.broadcast(plan)
    part, block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    vectors = entries.join(plan, "code").select(
        "code", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vector")
    queries = probes.join(plan, "code").select(
        "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"), "id", "vector")
    return vectors, queries


def build_index(df: DataFrame, rotations: Rotations, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector, codes): every usable vector with its bucket in every table, written to the shared folder.
    Rows that agree in id and vector are one."""
    rows = usable_vectors(df, key, vector).filter(F.size("vector") == rotations.dimension).dropDuplicates(["id", "vector"])
    return stored(_with_codes(rows, rotations, probes=False), "index")


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, settings: AnnSettings | None = None,
                       key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row that ``is_query`` (a condition on
    the column ``id``) names, among all rows. Without ``settings`` they follow the number of vectors."""
    sizes = usable_vectors(df, key, vector).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, s = sizes["n"], settings or sized(sizes["count"])
    rotations = Rotations(dimension, s)
    index = build_index(df, rotations, key, vector)
    asked = index.filter(is_query).select("id", "vector")
    entries = index.select(F.explode("codes").alias("code"), "id", "vector")
    probes = _with_codes(asked, rotations, probes=True).select(F.explode("codes").alias("code"), "id", "vector")
    vectors, queries = _dealt(entries, probes, s)
    found = stored(_top(_rerank(vectors, queries, dimension, k), k), "found")
    # queries that found too few meet all vectors, as one bucket in parts and blocks
    enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stored(asked.join(enough, "id", "left_anti").select(F.lit(-1).alias("code"), "id", "vector"), "short")
    if not short.isEmpty():
        every = index.select(F.lit(-1).alias("code"), "id", "vector")
        vectors, queries = _dealt(every, short, s)
        more = _rerank(vectors, queries, dimension, k)
        found = _top(found.select("query_id", "vec_id", "score").unionByName(more), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_neighbours(vectors: dict[int, np.ndarray], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """Brute force on a small fixture, to measure recall against."""
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids.tolist()])
    out = {}
    for q in queries:
        d = np.sqrt(((matrix - vectors[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)).tolist() if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out
