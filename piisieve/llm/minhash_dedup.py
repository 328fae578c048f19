"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set holds the hashes of its distinct 5-word shingles (words lower-cased A-Z; a shorter
text is one shingle). Two documents are linked when 100 * |intersection| >= 75 * |union|.

1. *Signatures.* One hash per shingle; its high bits choose one of ``bands * rows`` bins, each bin
   keeps its minimum, and an empty bin borrows from the first filled bin of its own probe sequence
   (optimal densification). ``rows`` bins make one band key.
2. *Equal sets* collapse to their smallest doc_id, so exact copies cost one row from here on.
3. *Stars.* Documents that share a band key form a bucket; each is tied to the bucket's smallest
   doc_id: n - 1 candidate edges for n members. Edges are confirmed on full sets.
4. *The rest, exactly.* A star does not test two members that both miss the centre. In every bucket
   whose other members are still in more than one component, the members outside the bucket's
   largest component are compared, in blocks of bounded size, with all members: an inverted index
   over a block's full sets counts what a member has in common with each of them. Only links leave
   a block, one for each document and component. No bucket is capped, skipped or emitted as pairs.
5. *Components* over confirmed links (large-star / small-star).

A linked pair that shares no bucket is lost: (1 - 0.75^4)^32 = 5e-6 at the limit, less above it.

Defined results: null or word-less text has an empty set, links with nothing and is kept; rows with
a null doc_id link with nothing (component null, kept); rows that share a doc_id are one document
with several texts; ties do not occur, the smallest id wins; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import stored
from .words import as_signed, mix64, window_hashes, word_hashes


@dataclass(frozen=True)
class NearDupSettings:
    shingle_words: int = 5
    similarity_pct: int = 75
    bands: int = 32
    rows: int = 4
    members_per_task: int = 512
    outlier_block: int = 512
    member_block: int = 2048


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text (``bytes.lower`` lowers A-Z alone)."""
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(size, len(h))))


def bin_minima(shingles: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled) of one-permutation hashing: the smallest hash that falls into each bin."""
    values, filled = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # sorted: bins rise, minima come first
    at = place[first].astype(np.int64)
    values[at], filled[at] = shingles[first], True
    return values, filled


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Each empty bin takes the value of the first filled bin in its own pseudo-random probe sequence."""
    bins, values = len(values), values.copy()
    empty = np.flatnonzero(~filled)
    attempt = 0
    while len(empty):
        attempt += 1
        seed = np.uint64((attempt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        probe = (mix64(empty.astype(np.uint64) + seed) % np.uint64(bins)).astype(np.int64)
        hit = filled[probe]
        values[empty[hit]] = values[probe[hit]]
        empty = empty[~hit]
    return values


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values, filled = bin_minima(shingles, bands * rows)
    if filled.sum() == 1:
        values[:] = values[filled][0]
    elif not filled.all():
        values = densify(values, filled)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in values.reshape(bands, rows).T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def signatures(docs: DataFrame, s: NearDupSettings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands): set size, 128-bit digest of the set, band keys (null if empty)."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"))

    def run(batches):
        for b in batches:
            sizes, d1, d2, keys = [], [], [], []
            for value in b.column(1):
                x = shingle_set(value.as_py(), s.shingle_words)
                digest = xxhash.xxh3_128_digest(x) if len(x) else bytes(16)
                sizes.append(len(x))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(as_signed(band_keys(x, s.bands, s.rows)) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return src.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, s: NearDupSettings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Pairs are grouped around ``a`` and dealt in parts of about ``members_per_task`` partners, so a
    centre with many partners is spread over tasks. A task streams its sorted rows and holds one
    set at a time besides the centre's.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(degree, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / s.members_per_task)).alias("part"))
    wanted = (dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("doc_id"))
              .unionByName(dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct()))
    rows = (wanted.join(texts, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "role", "doc_id")
            .select("a", "part", "role", "doc_id", "data"))

    def run(batches):
        group, centres = None, []
        for b in batches:
            left, right = [], []
            for a, part, role, doc, data in zip(*(c.to_pylist() for c in b.columns)):
                if group != (a, part):
                    group, centres = (a, part), []
                x = shingle_set(data, s.shingle_words)
                if role == 0:
                    centres.append(x)
                    continue
                for c in centres:
                    both = len(np.intersect1d(c, x, assume_unique=True))
                    if 100 * both >= s.similarity_pct * (len(c) + len(x) - both):
                        left.append(a)
                        right.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _sets(texts: DataFrame, s: NearDupSettings) -> DataFrame:
    """(doc_id, hashes): the sorted shingle hashes of each text as packed 64-bit integers."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([shingle_set(v, s.shingle_words).tobytes() for v in b.column("data").to_pylist()],
                                              pa.binary())], names=["doc_id", "hashes"])

    return texts.select("doc_id", "data").mapInArrow(run, "doc_id long, hashes binary")


class OutlierBlock:
    """An inverted index over the sets of a block of documents: one lookup of a set counts what it has in
    common with each of them."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.docs = np.array([r[0] for r in rows], dtype=np.int64)
        self.components = np.array([r[1] for r in rows], dtype=np.int64)
        self.sizes = np.array([len(r[2]) for r in rows], dtype=np.int64)
        hashes = np.concatenate([r[2] for r in rows])
        owners = np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.linked: set[tuple[int, int]] = set()

    def common(self, x: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.hashes, x, "left")
        counts = np.searchsorted(self.hashes, x, "right") - low
        low, counts = low[counts > 0], counts[counts > 0]
        at = np.arange(counts.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return np.bincount(self.owners[at], minlength=len(self.docs))

    def links(self, doc: int, component: int, x: np.ndarray, outlier: bool, similarity_pct: int) -> list[int]:
        """Documents of the block that are similar enough to the member, one link for each document and
        component of partners: further ones cannot change any class."""
        both = self.common(x)
        near = (100 * both >= similarity_pct * (self.sizes + len(x) - both)) & (self.components != component)
        if outlier:
            near &= self.docs < doc  # two outliers meet twice
        new = [i for i in np.flatnonzero(near).tolist() if (i, component) not in self.linked]
        self.linked.update((i, component) for i in new)
        return self.docs[new].tolist()


def untested_links(members: DataFrame, labels: DataFrame, texts: DataFrame, s: NearDupSettings) -> DataFrame:
    """Links (a, b) between documents that share a bucket, are in different components and were not tested
    by its star, decided on full sets inside the blocks."""
    rest = (members.filter("doc_id <> centre").join(labels, F.col("doc_id") == F.col("node"), "left")
            .select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    counts = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = (counts.groupBy("key").agg(F.sum("n").alias("members"), F.count("*").alias("parts"), F.max("n").alias("most"),
                                       F.max_by("component", F.struct("n", "component")).alias("main"))
             .filter("parts > 1")
             .select("key", "main", F.ceil((F.col("members") - F.col("most")) / s.outlier_block).alias("o_blocks"),
                     F.ceil(F.col("members") / s.member_block).alias("m_blocks")))
    rows = stored(rest.join(mixed, "key").withColumn("outlier", F.col("component") != F.col("main")).drop("main"), "mixed")
    o_block, m_block = F.pmod(F.xxhash64("doc_id"), "o_blocks"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "m_blocks")
    outliers = rows.filter("outlier").select(
        "key", o_block.alias("ob"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_blocks") - 1)).alias("mb"),
        F.lit(0).alias("role"), "doc_id", "component", "outlier")
    all_members = rows.select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_blocks") - 1)).alias("ob"), m_block.alias("mb"),
        F.lit(1).alias("role"), "doc_id", "component", "outlier")
    sets = stored(_sets(texts.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), s), "sets")
    dealt = (outliers.unionByName(all_members).join(sets, "doc_id").repartition("key", "ob", "mb")
             .sortWithinPartitions("key", "ob", "mb", "role", "doc_id")
             .select("key", "ob", "mb", "role", "doc_id", "component", "outlier", "hashes"))

    def run(batches):
        group, held, block = None, [], None
        for b in batches:
            left, right = [], []
            for key, ob, mb, role, doc, component, outlier, hashes in zip(*(c.to_pylist() for c in b.columns)):
                if group != (key, ob, mb):
                    group, held, block = (key, ob, mb), [], None
                x = np.frombuffer(hashes, dtype=np.uint64)
                if role == 0:
                    held.append((doc, component, x))
                    continue
                if held:
                    block, held = OutlierBlock(held), []
                if block is not None:
                    found = block.links(doc, component, x, outlier, s.similarity_pct)
                    left += found
                    right += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, settings: NearDupSettings = NearDupSettings(), key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    s = settings
    sigs = stored(signatures(docs, s, key, text), "signatures")
    filled = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = stored(filled.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
                    .select("d1", "d2", "r.doc_id", "r.bands"), "representatives")
    in_bands = groups.select("doc_id", F.explode("bands").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = stored(in_bands.join(buckets.drop("n"), "key"), "members")
    edges = members.filter("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    texts = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"))
                   .join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    links = stored(confirm(edges, texts, s), "links")
    labels = stored(connected_components(links, "a", "b"), "labels")
    more = stored(untested_links(members, labels, texts, s), "links")
    labels = connected_components(links.unionByName(more), "a", "b")
    classes = stored(groups.select("d1", "d2", "doc_id").join(labels, F.col("doc_id") == F.col("node"), "left")
                     .select("d1", "d2", F.coalesce("component", "doc_id").alias("component")), "classes")
    return (sigs.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.col("d1")).alias("d1"), "d2")
            .join(classes, ["d1", "d2"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
