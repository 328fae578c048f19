"""Removal of passages that repeat across documents, by level-wise doubling.

A window of ``2L`` words can only repeat if its windows of ``L`` words do, so each level hashes the
windows that survived the level before, extended to (at most) twice their length, and keeps those
found in two documents. Levels run 7 -> 13 words for the 13-word rule, which alone decides what is removed, and
go on by doubling (26, 52, ...) until no candidates survive when the longest repeats are asked for. Levels
beyond 13 words read only passages: the stretches of words whose windows both of a doubled window's halves
come from.

The first level is sparse without losing any window: every 13-word window holds seven 7-word windows
and is represented by the one with the smallest hash, so equal long windows share it (winnowing).
About a quarter of the positions are shuffled, and only documents with a shared one go on.

Texts with equal word sequences are one text from the start: all but the smallest doc_id lose every
word that a window covers, which is all of them from 13 words on.

Texts are hashed with numpy over many documents at a time; windows are compared by Spark's window functions over their
hashes. Before each shuffle by window a batch settles what it can: one document stands for a window that several
documents of the batch hold, and the rows of the others are dealt evenly, so a window in a third of all
documents is no hot key.

Defined results: null or word-less text has no words; rows with a null doc_id lose nothing and make
others lose nothing; rows that share a doc_id do not repeat each other; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .words import as_signed, hashed_words, mix64, run_hashes, window_hashes


#: Rows whose part in the result is settled before the shuffle by window.
UNKNOWN, REPEATED, KNOWN = 0, 1, 2
#: Bytes of text that are hashed at a time: their arrays stay in the processor's cache.
CHUNK_BYTES = 1 << 20


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"))


def _digest(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _word_sequences(src: DataFrame) -> DataFrame:
    """(doc_id, n_words, t1, t2, whole_sha256): size, digest and sha256 of each text's word sequence."""
    def run(batches):
        for b in batches:
            n, t1, t2, sha = [], [], [], []
            for value in b.column(1):
                words = (value.as_py() or b"").split()
                x, y = _digest(words)
                n.append(len(words))
                t1.append(x)
                t2.append(y)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(sha)],
                names=["doc_id", "n_words", "t1", "t2", "whole_sha256"])

    return src.mapInArrow(run, "doc_id long, n_words long, t1 long, t2 long, whole_sha256 string")


def window_minima(h: np.ndarray, size: int, part: int) -> np.ndarray:
    """For each window of ``size`` words the smallest hash of its windows of ``part`` words."""
    small = window_hashes(h, part)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, length = small, 1
    while length < size - part + 1:
        step = min(length, size - part + 1 - length)
        out, length = np.minimum(out[:len(out) - step], out[step:]), length + step
    return out


class _Words:
    """The words of several texts in one row, so that each step on hashes is one over all of them."""

    def __init__(self, texts: list[bytes]):
        self.sizes, self.first, self.second = hashed_words(texts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.count = len(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)  # whose word it is

    def fit(self, size: int) -> np.ndarray:
        """Whether a window of ``size`` words that starts at a word ends in its text; as long as the windows are many."""
        n = max(0, self.count - size + 1)
        return (self.starts + self.sizes)[self.text[:n]] - np.arange(n) >= size

    def minima(self, size: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(smallest hashes, texts, lengths) of the stretches of windows that one short window represents; the windows
        beyond a text's end are in stretches of text -1."""
        small = window_minima(self.first, size, part)
        text = np.where(self.fit(size), self.text[:len(small)], -1)
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(small)), dtype=bool), (small[1:] != small[:-1]) | (text[1:] != text[:-1])]))
        return small[at], text[at], np.diff(np.append(at, len(small)))

    def keys(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows of ``size`` words that start at ``at``."""
        return as_signed(run_hashes(self.first, size)[at]), as_signed(run_hashes(self.second, size)[at])


def _chunks(rows):
    """Lists of rows, whose last field is a text, of about CHUNK_BYTES bytes of text."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= CHUNK_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _shared_parts(src: DataFrame, size: int, part: int) -> DataFrame:
    """(t1, parts): of every text, the representing short windows that another text has too.

    Texts that share one within a batch are told apart there: one of them stands for it in the shuffle by
    window, the others (``known``) are dealt by text, so a window in very many texts is no hot key.
    """
    def emit(batches):
        for b in batches:
            hashes, texts = [], []
            rows = ((doc.as_py(), value.as_py() or b"") for doc, value in zip(b.column(0), b.column(1)))
            for chunk in _chunks(row for row in rows if row[0] is not None):
                found, text, _ = _Words([data for _, data in chunk]).minima(size, part)
                hashes.append(as_signed(found[text >= 0]))
                texts.append(np.array([_digest(data.split())[0] for _, data in chunk], dtype=np.int64)[text[text >= 0]])
            if any(map(len, hashes)):
                p, t = np.concatenate(hashes), np.concatenate(texts)
                order, group = _grouped(p)
                met = _members(group)  # windows found once need no order of their texts
                order[met] = order[met][np.lexsort((t[order[met]], group[met]))]
                p, t = p[order], t[order]
                fresh = np.concatenate([[True], (p[1:] != p[:-1]) | (t[1:] != t[:-1])])
                p, t = p[fresh], t[fresh]
                same = (p[1:] == p[:-1])  # the row before has the window in another text
                state = np.zeros(len(p), dtype=np.int8)
                state[:-1][same] = 1
                state[1:][same] = 2
                rows = pa.RecordBatch.from_arrays([pa.array(p), pa.array(t), pa.array(state)], names=["part", "t1", "state"])
                for at in range(0, rows.num_rows, 100_000):
                    yield rows.slice(at, 100_000)

    rows = src.mapInArrow(emit, "part long, t1 long, state byte")
    alike = Window.partitionBy(F.when(F.col("state") == KNOWN, F.xxhash64("t1")).otherwise(F.col("part")))
    found = rows.select("t1", "part", "state", F.min("t1").over(alike).alias("low"), F.max("t1").over(alike).alias("high")).filter("low < high OR state > 0")
    return found.groupBy("t1").agg(F.collect_set("part").alias("parts"))


def _windows(texts: DataFrame, size: int, part: int) -> DataFrame:
    """(k1, k2, doc_id, t1, pos) of the windows whose representing short window is shared."""
    def run(batches):
        for b in batches:
            out = []
            rows = zip(b.column("doc_id").to_pylist(), b.column("t1").to_pylist(), _lists(b.column("parts")),
                       b.column("data").to_pylist())
            for chunk in _chunks(row for row in rows if _digest(row[3].split())[0] == row[1]):  # else another row with this doc_id
                docs, t1s, parts, texts = zip(*chunk)
                words = _Words(texts)
                found, text, lengths = words.minima(size, part)
                # a text's number is mixed in; what that confuses is one candidate more
                salt = mix64(np.arange(1, len(texts) + 1, dtype=np.uint64))
                wanted = np.concatenate(parts).view(np.uint64) ^ np.repeat(salt, [len(x) for x in parts])
                shared = (text >= 0) & np.isin(found ^ salt[text], wanted)
                out.append(_keys(words, np.flatnonzero(np.repeat(shared, lengths)), size, docs, t1s))
            yield from _key_batches(out)

    return texts.mapInArrow(run, "k1 long, k2 long, doc_id long, t1 long, pos long, state byte")


def _keys(words: _Words, at: np.ndarray, size: int, docs, t1s, shift=0):
    """Columns of the windows that start at the words ``at``; places count from ``shift`` on in each text."""
    text = words.text[at]
    pos = at - (words.starts - shift)[text]
    return *words.keys(at, size), np.array(docs, dtype=np.int64)[text], np.array(t1s, dtype=np.int64)[text], pos


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): where the sorted values stand, and the number of each one's group of equals."""
    order = np.argsort(values)
    v = values[order]
    return order, np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))


def _members(group: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, of groups that stand one after another."""
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))


def _key_batches(out):
    """Rows with a state: within the batch a window's first document stands for it (REPEATED if others have
    it), rows of later documents are KNOWN to repeat a smaller one and need no shuffle by window."""
    if not out:
        return
    k1, k2, doc, t1, pos = (np.concatenate(c) for c in zip(*out))
    if not len(k1):
        return
    order, group = _grouped(k1)
    met = _members(group)  # windows found once need no order of their documents
    order[met] = order[met][np.lexsort((doc[order[met]], k2[order[met]], group[met]))]
    k1, k2, doc, t1, pos = (x[order] for x in (k1, k2, doc, t1, pos))
    start = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    group = np.cumsum(start) - 1
    first = doc[np.flatnonzero(start)]
    later = doc != first[group]
    shared = np.zeros(len(first), dtype=bool)
    shared[group[later]] = True
    state = np.where(later, KNOWN, np.where(shared[group], REPEATED, UNKNOWN)).astype(np.int8)
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in (k1, k2, doc, t1, pos, state)],
                                      names=["k1", "k2", "doc_id", "t1", "pos", "state"])
    for at in range(0, rows.num_rows, 100_000):
        yield rows.slice(at, 100_000)


def _repeated(windows: DataFrame) -> DataFrame:
    """(doc_id, t1, pos, later) of the windows found in two documents or more; later: also in a smaller one."""
    known = F.col("state") == KNOWN
    alike = Window.partitionBy(F.when(known, F.xxhash64("doc_id", "pos")).otherwise(F.col("k1")), "k2")
    rows = windows.select("doc_id", "t1", "pos", known.alias("known"), F.min("doc_id").over(alike).alias("first"), F.max("doc_id").over(alike).alias("last"),
                          F.max("state").over(alike).alias("state"))
    return rows.filter("first < last OR state > 0").select("doc_id", "t1", "pos", (F.col("known") | (F.col("doc_id") > F.col("first"))).alias("later"))


def _lists(column) -> list[np.ndarray]:
    """The arrays of a list column; a null is an empty one."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


_PASSAGES = "passages array<struct<start:long,data:binary,at:array<int>>>"
_PASSAGE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("data", pa.binary()), ("at", pa.list_(pa.int32()))]))


def _passages(words: list[bytes], starts: np.ndarray, size: int, offset: int = 0) -> list[dict]:
    """Stretches of words covered by windows of ``2 * size`` words both of whose halves start in ``starts``, with
    those windows' places in them."""
    starts = np.unique(starts)
    at = starts[np.isin(starts + size, starts, assume_unique=True)]
    if not len(at):
        return []
    cuts = np.flatnonzero(at[1:] > at[:-1] + 2 * size) + 1
    return [{"start": int(run[0]) + offset, "data": b" ".join(words[run[0]:run[-1] + 2 * size]), "at": (run - run[0]).astype(np.int32)}
            for run in np.split(at, cuts)]


def _doubled(passages: DataFrame, size: int) -> DataFrame:
    """Keys of the passages' windows of ``size`` words, whose halves repeat."""
    def run(batches):
        for b in batches:
            out = []
            rows = zip(*(b.column(c).to_pylist() for c in ("doc_id", "t1", "start")), _lists(b.column("at")), b.column("data").to_pylist())
            for chunk in _chunks(rows):
                docs, t1s, firsts, places, texts = zip(*chunk)
                words = _Words(texts)
                at = np.concatenate(places) + np.repeat(words.starts, [len(x) for x in places])
                out.append(_keys(words, at, size, docs, t1s, np.array(firsts, dtype=np.int64)))
            yield from _key_batches(out)

    return passages.mapInArrow(run, "k1 long, k2 long, doc_id long, t1 long, pos long, state byte")


def _surviving(passages: DataFrame, repeated: DataFrame, size: int, with_places: bool) -> DataFrame:
    """(doc_id, t1, passages, places) of the passages in which windows of ``size`` words repeat, cut down to the
    passages of the next level."""
    def run(batches):
        for b in batches:
            out = []
            for doc, t1, first, data, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t1", "start", "data")), _lists(b.column("starts"))):
                words = data.split()
                starts = starts - first
                starts = starts[(starts >= 0) & (starts + size <= len(words))]
                if len(starts):
                    out.append((doc, t1, _passages(words, starts, size, first), starts + first if with_places else None))
            columns = list(zip(*out)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), _PASSAGE_TYPE, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "t1", "passages", "places"])

    starts = repeated.groupBy("doc_id", "t1").agg(F.collect_list("pos").alias("starts"))
    return passages.join(starts, ["doc_id", "t1"]).select("doc_id", "t1", "start", "data", "starts").mapInArrow(
        run, f"doc_id long, t1 long, {_PASSAGES}, places array<long>")


def _levels(level: DataFrame, size: int, with_places: bool = False):
    """Stored levels (size, doc_id, t1, passages, places) from ``size`` on by doubling, until no candidates survive."""
    while not level.isEmpty():
        yield size, level
        passages, size = level.select("doc_id", "t1", F.inline("passages")), 2 * size
        level = stored(_surviving(passages, _repeated(_doubled(passages, size)), size, with_places), "level", release=True)


def _prepare(docs: DataFrame, size: int, key: str, text: str):
    """(sequences, representatives, texts with shared parts)."""
    src = _source(docs, key, text)
    part = (size + 1) // 2
    sequences = stored(_word_sequences(src), "sequences", release=True)
    first = sequences.filter((F.col("n_words") >= size) & F.col("doc_id").isNotNull()).groupBy("t1", "t2").agg(
        F.min("doc_id").alias("first_copy"))
    first = stored(first, "first_copies", release=True)
    parts = _shared_parts(src, size, part)
    wanted = first.join(parts, "t1").select(F.col("first_copy").alias("doc_id"), "t1", "parts")
    texts = stored(src.join(wanted, "doc_id"), "shared_texts", release=True)
    return sequences, first, texts, part


def _cuts(texts: DataFrame, level: DataFrame, size: int, with_text: bool = False, with_passages: bool = False,
          with_places: bool = False) -> DataFrame:
    """One row per text with a repeated window (``with_passages``) or with words that go: what goes, what is kept,
    and the passages for the next level."""
    def cut(batches):
        for b in batches:
            out = []
            for doc, data, t1, at, every in zip(*(b.column(c).to_pylist() for c in ("doc_id", "data", "t1")), _lists(b.column("starts")), _lists(b.column("every"))):
                words = data.split()
                if _digest(words)[0] != t1:  # another row with this doc_id
                    continue
                removed, sha, text = 0, None, None
                if len(at):
                    covered = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + size, -1)
                    gone = np.cumsum(covered)[:-1] > 0
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    removed, sha, text = int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept
                out.append((doc, t1, removed, sha, text.decode("utf-8") if with_text and text is not None else None,
                            _passages(words, every, size) if with_passages else None, every if with_places else None))
            columns = list(zip(*out)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["doc_id", "t1", "removed", "sha", "kept_text", "passages", "places"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _PASSAGE_TYPE, pa.list_(pa.int64())]
    every = F.collect_list("pos") if with_passages else F.lit(None).cast("array<long>")
    starts = (level if with_passages else level.filter("later")).groupBy("doc_id", "t1").agg(
        F.collect_list(F.when(F.col("later"), F.col("pos"))).alias("starts"), every.alias("every"))
    rows = texts.join(starts, ["doc_id", "t1"]).select("doc_id", "data", "t1", "starts", "every").mapInArrow(
        cut, f"doc_id long, t1 long, removed long, sha string, kept_text string, {_PASSAGES}, places array<long>")
    return rows.dropDuplicates(["doc_id", "t1"])  # rows repeated in id and text


def longest_repeats(docs: DataFrame, window_words: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, length): where a passage that another document holds starts, and the greatest length
    (window_words doubled any number of times) at which the window there repeats. Levels run until no
    candidates survive. Further copies of an equal word sequence are not listed."""
    _, _, texts, part = _prepare(docs, window_words, key, text)
    level = _repeated(_windows(texts, window_words, part))
    cuts = stored(_cuts(texts, level, window_words, with_passages=True, with_places=True), "cuts", release=True)
    every = texts.sparkSession.createDataFrame([], "doc_id long, pos long, length int")
    for size, rows in _levels(cuts, window_words, True):
        every = every.unionByName(rows.select("doc_id", F.explode("places").alias("pos"), F.lit(size).alias("length")))
    return every.groupBy("doc_id", "pos").agg(F.max("length").alias("length"))


def remove_repeats(docs: DataFrame, window_words: int = 13, key: str = "doc_id", text: str = "text",
                   with_text: bool = False, longest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and
    with ``with_text`` that kept text. A word goes if a window over it also starts in a document with a
    smaller doc_id; longer windows cannot change that. ``longest`` runs the doubling to its end and adds
    longest_repeat: the greatest length (window_words doubled any number of times) at which a window of
    the text is found in a document with another word sequence, 0 if there is none. Word sequences are judged by the
    first documents that hold them, and their copies take over the number; rows without a doc_id have 0."""
    sequences, first, texts, part = _prepare(docs, window_words, key, text)
    level = _repeated(_windows(texts, window_words, part))
    cuts = _cuts(texts, level, window_words, with_text, longest)
    copies = sequences.join(first, ["t1", "t2"], "left")
    copy = F.col("doc_id") > F.col("first_copy")
    nothing = hashlib.sha256(b"").hexdigest()
    if longest:
        cuts = stored(cuts, "cuts", release=True)
        sizes = None
        for size, rows in _levels(cuts, window_words):
            found = rows.select(F.col("doc_id").alias("first_copy"), "t1").distinct().withColumn("longest_repeat", F.lit(size).cast("long"))
            sizes = found if sizes is None else sizes.unionByName(found)
        if sizes is None:
            copies = copies.withColumn("longest_repeat", F.lit(0).cast("long"))
        else:
            sizes = sizes.groupBy("first_copy", "t1").agg(F.max("longest_repeat").alias("longest_repeat"))
            copies = copies.join(sizes, ["first_copy", "t1"], "left").withColumn(
                "longest_repeat", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("longest_repeat", F.lit(0))).cast("long"))
    extra = ["longest_repeat"] if longest else []
    out = copies.join(cuts.select("doc_id", "t1", "removed", "sha", "kept_text"), ["doc_id", "t1"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
        *extra, F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out if with_text else out.drop("kept_text")
