"""SentencePiece merge-type (BPE) encoding and decoding.

Encoding is exact and needs no merge queue. Merging always takes the best-ranked adjacent pair
(leftmost on ties), so what happens inside two neighbouring tokens depends on nothing outside
them until some merge crosses a token border. A token sequence is therefore the encoding of a text
if and only if every two adjacent tokens, merged alone, come out as these two tokens. The encoder:

* runs an Aho-Corasick automaton over the segment for the longest piece starting at each position;
* walks from the left, taking the longest piece that is compatible with the token before it (the
  check re-merges the two and is cached), then the next shorter prefix piece, and so on;
* steps back when nothing fits. A prefix of the text has one valid encoding at most, so a position
  that failed once has failed for good: a bitfield keeps these positions.

Characters outside the vocabulary are tokens of their own and become UTF-8 byte pieces.

A text is cut at places that no piece crosses (in front of a run of word marks, around characters
that occur in no longer piece); each segment is encoded alone and short ones are cached per worker.

Defined results: null text counts as empty; an empty text encodes to the begin and end ids alone
and decodes to an empty text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE_SEGMENTS = 300_000
CACHE_SEGMENT_CHARS = 64
CACHE_PAIRS = 1_000_000


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model file; bounded by the vocabulary, so it can be shipped to workers."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: frozenset[int] = field(repr=False)
    byte_ids: tuple[int, ...] = field(repr=False)
    control: frozenset[int]
    bos: int
    eos: int
    unk: int

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        """Read a BPE model with byte fallback, identity normalisation and a dummy prefix."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        pieces = tuple(m.id_to_piece(i) for i in ids)
        byte_ids = {int(pieces[i][3:5], 16): i for i in ids if m.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        special = {i for i in ids if m.is_byte(i) or m.is_control(i) or m.is_unknown(i)}
        return cls(pieces, tuple(m.get_score(i) for i in ids), frozenset(set(ids) - special),
                   tuple(byte_ids[b] for b in range(256)), frozenset(i for i in ids if m.is_control(i)),
                   m.bos_id(), m.eos_id(), m.unk_id())


class PieceCodec:
    """Encoder and decoder of one :class:`PieceModel`."""

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model = model
        self.rank = {model.pieces[i]: -model.scores[i] for i in model.normal}
        self.ids = {model.pieces[i]: i for i in model.normal}
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.compatible: dict[str, dict[str, bool]] = defaultdict(dict)
        self.pairs = 0
        self.shorter: dict[str, str | None] = {}
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        if any(SPACE in p.strip(SPACE) or p.endswith(SPACE) and p.strip(SPACE) for p in self.rank):
            raise ValueError("a piece crosses a word mark")
        # characters that texts are rich in and that no longer piece holds: a cut on both sides is exact
        cuts = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        single = f"[{cuts}]|" if cuts else ""
        self.segments = re.compile(f"{single}{SPACE}*[^{SPACE}{cuts}]+|{SPACE}+").findall
        self.cache = _SegmentCache(self)
        self.text_of = [p.replace(SPACE, " ") for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            self.text_of[i] = chr(b)
        for i in model.control:
            self.text_of[i] = ""
        self.text_of[model.unk] = " ⁇ "
        self.is_high_byte = np.zeros(len(model.pieces), dtype=bool)
        self.is_high_byte[[model.byte_ids[b] for b in range(128, 256)]] = True
        self.byte_of = {i: b for b, i in enumerate(model.byte_ids)}

    # -- encoding ------------------------------------------------------------------------------

    def remerge(self, text: str) -> list[str]:
        """Plain merging of a short text: best rank first, leftmost on ties."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when merged together (``left`` may be empty)."""
        known = self.compatible[left].get(right)
        if known is None:
            known = self.remerge(left + right) == ([left, right] if left else [right])
            if self.pairs >= CACHE_PAIRS:
                self.compatible.clear()
                self.pairs = 0
            self.compatible[left][right] = known
            self.pairs += 1
        return known

    def next_shorter(self, token: str) -> str | None:
        """The longest piece, or single character, that is a proper prefix of the token."""
        if token not in self.shorter:
            prefixes = (token[:k] for k in range(len(token) - 1, 0, -1))
            self.shorter[token] = next((p for p in prefixes if p in self.rank or len(p) == 1), None)
        return self.shorter[token]

    def tokens(self, segment: str) -> list[str]:
        """Encoding of one segment as strings, by backtracking."""
        n = len(segment)
        longest = list(segment)  # the longest piece, or the character alone, that starts at each position
        for end, piece in self.automaton.iter(segment):
            longest[end - len(piece) + 1] = piece  # ends only rise, so the last match at a start stays
        shorter = self.shorter.get
        failed = bytearray((n >> 3) + 1)  # one bit for each position
        out: list[str] = []
        left, at, token = "", 0, longest[0] if n else None
        while at < n:
            known = self.compatible[left].get
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = known(token)
                    if self.fits(left, token) if ok is None else ok:
                        break
                token = shorter(token) or self.next_shorter(token)
            if token is not None:
                out.append(token)
                left, at = token, end
                token = longest[at] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()  # position 0 always has an encoding
                left, at = out[-1] if out else "", at - len(token)
                token = self.next_shorter(token)
        return out

    def segment_ids(self, segment: str) -> list[int]:
        ids, out = self.ids.get, []
        for token in self.tokens(segment):
            i = ids(token)
            if i is not None:
                out.append(i)
            else:
                out += [self.model.byte_ids[b] for b in token.encode("utf-8")]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids with begin and end, little-endian unsigned 32-bit."""
        body = b"".join(map(self.cache.__getitem__, self.segments(SPACE + text.replace(" ", SPACE)))) if text else b""
        ids = np.empty(len(body) // 4 + 2, dtype="<u4")
        ids[0], ids[-1] = self.model.bos, self.model.eos
        ids[1:-1] = np.frombuffer(body, dtype="<u4")
        return ids

    # -- decoding ------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: control pieces vanish, byte pieces join to UTF-8 (U+FFFD for each byte that
        does not), word marks become spaces and the dummy prefix goes."""
        listed = ids.tolist()
        if self.is_high_byte[ids].any():
            parts, run = [], bytearray()
            for i in listed:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_from_bytes(run))
                    run = bytearray()
                parts.append(self.text_of[i])
            parts.append(_from_bytes(run))
            text = "".join(parts)
        else:
            text = "".join(map(self.text_of.__getitem__, listed))
        first = next((i for i in listed if i not in self.model.control), None)
        return text[1:] if first is not None and self.model.pieces[first].startswith(SPACE) else text


class _SegmentCache(dict):
    """segment -> its ids as bytes; long segments are not kept, a full cache is emptied."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, segment: str) -> bytes:
        ids = self.codec.segment_ids(segment)
        data = struct.pack(f"<{len(ids)}I", *ids)
        if len(segment) <= CACHE_SEGMENT_CHARS:
            if len(self) >= CACHE_SEGMENTS:
                self.clear()
            self[segment] = data
        return data


def _from_bytes(run: bytearray) -> str:
    out, i = [], 0
    while i < len(run):
        b = run[i]
        size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        try:
            out.append(bytes(run[i:i + size]).decode("utf-8"))
            i += size
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


_CODECS: dict[PieceModel, PieceCodec] = {}


def _codec(broadcast) -> PieceCodec:
    """One codec for each worker process and model."""
    model = broadcast.value
    key = id(model)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def encode_texts(df: DataFrame, model: PieceModel, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add ``ids`` (array of int: begin, tokens, end) to every row; whole texts, narrow, no shuffle."""
    model_b = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        codec = _codec(model_b)
        return texts.map(lambda t: codec.encode(t or "").astype(np.int32))

    return df.withColumn(ids, encode(F.col(text)))


def decode_ids(df: DataFrame, model: PieceModel, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the decoded text of an id array to every row (null array: null)."""
    model_b = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def decode(arrays: pd.Series) -> pd.Series:
        codec = _codec(model_b)
        return arrays.map(lambda a: None if a is None else codec.decode(np.asarray(a, dtype=np.int64)))

    return df.withColumn(text, decode(F.col(ids)))


def codec_digests(df: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass without shipping the ids back: ``key``, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (UTF-8 of the decoded text)."""
    import hashlib

    model_b = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    key_type = src.schema[key].dataType.simpleString()

    def run(batches):
        codec = _codec(model_b)
        for b in batches:
            counts, id_digests, text_digests = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py() or "")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(text_digests, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"{key} {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
