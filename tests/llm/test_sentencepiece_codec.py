import hashlib
import random

import numpy as np
import pytest

from llm_fixtures import documents, with_clashes
from piisieve.llm.queries import piece_model_path
from piisieve.llm.sentencepiece_codec import PieceCodec, PieceModel, codec_digests, decode_ids, encode_texts


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PieceModel.load(piece_model_path()))


def texts():
    rng = random.Random(5)
    out = ["", " ", "  a", "a\n\tb  c ", "▁x", "\x00a", "é\u2028日本𝒳", "<s>hi</s>", "<0x41>", "a" * 3000, "�", "▁▁▁ ▁a▁ b▁▁",
           " " * 300, "ab" * 500, "日本語" * 300, "\r\n\t ", "　 x", "👩‍👩‍👧"]
    alphabet = " ▁aeinorst\n\t.,é日1<>|"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
                    for _ in range(rng.randint(1, 20))) for _ in range(500)]
    return out


def test_encodes_as_the_library(library, codec):
    for t in texts():
        want = library.encode(t, add_bos=True, add_eos=True)
        got = codec.encode(t)
        assert got.tolist() == want
        assert codec.decode(got) == library.decode(want)


def test_joined_pieces(library, codec):
    rng = random.Random(6)
    for _ in range(1000):
        t = "".join(rng.choice(codec.model.pieces[300:]) for _ in range(rng.randint(1, 12)))
        assert codec.encode(t).tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_decodes_any_ids_as_the_library(library, codec):
    rng = random.Random(7)
    for _ in range(1500):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(np.array(ids, dtype=np.int64)) == library.decode(ids)


def test_digests_of_odd_documents(spark, library):
    model = PieceModel.load(piece_model_path())
    df = with_clashes(documents(spark))
    got = sorted(map(tuple, codec_digests(df, model).collect()), key=str)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert codec_digests(df.limit(0), model).collect() == []


def test_columns_of_ids(spark, library):
    model = PieceModel.load(piece_model_path())
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in decode_ids(encode_texts(df, model), model).collect()}
    assert list(rows[1].token_ids) == library.encode("hello world", add_bos=True, add_eos=True)
    assert (rows[1].decoded, rows[2].decoded, list(rows[3].token_ids)) == ("hello world", "", [1, 2])
