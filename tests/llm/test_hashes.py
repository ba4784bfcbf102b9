"""Hashes of spans and words tell strings apart that a modulus of 2^64 does not."""

import numpy as np
import pytest

from tarnwork.llm import pieces
from tarnwork.llm.common import SpanHash
from tarnwork.llm.minhash import near_duplicates
from tarnwork.llm.words import hashes


def thue_morse(n, a=b"a", b=b"b"):
    return b"".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [128, 1024, 2048, 4096])
def test_span_hashes(n):
    one, two = thue_morse(n), thue_morse(n, b"b", b"a")
    data = np.frombuffer(one + two + one, np.uint8)
    for seed in (0, 1):
        h = SpanHash(data, seed).of(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] == h[2] != h[1]
    assert len(set(hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])).tolist())) == 2


def test_grams_are_hashes_of_their_bytes():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    grams = SpanHash(data).grams(3)
    text = data.tobytes()
    byte = {}
    for i, g in enumerate(grams.tolist()):
        assert byte.setdefault(text[i : i + 3], g) == g
    assert len(set(byte.values())) == len(byte)
    assert len(SpanHash(data[:2]).grams(3)) == 0


def test_near_duplicates_keep_both(spark):
    texts = [f"one two three four {thue_morse(2048, *x).decode()}" for x in ((b"a", b"b"), (b"b", b"a"))]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)


def test_pieces_are_those_of_each_text():
    spm = pytest.importorskip("sentencepiece")
    texts = [thue_morse(1024, *x) for x in ((b"a", b"b"), (b"b", b"a"))]
    model = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = pieces.Encoder(pieces.Vocabulary.load()).encode(texts)
    assert [i.tolist() for i in ids] == [model.encode(t.decode()) for t in texts]
