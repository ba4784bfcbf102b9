"""Language-model scores against the interpolation formula, the automaton's own shape, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwork.llm import lm

SCHEMA = "doc_id BIGINT, text STRING"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain(rows, held, order, mass):
    """[(n_tokens, n_known, N, base, score)] from counts of all n-grams and the recursion as it is written."""
    counts = Counter()
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            seq = ["<", *tokens(text)]
            counts.update(tuple(seq[i : j + 1]) for j in range(len(seq)) for i in range(max(0, j - order + 1), j + 1))
    known = {g: c for g, c in counts.items() if len(g) == 1 and g != ("<",)}
    n = sum(known.values())

    def p(history, word):
        if not history:
            return (counts[(word,)] + 0.5) / (n + 0.5 * (len(known) + 1))
        return (counts[(*history, word)] + mass * p(history[1:], word)) / (counts[history] + mass)

    result = []
    for _, text in rows:
        seq = ["<", *tokens(text)]
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, j - order + 1) : j]), seq[j])) for j in range(1, len(seq)))
        result.append((len(seq) - 1, sum(counts[(w,)] > 0 for w in seq[1:]), n, base, score))
    return result


@pytest.fixture
def rows():
    rng = random.Random(11)
    words = ["the", "The", "cat", "Katze", "sat", "w" * 30, "w" * 31, "naïve", "\x00", "a\x00", "x", "y", "z"]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(120)]
    return made + [(500, None), (501, ""), (502, " \t\n"), (503, "never seen words at all"), (503, "the cat the cat"), (None, "cat sat"), (504, "the cat sat " * 900)]


@pytest.mark.parametrize(("order", "piece"), [(1, 4096), (2, 4096), (2, 7), (3, 4096), (4, 5)])
def test_equals_the_formula(spark, rows, order, piece):
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1 for i, _ in rows]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS block", "2 AS score", "'x' AS level")
    got = lm.score_texts(table, lm.remainder("doc_id", 5) == 1, order=order, mass=3.0, piece=piece, block=2000, shard=2000).collect()
    wanted = sorted((str(i), out, *w) for (i, _), out, w in zip(rows, held, plain(rows, held, order, 3.0), strict=True))
    for g, w in zip(sorted((str(r["doc_id"]), *r[1:]) for r in got), wanted, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_every_history_sums_to_one():
    texts = [b"a b c a b", b"a c", b"b b b a"]
    g = lm.grams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 3)
    counts = [np.bincount(at[at >= 0], minlength=len(f))[: len(o)] for at, f, o in zip(g.at, g.first, g.order, strict=True)]
    a = lm.build(g, counts, tokens=int(counts[0].sum()), known=len(g.words), texts=3, mass=2.0)
    unknown = 0.5 / (counts[0].sum() + 0.5 * (len(g.words) + 1))
    words = np.arange(len(g.words))
    for state in {0, *(a.arcs // a.width).tolist()}:  # what ends with the end goes nowhere
        one = lm.walk(a, words, words, words + 1, np.full(len(words), state), words)
        lost, at = 0.0, state
        while at:
            lost, at = lost + a.failure_weight[at], a.failure[at]
        assert (10**one).sum() + 10**lost * unknown == pytest.approx(1)


def test_no_rows_and_no_training_rows(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA), lm.F.lit(False)).count() == 0
    (got,) = lm.score_texts(spark.createDataFrame([(1, "a b")], SCHEMA), lm.F.lit(True)).collect()
    assert tuple(got) == (1, True, 3, 0, 0, 0.0, 0.0)


def test_numbers_survive_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm._unpack(lm._pack(keys)) == keys).all() and len(lm._unpack(lm._pack(keys[:0]))) == 0


def test_held_out_text_scores_better_than_by_single_words(spark):
    rng = random.Random(4)
    follows = {w: rng.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def text():
        out = [rng.choice("abcdefghijklmnop")]
        while len(out) < 60:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    got = lm.score_texts(spark.createDataFrame([(i, text()) for i in range(400)], SCHEMA), lm.remainder("doc_id", 5) == 1).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.6 * sum(r["base_score"] for r in got)
