"""Source divergence against the plain sums over all terms, and its edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarnwork.llm import divergence as d
from tarnwork.llm.common import LOWER
from tarnwork.llm.words import distinct, spans, taken

SCHEMA = "lang STRING, source STRING, text STRING"


def plain(rows):
    """{(lang, source, part): [(item, value) by rank]} with every term of a language."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), c or ""))) for a, b, c in rows]
    support = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    count = defaultdict(Counter)
    for lang, source, terms in docs:
        mine = [t for t in terms if support[lang, t] >= 3]
        count[lang, source].update(mine)
        count[lang, None].update(mine)
    out = {}
    for lang in {x[0] for x in docs}:
        kept = sorted(t for a, t in support if a == lang and support[a, t] >= 3)
        n = {s: sum(count[lang, s].values()) for (a, s) in count if a == lang}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in n}
        f = lambda x, y: (x - y) * (x - y) // y
        by_rank = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
        for s in n.keys() - {None}:
            out[lang, s, "pair"] = by_rank((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in n.keys() - {None, s})
            out[lang, s, "term"] = by_rank((t, f(p[s][t], p[None][t])) for t in kept if count[lang, s][t] and p[s][t] > p[None][t])[:200]
    return {k: v for k, v in out.items() if v}


def ranked(table):
    out = defaultdict(list)
    for r in sorted(table.collect(), key=lambda r: r["rank"]):
        out[r["lang"], r["source"], r["part"]].append((r["item"], r["value"]))
        assert r["rank"] == len(out[r["lang"], r["source"], r["part"]])
    return dict(out)


@pytest.fixture
def rows():
    rng = random.Random(3)
    words = ["the", "Öl", "a", "x" * 40, "x" * 41, "ÉCOLE", "naïve", "zebra", *(f"w{chr(97 + i)}" for i in range(26))]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 30)))
    made = [(rng.choice(["en", "de"]), f"s{min(rng.randint(0, 9), rng.randint(0, 9))}", text()) for _ in range(300)]
    made += [("en", "s0", "spam " * 3000)] * 5 + [("fr", "alone", "un deux trois")] * 3 + [("it", "a", "solo"), ("it", "b", None)] + [(None, None, "nul 12 nul")] * 3 + [(None, "b", "")]
    return made


def test_equals_plain_sums(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS doc_id", "2 AS n", "'k' AS value", "3 AS p")
    assert ranked(d.source_divergence(table)) == plain(rows)


def test_rounds_ranges_and_blocks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(d, "RANGE", 3)
    monkeypatch.setattr(d, "FAN", 2)
    monkeypatch.setattr(d, "BLOCK", 3000)
    assert ranked(d.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)


def test_no_rows_and_no_terms(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert d.source_divergence(none).count() == 0
    got = ranked(d.source_divergence(spark.createDataFrame([("en", "a", "1 2 3"), ("en", "b", None), ("en", "c", "once")], SCHEMA)))
    assert got == {("en", a, "pair"): [(b, 0) for b in "abc" if b != a] for a in "abc"}


def test_words_of_a_block_are_told_apart():
    texts = [b"ab AB", b"", b"ab\x00", b"a" * 16 + b" " + b"a" * 17, b"a" * 17 + b" ", b"b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    inside = np.ones(256, bool)
    inside[32] = False
    start, end, text = spans(LOWER[data], offsets, inside)
    words = [LOWER[data][a:b].tobytes() for a, b in zip(start, end)]
    assert list(zip(text, words)) == [(0, b"ab"), (0, b"ab"), (2, b"ab\x00"), (3, b"a" * 16), (3, b"a" * 17), (4, b"a" * 17), (5, b"b")]
    code, first, hashes = distinct(LOWER[data], start, end)
    assert [words[first[c]] for c in code] == words and len(first) == len(set(words)) == len(set(hashes.tolist()))
    assert taken(LOWER[data], start, end).to_pylist() == [w.decode() for w in words]
    again = distinct(LOWER[data[offsets[3] :]], start[3:] - offsets[3], end[3:] - offsets[3])
    assert dict(zip((words[i] for i in first), hashes)).items() >= dict(zip((words[3:][i] for i in again[1]), again[2])).items()  # of any block


def test_shares_stay_exact_for_huge_counts(spark):
    n, total, terms = 8_999_999_999_999, 80_000_000_000_000, 1_000_000_000
    got = spark.range(1).select(d.share(*(d.F.lit(x) for x in (n, total, terms))).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // (total + terms)
