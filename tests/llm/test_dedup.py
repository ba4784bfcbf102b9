"""Near-dedup, line dedup and substring dedup against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import substrings
from tarnwork.llm.common import apart, connected_components
from tarnwork.llm.linededup import CuckooFilter, LineIndex, dedup_lines
from tarnwork.llm.minhash import CirculantMinHash, UNIVERSE, bitmap, drop_near_duplicates, near_duplicates
from tarnwork.llm.substrings import drop_repeats, repeat_report

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- near-dedup


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_rows():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocab, k=rng.choice([4, 30, 80, 200])) for _ in range(12)]
    rows = []
    for i in range(140):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return [*rows, (900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (906, "É a b c d"), (907, "é a b c d")]


def test_components_equal_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_chain_of_links_and_kept(spark):
    words = [f"x{i}" for i in range(40)]
    rows = [(10 - i, " ".join(words[i : i + 30])) for i in range(5)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {6} and [r["doc_id"] for r in got if r["kept"]] == [6]
    assert brute_components(rows)[10][1] == 6


def test_near_dedup_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    extra = frame(spark, [(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")], "doc_id long, text string, n_shingles int, component_id string")
    kept = drop_near_duplicates(extra)
    assert kept.columns == extra.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_signature_is_a_shifted_permutation():
    m = CirculantMinHash(16)
    pi = np.array([m.windows[i][0] for i in range(0, UNIVERSE, 1 << 12)])
    assert len(set(pi.tolist())) == len(pi) and sorted(m.sigma[:10].tolist()) != list(range(10))
    s = np.array([3, 99], dtype=np.uint64)
    want = [min(m.windows[(int(m.sigma[3]) + k) % UNIVERSE][0], m.windows[(int(m.sigma[99]) + k) % UNIVERSE][0]) for k in range(16)]
    assert m.signature(s).tolist() == want


def test_bitmap_bounds_the_intersection():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        x, y = np.unique(rng.choice(pool, 150)), np.unique(rng.choice(pool, 150))
        miss = sum(bin(int(a) & ~int(b)).count("1") for a, b in zip(bitmap(x).view(np.uint64), bitmap(y).view(np.uint64), strict=True))
        assert len(np.intersect1d(x, y)) <= len(x) - miss


# ---------------------------------------------------------------- lines


def brute_lines(rows, at_least=20, docs=3):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in set(map(key, (t or "").split("\n"))):
            if len(line) >= at_least and i is not None:
                held.setdefault(line, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < docs or max(held[key(x)]) == i or i is None]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_rows(seed=2, n=60):
    rng = random.Random(seed)
    pool = [f"line number {i} with some words in it" for i in range(25)] + ["ééééééééééééééééééé", "éééééééééééééééééééé", "short"]
    return [(i, "\n".join(rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", " "]) for x in rng.choices(pool, k=rng.randint(0, 8)))) for i in range(n)]


def test_lines_equal_brute_force(spark):
    rows = [*line_rows(), (500, None), (501, ""), (502, "\n\n")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_keep_extra_columns_and_null_ids(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, 7, 1), (2, line, 8, 2), (3, line, 9, 3), (None, line, 10, 4)]
    out = dedup_lines(frame(spark, rows, "doc_id long, text string, other int, n_lines int"))
    got = {r["doc_id"]: (r["text"], r["other"], r["n_dropped"]) for r in out.collect()}
    assert got == {1: ("", 7, 1), 2: ("", 8, 1), 3: (line, 9, 0), None: (line, 10, 0)}
    assert dedup_lines(frame(spark, [])).count() == 0


def test_insert_and_delete_are_reversible(spark):
    rows = line_rows()
    old, new = frame(spark, rows[:40]), frame(spark, rows[40:])
    drops = lambda index, **group: {(r["doc_id"], tuple(sorted(map(tuple, r["drops"])))) for r in index.dropped(**group).collect()}
    before = LineIndex.build(old, shards=4)
    both = before.insert(new)
    assert drops(both) == drops(LineIndex.build(frame(spark, rows), shards=4))
    after = both.delete(new)
    assert drops(after) == drops(before) == drops(before, group=3)
    counts = lambda index: {tuple(r) for r in index.counts.select("k1", "k2", "n_docs", "last_doc").collect()}
    assert counts(after) == counts(before)
    held = lambda index: {r["shard"]: CuckooFilter.loads(bytes(r["slots"])) for r in index.filters.collect()}
    hot = before.counts.where("n_docs >= 3").withColumn("shard", before._shard()).collect()
    filters = held(after)
    assert hot and all(filters[r["shard"]].contains(np.array([r["k1"]]), np.array([r["k2"]]))[0] for r in hot)


def test_cuckoo_filter():
    rng = np.random.default_rng(9)
    k1, k2 = (rng.integers(-(1 << 62), 1 << 62, 5000) for _ in range(2))
    f = CuckooFilter.sized(5000)
    assert f.insert(k1, k2) and f.contains(k1, k2).all()
    assert CuckooFilter.loads(f.dumps()).contains(k1, k2).all()
    other = rng.integers(-(1 << 62), 1 << 62, 20_000)
    assert f.contains(other, other).mean() < 0.002
    f.delete(k1[:2500], k2[:2500])
    assert f.contains(k1[2500:], k2[2500:]).all() and f.contains(k1[:2500], k2[:2500]).mean() < 0.01
    small = CuckooFilter(np.zeros((4, 4), dtype=np.uint16))
    assert not small.insert(k1[:100], k2[:100])


# ---------------------------------------------------------------- substrings


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, b in sorted((i, (t or "").encode()) for i, t in rows):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdefgh \né") for _ in range(rng.choice([60, 90, 99, 100, 101, 140, 300]))) for _ in range(12)]
    made = [(i, "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("ab cdé") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6)))) for i in range(200)]
    return [*made, (901, "a" * 700), (902, "b" * 50 + "a" * 300), (903, None), (904, ""), (905, "ab" * 400), (906, "xyz" * 20 + "ab" * 300 + "q" * 120), (907, "z" * 99), (908, "y" * 100), (909, "y" * 100)]


def test_repeated_ids_are_alike_in_hot_buckets(spark):
    """Rows of one doc_id and several texts, with q-grams in hot buckets and in plain ones."""
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=150))
    rows = [(i % 9, "".join(rng.choices("abcdefgh ", k=rng.choice([0, 20, 90]))) + passage + "".join(rng.choices("abcdefgh ", k=60))) for i in range(40)]
    docs = frame(spark, rows)
    reports = [sorted(map(tuple, repeat_report(docs, hot=hot).collect())) for hot in (50_000, 5)]
    assert reports[0] == reports[1] and sum(r[2] for r in reports[0]) > 0


@pytest.mark.parametrize("hot", [50_000, 15])
def test_repeats_equal_brute_force(spark, hot):
    rows = repeat_rows()
    got = {r["doc_id"]: tuple(r)[1:] for r in repeat_report(frame(spark, rows), hot=hot).collect()}
    assert got == brute_repeats(rows)


def test_repeats_edges(spark):
    text = "".join(random.Random(1).choices("abcdefghij ", k=400))
    rows = [(1, text, 1), (1, text, 2), (2, "x" + text, 3), (None, text, 4)]
    out = drop_repeats(frame(spark, rows, "doc_id long, text string, marks int"))
    got = sorted(((r["doc_id"] or -1), r["marks"], r["text"]) for r in out.collect())
    assert got == [(-1, 4, text), (1, 1, text), (1, 2, text), (2, 3, "x")]
    assert repeat_report(frame(spark, [])).count() == 0


def traced_peak(call):
    """MB that a call takes at most beyond what was there."""
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def repeat_context_rows(n):
    """Contexts of one q-gram bucket as the context pass sends them: one in two is a copy of one of 200."""
    rng = np.random.default_rng(3)
    ctx = rng.integers(97, 100, (n, 168)).astype(np.uint8)
    ctx[:, 68:100] = 65
    ctx[::2] = ctx[rng.integers(0, 200, len(ctx[::2]))]
    doc, place = np.arange(n, dtype=np.int64) // 2, np.tile(np.array([68, 68, 68], np.int32), (n, 1))
    place[1::2, 0] = 400
    rows = {"shard": [0], "bucket": [np.zeros(n, np.uint64).tobytes()], "doc": [doc.tobytes()], "place": [place.tobytes()], "context": [ctx.tobytes()]}
    return pd.DataFrame(rows), ctx, doc, place


def test_contexts_and_buckets_take_little_memory():
    """8 MB of texts in one batch, and 20,000 contexts in one bucket: two such tasks share an executor."""
    rng = np.random.default_rng(4)
    texts = [bytes(x).decode() for x in rng.integers(97, 123, (1000, 8000)).astype(np.uint8)]
    mark = np.zeros(20, substrings._MARK)
    mark["pos"], mark["open"] = np.arange(20) * 390, 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts), pa.array([[mark.tobytes()]] * 1000, pa.list_(pa.binary()))], names=["doc_id", "text", "marks"])
    sent = []
    assert traced_peak(lambda: sent.extend(substrings._context_pass(5, 100, 32)(iter([batch])))) < 60
    assert sum(len(x.as_py()) for b in sent for x in b.column(1)) == 8 * 20_000
    pdf = repeat_context_rows(20_000)[0]
    assert traced_peak(lambda: substrings._refine_shard(100, 32)(pdf)) < 60


def test_hot_strings_take_little_memory():
    """A batch of which every anchor is hot: copies leave as ranges and not as one record a string."""
    rng = np.random.default_rng(6)
    passage = bytes(rng.integers(97, 123, 1200).astype(np.uint8)).decode()
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([passage] * 1000)], names=["doc_id", "text"])
    counted = next(substrings._count_pass(100, 32)(iter([batch])))
    hot = np.sort(counted.column(0).to_numpy().view(np.uint64))
    sent = []
    assert traced_peak(lambda: sent.extend(substrings._anchor_pass(5, 100, 32, hot)(iter([batch])))) < 320
    raw = {k: b"".join(x for b in sent for x, s in zip(b.column(1).to_pylist(), b.column(0).to_pylist()) if (s < 0) == k) for k in (True, False)}
    gone, own = (np.frombuffer(raw[k], substrings._ANCHOR) for k in (True, False))
    assert len(gone) + len(own) < 100_000
    marks = substrings._marks(gone, 0)
    for doc in (1, 500, 999):
        assert substrings.covered(marks[gone["doc"] == doc], 1200, 100).all()


def test_refined_buckets_equal_brute_force():
    pdf, ctx, doc, place = repeat_context_rows(600)
    out = substrings._refine_shard(100, 32)(pdf)
    got = set()
    for d, raw in zip(out["doc_id"], out["marks"], strict=True):
        for m in np.frombuffer(raw, substrings._MARK):
            got |= {(d, int(m["pos"]), back) for back in range(m["lo"], m["hi"] + 1)}
    want, seen = set(), set()
    for i in range(600):  # in the order of documents and places
        for j in range(69):
            s = (j, ctx[i, j : j + 100].tobytes())
            if s in seen:
                want.add((int(doc[i]), int(place[i, 0]), 68 - j))
            seen.add(s)
    assert got == want and want


# ---------------------------------------------------------------- components and skew


def test_components_of_a_long_path_and_a_hub(spark):
    """A path of 3,000 nodes in shuffled edges and a star: no bound on the rounds."""
    edges = [(i, i + 1) for i in range(3000)] + [(10_000, 10_000 + i) for i in range(1, 300)] + [(None, 5)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3001)}, **{10_000 + i: 10_000 for i in range(300)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hot_key_is_split(spark):
    """Joined with an aggregate that is dealt apart, a key of half of all rows is read by several tasks."""
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        rows = spark.range(100_000).repartition(8).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("u"), F.xxhash64("id").alias("v"))
        least = rows.groupBy("u").agg(F.min("v").alias("m"))
        out = rows.join(apart(least, "m"), "u").agg(F.sum(F.col("v") % 7 + F.col("m") % 7))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
