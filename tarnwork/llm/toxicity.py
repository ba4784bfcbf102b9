"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary stands for toxic text, one for ordinary text. They are lists of words that
are chosen from a bounded sample of labelled rows, not that text itself. A window is one
word of any length, with its digits and signs, or a run of punctuation marks; every byte
that is no blank lies in one window. Windows stand between two strings that both
dictionaries hold, so that zstandard codes them with matches instead of storing them. Of every window
of the whole text two lengths are compared: what is left under the toxic dictionary, and how
much the ordinary one costs beyond that. Their counts over fixed length thresholds feed
a ridge logistic regression, which calibrates the thresholds into a probability.

Training: per class at most ``SAMPLE`` documents and ``BYTES`` bytes, taken by hash order
of doc_id among labelled rows of at most ``LONGEST`` bytes, so that the driver's memory is
bounded and the sample and the model do not depend on partitioning. Of the entries of a
dictionary the ``ENTRIES`` strongest are kept, as its size bounds a match's offset. A toxic entry
is a word of which some prefix of four bytes or more (the whole word, if shorter) is ``Z`` standard errors more frequent in toxic
documents; an ordinary entry is a frequent word, or one that begins like a toxic entry.
Calibration is cross-fitted over two halves, so that no document is scored by entries
learnt from it; the final dictionaries use the whole sample. The intercept is moved to
the class shares of all labelled rows. The model (two dictionaries of some tens of KB
and 91 weights) travels in the closure.

Edge cases: null and empty texts have no windows and score the intercept. Labels that
are null are not learnt from; of several labels of one doc_id the largest counts. If a
class has no labelled row, every score is the smoothed share of toxic rows. Rows that
repeat a doc_id score each by its own text, and the smallest text is learnt from; extra columns pass through :func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import drop_table, write_table

SAMPLE = {1: 2_000, 0: 6_000}
BYTES = {1: 8 << 20, 0: 24 << 20}  # of the sampled texts of a class
LONGEST = 1 << 20  # bytes of a text that may be learnt from; every text is scored whole
Z = 4.0
ENTRIES = 2_000
RIDGE = 3.0
LEVEL = 9
FRAME = b"\x01<<frame-of-known-bytes>>\x02"
TAIL = b"\x03{{end-of-window}}\x04"  # zstandard starts no match in the last 8 bytes of its input
LEFT, GAIN = 10, 9  # thresholds: bytes left under the toxic dictionary 0..9, gain 0..8
MEMO = 400_000  # words whose lengths a task remembers

_MARK = rb".,;:!?\"()\[\]{}<>"
_WORD = re.compile(rb"[^\s'" + _MARK + rb"]+(?:'+[^\s'" + _MARK + rb"]+)*|['" + _MARK + rb"]+")


def words_of(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw.lower())


def _heads(w: bytes) -> list[bytes]:
    """What stands for a word in counts: its prefixes, or a short word with its end."""
    return [w[:n] for n in range(4, min(len(w), 12) + 1)] or [w + b" "]


def _prefixes(words: set[bytes]) -> set[bytes]:
    return {p for w in words for p in _heads(w)}


class Dictionaries:
    """The two compressors; picklable by the dictionaries' bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.raw = (toxic, ordinary)
        self._ready()

    def _ready(self) -> None:
        made = []
        for raw in self.raw:
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=8192, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
        self.toxic, self.ordinary = made
        self.floor = [len(c.compress(FRAME + TAIL)) for c in made]
        self.memo: dict[bytes, int] = {}

    def __getstate__(self):
        return self.raw

    def __setstate__(self, raw):
        self.raw = raw
        self._ready()

    def cell(self, word: bytes) -> int:
        at = self.memo.get(word)
        if at is None:
            window = FRAME + b" " + word + b" " + TAIL
            short, long = (len(c.compress(window)) - k for c, k in zip((self.toxic, self.ordinary), self.floor, strict=True))
            at = min(max(short, 0), LEFT - 1) * GAIN + min(max(long - short, 0), GAIN - 1)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = at
        return at

    def features(self, raw: bytes) -> np.ndarray:
        cells = np.fromiter(map(self.cell, words_of(raw)), dtype=np.int64)
        return np.log1p(np.bincount(cells, minlength=LEFT * GAIN))


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    words, heads = {1: Counter(), 0: Counter()}, {1: Counter(), 0: Counter()}
    for text in toxic:
        found = set(words_of(text))
        words[1].update(found)
        heads[1].update(_prefixes(found))
    heads[1] = Counter({p: k for p, k in heads[1].items() if k > 1})  # one document is no evidence
    for text in ordinary:
        found = set(words_of(text))
        words[0].update(found)
        heads[0].update(p for p in _prefixes(found) if p in heads[1])
    share = len(toxic) / (len(toxic) + len(ordinary))

    def excess(w: bytes) -> float:
        best = -math.inf
        for p in _heads(w):
            if k := heads[1].get(p):
                n_all = k + heads[0][p]
                best = max(best, (k - n_all * share) / math.sqrt(n_all * share * (1 - share)))
        return best

    ranked = [(excess(w), k, w) for w, k in words[1].items()]
    bad = [w for z, _, w in sorted(ranked, reverse=True)[:ENTRIES] if z >= Z]
    begin, known = {w[:4] for w in bad}, set(bad)
    common = sorted(words[0].items(), key=lambda x: (-x[1], x[0]))
    near = [w for w, _ in common if (w[:4] in begin or w[:3] in begin) and w not in known][:ENTRIES]
    plain = near + [w for w, _ in common[:300] if w not in known]
    return Dictionaries(*(b" " + b" ".join(reversed(entries)) + b" " + TAIL + FRAME for entries in (bad, plain)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
    return w


class ToxicityModel:
    def __init__(self, dictionaries: Dictionaries | None, weights: np.ndarray):
        self.dictionaries, self.weights = dictionaries, weights

    def score(self, raw: bytes) -> float:
        z = self.weights[0]
        if self.dictionaries is not None:
            z = z + self.dictionaries.features(raw) @ self.weights[1:]
        return float(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))


def fit(rows: list[tuple[int, bytes, int]], totals: dict[int, int]) -> ToxicityModel:
    """A model of (doc_id, text, toxic) rows; ``totals``: labelled rows of each class."""
    n = {y: sum(1 for r in rows if r[2] == y) for y in (0, 1)}
    if min(n.values()) < 2:
        share = (totals.get(1, 0) + 0.5) / (totals.get(0, 0) + totals.get(1, 0) + 1)
        return ToxicityModel(None, np.array([math.log(share / (1 - share))]))
    rows = sorted(rows)
    split = lambda part: [[r[1] for r in part if r[2] == y] for y in (1, 0)]
    seen = {0: 0, 1: 0}
    halves: tuple[list, list] = ([], [])
    for r in sorted(rows, key=lambda r: (zlib.crc32(b"half%d" % r[0]), r)):
        halves[seen[r[2]] % 2].append(r)
        seen[r[2]] += 1
    xs, ys = [], []
    for learn, apply in (halves, halves[::-1]):
        d = train_dictionaries(*split(learn))
        xs += [d.features(r[1]) for r in apply]
        ys += [r[2] for r in apply]
    weights = fit_logistic(np.stack(xs), np.array(ys, dtype=float))
    weights[0] += math.log(totals[1] / totals[0]) - math.log(n[1] / n[0])
    return ToxicityModel(train_dictionaries(*split(rows)), weights)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train_model(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> ToxicityModel:
    """Learn from rows of ``docs`` that ``labels`` (doc_id, toxic) covers and that are not held out."""
    sample = sample or SAMPLE
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id")  # lengths meet the labels, not texts
    size = size.groupBy("doc_id", "toxic").agg(F.max("size").alias("size"))
    size = write_table(size, "toxicity-known")
    totals = {r["toxic"]: r["n"] for r in size.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = []
    for toxic, most in sample.items():
        chosen = size.where((F.col("toxic") == toxic) & (F.col("size") <= LONGEST)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked, left = [], BYTES[toxic]
        for r in chosen.collect():  # at most `most` ids
            left -= r["size"]
            if left < 0:
                break
            picked.append((r["doc_id"],))
        ids = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long"))
        some = texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows += [(r["doc_id"], r["text"].encode(), toxic) for r in some.toLocalIterator()]
    drop_table(size)
    return fit(rows, totals)


def _score_pass(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            scores = [model.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "__score"])

    return run


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``__score``, the probability that a text is toxic."""
    plain = docs.drop("__score").withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(_score_pass(model), plain.withColumn("__score", F.lit(0.0)).schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_model(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    return score_texts(docs, train_model(docs, labels)).where(F.col("__score") < threshold).drop("__score")
