"""Language ID of pages by Bayesian evidence fusion.

Four kinds of evidence about a page's language l are multiplied:
  - text: byte-trigram likelihood of the visible text, tempered, from a naive Bayes model
    fitted on a bounded sample of the documents of every label;
  - markup: P(declared lang | l), for ``<html lang>`` or its ``xml:lang``;
  - address: P(suffix | l), for the host's last label;
  - host: P(l | host), smoothed hierarchically host -> registered domain -> corpus.
The tables of the last three are grouped aggregates over *all* pages: every page adds its
text-only posterior to the counts of its declared language, suffix, domain and host, and
a page's own share is taken out of the counts that judge it. Counts are combined map
side, so a host with a third of all pages is one row a task before any shuffle; they are
dealt out anew for the equi join back, so that the adaptive skew join can split it.

Edge cases: a null or empty html leaves address, markup and host evidence; a null url
has host, domain and suffix "". Ties go to the first language in code-point order. No
labelled document gives an empty language set: lang is null. Rows that repeat a page_id
are separate pages; of labelled rows that repeat a doc_id the smallest text counts. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html as htmllib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import apart, write_table

SAMPLE = 500  # documents a language
ADD = 0.1  # to the count of every trigram
TEMPER = 0.05
SMOOTH = 5.0

_OPENS = re.compile(rb"<(?:(script|style|nav|noscript|template)\b|!--)", re.I)
_CLOSES = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style", b"nav", b"noscript", b"template")} | {b"": re.compile(rb"-->")}
_TAG = re.compile(rb"<[^>]*>")


def _without_hidden(raw: bytes) -> bytes:
    """``raw`` with a blank for every comment and every element that shows no text; one that is never closed stays. One pass, whatever stays open."""
    ends: dict[bytes, list[tuple[int, int]]] = {}
    kept, at = [], 0
    for opened in _OPENS.finditer(raw):
        if opened.start() < at:
            continue
        name = (opened[1] or b"").lower()
        if name not in ends:
            ends[name] = [m.span() for m in _CLOSES[name].finditer(raw)]
        k = bisect.bisect_left(ends[name], (opened.end(), 0))
        if k < len(ends[name]):
            kept += [raw[at : opened.start()], b" "]
            at = ends[name][k][1]
    return b"".join([*kept, raw[at:]])


def visible_text(raw: bytes) -> bytes:
    text = _without_hidden(raw)
    last = text.rfind(b">") + 1  # beyond it no tag is closed
    text = _TAG.sub(b" ", text[:last]) + text[last:]
    return htmllib.unescape(text.decode("utf-8", "ignore")).encode("utf-8", "ignore") if b"&" in text else text


def trigrams(raw: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text; digits and marks are blanks."""
    x = np.frombuffer(b" " + re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", raw).lower() + b" ", dtype=np.uint8).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    return np.bincount((h >> np.uint32(16)).astype(np.int64), minlength=1 << 16)


class TextModel:
    """Naive Bayes over the trigrams; only those that a language has take memory.

    ``samples``: (language, text) pairs in order of language.
    """

    def __init__(self, samples: Iterable[tuple[str, bytes]]):
        self.langs, grams, gains, missing = [], [], [], []
        for lang, texts in groupby(samples, key=lambda s: s[0]):
            counts = sum((trigrams(t) for _, t in texts), np.zeros(1 << 16))
            seen = np.flatnonzero(counts)
            self.langs.append(lang)
            grams.append(seen.astype(np.uint16))
            gains.append(np.log1p(counts[seen] / ADD).astype(np.float32))  # above a trigram of count 0
            missing.append(np.log(ADD / (counts.sum() + ADD * len(counts))))
        gram = np.concatenate([np.zeros(0, np.uint16), *grams])
        order = np.argsort(gram, kind="stable")
        self.start = np.searchsorted(gram[order], np.arange((1 << 16) + 1))
        self.lang = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.gain = np.concatenate([np.zeros(0, np.float32), *gains])[order]
        self.missing = np.array(missing)

    def log_likelihood(self, raw: bytes) -> np.ndarray:
        counts = trigrams(raw)
        seen = np.flatnonzero(counts)
        first, size = self.start[seen], self.start[seen + 1] - self.start[seen]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        gain = np.bincount(self.lang[at], self.gain[at] * np.repeat(counts[seen], size), len(self.langs))
        return TEMPER * (gain + self.missing * counts.sum())


def train_text_model(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fit on at most ``sample`` documents of every label, chosen by hash order of doc_id."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = rows.select("lang", "doc_id").withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "doc_id").distinct()
    texts = rows.join(F.broadcast(picked), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id")
    return TextModel((r["lang"], r["text"].encode()) for r in texts.toLocalIterator())


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, registered domain as the last two labels, suffix) of an address."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]*)$", 0), F.regexp_extract(host, r"([^.]*)$", 1)


def declared_language(html: Column) -> Column:
    said = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.lower(said)


def _text_pass(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            scores = []
            for x in html:
                s = model.log_likelihood(visible_text(x.as_buffer().to_pybytes()) if x.is_valid else b"")
                scores.append((s - s.max()).tolist() if len(s) else [])
            keep = [i for i, n in enumerate(batch.schema.names) if n != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores, pa.list_(pa.float64()))], names=[*(batch.schema.names[i] for i in keep), "loglik"])

    return run


def identify(pages: DataFrame, model: TextModel, smooth: float = SMOOTH) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence of every page."""
    n = len(model.langs)
    host, domain, suffix = address(F.col("url").cast("string"))
    html = F.col("html").cast("string")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared_language(html).alias("declared"), html.alias("html"))
    scored = plain.mapInArrow(_text_pass(model), "page_id long, host string, domain string, suffix string, declared string, loglik array<double>")
    if not n:
        return scored.select("page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    exps = F.transform("loglik", lambda x: F.exp(x))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    scored = write_table(scored.withColumn("own", F.transform(exps, lambda x: x / total)), "pages-text")

    def counts(key: str) -> DataFrame:
        sums = [F.sum(F.col("own")[i]) for i in range(n)]
        return scored.groupBy(key).agg(F.array(*sums).alias(f"n_{key}"))

    everything = scored.agg(*[F.sum(F.col("own")[i]).alias(str(i)) for i in range(n)]).first()
    corpus = F.array(*[F.lit(float(x or 0.0)) for x in everything])
    width = {k: scored.select(k).distinct().count() + 1 for k in ("declared", "suffix")}
    all_ = scored
    for key in ("host", "domain", "declared", "suffix"):
        all_ = all_.join(apart(counts(key), f"n_{key}"), key)

    def without_own(col: Column) -> Column:
        return F.zip_with(col, F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))

    def normal(col: Column) -> Column:
        s = F.aggregate(col, F.lit(0.0), lambda a, x: a + x)
        return F.transform(col, lambda x: F.when(s > 0, x / s).otherwise(1.0 / n))

    def smoothed(col: Column, prior: Column) -> Column:
        s = F.aggregate(col, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(col, prior, lambda c, p: (c + smooth * p) / (s + smooth))

    all_ = all_.withColumn("rest", without_own(corpus)).withColumn("p0", normal(F.transform("rest", lambda x: x + 1.0)))
    all_ = all_.withColumn("p1", smoothed(without_own(F.col("n_domain")), F.col("p0"))).withColumn("p2", smoothed(without_own(F.col("n_host")), F.col("p1")))
    for key in ("declared", "suffix"):  # P(value | l), with one spare value
        all_ = all_.withColumn(f"q_{key}", F.zip_with(without_own(F.col(f"n_{key}")), F.col("rest"), _rate(width[key])))
    post = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("loglik", i) + F.log(F.get("p2", i)) + F.when(F.col("declared") != "", F.log(F.get("q_declared", i))).otherwise(0.0) + F.when(F.col("suffix") != "", F.log(F.get("q_suffix", i))).otherwise(0.0))
    all_ = all_.withColumn("post", post).withColumn("top", F.array_max("post"))
    langs = F.array(*[F.lit(c) for c in model.langs])

    def best(col: str) -> Column:
        return F.element_at(langs, F.array_position(F.col(col), F.array_max(col)).cast("int"))

    confidence = 1 / F.aggregate(F.transform("post", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return all_.select("page_id", "host", "declared", best("loglik").alias("text_lang"), best("post").alias("lang"), F.round(confidence, 6).alias("confidence"))


def _rate(width: int):
    def rate(count: Column, total: Column) -> Column:
        return (count + 1.0 / width) / (total + 1.0)

    return rate
