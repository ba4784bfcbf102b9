"""Exact substring dedup by bucket-pointer refinement over sampled suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts earlier, in (doc_id,
position) order, is removed. Positions are bytes of one document's UTF-8; matches never
cross documents; strings are judged on the input.

A string of LENGTH bytes holds a window of q-grams whose least hash marks an *anchor*;
equal strings have the same anchors at the same places, so only anchors (about one
position in 35) are dealt out. An anchor stands for all strings that contain its q-gram.

Round one sorts anchors into their q-gram's bucket, and inside it by the hash of the
whole context (the union of those strings). In (doc_id, position) order
  - the first of a q-gram bucket holds no string that starts earlier: it is kept;
  - one whose whole context occurred before is covered by earlier strings: removed;
  - any other is open.
Round two refines the buckets with an open member, on the bytes themselves: initial
buckets of 8-grams get identifiers, and sorting on (own identifier, identifier d bytes
later) doubles their length, 8, 16, 32, 64 and LENGTH, each step reusing the last one's
identifiers. Suffixes whose bucket has one member leave, and so does every suffix that
would look one of them up: it shares its longer string with no other either. What shares a bucket of
LENGTH bytes with an earlier suffix is removed. Equal strings of a bucket lie at the same
place beside its q-gram, so each place is sorted alone: of n contexts a task holds 812 n bytes
(identifiers of four bytes, and the contexts), and sorts n keys at once.

Rows of both shuffles are packed arrays, one a shard and Arrow batch; shards and their
tasks grow in number with the input's bytes. A batch first settles what it can by itself:
of anchors with equal context only the first goes out, so a passage held by a third of all
documents reaches its shard once a batch. Anchors with a common q-gram but all sorts of
contexts (the ends of such a passage) would still meet in one bucket. All anchor q-grams
are therefore counted first, combined map side, and those above ``hot`` skip the bucket:
each of their strings is a key of its own, which again reaches its shard once a batch
(or once in RECORDS records of a batch that makes more); neighbouring strings that a batch
settles are one record.
``hot`` is 50,000, or a millionth of all anchors if that is more, so that there are never
more than a million hot q-grams (8 MB) on the driver, none of which is left out.

Edge cases: null text is empty; texts shorter than LENGTH lose nothing. A null doc_id
takes no part and loses nothing. Equal rows are one document, each returned; of rows that
share a doc_id with other texts each loses what is marked for any. Extra columns pass through
:func:`drop_repeats`. Bytes of a cut multi-byte character are kept in the digest and
dropped when a text is rebuilt. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import SpanHash, arrow_batch, mix, parallelism, text_blocks, write_table

LENGTH = 100
Q = 32  # bytes of an anchor's q-gram
HOT = 50_000  # contexts that may meet in one bucket
SHARD = 16 << 20  # bytes of text a shard, about
RECORDS = 1 << 20  # anchors that a batch holds at once, about
STRINGS = 1 << 18  # strings of hot anchors that are made at once, about
GRID = 1 << 13  # contexts that are cut out at once
SENT = 1 << 16  # contexts that go out together, about

_ANCHOR = np.dtype([("narrow", "<u8"), ("wide", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("lo", "<i2"), ("hi", "<i2")])
_MARK = np.dtype([("pos", "<i4"), ("lo", "<i2"), ("hi", "<i2"), ("open", "<i4")])
_MARKS = "doc_id long, marks binary, n_open int"
_PACKED = pa.schema([("shard", pa.int32()), ("packed", pa.binary())])


# ---------------------------------------------------------------- anchors


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least (or greatest) of w neighbours from every position where w remain."""
    pick = np.minimum if least else np.maximum
    done = 1
    while done < w:
        step = min(done, w - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def anchors(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, q: int = Q):
    """(row, position in the block, span hashes) of every anchor of a block of texts."""
    spans = SpanHash(data)
    grams = spans.grams(q)
    rank = (grams >> np.uint64(32)).astype(np.uint32)
    rows, places = [], []
    w = length - q + 1
    for row in np.flatnonzero(np.diff(offsets) >= length):
        h = rank[offsets[row] : offsets[row + 1] - q + 1]
        least = _sliding(h, w, True)
        pad = np.zeros(w - 1, dtype=np.uint32)
        most = _sliding(np.concatenate([pad, least, pad]), w, False)
        at = np.flatnonzero(most == h)
        rows.append(np.full(len(at), row))
        places.append(at + offsets[row])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), spans, grams
    return np.concatenate(rows), np.concatenate(places), spans, grams


def _records(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """A record for every anchor, and its row in the block; lo..hi are the string starts it stands for, before its position."""
    row, at, spans, grams = anchors(offsets, data, length, q)
    start, end = offsets[row], offsets[row + 1]
    left = np.minimum(length - q, at - start)  # bytes of context before the q-gram
    right = np.minimum(length - q, end - at - q)
    out = np.zeros(len(at), dtype=_ANCHOR)
    out["narrow"] = grams[at]
    with np.errstate(over="ignore"):
        out["wide"] = mix(spans.of(at - left, at + q + right) + left.astype(np.uint64))
    out["doc"], out["pos"] = ids[row], at - start
    out["hi"], out["lo"] = left, np.maximum(0, length - q - right)
    some = out["hi"] >= out["lo"]
    return out[some], row[some]


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Of sorted rows, whether each starts a run of equal keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _first_of(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether a row is at the first (doc, pos) among rows of equal keys."""
    order = np.lexsort((pos, doc, *keys))
    new = np.flatnonzero(_starts([k[order] for k in keys]))
    run = np.repeat(new, np.diff(np.concatenate([new, [len(order)]])))
    out = np.zeros(len(order), dtype=bool)
    out[order] = (doc[order] == doc[order][run]) & (pos[order] == pos[order][run])
    return out


def _split(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, and the rows of each."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(_starts([keys[order]])) if len(keys) else np.zeros(0, np.int64)
    return keys[order][at], np.split(order, at[1:]) if len(keys) else []


def _packed(r: np.ndarray, shards: int) -> pa.RecordBatch:
    """Records by shard. Of equal contexts all but the first are removals already (shard < 0)."""
    own = _first_of([r["wide"], r["narrow"]], r["doc"], r["pos"])
    shard = np.where(own, (r["narrow"] % np.uint64(shards)).astype(np.int64), -1 - r["doc"] % shards)
    keys, rows = _split(shard)
    return arrow_batch(_PACKED, [keys.tolist(), [(r[x] if k >= 0 else _joined(r[x])).tobytes() for k, x in zip(keys.tolist(), rows, strict=True)]])


def _joined(r: np.ndarray) -> np.ndarray:
    """Removals, those of neighbouring strings of one anchor as one record."""
    r = r[np.lexsort((r["lo"], r["pos"], r["doc"]))]
    new = _starts([r["doc"], r["pos"]])
    new[1:] |= (r["lo"][1:] != r["hi"][:-1] + 1) & (r["lo"][1:] != r["hi"][:-1])
    at = np.flatnonzero(new)
    out = r[at]
    out["hi"] = r["hi"][np.append(at[1:], len(r)) - 1]
    return out


def _batch_records(batch: pa.RecordBatch, length: int, q: int, hot: np.ndarray) -> Iterator[np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for first, end, offsets, data in text_blocks(batch):
        r, row = _records(ids[first:end], offsets, data, length, q)
        if len(hot) and len(r):
            common = np.isin(r["narrow"], hot)
            if common.any():
                yield from _strings(r[common], offsets[row[common]], data, length)
                r = r[~common]
        yield r


def _strings(r: np.ndarray, base: np.ndarray, data: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """A record for every string of the given anchors, keyed by the string and its anchor's place; ``base``: where their texts start."""
    hashes = [SpanHash(data, seed) for seed in (0, 1)]  # 124 bits of the string
    some = max(1, STRINGS // length)
    for first in range(0, len(r), some):
        part = r[first : first + some]
        n = part["hi"].astype(np.int64) - part["lo"] + 1
        out = np.repeat(part, n)
        back = out["lo"] + (np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n))
        start = np.repeat(base[first : first + some], n) + out["pos"] - back
        with np.errstate(over="ignore"):
            for name, spans in zip(("narrow", "wide"), hashes, strict=True):
                out[name] = mix(spans.of(start, start + length) + back.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out["lo"] = out["hi"] = back
        yield out


def _anchor_pass(shards: int, length: int, q: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for r in _batch_records(batch, length, q, hot):
                held.append(r)
                n += len(r)
                if n >= RECORDS:
                    yield _packed(np.concatenate(held), shards)
                    held, n = [], 0
            if n:
                yield _packed(np.concatenate(held), shards)

    return run


def _count_pass(length: int, q: int):
    """(gram, n) of the anchor q-grams of a batch."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, offsets, data in text_blocks(batch):
                _, at, _, grams = anchors(offsets, data, length, q)
                found.append(grams[at])
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield arrow_batch(schema, [grams.view(np.int64), n])

    return run


def _by_doc(doc: np.ndarray, marks: np.ndarray) -> pd.DataFrame:
    ids, rows = _split(doc)
    return pd.DataFrame({"doc_id": ids.astype(np.int64), "marks": [marks[x].tobytes() for x in rows], "n_open": np.array([int(marks["open"][x].sum()) for x in rows], dtype=np.int32)})


def _marks(r: np.ndarray, is_open: int) -> np.ndarray:
    out = np.zeros(len(r), dtype=_MARK)
    for f in ("pos", "lo", "hi"):
        out[f] = r[f]
    out["open"] = is_open
    return out


def _settle_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Marks of one shard: removed anchors, and every context of a bucket with an open one."""
    r = np.concatenate([np.frombuffer(x, dtype=_ANCHOR) for x in pdf.packed])
    if pdf["shard"].iloc[0] < 0:  # settled by their own batch
        return _by_doc(r["doc"], _marks(r, 0))
    r = r[np.argsort(r["narrow"], kind="stable")]
    first = _first_of([r["narrow"]], r["doc"], r["pos"])
    first_wide = _first_of([r["wide"], r["narrow"]], r["doc"], r["pos"])
    removed, is_open = ~first & ~first_wide, ~first & first_wide
    bucket = np.cumsum(_starts([r["narrow"]])) - 1
    again = (np.bincount(bucket, weights=is_open) > 0)[bucket] & first_wide
    return _by_doc(np.concatenate([r["doc"][removed], r["doc"][again]]), np.concatenate([_marks(r[removed], 0), _marks(r[again], 1)]))


# ---------------------------------------------------------------- refining on bytes

_CONTEXT = pa.schema([("shard", pa.int32()), ("bucket", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("context", pa.binary())])


def _joined_marks(value: pa.Scalar) -> np.ndarray:
    raw = b"".join(value.as_py()) if value.is_valid else b""
    return np.frombuffer(raw, dtype=_MARK)


def _contexts(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place, context bytes, zero padded) of the anchors at ``at`` of texts from lo to hi."""
    side = length - q
    grid = (at[:, None] + np.arange(-side, q + side)[None, :]).astype(np.int32)
    ctx = data[np.clip(grid, 0, len(data) - 1)]
    ctx[(grid < lo[:, None]) | (grid >= hi[:, None])] = 0
    place = np.stack([at - lo, np.minimum(side, at - lo), np.minimum(side, hi - at - q)], axis=1).astype(np.int32)
    gram = np.arange(len(at)) * q  # only the q-grams are hashed, not all of the texts
    return SpanHash(ctx[:, side : side + q].ravel()).of(gram, gram + q), place, ctx


def _dealt(held: list[tuple[np.ndarray, ...]], shards: int) -> pa.RecordBatch:
    """Buckets, documents, places and contexts by shard."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    keys, rows = _split((columns[0] % np.uint64(shards)).astype(np.int32))
    return arrow_batch(_CONTEXT, [keys.tolist(), *([x[g].tobytes() for g in rows] for x in columns)])


def _context_pass(shards: int, length: int, q: int):
    """Context bytes (zero padded) of every member of an open bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, offsets, data in text_blocks(batch):
                marks = [_joined_marks(batch.column(2)[i]) for i in range(first, end)]
                at = [m["pos"][m["open"] == 1].astype(np.int64) for m in marks]
                row = np.repeat(np.arange(end - first), [len(x) for x in at])
                at = np.concatenate(at) + offsets[row]
                inside = at + q <= offsets[row + 1]
                at, row = at[inside], row[inside]
                for k in range(0, len(at), GRID):
                    some = row[k : k + GRID]
                    bucket, place, ctx = _contexts(at[k : k + GRID], offsets[some], offsets[some + 1], data, length, q)
                    held.append((bucket, ids[first + some], place, ctx))
                    n += len(some)
                    if n >= SENT:
                        yield _dealt(held, shards)
                        held, n = [], 0
        if held:
            yield _dealt(held, shards)

    return run


def _shared(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of n contexts, numbers of the keys of ``rows``; -1 for keys met once, and for all other contexts."""
    out = np.full(n, -1, dtype=np.int32)
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    out[rows] = np.where(count[inverse] > 1, inverse, -1)
    return out


def refine(ctx: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of all strings of ``length`` bytes of the contexts; -1 for those met once.

    Row j, column i: the string at byte j of context i. Strings meet strings of the same
    q-gram bucket at the same byte, so the rows are numbered one by one.
    """
    n, width = ctx.shape
    group = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    ident = np.empty((width - 7, n), dtype=np.int32)
    eight, every = np.zeros(n, dtype=np.uint64), np.arange(n)
    for j, byte in enumerate(np.ascontiguousarray(ctx.T)):  # initial buckets: eight bytes as they are
        eight = (eight << np.uint64(8)) | byte
        if j >= 7:
            own = _shared(eight, every, n)
            rows = np.flatnonzero(own >= 0)
            ident[j - 7] = _shared(own[rows] * (int(group.max(initial=0)) + 1) + group[rows], rows, n)
    size = 8
    while size < length:
        step = min(size, length - size)
        ident, later = ident[: len(ident) - step], ident[step:]  # one array: a row is read before it is numbered anew
        for own, other in zip(ident, later, strict=True):
            rows = np.flatnonzero((own >= 0) & (other >= 0))
            own[:] = _shared(own[rows].astype(np.int64) * n + other[rows], rows, n)
        size += step
    return ident


def _refine_shard(length: int, q: int, contexts: int = 20_000):
    side, width = length - q, 2 * length - q

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf.bucket])
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in pdf.doc])
        place = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 3) for x in pdf["place"]])
        ctx = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, width) for x in pdf.context])
        order = np.lexsort((place[:, 0], doc, bucket))
        bucket, doc, place = bucket[order], doc[order], place[order]
        turns = np.cumsum(_starts([bucket, doc, place[:, 0]]))  # rows of one document and place are at the same turn
        edges = np.append(np.flatnonzero(_starts([bucket])), len(bucket))
        docs, marks = [], []
        turn = 0
        while turn < len(edges) - 1:  # whole buckets, some thousand contexts at a time
            last = max(turn + 1, int(np.searchsorted(edges, edges[turn] + contexts, side="right")) - 1)
            part = slice(edges[turn], edges[last])
            turn = last
            later = _later(refine(ctx[order[part]], bucket[part], length), turns[part], place[part], side)
            m, i = _ranges(later, place[part, 0], side)
            docs.append(doc[part][i])
            marks.append(m)
        return _by_doc(np.concatenate(docs), np.concatenate(marks))

    return run


def _later(ident: np.ndarray, turns: np.ndarray, place: np.ndarray, side: int) -> np.ndarray:
    """Whether the string at byte j of context i lies in its text and in an earlier turn; contexts are sorted by turn."""
    out = np.zeros(ident.shape, dtype=bool)
    for j in range(len(ident)):  # the string at byte j starts side - j before the q-gram
        rows = np.flatnonzero((ident[j] >= 0) & (side - j <= place[:, 1]) & (j <= place[:, 2]))
        _, at, inverse = np.unique(ident[j, rows], return_index=True, return_inverse=True)
        out[j, rows] = turns[rows] > turns[rows[at]][inverse]
    return out


def _ranges(later: np.ndarray, pos: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of neighbouring starts of one anchor as one range, and their contexts."""
    edge = np.diff(np.pad(later.astype(np.int8), ((1, 1), (0, 0))), axis=0)
    row, first = np.nonzero(edge.T == 1)
    _, end = np.nonzero(edge.T == -1)
    out = np.zeros(len(row), dtype=_MARK)
    out["pos"], out["lo"], out["hi"] = pos[row], side - end + 1, side - first
    return out, row


# ---------------------------------------------------------------- the operator


def covered(m: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which bytes of a document the marked strings cover."""
    m = m[m["open"] == 0]
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, np.clip(m["pos"].astype(np.int64) - m["hi"], 0, size), 1)
    np.add.at(edge, np.clip(m["pos"].astype(np.int64) - m["lo"] + length, 0, size), -1)
    return np.cumsum(edge)[:size] > 0


def _texts(docs: DataFrame, length: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where("doc_id IS NOT NULL").where(F.octet_length("text") >= length)


def hot_grams(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> np.ndarray:
    """Every anchor q-gram counted above ``hot``."""
    counted = _texts(docs, length).mapInArrow(_count_pass(length, q), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > hot).collect()  # at most a millionth of the anchors' number, or their number / HOT
    return np.sort(np.array([r["gram"] for r in rows], dtype=np.int64).view(np.uint64))


def repeated_marks(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """(doc_id, marks): of documents of which something is removed, the marks as packed arrays."""
    size = _texts(docs, length).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(parallelism(docs.sparkSession), -(-size // SHARD))
    hot = max(hot, size // 35 // 1_000_000)
    texts = _texts(docs, length)
    packed = texts.mapInArrow(_anchor_pass(shards, length, q, hot_grams(docs, length, q, hot)), "shard int, packed binary")
    one = packed.repartition(shards, "shard").groupBy("shard").applyInPandas(_settle_shard, _MARKS)
    one = write_table(one.groupBy("doc_id").agg(F.collect_list("marks").alias("marks"), F.sum("n_open").alias("n_open")), "substring-marks")
    with_open = texts.join(one.where("n_open > 0").select("doc_id", "marks"), "doc_id").select("doc_id", "text", "marks")
    ctx = with_open.mapInArrow(_context_pass(shards, length, q), "shard int, bucket binary, doc binary, place binary, context binary")
    two = ctx.repartition(shards, "shard").groupBy("shard").applyInPandas(_refine_shard(length, q), _MARKS)
    two = write_table(two.groupBy("doc_id").agg(F.collect_list("marks").alias("more")), "substring-marks")
    none = F.expr("CAST(array() AS array<binary>)")
    both = one.select("doc_id", "marks").join(two, "doc_id", "full")
    return both.select("doc_id", F.concat(F.coalesce("marks", none), F.coalesce("more", none)).alias("marks"))


def _cut(text: pa.Scalar, marks: pa.Scalar, length: int) -> tuple[bytes, int, int, int]:
    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
    if not marks.is_valid:
        return raw, len(raw), 0, 0
    gone = covered(_joined_marks(marks), len(raw), length)
    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), spans


def _report_pass(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(t, m, length) for t, m in zip(batch.column(1), batch.column(2), strict=True)]
            yield arrow_batch(schema, [batch.column(0), *([c[i] for c in cut] for i in (1, 2, 3)), [hashlib.sha256(c[0]).hexdigest() for c in cut]])

    return run


def _rebuild_pass(length: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_cut(t, m, length)[0].decode("utf-8", "ignore") if t.is_valid else None for t, m in zip(batch.column("text"), batch.column("__marks"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return run


def repeat_report(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = texts.join(repeated_marks(docs, length, q, hot), "doc_id", "left").select("doc_id", "text", "marks")
    return both.mapInArrow(_report_pass(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """``docs`` without the repeated bytes of ``text``."""
    plain = docs.drop("__marks", "__doc").withColumn("text", F.col("text").cast("string"))
    marks = repeated_marks(plain, length, q, hot).select(F.col("doc_id").alias("__doc"), F.col("marks").alias("__marks"))
    both = plain.join(marks, F.col("doc_id").cast("long") == F.col("__doc"), "left").drop("__doc")
    return both.mapInArrow(_rebuild_pass(length, plain.columns), plain.schema)
