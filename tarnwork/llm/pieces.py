"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut where a run of spaces begins (no piece of the vocabulary goes
across; a vocabulary that does is refused), and its distinct segments are concatenated
and indexed by a suffix array over the first ``WIDTH`` characters. Every piece is
binary-searched for its range of occurrences; the occurrences are edges (start, end,
piece), sorted by position. Relaxation then takes, in each segment, the edge of best
score that spans exactly two current symbols, leftmost first, and joins them, until no
edge does. That is the merge rule of byte-pair models, so results equal the library's;
segments longer than ``LONG`` take the same edges from a heap.

Spaces are escaped as U+2581 with one in front of the text; characters that are no piece
become byte pieces. Decoding looks pieces up, joins bytes, and turns U+2581 into spaces.

Encoding works per Arrow batch without a shuffle; the vocabulary (some hundred KB) goes
with the closure, read once on the driver from the path that is a parameter.

Edge cases: null and empty texts have no pieces; null stays null when encoded as an
array. A text holding U+2581 itself decodes with spaces there. Equal texts encode
alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import arrow_batch, text_blocks
from tarnwork.llm.words import distinct

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WIDTH = 16
LONG = 96
BLOCK = 1 << 22  # bytes of text encoded at a time
SPACE = "▁"


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 1 normal, 6 byte

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("only byte-pair models without text normalisation are handled")
        out = cls([p.piece for p in model.pieces], np.array([p.score for p in model.pieces]), np.array([p.type for p in model.pieces]))
        if any(SPACE in p.lstrip(SPACE) or len(p) > WIDTH or k in (4, 5) for p, k in zip(out.pieces, out.kinds, strict=True) if k not in (2, 3, 6)):
            raise ValueError("pieces across spaces, very long or user-defined pieces are not handled")
        return out


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        normal = np.flatnonzero(vocab.kinds == 1)
        texts = [vocab.pieces[i] for i in normal]
        self.alphabet = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
        self.single = {p: int(i) for p, i in zip(texts, normal, strict=True) if len(p) == 1}
        self.single_of = np.array([self.single.get(chr(c), -1) for c in self.alphabet], dtype=np.int32)
        self.bytes_at = np.full(256, -1, np.int32)
        for i in np.flatnonzero(vocab.kinds == 6):
            self.bytes_at[int(vocab.pieces[i][3:5], 16)] = i
        many = [(p, int(i)) for p, i in zip(texts, normal, strict=True) if len(p) > 1]
        self.ids = np.array([i for _, i in many], np.int32)
        self.sizes = np.array([len(p) for p, _ in many], np.int32)
        rows = np.zeros((len(many), WIDTH), np.uint16)
        for row, (p, _) in zip(rows, many, strict=True):
            row[: len(p)] = self._codes(np.frombuffer(p.encode("utf-32-le"), np.uint32))
        self.low = self._keys(rows)
        rows[np.arange(WIDTH)[None, :] >= self.sizes[:, None]] = 0xFFFF
        self.high = self._keys(rows)
        self.rank = np.full(len(vocab.pieces), np.iinfo(np.int32).max, np.int32)  # ties of score share a rank
        self.rank[normal] = np.unique(-vocab.scores[normal], return_inverse=True)[1]

    def _codes(self, chars: np.ndarray) -> np.ndarray:
        """Characters as 1.. in the vocabulary's alphabet; 0xFFFE for any other."""
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 1, 0xFFFE).astype(np.uint16)

    @staticmethod
    def _keys(rows: np.ndarray) -> list[np.ndarray]:
        wide = rows.astype(np.uint64)
        return [(wide[:, i] << np.uint64(48)) | (wide[:, i + 1] << np.uint64(32)) | (wide[:, i + 2] << np.uint64(16)) | wide[:, i + 3] for i in range(0, WIDTH, 4)]

    def _ranges(self, sorted_keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all pieces at once in the suffix array."""
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(sorted_keys[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(sorted_keys[0]) - 1)
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for have, want in zip(sorted_keys, wanted, strict=True):
                h = have[mid]
                less |= equal & (h < want)
                equal &= h == want
            go = open_ & (less | equal if after else less)
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of a piece inside a segment, by start.

        ``ends``: of each character, where its segment ends.
        """
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(WIDTH, np.uint16)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[:n].copy()
        rows[np.arange(WIDTH)[None, :] >= (ends - np.arange(n))[:, None]] = 0
        keys = self._keys(rows)
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        lo, hi = self._ranges(keys, self.low, False), self._ranges(keys, self.high, True)
        many = hi - lo
        start = order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        size, piece = np.repeat(self.sizes, many), np.repeat(self.ids, many)
        by = np.argsort(start, kind="stable")
        return start[by], (start + size)[by], piece[by]

    def relax(self, n: int, starts: np.ndarray, edge: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Piece of every symbol start (-1: no start; single characters keep -2)."""
        a, b, piece = edge
        after = np.arange(1, n + 1)  # end of the symbol that starts here
        symbol = np.full(n, -2, np.int32)
        segment = np.searchsorted(starts, a, side="right") - 1
        size = np.diff(np.append(starts, n))
        long = size[segment] > LONG if len(a) else np.zeros(0, bool)
        if long.any():
            for s in np.unique(segment[long]):
                mine = segment == s
                self._heap(a[mine], b[mine], piece[mine], after, symbol, int(starts[s]), int(starts[s] + size[s]))
            a, b, piece, segment = a[~long], b[~long], piece[~long], segment[~long]
        rank = self.rank[piece]
        while len(a):
            mid = after[a]
            inside = mid < b
            two = inside & (after[np.minimum(mid, n - 1)] == b)
            if not two.any():
                break
            at = np.flatnonzero(two)
            best = at[np.lexsort((a[at], rank[at], segment[at]))]
            first = np.ones(len(best), bool)
            first[1:] = segment[best[1:]] != segment[best[:-1]]
            best = best[first]
            symbol[mid[best]] = -1
            after[a[best]], symbol[a[best]] = b[best], piece[best]
            # An edge stays while both its ends are symbol borders and it spans two or more.
            live = np.zeros(len(starts), bool)
            live[segment[best]] = True
            keep = live[segment] & (symbol[a] != -1) & ((b == n) | (symbol[np.minimum(b, n - 1)] != -1)) & (after[a] < b)
            a, b, piece, rank, segment = a[keep], b[keep], piece[keep], rank[keep], segment[keep]
        return symbol

    def _heap(self, a, b, piece, after, symbol, lo: int, hi: int) -> None:
        found = {(x, y): p for x, y, p in zip(a.tolist(), b.tolist(), piece.tolist(), strict=True)}
        nxt = list(range(1, hi - lo + 1))
        prev = list(range(-1, hi - lo - 1))
        alive = [True] * (hi - lo)
        heap: list = []

        def offer(i: int) -> None:
            if 0 <= i and nxt[i] < hi - lo:
                end = nxt[nxt[i]]
                p = found.get((lo + i, lo + end))
                if p is not None:
                    heapq.heappush(heap, (int(self.rank[p]), i, nxt[i], end, p))

        for i in range(hi - lo):
            offer(i)
        while heap:
            _, i, mid, end, p = heapq.heappop(heap)
            if not alive[i] or nxt[i] != mid or mid >= hi - lo or not alive[mid] or nxt[mid] != end:
                continue
            nxt[i], alive[mid] = end, False
            if end < hi - lo:
                prev[end] = i
            symbol[lo + i], symbol[lo + mid] = p, -1
            after[lo + i] = lo + end
            offer(i)
            offer(prev[i])

    def encode_segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct segments, spaces still plain."""
        chars = np.frombuffer(b"".join(texts).decode("utf-8").replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        starts = heads[np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]].astype(np.int64)
        n = len(chars)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        codes = self._codes(chars)
        symbol = self.relax(n, starts, self.edges(codes, ends))
        alone = symbol == -2
        symbol[alone] = np.where(codes[alone] == 0xFFFE, -3, self.single_of[np.minimum(codes[alone].astype(np.int64) - 1, len(self.single_of) - 1)])
        symbol[alone & (symbol == -1)] = -3
        strange = np.flatnonzero(symbol == -3)
        at = np.flatnonzero(symbol != -1)
        count = np.ones(len(at), np.int64)
        ids = symbol[at]
        if len(strange):
            spelled = {int(i): self.bytes_at[list(chr(chars[i]).encode("utf-8", "surrogatepass"))] for i in strange}
            place = np.searchsorted(at, strange)
            count[place] = [len(spelled[int(i)]) for i in strange]
            ids = np.repeat(ids, count)
            where = np.concatenate([[0], np.cumsum(count)])
            for i, p in zip(strange.tolist(), place.tolist(), strict=True):
                ids[where[p] : where[p + 1]] = spelled[i]
        filled = np.concatenate([[0], np.cumsum(count)])
        return ids, filled[np.searchsorted(at, np.append(starts, n))]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each text."""
        raw = [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else t for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [np.zeros(0, np.int32)] * len(texts)
        blank = data == 32
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(data))
        inverse, first, _ = distinct(data, start, end)
        whole = data.tobytes()
        ids, at = self.encode_segments([whole[start[i] : end[i]] for i in first])
        n = np.diff(at)[inverse]
        out = ids[np.repeat(at[inverse] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        edge = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offsets)]
        return [out[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


class Decoder:
    def __init__(self, vocab: Vocabulary):
        made = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.encode() for p, k in zip(vocab.pieces, vocab.kinds, strict=True)]
        made = [m.replace(SPACE.encode(), b" ") for m in made]
        self.flat = np.frombuffer(b"".join(made), np.uint8)
        self.size = np.array([len(m) for m in made], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        raw = self.flat[np.repeat(self.at[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_REPORT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def _encoded(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[tuple[bytes, np.ndarray]]:
    for first, end, offsets, data in text_blocks(batch, limit=BLOCK):
        raw = data.tobytes()
        texts = [raw[offsets[i] : offsets[i + 1]] for i in range(end - first)]
        yield from zip(texts, encoder.encode(texts), strict=True)


def _encode_pass(vocab: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for batch in batches:
            missing = batch.column(1).is_null().to_pylist()
            yield arrow_batch(_IDS, [batch.column(0), [None if gone else ids for gone, (_, ids) in zip(missing, _encoded(batch, encoder), strict=True)]])

    return run


def _report_pass(vocab: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocab), Decoder(vocab)
        for batch in batches:
            rows = []
            for text, ids in _encoded(batch, encoder):
                back = decoder.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text))
            yield arrow_batch(_REPORT, [batch.column(0), *([r[i] for r in rows] for i in range(4))])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_texts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids): the piece ids of every text."""
    return _texts(docs).mapInArrow(_encode_pass(Vocabulary.load(model)), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null text."""
    vocab = Vocabulary.load(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocab)
        for batch in batches:
            texts = [decoder.decode(np.array(x.as_py(), np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in batch.column(1)]
            yield arrow_batch(schema, [batch.column(0), texts])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def piece_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, digests of the ids (little-endian int32) and of the decoded text, round_trip."""
    return _texts(docs).mapInArrow(_report_pass(Vocabulary.load(model)), "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
