"""Language-model scores: a weighted backoff automaton over smoothed n-grams.

The model is interpolated: with mass m, P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), h' being
h without its first word; below that P(w) = (c + 0.5) / (N + 0.5 (V + 1)), which leaves one
share for all unknown words. Every level sums to one. Nothing seen in training is pruned.

As an automaton: a state is an n-gram of up to ``order`` - 1 words that training holds. An arc
of a state reads a word that followed it there and carries log10 P; every other word takes the
failure arc, which carries log10 m / (c(h) + m), to the state without the first word, and
tries again; the root has an arc for every word. One traversal from left to right carries the
state and adds up the weights. The texts of a block go in step, and a text above ``PIECE``
tokens in pieces that read the ``order`` - 1 tokens before them first, which is all that a
state can remember.

Plan: documents are dealt into blocks of text by a hash of the whole row. A block posts its
distinct n-grams with their training counts, packed by ranges of a hash; a shard adds up
each n-gram of its range and answers every block with the totals of what it posted. An n-gram
is one posting a block however often it occurs, so no n-gram is hot. A block then has all
counts its own texts can ask for, builds that part of the automaton and walks its texts. The
model as a whole is nowhere in one place; the driver sees N, V and the number of training
documents. Words are counted as they are; longer n-grams by 64-bit hashes. ``BLOCK`` and
``SHARD`` bound what a task holds; at 100 TB take 16 times both, so that the pieces between
blocks and shards stay long.

Edge cases: a null text is empty and has its end token only. A null id counts as an empty one
where rows are held out. Rows that repeat an id are texts of their own. Without training rows
N and V are 0 and every word is unknown, with probability 1. A very long text is a block of
its own. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import IS_SPACE, LOWER, mix, parallelism, text_blocks, write_table
from tarnwork.llm.words import distinct, spans

ORDER = 2
MASS = 128.0  # pseudo-counts that the shorter history gets
BLOCK = 16 << 20  # bytes of text a block, about
SHARD = 32 << 20  # bytes of text a shard of n-grams, about
PIECE = 4096  # tokens walked in one go

_MARKS = mix(np.array([1, 2], dtype=np.uint64))  # hashes of the end and of the beginning

_POSTED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("level", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOTALS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("level", pa.int64()), ("totals", pa.binary()), ("tokens", pa.int64()), ("known", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_KINDS = {pa.int64(): "LONG", pa.binary(): "BINARY", pa.string(): "STRING", pa.bool_(): "BOOLEAN", pa.float64(): "DOUBLE"}
_spark = lambda schema: ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of one rank, which is what compresses of sorted or small ones."""
    return zstandard.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


@dataclass
class Grams:
    """The distinct n-grams of a block of texts, by level; level 1 are its words, the end and (last) the beginning."""

    seq: np.ndarray  # words of all texts, each between its beginning and its end
    text: np.ndarray  # the text of each
    words: list[bytes]  # by code; b"" is the end
    at: list[np.ndarray]  # by level: the n-gram that ends at each place of seq, -1 if none
    first: list[np.ndarray]  # by level: one place of each n-gram
    order: list[np.ndarray]  # by level: n-grams in order of key
    keys: list[np.ndarray]  # by level: 64-bit keys in that order


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> Grams:
    """All n-grams of up to ``order`` words of lower-cased texts."""
    n = len(offsets) - 1
    low = LOWER[data]
    start, end, text = spans(low, offsets, ~IS_SPACE)
    code, first, hashed = distinct(low, start, end)
    raw = low.tobytes()
    words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)] + [b""]
    size = np.bincount(text, minlength=n) + 2
    begin = np.cumsum(size) - size
    seq = np.full(int(size.sum()), len(words) - 1)
    seq[begin] = len(words)
    seq[np.arange(len(code)) + 2 * text + 1] = code
    of = np.repeat(np.arange(n), size)
    place = np.arange(len(seq)) - begin[of]
    hashes = np.concatenate([hashed, _MARKS])
    rank = np.argsort(hashes[:-1], kind="stable")
    if (np.diff(hashes[rank]) == 0).any():  # the order of words of one hash must not hang on the block
        rank = np.array(sorted(rank.tolist(), key=lambda i: (hashes[i], words[i])))
    one = np.zeros(len(words) + 1, np.int64)
    one[seq[::-1]] = np.arange(len(seq) - 1, -1, -1)
    out = Grams(seq, of, words, [seq], [one], [rank], [hashes[rank]])
    longer = hashes
    for level in range(2, order + 1):
        ends = np.flatnonzero(place >= level - 1)
        pair = out.at[-1][ends - 1] * (len(words) + 1) + seq[ends]
        _, where, inverse = np.unique(pair, return_index=True, return_inverse=True)
        at = np.full(len(seq), -1)
        at[ends] = inverse
        spot = ends[where]
        longer = mix(longer[out.at[-1][spot - 1]] * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[seq[spot]] + np.uint64(level)))
        by_key = np.argsort(longer, kind="stable")
        for held, value in ((out.at, at), (out.first, spot), (out.order, by_key), (out.keys, longer[by_key])):
            held.append(value)
    return out


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of a whole table."""
    parts = [part for batch in table.combine_chunks().to_batches() for part in text_blocks(batch, "text", 1 << 62)]
    ends = np.cumsum([0, *(len(data) for *_, data in parts)])
    offsets = [offsets[:-1] + e for (_, _, offsets, _), e in zip(parts, ends, strict=False)]
    return np.concatenate([np.zeros(0, np.uint8), *(data for *_, data in parts)]), np.concatenate([*offsets, ends[-1:]]).astype(np.int64)


def _post(order: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block, g = table.column("block")[0].as_py(), grams(*_texts(table), order)
        train = ~table.column("held_out").to_numpy()[g.text]
        made = []
        for level in range(order):
            used = train & (g.at[level] >= 0)
            counts = np.bincount(g.at[level][used], minlength=len(g.first[level]))[g.order[level]]
            keys = g.keys[level]
            shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
            for a, b in zip(cuts, cuts[1:], strict=False):
                named = zstandard.compress(b"\n".join(g.words[i] for i in g.order[0][a:b])) if level == 0 else _pack(keys[a:b])
                made.append((int(shard[a]), block, level, named, _pack(counts[a:b])))
        return pa.Table.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(_POSTED)], schema=_POSTED)

    return run


def _total(table: pa.Table) -> pa.Table:
    """What every block posted to one shard, answered with the totals of all blocks."""
    made = []
    for level in sorted(set(table.column("level").to_pylist())):
        rows = [r for r in table.select(["block", "level", "shard", "keys", "counts"]).to_pylist() if r["level"] == level]
        counts = [_unpack(r["counts"]).astype(np.int64) for r in rows]
        if level == 0:
            total: Counter[bytes] = Counter()
            named = [zstandard.decompress(r["keys"]).split(b"\n") for r in rows]
            for words, n in zip(named, counts, strict=True):
                for word, k in zip(words, n.tolist(), strict=True):
                    total[word] += k
            answers = [np.array([total[w] for w in words]) for words in named]
            tokens, known = sum(total.values()), sum(k > 0 for k in total.values())
        else:
            keys, inverse = np.unique(np.concatenate([_unpack(r["keys"]) for r in rows]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, inverse, np.concatenate(counts))
            answers = np.split(sums[inverse], np.cumsum([len(c) for c in counts])[:-1])
            tokens = known = 0
        for k, (r, answer) in enumerate(zip(rows, answers, strict=True)):
            made.append((r["block"], r["shard"], level, _pack(answer), 0 if k else tokens, 0 if k else known))
    return pa.Table.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(_TOTALS)], schema=_TOTALS)


@dataclass
class Automaton:
    """States are numbered; 0 is the root. Arcs are sorted by state * width + word."""

    width: int
    arcs: np.ndarray
    weight: np.ndarray
    then: np.ndarray
    root_weight: np.ndarray
    root_then: np.ndarray
    failure: np.ndarray
    failure_weight: np.ndarray
    start: int


def build(g: Grams, counts: list[np.ndarray], tokens: int, known: int, texts: int, mass: float) -> Automaton:
    """The automaton of one block's n-grams; ``counts`` by level and n-gram, ``texts`` of the training rows."""
    width = len(g.words) + 1
    held = [np.append(counts[0], texts), *counts[1:]]  # the beginning was seen once a text
    base = (counts[0] + 0.5) / (tokens + 0.5 * (known + 1))
    p = [np.append(base, 1.0)]
    levels = len(counts)
    number, first, states = [], 1, [np.zeros(1, np.int64)]
    for level in range(max(1, levels - 1)):  # histories that training holds
        seen = held[level] > 0 if levels > 1 else np.zeros(width, bool)
        ids = np.zeros(len(seen), np.int64)
        ids[seen] = first + np.arange(int(seen.sum()))
        first += int(seen.sum())
        number.append(ids)
    failure, failure_weight = np.zeros(first, np.int64), np.zeros(first)
    arcs, weight, then = [], [], []
    for level in range(levels):
        ids = np.flatnonzero(held[level] > 0)
        spot = g.first[level][ids]
        if level:
            parent, suffix = g.at[level - 1][spot - 1], g.at[level - 1][spot]
            p.append(np.zeros(len(held[level])))
            p[level][ids] = (held[level][ids] + mass * p[level - 1][suffix]) / (held[level - 1][parent] + mass)
            arcs.append(number[level - 1][parent] * width + g.seq[spot])
            weight.append(np.log10(p[level][ids]))
            then.append(number[level][ids] if level < levels - 1 else number[level - 1][suffix])
        if level < levels - 1:
            mine = number[level][ids]
            failure[mine] = number[level - 1][g.at[level - 1][spot]] if level else 0
            failure_weight[mine] = np.log10(mass / (held[level][ids] + mass))
    joined = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((arcs, np.int64), (weight, np.float64), (then, np.int64))]
    order = np.argsort(joined[0])
    return Automaton(width, *(x[order] for x in joined), np.log10(base), number[0][:-1], failure, failure_weight, int(number[0][-1]))


def walk(a: Automaton, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The log10 probability of every tokens[begin:end] from ``state``, of the places from ``counted`` on; all go in step."""
    by_size = np.argsort(begin - end, kind="stable")
    begin, counted, state = begin[by_size], counted[by_size], state[by_size].copy()
    size = (end[by_size] - begin).astype(np.int64)
    total = np.zeros(len(begin))
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -step, side="left"))  # those longer than step
        word, here = tokens[begin[:live] + step], state[:live].copy()
        gained, todo = np.zeros(live), np.arange(live)
        while len(todo):
            root = here[todo] == 0
            done = todo[root]
            gained[done] += a.root_weight[word[done]]
            state[done] = a.root_then[word[done]]
            todo = todo[~root]
            wanted = here[todo] * a.width + word[todo]
            at = np.minimum(np.searchsorted(a.arcs, wanted), max(0, len(a.arcs) - 1))
            hit = a.arcs[at] == wanted if len(a.arcs) else np.zeros(len(todo), bool)
            done = todo[hit]
            gained[done] += a.weight[at[hit]]
            state[done] = a.then[at[hit]]
            todo = todo[~hit]
            gained[todo] += a.failure_weight[here[todo]]
            here[todo] = a.failure[here[todo]]
        total[:live] += np.where(begin[:live] + step >= counted[:live], gained, 0.0)
    out = np.empty(len(total))
    out[by_size] = total
    return out


def _score(order: int, mass: float, tokens: int, known: int, texts: int, piece: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, totals: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCORED.empty_table()
        g = grams(*_texts(table), order)
        answers = sorted(totals.to_pylist(), key=lambda r: r["shard"])
        counts = []
        for level in range(order):
            found = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["totals"]) for r in answers if r["level"] == level)])
            counts.append(np.zeros(len(g.order[level]), np.int64))
            counts[level][g.order[level]] = found
        automaton = build(g, counts, tokens, known, texts, mass)
        n = table.num_rows
        begin = np.flatnonzero(g.seq == len(g.words)) + 1  # after the beginning of each text
        end = np.append(begin[1:] - 1, len(g.seq))
        pieces = -(-(end - begin) // piece)
        of = np.repeat(np.arange(n), pieces)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        counted = begin[of] + turn * piece
        read = np.maximum(begin[of], counted - (order - 1))
        state = np.where(read == begin[of], automaton.start, 0)
        score = np.bincount(of, walk(automaton, g.seq, read, np.minimum(end[of], counted + piece), state, counted), n)
        said = g.seq != len(g.words)
        word, text = g.seq[said], g.text[said]
        base = np.bincount(text, automaton.root_weight[word], n)
        heard = np.bincount(text, counts[0][word] > 0, n).astype(np.int64)
        return pa.table([table.column("doc_id"), table.column("held_out"), end - begin, heard, base, score], schema=_SCORED)

    return run


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER, mass: float = MASS, block: int = BLOCK, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every (doc_id, text); training takes the rows not held out."""
    ident = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    width = parallelism(docs.sparkSession)
    blocks, shards = max(width, -(-size // block)), max(width, -(-size // shard))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    posted = dealt.groupBy("block").applyInArrow(_post(order, shards), _spark(_POSTED))
    totals = write_table(posted.groupBy("shard").applyInArrow(_total, _spark(_TOTALS)), "lm-totals")
    tokens, known = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    both = dealt.groupBy("block").cogroup(totals.select("block", "shard", "level", "totals").groupBy("block"))
    scored = both.applyInArrow(_score(order, mass, tokens, known, texts, piece), _spark(_SCORED))
    return scored.select(F.col("doc_id").cast(ident).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def remainder(ident: str, n: int) -> Column:
    """The CRC-32 of an id as text, modulo ``n``."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit(""))) % n
