"""The k best references of queries by matrix products of small tiles, exact to the digits that count."""

from __future__ import annotations

import numpy as np

DIGITS = 9  # similarities equal to so many places are ties
QUERIES = 512  # query vectors a tile
REFS = 2_048  # reference vectors a tile, at most
FIRST = 128  # reference vectors of the first tile, which has no candidates yet and is scored whole; the next ones double
_FEW = 64  # candidates a query and tile, above which a tile is scored whole
_WAITING = 2  # candidates a query, above which they are ranked and the bound rises
_NONE = np.zeros(0, np.int64)


def _first_k(row: np.ndarray, ref: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, ref, sim), in any order, the k best a row: by similarity, then by ref."""
    order = np.lexsort((ref, -sim, row))
    row, ref, sim = row[order], ref[order], sim[order]
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else _NONE
    place = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    keep = place < k
    return row[keep], ref[keep], sim[keep]


def _hide(sims: np.ndarray, own: tuple[np.ndarray, np.ndarray], same: np.ndarray | None) -> None:
    sims[own] = -np.inf
    if same is not None:
        np.copyto(sims, -np.inf, where=same)


def _spans(n: int) -> list[tuple[int, int]]:
    """Where the tiles of n references begin and end."""
    spans, at, size = [], 0, min(FIRST, REFS)
    while at < n:
        spans.append((at, min(at + size, n)))
        at, size = at + size, min(2 * size, REFS)
    return spans


def _places(flags: np.ndarray) -> np.ndarray:
    """Flat places of the few true flags of a matrix, by eight flags at once."""
    flat = flags.ravel()
    whole = len(flat) - len(flat) % 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = np.concatenate([(8 * words[:, None] + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return at[flat[at]]


def _whole(q: np.ndarray, bank: np.ndarray, own: tuple[np.ndarray, np.ndarray], same: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sim) of the k best of one tile; the smaller column on ties."""
    sims = np.round(q @ bank.T, DIGITS)
    _hide(sims, own, same)
    sims[~np.isfinite(sims)] = -np.inf
    k = min(k, len(bank))
    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
    above, equal = sims > least, (sims == least) & np.isfinite(sims)
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)
    row, column = np.nonzero(above | equal)
    return row, column, sims[row, column]


def best(q_ids: np.ndarray, q: np.ndarray, ref_ids: np.ndarray, bank: np.ndarray, k: int, q_tags: np.ndarray | None = None, ref_tags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q_id, ref_id, sim) of the k most similar references of each query, ties to the smaller ref_id.

    Vectors are rows of unit length. A reference with the query's own id is left out, and
    so, with tags, is one with the same tag (no tag, None, is the same as none). A tile's
    products in single precision only choose candidates, by a bound that no rounding of
    unit vectors crosses; these are scored in double precision. A tile with many
    candidates, as in a group of copies, is scored whole. So memory is a few tiles,
    whatever the numbers of queries and references.
    """
    if not len(q_ids) or not len(ref_ids):
        return _NONE, _NONE, np.zeros(0)
    order = np.argsort(ref_ids, kind="stable")
    ref_ids, bank = ref_ids[order], bank[order]
    small, slack = bank.astype(np.float32), bank.shape[1] * 2.5e-7 + 1e-6
    if q_tags is not None:
        codes = {t: i for i, t in enumerate(dict.fromkeys([*q_tags, *ref_tags]))}
        q_codes, ref_codes = (np.array([codes[t] for t in tags], np.int32) for tags in (q_tags, ref_tags[order]))
    found, spans = [], _spans(len(ref_ids))
    for lo in range(0, len(q_ids), QUERIES):
        part, ids = q[lo : lo + QUERIES], q_ids[lo : lo + QUERIES]
        few = part.astype(np.float32)
        held, waiting = [(_NONE, _NONE, np.zeros(0))], 0
        least = np.full(len(ids), np.finfo(np.float32).min)  # a hidden reference is below it
        first, last = np.searchsorted(ref_ids, ids, "left"), np.searchsorted(ref_ids, ids, "right")
        own_row = np.repeat(np.arange(len(ids)), last - first)
        own_ref = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True) if b > a] or [_NONE])
        for at, end in spans:
            tile = slice(at, end)
            here = (own_ref >= at) & (own_ref < end)
            own = (own_row[here], own_ref[here] - at)
            same = None if q_tags is None else q_codes[lo : lo + QUERIES, None] == ref_codes[None, tile]
            rough = few @ small[tile].T
            _hide(rough, own, same)
            flags = rough >= least[:, None]
            many = np.count_nonzero(flags)
            if many > _FEW * len(ids):
                r, c, s = _whole(part, bank[tile], own, same, k)
            elif many:
                r, c = np.divmod(_places(flags), end - at)
                s = np.round(np.einsum("ij,ij->i", part[r], bank[at + c]), DIGITS)
                sure = np.isfinite(s)
                r, c, s = r[sure], c[sure], s[sure]
            else:
                continue
            held.append((r, at + c, s))
            waiting += len(r)
            if waiting > _WAITING * len(ids):
                held, waiting = [_first_k(*map(np.concatenate, zip(*held, strict=True)), k)], 0
                row, _, sim = held[0]
                full = np.flatnonzero(np.bincount(row, minlength=len(ids)) == k)
                ends = np.searchsorted(row, full, "right") - 1
                least[full] = (sim[ends] - slack).astype(np.float32)
        row, ref, sim = _first_k(*map(np.concatenate, zip(*held, strict=True)), k)
        found.append((ids[row], ref_ids[ref], sim))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
