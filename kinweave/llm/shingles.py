"""Word shingles, set digests and SuperMinHash signatures over whole batches of texts in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix64, min_labels

_M = np.uint64(0x9E3779B97F4A7C15)
#: Elements whose permutations are held at once.
ELEMENTS = 60_000


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then words [^\\x20\\x09-\\x0D]+: what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Per text, its distinct k-word shingles as sorted 64-bit hashes; with fewer words the whole sequence is one."""
    lists = [words(t) for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in lists for w in x), dtype=np.uint64, count=int(n.sum()))
    with np.errstate(over="ignore"):
        acc = mix64(flat + _M)
        if len(flat) >= k:
            acc = acc[: len(flat) - k + 1]
            for i in range(1, k):
                acc = mix64(acc * _M + flat[i : len(flat) - k + 1 + i])
        out, at = [], 0
        for m in n.tolist():
            if m >= k:
                out.append(np.unique(acc[at : at + m - k + 1]))
            elif m:
                h = np.uint64(m)
                for x in flat[at : at + m]:
                    h = mix64(np.array([h], dtype=np.uint64) * _M + x)[0]
                out.append(np.array([h], dtype=np.uint64))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += m
    return out


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set that do not depend on order."""
    with np.errstate(over="ignore"):
        one = [mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets]
        two = [mix64(s * _M + np.uint64(0x1234567)).sum(dtype=np.uint64) for s in sets]
    return np.array(one, dtype=np.uint64).view(np.int64), np.array(two, dtype=np.uint64).view(np.int64)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl, 2017), one row of m doubles per non-empty set.

    Every element walks its own pseudo-random permutation of the m slots and offers slot p(j) the value j + u. A
    step j can only lower slots that still hold more than j, so a set stops after the first step at which all of
    its slots hold less than j + 1; sets of hundreds of elements stop after two or three.
    """
    out = np.empty((len(sets), m))
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= ELEMENTS):
            size += len(sets[to])
            to += 1
        out[at:to] = _signatures(sets[at:to], m)
        at = to
    return out


def _signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    sig = np.full(len(sets) * m, np.inf)
    kind = np.uint8 if m <= 256 else np.uint16
    # a very long set is fed in parts: minima over parts are minima over the whole
    parts = [(d, s[i : i + ELEMENTS]) for d, s in enumerate(sets) for i in range(0, len(s), ELEMENTS)]
    runs, held = [[]], 0
    for d, s in parts:
        if held + len(s) > ELEMENTS and runs[-1]:
            runs.append([])
            held = 0
        runs[-1].append((d, s))
        held += len(s)
    for run in runs:
        if not run:
            continue
        elem = np.concatenate([s for _, s in run])
        doc = np.repeat(np.array([d for d, _ in run]), [len(s) for _, s in run])
        perm = np.tile(np.arange(m, dtype=kind), (len(elem), 1))
        with np.errstate(over="ignore"):
            for j in range(m):
                r = mix64(elem + np.uint64(j + 1) * _M)
                k = j + ((mix64(r ^ _M) >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
                rows = np.arange(len(elem))
                slot = perm[rows, k].astype(np.int64)
                perm[rows, k] = perm[:, j]
                np.minimum.at(sig, doc * m + slot, j + (r >> np.uint64(11)).astype(np.float64) * 2.0**-53)
                live = np.flatnonzero(sig.reshape(-1, m).max(axis=1) >= j + 1)
                stay = np.isin(doc, live)
                if not stay.any():
                    break
                if not stay.all():
                    elem, doc, perm = elem[stay], doc[stay], perm[stay]
    return sig.reshape(-1, m)


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit hash per band of each signature; the band's number is part of it."""
    n, m = signatures.shape
    v = np.ascontiguousarray(signatures).view(np.uint64).reshape(n, bands, m // bands)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64) + _M), (n, bands)).copy()
        for r in range(m // bands):
            acc = mix64(acc * _M + v[:, :, r])
    return acc.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """One byte per slot: equal slots have equal bytes, others do by chance in 1 of 256."""
    return (mix64(np.ascontiguousarray(signatures).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def shared(s: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(s) or not len(other):
        return 0
    at = np.minimum(np.searchsorted(other, s), len(other) - 1)
    return int((other[at] == s).sum())


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of left with right (or with left). Elements that only one set has are left out,
    the rest become columns of 0/1 matrices that are multiplied a few thousand columns at a time."""
    own = right is None
    both = left if own else left + right
    n, sizes = len(both), [len(s) for s in both]
    flat, rows = np.concatenate(both), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    new = np.append(True, flat[1:] != flat[:-1])
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    rows, col = rows[keep], (np.cumsum(shared) - 1)[col[keep]]
    a = len(left)
    out = np.zeros((a, a if own else n - a), dtype=np.float32)
    step = max(512, 2_000_000 // n)
    cuts = np.searchsorted(col, np.arange(0, int(shared.sum()) + step, step))
    for c in range(len(cuts) - 1):
        x = np.zeros((n, step), dtype=np.float32)
        x[rows[cuts[c] : cuts[c + 1]], col[cuts[c] : cuts[c + 1]] - c * step] = 1
        out += x[:a] @ (x if own else x[a:]).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with 100 * intersection >= percent * union, exact."""
    inter = intersections(left, right).astype(np.int64)
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (left if right is None else right)])[None, :]
    i, j = np.nonzero(100 * inter >= percent * (a + b - inter))
    if right is None:
        return i[i < j], j[i < j]
    return i, j


__all__ = ["band_hashes", "intersections", "linked", "min_labels", "set_digests", "shared", "shingle_sets", "sketches", "super_minhash", "words"]
