"""Substring deduplication by seed and extend: winnowed anchors, extension both ways, maximal repeated runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, join_split, mix64, slices, texts

_M = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Words of an anchor. Windows of `length` words then hold length - ANCHOR + 1 of them, of which the least is chosen.
ANCHOR = 5


class _Words:
    """Words of several texts in a row, with hashes of any range of them from one prefix sum."""

    def __init__(self, texts: list[str | None]) -> None:
        self.lists = [t.encode("utf-8").split() if t else [] for t in texts]
        self.n = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        total = int(self.start[-1])
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in self.lists for w in x), dtype=np.uint64, count=total)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        with np.errstate(over="ignore"):
            self.up, self.down = np.ones(total + 1, dtype=np.uint64), np.ones(total + 1, dtype=np.uint64)
            np.cumprod(np.full(total, _M), out=self.up[1:])
            np.cumprod(np.full(total, _INV), out=self.down[1:])
            self.sum = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.hash * self.up[:-1], dtype=np.uint64)])

    def range_hash(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """64-bit hashes of the words a to b - 1, wherever they stand."""
        with np.errstate(over="ignore"):
            return mix64((self.sum[b] - self.sum[a]) * self.down[a] + (b - a).astype(np.uint64) * _INV + np.asarray(salt).astype(np.uint64) * _M)

    def second_hash(self, a: np.ndarray, length: int) -> np.ndarray:
        """A second hash of the `length` words from a, independent of the first."""
        with np.errstate(over="ignore"):
            acc = np.zeros(len(a), dtype=np.uint64)
            for i in range(length):
                acc = mix64(acc * _INV + self.hash[a + i])
        return acc

    def anchors(self, length: int) -> np.ndarray:
        """Positions of the anchors that winnowing chooses: in every window of `length` words, its least ANCHOR-gram."""
        w = length - ANCHOR + 1
        total = int(self.start[-1])
        if total < length:
            return np.empty(0, dtype=np.int64)
        gram = self.range_hash(np.arange(total - ANCHOR + 1), np.arange(ANCHOR, total + 1))
        first = np.flatnonzero(self.doc[: total - length + 1] == self.doc[length - 1 :])
        view = np.lib.stride_tricks.sliding_window_view(gram[::-1], w)[::-1]
        return np.unique(first + (w - 1 - view[first].argmin(axis=1)))


def _anchored(length: int, anchors_only: bool = False):
    """Seeds of each document; with anchors_only, just each document's distinct anchors."""
    side = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = _Words(part.column("text").to_pylist())
                p = w.anchors(length)
                d = w.doc[p]
                if anchors_only:
                    pair = np.stack([d, w.range_hash(p, p + ANCHOR).view(np.int64)])
                    d, anchor = np.unique(pair, axis=1) if len(p) else pair
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(anchor)], names=["doc_id", "anchor"])
                    continue
                a, b = np.maximum(w.start[d], p - side), np.minimum(w.start[d + 1], p + length)
                anchor, context = w.range_hash(p, p + ANCHOR), w.range_hash(a, b, (p - a) * 64 + (b - p))
                # a document's equal seeds travel as one row
                order = np.lexsort((p, context, anchor, d))
                p, d, anchor, context = p[order], d[order], anchor[order], context[order]
                new = np.append(True, (d[1:] != d[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))[: len(p)]
                head, pos = np.flatnonzero(new), (p - w.start[d]).astype(np.int32)
                size = np.diff(np.append(head, len(p)))
                ends = np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[~new]), mask=pa.array(size == 1))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[d[head]]), pa.array(pos[head]), rest, pa.array(anchor[head].view(np.int64)), pa.array(context[head].view(np.int64))], names=["doc_id", "pos", "rest", "anchor", "context"])

    return run


def _windowed(length: int):
    """For seeds of a document that stay open: all windows that hold them, with two hashes."""
    side = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = _Words(part.column("text").to_pylist())
                at: list[np.ndarray] = []
                for d, (seeds, done) in enumerate(zip(part.column("opened").to_pylist(), part.column("covered").to_pylist(), strict=True)):
                    s = (np.array(seeds, dtype=np.int64)[:, None] - np.arange(side + 1)[None, :]).ravel()
                    todo = np.zeros(w.n[d] + 1, dtype=bool)
                    todo[s[(s >= 0) & (s + length <= w.n[d])]] = True
                    c = (np.array(done, dtype=np.int64)[:, None] - np.arange(side + 1)[None, :]).ravel()
                    todo[c[c >= 0]] = False  # inside a covered context, so known to be a repeat
                    at.append(w.start[d] + np.flatnonzero(todo))
                s = np.concatenate(at)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.doc[s]]), pa.array((s - w.start[w.doc[s]]).astype(np.int32)), pa.array(w.range_hash(s, s + length).view(np.int64)), pa.array(w.second_hash(s, length).view(np.int64))], names=["doc_id", "pos", "w1", "w2"])

    return run


def _kept(length: int, digest: bool):
    side = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                total, gone, text = [], [], []
                for t, seeds, starts in zip(*(part.column(c).to_pylist() for c in ("text", "covered", "windows")), strict=True):
                    words = t.encode("utf-8").split() if t else []
                    n = len(words)
                    edge = np.zeros(n + 1, dtype=np.int64)
                    if seeds:
                        p = np.array(seeds, dtype=np.int64)
                        np.add.at(edge, np.maximum(0, p - side), 1)
                        np.add.at(edge, np.minimum(n, p + length), -1)
                    if starts:
                        p = np.array(starts, dtype=np.int64)
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + length, -1)
                    stay = np.cumsum(edge[:n]) == 0
                    total.append(n)
                    gone.append(n - int(stay.sum()))
                    kept = b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)])
                    text.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(text, type=pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space; with digest
    its SHA-256 as kept_sha256 instead).

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if some window of `length` consecutive words that covers it
    starts in a document with a smaller id too. Windows are judged on the input. Null and empty texts have no
    words. Rows with a null id neither lose words nor make others lose them. Repeated rows of one id are one document
    and share one result. Ties cannot arise. An empty table gives an empty result. Other columns are not read.

    Plan. Seed: winnowing picks, from each window's content alone, one anchor in it, so two equal windows share
    their anchor; about a fifth of the words start one. A first pass counts anchors with map-side minima and keeps
    those of several documents; only their seeds go on, each with a hash of the context to both sides within reach of a
    window. Extend: where that whole context already stood in a smaller document, all windows around the anchor are
    repeats; this settles the inside of long repeats without comparing pairs of documents. Only seeds of anchors with
    several contexts stay open, mostly at ends of repeats: they spell out their windows, which are compared by
    128-bit hash with a pre-aggregated minimum (windows inside a settled context are left out: the smallest document
    that has a window never holds it in a settled context). Overlapping repeats merge into maximal runs.
    Copies of a passage never meet in pairs: each key keeps its smallest document only, and rows of a common
    anchor, context or window take its minimum from a broadcast, so they never meet in one task.
    """
    if length <= ANCHOR or length > 40:
        raise ValueError(f"length must be {ANCHOR + 1} to 40")
    base = texts(docs, id_col, text_col)
    known = base.where("doc_id is not null")
    marks = cut(_marks(known, length))
    limit = max(1.0, (marks.agg(F.sum(F.size("opened"))).first()[0] or 0) * (length - ANCHOR + 1) * HOT_SHARE)
    # the three joins below read one shuffle of the texts
    opened = known.join(marks.where("size(opened) > 0"), "doc_id")
    windows = opened.select("doc_id", "text", "covered", "opened").mapInArrow(_windowed(length), "doc_id long, pos int, w1 long, w2 long")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    again = join_split(windows, first, ["w1", "w2"], "n", limit, F.col("doc_id")).where("least < doc_id").groupBy("doc_id").agg(F.collect_set("pos").alias("windows"))
    judged = known.join(marks.select("doc_id", "covered"), "doc_id", "left").join(again, "doc_id", "left")
    spared = base.where("doc_id is null").withColumns({c: F.lit(None).cast("array<int>") for c in ("covered", "windows")})
    return judged.unionByName(spared).select("doc_id", "text", "covered", "windows").mapInArrow(
        _kept(length, digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string")


def _marks(known: DataFrame, length: int) -> DataFrame:
    """Per document with shared anchors, positions of covered and of opened seeds: doc_id, covered, opened."""
    anchors = known.mapInArrow(_anchored(length, anchors_only=True), "doc_id long, anchor long")
    shared = cut(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n"))
    limit = max(1.0, (shared.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    seeds = known.mapInArrow(_anchored(length), "doc_id long, pos int, rest array<int>, anchor long, context long")
    own = F.xxhash64("doc_id", "pos")
    live = cut(join_split(seeds, shared, ["anchor"], "n", limit, own))
    context = live.groupBy("anchor", "context").agg(F.min("doc_id").alias("same"), F.count("*").alias("n"))
    # an anchor is open if some context of it first stands in another document than the anchor itself
    open_ = context.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select("anchor", "n", F.lit(True).alias("open"))
    seen = join_split(join_split(live, context, ["anchor", "context"], "n", limit, own), open_, ["anchor"], "n", limit, own, "left")
    seen = seen.where("same < doc_id or open").select("doc_id", F.explode(F.expr("concat(array(pos), coalesce(rest, array()))")).alias("pos"), F.expr("same < doc_id").alias("done"))
    return seen.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("done"), F.col("pos"))).alias("covered"), F.collect_list(F.when(~F.col("done"), F.col("pos"))).alias("opened"))
