"""Byte-level BPE encoding and decoding with contiguous rank arrays, for whole batches of words at a time."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts

#: Fixed value: the pre-tokenising pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of up to SHORT bytes are merged in rank arrays, longer ones with a heap. A worker caches the first CACHE words it
#: meets, in which common words are; nothing is evicted.
SHORT, CACHE = 48, 120_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others in turn for the code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode("utf-8") for t, i in self.special.items()})
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self._key, self._rank = key[order], order.astype(np.int32)
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._rank_of = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[bytes, int, bytes]] = {}

    def ids_are_ranks(self) -> bool:
        """Whether a lower id always merges first, so that ids can serve as ranks."""
        return bool((np.diff(self._merged) > 0).all())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of neighbours, _NONE where they do not merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        return np.where(self._key[at] == key, self._rank[at], _NONE)

    def words_of(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings inside it are whole ones."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.split.findall(part)
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        raw = [w.encode("utf-8") for w in words]
        for i, (w, r) in enumerate(zip(words, raw, strict=True)):
            if w in self.special:
                out[i] = [self.special[w]]
            elif len(r) > SHORT:
                out[i] = self._long(r)
            else:
                by_width.setdefault(4 if len(r) <= 4 else 8 if len(r) <= 8 else 16 if len(r) <= 16 else SHORT, []).append(i)
        for width, index in by_width.items():
            for at in range(0, len(index), 20_000):
                part = index[at : at + 20_000]
                for i, ids in zip(part, self._short([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _short(self, raw: list[bytes], width: int) -> list[list[int]]:
        """Rank arrays of many words side by side. ids[w, :n] are the parts between boundaries, rank[w, i] the rank of
        joining parts i and i + 1. Each round finds every word's least rank, deletes that boundary and refreshes the
        two ranks beside it; words without a rank left are done."""
        n = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = np.full((len(raw), width + 1), -1, dtype=np.int32)
        ids[np.arange(width + 1)[None, :] < n[:, None]] = self.first[flat]
        rank = np.where(ids[:, 1:] >= 0, self.ranks(ids[:, :-1], ids[:, 1:]), _NONE)
        live, done = np.arange(len(raw)), ids.copy()
        cols = np.arange(width + 1)
        while True:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(live)), at]
            go = least != _NONE
            if not go.all():
                done[live[~go]] = ids[~go]
                live, ids, rank, at, least = live[go], ids[go], rank[go], at[go], least[go]
            if not len(live):
                break
            rows = np.arange(len(live))
            ids[rows, at] = self._merged[least]
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), width), axis=1)
            ids[:, width] = -1
            rank = np.take_along_axis(rank, np.minimum(cols[:width] + (cols[:width] >= at[:, None]), width - 1), axis=1)
            rank[:, width - 1] = _NONE
            here, after = ids[rows, at], ids[rows, at + 1]
            rank[rows, at] = np.where(after >= 0, self.ranks(here, after), _NONE)
            left = at > 0
            rank[rows[left], at[left] - 1] = self.ranks(ids[rows[left], at[left] - 1], here[left])
        return [row[:k].tolist() for row, k in zip(done, (done >= 0).sum(axis=1).tolist(), strict=True)]

    def _long(self, raw: bytes) -> list[int]:
        """One long word: a linked list of parts and a heap of their ranks, as scanning an array would be quadratic."""
        ids = self.first[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self._merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := self._rank_of.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_words(self.words_of(text)) for i in ids] if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                words = [bpe.words_of(t) if t else [] for t in part.column("text").to_pylist()]
                new = list({w for x in words for w in x if w not in bpe.cache})
                fresh = {}
                for w, ids in zip(new, bpe.encode_words(new), strict=True):
                    fresh[w] = (",".join(map(str, ids)).encode(), len(ids), b"".join(map(bpe.bytes_of.__getitem__, ids)))
                if len(bpe.cache) + len(fresh) <= CACHE:
                    bpe.cache.update(fresh)
                known = bpe.cache.get
                n, ids_sha, text_sha = [], [], []
                for x in words:
                    ids, count, back = zip(*[known(w) or fresh[w] for w in x], strict=True) if x else ((), (), ())
                    n.append(sum(count))
                    ids_sha.append(hashlib.sha256(b",".join(ids)).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(back).decode("utf-8", "replace").encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(ids_sha, type=pa.string()), pa.array(text_sha, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, type=pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], type=pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded (the text those ids decode to). See encode_digests."""
    base = texts(docs, id_col, text_col)
    return base.mapInArrow(_coded(tokenizer_file), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Texts are encoded whole, then their ids are decoded. A null or empty text has no ids: digests of the empty
    string. Null ids stay null, repeated rows are encoded each, an empty table gives an empty result. Special strings
    inside a text become their single id. Other columns of docs are not read.

    Plan: one scan, no shuffle. Distinct words of a slice are encoded side by side; a bounded cache keeps frequent ones.
    """
    base = texts(docs, id_col, text_col)
    return base.mapInArrow(_digests(tokenizer_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
