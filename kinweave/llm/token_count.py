"""Token counts by batch encoding that returns lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import slices, texts

#: Bytes handed to the library in one call, and entries of a worker's cache of chunk lengths.
CALL_BYTES, CACHE = 1 << 20, 300_000


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, dict[bytes, int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, {}


def _lengths(t: Tokenizer, chunks: list[bytes]) -> dict[bytes, int]:
    """Lengths of distinct chunks, encoded in calls balanced by bytes rather than by number of chunks."""
    out: dict[bytes, int] = {}
    call: list[bytes] = []
    held = 0
    for c in [*chunks, None]:
        if call and (c is None or held + len(c) > CALL_BYTES):
            for x, e in zip(call, t.encode_batch_fast([x.decode("utf-8") for x in call], add_special_tokens=False), strict=True):
                out[x] = len(e)
            call, held = [], 0
        if c is not None:
            call.append(c)
            held += len(c)
    return out


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = _tokenizer(path)
        for batch in batches:
            for part in slices(batch):
                raw = [(x or "").encode("utf-8") for x in part.column("text").to_pylist()]
                chunks = [x.split() for x in raw]
                new = _lengths(t, [c for c in {c for x in chunks for c in x} if c not in known])
                if len(known) + len(new) <= CACHE:
                    known.update(new)
                    of = known
                else:
                    of = {c: known[c] if c in known else new[c] for x in chunks for c in x}
                n = [sum(map(of.__getitem__, x)) for x in chunks]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], type=pa.int64()), pa.array(n, type=pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    For tokenizers whose pre-tokeniser never joins text across white space and drops it, such as word-level BPE
    with word ends: a text is split at ASCII white space, a boundary no token, special token or Unicode
    composition crosses, so a text's length is the sum of its chunks' lengths and texts of any length cost
    bounded memory. Each distinct chunk of a batch is encoded once, in calls of equal bytes; a bounded cache keeps
    frequent chunks' lengths between batches.

    A null text counts as empty (0 tokens); a null id stays null; repeated rows are counted each; no row is
    dropped. Other columns of docs are not read. Plan: one scan, no shuffle.
    """
    base = texts(docs, id_col, text_col)
    return base.mapInArrow(_counted(tokenizer_file, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
