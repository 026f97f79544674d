"""Sequence packing: shortest-pack-first over the histogram of piece lengths, joined back to documents by rank."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Bpe
from .common import cut, parts_for, slices, texts

#: Fixed value: the special string that a file of ranks leaves out.
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def encoder(path: str, special_id: int) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """Encoding and special strings of a vocabulary: a tokenizers file, whose ids must follow the order of its merges, or a
    file of ranks, which names no special string."""
    if path.endswith(".json"):
        v = Bpe(path)
        if not v.ids_are_ranks():
            raise ValueError(f"ids of {path} do not follow its merges")
        special = v.special
        ranks = {b: i for i, b in v.bytes_of.items() if i not in special.values()}
    else:
        special = {SPECIAL: special_id}
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(enc: tiktoken.Encoding, text: str, special: dict[str, int]) -> list[int]:
    """Ids of a whole text; a special string inside it is one id, as the tokenizers library has it by default."""
    if not any(s in text for s in special):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text):
        ids += [special[part]] if part in special else enc.encode_ordinary(part)
    return ids


def _pieces(ranks_file: str, special_id: int, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, special = encoder(ranks_file, special_id)
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*token_ids(enc, text or "", special), end_id], dtype="<u4")
                    raw, n = ids.tobytes(), len(ids)
                    out += ((doc, at, min(capacity, n - at), zlib.crc32(raw[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (how many packs, {length: times}). Lengths are placed longest first, each into the open packs
    that hold least so far, many packs at a time; a pack is opened only where no open one has room."""
    open_packs: dict[int, list[tuple[int, dict[int, int]]]] = {}
    full: list[tuple[int, dict[int, int]]] = []

    def put(room: int, count: int, pattern: dict[int, int]) -> None:
        if room:
            open_packs.setdefault(room, []).append((count, pattern))
        else:
            full.append((count, pattern))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                fit = min(capacity // length, left)
                packs, rest = divmod(left, fit)
                put(capacity - fit * length, packs, {length: fit})
                if rest:
                    put(capacity - rest * length, 1, {length: rest})
                break
            count, pattern = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            used = min(count, left)
            if used < count:
                put(room, count - used, pattern)
            put(room - length, used, pattern | {length: pattern.get(length, 0) + 1})
            left -= used
    return full + [x for packs in open_packs.values() for x in packs]


def slot_table(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, packs, first sequence, first offset): ranks low to high of a length go to these packs."""
    cursor: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in sorted(patterns, key=lambda x: sorted(x[1].items(), reverse=True), reverse=True):
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            low = cursor.get(length, 0)
            cursor[length] = low + count * times
            rows.append((length, low, cursor[length], count, sequence, offset))
            offset += length * times
        sequence += count
    return rows


def pack(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
         end_id: int = 0, special_id: int = 50256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and end_id after them (a null or empty text: end_id alone). It is cut every `capacity`
    ids; the last piece is shorter. Pieces fill sequences of at most `capacity` ids, gapless from 0; every id is in
    one piece. ranks_file is a tokenizers file (its special strings hold) or a file of ranks (`special_id` is that of SPECIAL). Rows with a null id are packed too and show a null doc_id. Repeated rows are separate documents.
    Pieces of equal length are interchangeable and take their rank by (id, start, crc). An empty table gives no
    pieces. Other columns of docs are not read.

    Plan: texts are encoded once and only narrow piece rows are kept (checkpointed). The histogram has at most
    `capacity` bins and is all the driver sees. Ranks inside a length come from a prefix sum over (length, salt)
    counts and a row number inside each (length, salt), so no length, however common, is sorted in one task. The
    slot table has a row per pattern and length, bounded by the histogram, not by the data.
    """
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col)
    salts = 4 * parts_for(spark, 0, 1)
    pieces = cut(base.mapInArrow(_pieces(ranks_file, special_id, end_id, capacity), PIECES)
                 .withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(slot_table(shortest_pack_first(histogram, capacity)), "len long, low long, high long, packs long, first long, at long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(shift, ["length", "salt"]).withColumn("rank", F.col("shift") + F.col("row") - 1)
    k = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + k % F.col("packs")).alias("sequence_id"),
        (F.col("at") + F.floor(k / F.col("packs")).cast("long") * F.col("length")).alias("offset"),
    )
