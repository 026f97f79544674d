"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, connected_components, cut, groups, join_split, min_labels, parts_for

#: Vectors the rotations are fitted on at most (the least by hash of id), vectors that have a block as their home, and codes of a
#: bucket that one task compares with as many others.
FIT_ROWS, BLOCK, CODES = 10_000, 2048, 2048
#: Standard deviations that a pair at the threshold may differ in more bits than is to be expected, and stay a candidate.
SPREAD = 5.0
#: Chance, for bits that differ with probability angle / pi after centring, that a pair right at the threshold shares no bucket.
MISS = 0.005
#: Tables at most; where more would be needed, substrings get shorter, down to none: one bucket, all pairs compared.
TABLES = 128


@dataclass(frozen=True)
class Index:
    """Rotations that turn a centred unit vector into bits, and how bits are cut into tables."""

    mean: np.ndarray
    rotations: tuple[np.ndarray, ...]
    bits: int
    tables: int
    #: Differing bits over all tables up to which a pair is a candidate.
    reach: int = 0

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One bucket number per vector and table."""
        if not self.bits:
            return np.zeros((len(unit), 1), dtype=np.int32)
        centred = unit - self.mean
        out = []
        for r in self.rotations:
            b = centred @ r > 0
            each = b.shape[1] // self.bits
            out.append(b[:, : each * self.bits].reshape(len(b), each, self.bits) @ (1 << np.arange(self.bits)))
        return np.concatenate(out, axis=1)[:, : self.tables].astype(np.int32)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Codes in as few bytes as a table's bits need, filled up to whole 64-bit words, for Hamming distances over all tables."""
        b = np.ascontiguousarray(codes.astype(np.uint8 if self.bits <= 8 else np.uint16 if self.bits <= 16 else np.uint32)).view(np.uint8)
        return np.pad(b, ((0, 0), (0, -b.shape[1] % 8)))

    def cells(self, unit: np.ndarray, bits: int) -> np.ndarray:
        """The leading bits of the first rotation, which put vectors that are near each other mostly in one cell."""
        if not self.rotations or not bits:
            return np.zeros(len(unit), dtype=np.int64)
        b = (unit - self.mean) @ self.rotations[0][:, :bits] > 0
        return b.astype(np.int64) @ (1 << np.arange(b.shape[1], dtype=np.int64))


def agreement(square: np.ndarray, threshold: float) -> np.ndarray:
    """Chance that a bit of two unit vectors at the threshold agrees, by the squared length both have after centring.
    Centring keeps their distance, so the shorter they get, the wider their angle; 0 where the distance is all there is."""
    cosine = 1 - (1 - threshold) / np.maximum(np.minimum(square, 1), 1e-12)
    return 1 - np.arccos(np.clip(cosine, -1, 1)) / math.pi


def tables_needed(same: np.ndarray, bits: int, most: int) -> int:
    """The least number of tables with a mean miss of at most MISS over `same`; most + 1 if `most` are too few."""
    miss = 1 - same**bits
    low, high = 1, most + 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if (miss**middle).mean() <= MISS else (middle + 1, high)
    return low


def fit_index(sample: np.ndarray, rows: int, threshold: float, seed: int = 7, passes: int = 30) -> Index:
    """Iterative quantisation (Gong and Lazebnik): rotate centred vectors so that signs lose least, alternating
    between signs and the rotation that fits them best (an orthogonal Procrustes problem).

    A table's substring has about log2(rows / 256) bits, at least 8, so buckets keep a few hundred vectors as the data
    grows; the number of tables follows from MISS and the lengths of the sample's vectors after centring. If it passes
    TABLES, substrings are shortened; once tables are no fewer than buckets, all pairs are compared (0 bits, one table).
    Several rotations with different starts supply the bits.
    """
    d = sample.shape[1]
    bits = int(min(d, 20, max(8, math.ceil(math.log2(max(rows, 1) / 256)) if rows > 256 else 8)))
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    x = sample - mean
    same = agreement((x * x).sum(axis=1) if len(x) else np.ones(1), threshold)
    while (tables := tables_needed(same, bits, TABLES)) > TABLES and 2**bits > TABLES:
        bits -= 1
    if tables >= 2**bits:
        return Index(mean, (), 0, 1)
    rng = np.random.default_rng(seed)
    rotations = []
    while len(rotations) * (d // bits) < tables:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(passes if len(x) > d else 0):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        rotations.append(r)
    low = float(same.min())
    total = bits * tables
    return Index(mean, tuple(rotations), bits, tables, math.ceil(total * (1 - low) + SPREAD * math.sqrt(total * low * (1 - low))) + 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _coded(index: Index, cell_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64))
                c = index.codes(unit)
                t = np.arange(index.tables, dtype=np.int64)[None, :] << 32
                keys = pa.ListArray.from_arrays(pa.array((np.arange(len(c) + 1) * index.tables).astype(np.int32)), pa.array((t + c).ravel()))
                code = pa.array([x.tobytes() for x in index.packed(c)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(index.cells(unit, cell_bits)), keys, code], names=["vec_id", "cell", "keys", "code"])

    return run


def _visits(reach: int):
    """Per pair of a bucket's parts: which vectors must be in which block, since a code within reach stands there. Of two near
    vectors the one of the lower block visits the higher one. Rows come out once per vector and block, never as pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in groups(batches, 3):
            side, ids, home = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
            code = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
            left = np.flatnonzero(side == low)
            right = left if low == high else np.flatnonzero(side == high)
            out = []
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                far = np.zeros((len(part), len(right)), dtype=np.uint16)
                for x, y in zip(code[part].T, code[right].T, strict=True):
                    far += np.bitwise_count(x[:, None] ^ y[None, :])
                i, j = np.nonzero((far <= reach) & (ids[part][:, None] != ids[right][None, :]))
                i, j = part[i], right[j]
                into = np.maximum(home[i], home[j])  # both stand in the higher of their blocks
                out.append(np.unique(np.concatenate([np.stack([i, into]), np.stack([j, into])], axis=1), axis=1))
            if out and sum(x.shape[1] for x in out):
                at, into = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(home[at]), pa.array(into)], names=["vec_id", "home", "block"])

    return run


def _compared(threshold: float):
    """Per block and part of its visitors: exact cosines of visitors and members, in the first part of members, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, piece), rows in groups(batches, 2):
            ids, weight = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2))
            unit = _unit(np.array([r[3] for r in rows], dtype=np.float64))
            member = np.array([r[0] for r in rows], dtype=bool)
            inside, guests = np.flatnonzero(member), np.flatnonzero(~member)
            n, tied = np.zeros(len(ids), dtype=np.int64), []
            for some, own in [(inside, True)] * (piece == 0) + [(guests, False)]:
                for at in range(0, len(some), 1024):
                    part = some[at : at + 1024]
                    near = unit[part] @ unit[inside].T >= threshold
                    if own:
                        near &= part[:, None] < inside[None, :]
                    i, j = np.nonzero(near)
                    i, j = part[i], inside[j]
                    n += np.bincount(i, weights=weight[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=weight[i], minlength=len(ids)).astype(np.int64)
                    label = min_labels(len(ids), i, j)
                    moved = np.flatnonzero(label != np.arange(len(ids)))
                    tied.append(np.stack([moved, label[moved]]))
            label = min_labels(len(ids), *np.concatenate(tied, axis=1)) if tied else np.arange(len(ids))
            out = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(n[out]), pa.array(ids[label[out]])], names=["vec_id", "n", "low"])

    return run


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Two vectors are linked when their cosine in double precision is >= threshold; every reported link is confirmed on
    the original vectors. Null and zero vectors and vectors with null or non-finite components link with nothing;
    vectors of different lengths do not link with each other. n_links counts the other rows linked directly, copies
    included; component_id is the smallest id reachable. Rows with a null id have no links, component_id null and
    kept true. Repeated rows of an id share one result and do not link with themselves. Empty tables give empty
    results. Other columns are not read.

    Plan: equal vectors collapse to one weighted representative by a pre-aggregated 128-bit key. Rotations are fitted
    on FIT_ROWS vectors; all are indexed, once per vector length. Retrieval sees codes only: narrow rows (key, id, code)
    meet in the tables' buckets, and pairs within reach over all bits tell which blocks of neighbouring vectors
    each vector has to visit. Vectors travel once per block that they visit, not per table; blocks of many visitors are split.
    A task compares visitors and members by matrix products and returns counts and a spanning forest, never pairs. A
    pair at the threshold shares none of the tables with probability below MISS; where a shared direction leaves the
    tables no gain, all codes meet in one bucket.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    if dict(raw.dtypes)["v"] not in ("array<float>", "array<double>"):
        raw = raw.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = (F.coalesce(F.size("v"), F.lit(-1)) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = raw.withColumns({"h1": F.when(good, F.xxhash64("v")), "h2": F.when(good, F.xxhash64(F.lit(1), "v")), "d": F.size("v")})
    everyone = keyed.select("vec_id", "h1", "h2")
    reps = cut(keyed.where("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("w"), F.count("*").alias("n_rows"), F.any_value("v").alias("v"), F.any_value("d").alias("d")))
    lengths = {r.d: (r.n, r.rows) for r in reps.groupBy("d").agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows")).collect()}  # few: one per kind of vector
    if not lengths:
        nothing = {c: F.lit(None).cast("long") for c in ("rep", "n", "component")}
        return _result(everyone.withColumns({**nothing, "w": F.lit(1).cast("long")}))
    found = reduce(DataFrame.unionByName, [_found(reps.where(F.col("d") == d).select("vec_id", "w", "v"), n, threshold) for d, (n, _) in sorted(lengths.items())])
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("low <> vec_id").select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    own = reps.select("h1", "h2", "n_rows", F.col("vec_id").alias("rep"), "w").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(
        components.withColumnRenamed("node", "rep"), "rep", "left")
    limit = max(1.0, sum(n for _, n in lengths.values()) * HOT_SHARE)
    return _result(join_split(everyone, own, ["h1", "h2"], "n_rows", limit, F.coalesce("vec_id", F.monotonically_increasing_id()), "left"))


def _found(reps: DataFrame, rows: int, threshold: float) -> DataFrame:
    """(vec_id, n, low) of linked vectors of one length: partial counts and edges of a spanning forest."""
    spark = reps.sparkSession
    sample = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow().column("v").to_pylist()
    index = fit_index(_unit(np.array(sample, dtype=np.float64)), rows, threshold)
    coded = cut(reps.select("vec_id", "v").mapInArrow(_coded(index, max(0, math.ceil(math.log2(rows / BLOCK)))), "vec_id long, cell long, keys array<long>, code binary"))
    limit = max(1.0, rows * HOT_SHARE)
    cells = coded.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("g"))
    home = F.shiftleft("cell", 40) + F.pmod(F.xxhash64("vec_id"), "g")
    placed = cut(join_split(coded, cells, ["cell"], "n", limit, F.col("vec_id")).select("vec_id", home.alias("home"), "keys", "code"))

    narrow = placed.select("vec_id", "home", "code", F.explode("keys").alias("key"))
    buckets = narrow.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CODES).cast("int").alias("g")).where("n > 1")
    near = join_split(narrow, buckets, ["key"], "n", limit * index.tables, F.col("vec_id")).withColumn("side", F.pmod(F.xxhash64("vec_id"), "g").cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "vec_id", "home", "code")
    visits = near.repartition(parts_for(spark, rows * index.tables, 100_000), "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(
        _visits(index.reach if index.bits else 0), "vec_id long, home long, block long")
    visits = cut(visits.distinct())

    guests = visits.groupBy("block").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("home") != F.col("block")) / (2 * BLOCK))).cast("int").alias("g"))
    seat = join_split(visits, guests, ["block"], "n", limit, F.col("vec_id")).withColumn("member", F.col("home") == F.col("block"))
    seat = seat.withColumn("piece", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.pmod(F.xxhash64("vec_id"), "g").cast("int")))))
    task = seat.select("block", "piece", "member", "vec_id").join(reps, "vec_id").select("block", "piece", "member", "vec_id", "w", "v")
    return cut(
        task.repartition(parts_for(spark, visits.count(), 20_000), "block", "piece").sortWithinPartitions("block", "piece")
        .mapInArrow(_compared(threshold), "vec_id long, n long, low long"))


def _result(rows: DataFrame) -> DataFrame:
    alone = F.col("rep").isNull() | F.col("vec_id").isNull()
    return rows.select(
        "vec_id",
        F.when(alone, 0).otherwise(F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
