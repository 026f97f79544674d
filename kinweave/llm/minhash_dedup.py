"""Near-duplicate grouping by SuperMinHash: signatures, banding, exact verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, connected_components, cut, groups, join_split, parts_for, slices, texts
from .shingles import band_hashes, linked, min_labels, set_digests, shared, shingle_sets, sketches, super_minhash

#: 28 bands of 6 slots: a pair shares no band with probability 2e-6 at similarity 0.85, 2e-4 at 0.8; at 0.5 it shares one with 0.36.
BANDS, ROWS = 28, 6
#: Texts that one task compares with a bucket's leader, in a stream.
STAR = 256
#: A task of the second pass holds two blocks of at most about this many sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1_000_000
#: How far below the threshold a signature's estimate may fall before a pair is no candidate: over six standard deviations.
SLACK = 0.2


def _signed(bands: int, rows: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), k)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s for s in sets if len(s)]
                signature = super_minhash(full, bands * rows) if full else np.empty((0, bands * rows))
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                h1, h2 = set_digests(sets)
                bytes_ = iter(sketches(signature))
                sketch = pa.array([next(bytes_).tobytes() if n else b"" for n in size], type=pa.binary())
                hashes = band_hashes(signature, bands).ravel() if full else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes)), sketch], schema=schema)

    return run


def _star(percent: int, k: int):
    """Rows (lead, part, side, doc_id, text) sorted so that a part's leader comes first: members linked with it, in a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first = (None, None), np.empty(0, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch):
                a, b = [], []
                sets = shingle_sets(part.column("text").to_pylist(), k)
                for s, lead, piece, side, doc in zip(sets, *(part.column(c).to_pylist() for c in ("lead", "part", "side", "doc_id")), strict=True):
                    if side == 0:
                        head, first = (lead, piece), s
                    elif head == (lead, piece):
                        both = shared(s, first)
                        if 100 * both >= percent * (len(s) + len(first) - both):
                            a.append(doc)
                            b.append(lead)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return run


def _near(percent: int):
    """Per block pair of a bucket: its members that may be linked with a member of another component there, judged by
    sizes and sketches. A pair counts in the first band it shares only. Members come out, never pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, low, high), rows in groups(batches, 3):
            side, doc, comp, size = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
            sketch = np.stack([np.frombuffer(r[4], dtype=np.uint8) for r in rows])
            bands = np.array([r[5] for r in rows], dtype=np.int64)
            left = np.flatnonzero(side == low)
            right = left if low == high else np.flatnonzero(side == high)
            if not len(left) or not len(right):
                continue
            fits = comp[left][:, None] != comp[right][None, :]
            fits &= 100 * np.minimum(size[left][:, None], size[right][None, :]) >= percent * np.maximum(size[left][:, None], size[right][None, :])
            if fits.any():
                same = np.zeros(fits.shape, dtype=np.uint16)
                for x, y in zip(sketch[left].T, sketch[right].T, strict=True):
                    same += x[:, None] == y[None, :]
                fits &= same >= (percent / 100 - SLACK) * sketch.shape[1]
            i, j = np.nonzero(fits)
            i, j = left[i], right[j]
            band = int(np.flatnonzero(bands[left[0]] == key)[0])
            if band:
                new = np.ones(len(i), dtype=bool)
                for at in range(0, len(i), 100_000):
                    to = slice(at, at + 100_000)
                    new[to] = ~(bands[i[to], :band] == bands[j[to], :band]).any(axis=1)
                i, j = i[new], j[new]
            if len(i):
                some = np.unique(np.concatenate([i, j]))
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, low, dtype=np.int32)), pa.array(np.full(n, high, dtype=np.int32)), pa.array(side[some].astype(np.int32)), pa.array(doc[some])], names=["key", "low", "high", "side", "doc_id"])

    return run


def _blocks(percent: int, k: int):
    """Exact links between the texts of two blocks, as a spanning forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for (_, low, high), rows in groups(batches, 3):
            ids = np.array([r[1] for r in rows], dtype=np.int64)
            sets = shingle_sets([r[2] for r in rows], k)
            side = np.array([r[0] for r in rows])
            if low == high:
                i, j = linked(sets, None, percent)
            else:
                left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
                if not len(left) or not len(right):
                    continue
                i, j = linked([sets[x] for x in left], [sets[x] for x in right], percent)
                i, j = left[i], right[j]
            label = min_labels(len(ids), i, j)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            a.append(ids[tied])
            b.append(ids[label[tied]])
            if sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _linked_with_leaders(member: DataFrame, held: DataFrame, percent: int, k: int, limit: float) -> DataFrame:
    """(a, b) of members of buckets that are linked with a leader of theirs."""
    spark = held.sparkSession
    pairs = cut(member.where("doc_id > lead").select("lead", "doc_id").distinct())
    leads = cut(pairs.groupBy("lead").agg(F.count("*").alias("n"), F.ceil(F.count("*") / STAR).cast("int").alias("g")))
    part = F.pmod(F.xxhash64("doc_id"), "g").cast("int").alias("part")
    members = join_split(pairs, leads, ["lead"], "n", limit, F.col("doc_id")).select("lead", part, F.lit(1).alias("side"), "doc_id").join(held, "doc_id")
    # a leader's text is fetched once and then copied for each of its parts
    heads = held.join(leads.select(F.col("lead").alias("doc_id"), "g"), "doc_id").select(
        F.col("doc_id").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"), F.lit(0).alias("side"), "doc_id", "text")
    task = members.select("lead", "part", "side", "doc_id", "text").unionByName(heads)
    n = parts_for(spark, pairs.count(), 20_000)
    return task.repartition(n, "lead", "part").sortWithinPartitions("lead", "part", "side").mapInArrow(_star(percent, k), "a long, b long")


def _linked_across(member: DataFrame, found: DataFrame, reps: DataFrame, held: DataFrame, percent: int, k: int, limit: float) -> DataFrame | None:
    """(a, b) between members of a bucket that leaders left in different components, or None without such buckets."""
    spark = held.sparkSession
    rest = member.where("size > 2 and doc_id > lead").join(found, member["doc_id"] == found["node"], "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    rest = rest.join(reps.select("doc_id", "n_shingles"), "doc_id")
    open_ = rest.groupBy("key").agg(
        F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("g")).where("lo < hi").select("key", "n", "g")
    rest = cut(join_split(rest, open_, ["key"], "n", limit, F.col("doc_id")))
    rows = rest.count()
    if not rows:
        return None
    side = F.pmod(F.xxhash64("doc_id"), "g").cast("int").alias("side")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    block = (F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    narrow = rest.select("key", "doc_id", "comp", "n_shingles", "g", side).join(reps.select("doc_id", "sketch", "bands"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    narrow = narrow.select("key", *block, "side", "doc_id", "comp", "n_shingles", "sketch", "bands")
    n = parts_for(spark, rows, 50_000)
    near = cut(narrow.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_near(percent), "key long, low int, high int, side int, doc_id long"))
    task = near.join(held, "doc_id").select("key", "low", "high", "side", "doc_id", "text")
    return task.repartition(parts_for(spark, near.count(), 20_000), "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_blocks(percent, k), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = 5,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A text's set is its distinct k-word shingles (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+); fewer words make one
    shingle; a null or wordless text has none, links with nothing and is its own component. Texts are linked
    when 100 * intersection >= percent * union, confirmed on full sets. component_id is the smallest id reachable.

    Rows with a null id are never linked: component_id null, kept true. Repeated rows of an id share one result.
    Ties cannot arise (ids are ordered). Empty tables give empty results. Other columns of docs are not read.

    Plan: (1) one scan makes signatures; equal sets collapse to one representative by a map-side aggregate of a
    128-bit digest, so copies never meet each other again. (2) In each bucket of two or more, every member is compared
    with its leader, the smallest; leaders of many members are split into parts. That settles buckets whose members
    end up in one component, however large, with one comparison per member. (3) Only buckets that still hold members of
    several components go on, without their leaders: blocks of bounded size find by sizes and sketches which members can
    have a partner in another component, and the texts of these alone are compared exactly. No cell larger than a
    bucket is ever compared, pairs already in one component are not compared again, and no pair is
    shuffled but a member's with a leader. (4) Components of the links label the representatives, and the
    digest takes labels back to all rows. A bucket of n texts that are all a little below the threshold still costs n * n / 2 comparisons.
    """
    base = texts(docs, id_col, text_col)
    sig = cut(base.mapInArrow(_signed(bands, rows, k), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"))
    reps = cut(sig.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.count("*").alias("n_rows")))
    one = reps.dropDuplicates(["doc_id"])  # repeated rows of an id may hold several texts
    total = reps.count()
    bucket = reps.select("doc_id", F.explode("bands").alias("key"))
    star = bucket.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("size"), F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last")
    member = cut(join_split(bucket, star, ["key"], "n", max(1.0, total * bands * HOT_SHARE), F.col("doc_id")))
    held = cut(base.where("doc_id is not null").join(member.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id"]))
    limit = max(1.0, total * HOT_SHARE)
    links = cut(_linked_with_leaders(member, held, percent, k, limit))
    found = cut(connected_components(links))
    more = _linked_across(member, found, one, held, percent, k, max(1.0, total * bands * HOT_SHARE))
    if more is not None:
        found = connected_components(cut(more).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    label = reps.select("h1", "h2", "n_rows", F.col("doc_id").alias("node")).join(found, "node", "left").select(
        "h1", "h2", "n_rows", F.coalesce("component", "node").alias("component_id"))
    usable = F.expr("n_shingles > 0 and doc_id is not null")
    # rows without a set take keys of their own, which match nothing
    rows_ = sig.select("doc_id", "n_shingles", F.when(usable, F.col("h1")).otherwise(F.monotonically_increasing_id()).alias("h1"), F.when(usable, F.col("h2")).otherwise(F.col("h2") + 1).alias("h2"), usable.alias("usable"))
    return (
        join_split(rows_, label, ["h1", "h2"], "n_rows", max(1.0, sig.count() * HOT_SHARE), F.coalesce("doc_id", F.lit(0)), "left")
        .select("doc_id", "n_shingles", F.when(F.col("usable"), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs that stay, one id of each component, with all their columns; rows with a null id stay."""
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs[id_col].cast("long") == F.col("__kept"), "left_semi").unionByName(docs.where(docs[id_col].isNull()))
