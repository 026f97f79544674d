"""Lineage cuts, joins that split hot keys, and connected components."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than this share of all rows is joined by broadcast; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3
#: Spark's own switch for deleting a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir. Without it a local session, whose driver and tasks share one machine, takes a temporary
    folder; a cluster is refused, since only its shared storage survives a lost executor."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="kinweave-")
    sc.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """Computes df now and cuts its lineage with a checkpoint on shared storage, which survives lost executors. The
    shuffle files of this computation are deleted as soon as it has ended."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def sorted_joins(df: DataFrame) -> DataFrame:
    """df, whose joins are to be sort-merge joins, as those of tables that grow with the input must be: Spark takes a small
    compressed file, or what is left of it, for a small table, and would gather all its rows in the driver to broadcast them."""
    return df.hint("merge")


def join_split(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, limit: float, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with keyed, which has one row per key `on` (the first a long) and says in `count` how many
    rows have it. Keys of over `limit` rows meet by a broadcast; their rows, and rows with a null in their key, take a key of
    their own from `spread` (a long) in the shuffled join, where they match nothing. So no task gets more than `limit`
    rows of a key, and rows is computed once. `limit` must be a share of all rows, so that the broadcast is bounded by its inverse."""
    values = [c for c in keyed.columns if c not in (*on, count)]
    kinds = dict(keyed.dtypes)
    pack = lambda name: F.struct(F.lit(True).alias("__hit"), *values).alias(name)
    hot = F.broadcast(keyed.where(F.col(count) > limit).select(*on, pack("__hot")))
    cold = keyed.where(F.col(count) <= limit).select(*(F.col(k).alias(f"__{k}") for k in on), F.lit(False).alias("__side"), pack("__cold"))
    blank = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in on))
    r = rows.join(hot, on, "left").withColumn("__found", F.col("__hot").isNotNull() | blank)
    same = F.col("__found") == F.col("__side")
    for i, k in enumerate(on):
        r = r.withColumn(f"__r_{k}", F.when(F.col("__found"), (spread if i == 0 else F.lit(0)).cast(kinds[k])).otherwise(F.col(k)))
        same = same & (F.col(f"__r_{k}") == F.col(f"__{k}"))
    out = r.join(cold, same, "left").withColumn("__x", F.coalesce("__hot", "__cold"))
    if how == "inner":
        out = out.where("__x is not null")
    return out.select(*rows.columns, *(F.col(f"__x.{v}").alias(v) for v in values))


def numbered(df: DataFrame, order: list[Column], out: str = "n") -> DataFrame:
    """df with a row's place, from 0, in a total order: a range-partitioned sort, then counts of its partitions, of which there
    are as many as tasks. No window over the whole table."""
    place = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order).withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__before"))
    return rows.join(F.broadcast(parts), "__part").withColumn(out, F.col("__before") + F.col("__at")).select(*df.columns, out)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every row is one edge, minima are pre-aggregated
    before each shuffle, no adjacency list is ever gathered, and centres of many edges are split. The number of rounds
    is logarithmic in the longest path. Null ends are ignored; a node with a self-loop only is its own component.
    """
    whole = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    alone = whole.where("a = b").select(F.col("a").alias("node")).distinct()
    e = cut(whole.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _signature(e)
    while state[0]:
        limit = max(1.0, 2 * state[0] * HOT_SHARE)
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_split(sym.where("v > u"), least, ["u"], "n", limit, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node now points at few smaller ones, so no u is hot from here on: its edges are distinct minima
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_split(large, least, ["u"], "n", limit, F.col("v")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct())
        now = _signature(e)
        if now == state:
            break
        state = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def _signature(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor(h)).first())
