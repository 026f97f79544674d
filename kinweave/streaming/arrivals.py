"""Matches at the moment somebody arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import affinity
from kinweave.streaming.presence import present_now


def matches_on_arrival(log: DataFrame, history: DataFrame, roster: DataFrame, edges: DataFrame, stats: DataFrame, people: int) -> DataFrame:
    """Arrivals of log(person_id, ts, event_id, kind) that the roster knows, matched with everyone present after `history` and
    `log`. Who is on no roster is ignored; who came and left again within the log is not matched."""
    known = roster.select("person_id").distinct()
    now = present_now(history.unionByName(log).join(known, "person_id", "left_semi"))
    arrived = log.where("kind = 'arrive'").join(now.select("person_id"), "person_id", "left_semi").select("person_id").distinct()
    return affinity.match_present(arrived, now, edges, stats, people)


def on_arrival(log: DataFrame, path: str, roster: DataFrame, edges: DataFrame, stats: DataFrame, people: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The streaming form: each micro-batch is written under `path` by its number, so that a repeated one overwrites itself, and
    matched against all batches before it. sink(matches, batch number) must bear a repeated number, too."""
    schema = log.select("person_id", "ts", "event_id", "kind").schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("person_id", "ts", "event_id", "kind").write.mode("overwrite").parquet(f"{path}/batch={number}")
        whole = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, batch long").option("basePath", path).parquet(path)
        rows = whole.where(F.col("batch") == number).drop("batch")
        sink(matches_on_arrival(rows, whole.where(F.col("batch") < number).drop("batch"), roster, edges, stats, people), number)

    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
