"""Streams of requests against a directory that stays put, and late-data counts of their arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kvartal.operators import linkage as L
from kvartal.session import checkpointed, released


def match_stream(requests: DataFrame, records: DataFrame, places: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Decisions of every micro-batch of a request stream, written to out. records, places: linkage.prepared_directory and
    general_places.

    A batch is written under its own number and overwritten if it is run again, so each request is decided
    exactly once. Its intermediate tables are deleted when it is done.
    """

    def decide(batch: DataFrame, number: int) -> None:
        with released(batch.sparkSession):
            q = checkpointed(L.prepared_requests(batch))
            _, decided = L.resolved(q, checkpointed(L.scored_pairs(q, records)), places)
            decided.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(requests: DataFrame, delay: str = "2 days", window: str = "1 day") -> DataFrame:
    """window_start, n, late: requests per window of their time; rows later than the delay are left to the
    watermark. Works on streams and on tables."""
    late = (F.col("loaded_at") > F.col("requested_at") + F.expr("INTERVAL 1 HOUR")).cast("int")
    own = requests.select(F.col("requested_at").cast("timestamp").alias("at"), late.alias("late")).withWatermark("at", delay)
    return own.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("n"), F.sum("late").alias("late")).select(F.col("w.start").alias("window_start"), "n", "late")
