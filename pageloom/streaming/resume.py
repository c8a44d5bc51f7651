"""Resumable processing of a growing manifest as a stream: each micro-batch skips what is already logged.

An addition: batch resume is the anti-join on the outcome log. Every micro-batch is first-seen
deduplicated, anti-joined against the log and appended to it, so a restart repeats nothing that was
logged, and a batch that is replayed after a failure finds its own rows and adds none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions.text import utc_now
from pageloom.operators.manifest import first_seen, unprocessed
from pageloom.sources.layout_json import exists


def logged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The outcome log, empty if it isn't there yet; looked up through Spark's own file systems."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def resume(source: DataFrame, process: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, key: str = "arxiv_id", order: str = "line") -> StreamingQuery:
    """Start the stream ``source`` (key, order, ...) through ``process``, whose rows (with key and status) are appended to ``log``."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        done = logged(spark, log, f"{key} string, status string")
        new = unprocessed(first_seen(rows, key, order), done, key)
        process(new).write.mode("append").json(log)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(log: DataFrame) -> DataFrame:
    """One row of counts: rows, accepted, and a map of statuses."""
    by = log.groupBy(F.coalesce("status", F.lit("unknown")).alias("s")).agg(F.count("*").alias("n"))
    accepted = F.sum(F.when(F.col("s").isin("accepted", "already_present"), F.col("n")).otherwise(0))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(accepted, F.lit(0)).alias("accepted"), F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("status_counts"))


#: Statuses of candidates that were never fetched, and of those that a compiler decided.
UNFETCHED, COMPILED = ("source_not_found", "download_error"), ("accepted", "compile_failed", "timeout")


def progress_document(candidates: DataFrame, log: DataFrame, target: int, started_at: str, mode: str = "combined", key: str = "arxiv_id") -> DataFrame:
    """One row that tells how far a run is, from its candidates (key) and its outcome log (key, status).

    Counts of rows at each step, the quota, what is pending (candidates without an outcome), the
    share of successes and the successes an hour since ``started_at`` (ISO, UTC).
    """
    status = F.coalesce("status", F.lit("unknown"))
    count = lambda c: F.count_if(c)
    done = log.agg(
        F.count("*").alias("attempted_submitted"), count(~status.isin(*UNFETCHED)).alias("download_completed"), count(status.isin(*COMPILED)).alias("compile_completed"),
        count(status.isin("accepted", "already_present")).alias("accepted_total"),
    )
    by = progress(log).select("status_counts")
    pending = unprocessed(candidates.select(key).distinct(), log, key).agg(F.count("*").alias("pending"))
    hours = (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp(F.lit(started_at)))) / 3600.0
    rate = F.when(hours > 0, F.col("accepted_total") / hours)
    return done.crossJoin(by).crossJoin(pending).select(  # three rows of one each
        F.lit(started_at).alias("started_at"), utc_now().alias("updated_at"), F.lit(mode).alias("mode"), "*", F.lit(target).alias("target_successes"),
        F.greatest(F.lit(target) - F.col("accepted_total"), F.lit(0)).alias("remaining"), F.try_divide("accepted_total", "attempted_submitted").alias("success_share"), rate.alias("accepted_an_hour"),
    )
