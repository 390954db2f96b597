"""New findings checked as they arrive.

A file stream of finding batches is compared with the frozen baseline batch by batch; counts per
repository are kept under a watermark. Both restart from their checkpoints after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlake.functions import text as T
from claimlake.operators import ledger as L


def stream_of(spark: SparkSession, folder: str, schema: str, per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def check_stream(findings: DataFrame, baseline: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's findings with ``baselined`` to ``sink``; a replayed batch replaces itself.

    ``findings``: rule, repo, file, message, ...; the baseline is joined on the fingerprint.
    """

    def accept(batch: DataFrame, number: int) -> None:
        marked = L.apply_baseline(batch.withColumn("fingerprint", T.fingerprint("rule", "repo", "file", "message")), baseline)
        marked.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return findings.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity_windows(findings: DataFrame, time: str = "run_at", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, repo, errors, warnings, n): counts per repository and window; rows later than ``late`` are dropped."""
    windowed = findings.withWatermark(time, late).groupBy(F.window(time, width), "repo")
    return windowed.agg(F.count_if(F.lower("severity") == "error").alias("errors"), F.count_if(F.lower("severity") == "warning").alias("warnings"), F.count("*").alias("n"))
