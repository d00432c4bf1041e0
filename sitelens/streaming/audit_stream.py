"""Structured Streaming: page audits over a stream of new pages.

The page-grain audit is a stateless projection, so it runs unchanged on a
streaming ``pages`` source; the checkpoint makes the query restartable and
exactly-once on the file sink.  Per-site roll-ups keep state per site with a
streaming aggregation (update mode), the Structured Streaming counterpart of
the batch ``site_audit`` (flags OR-ed, counters summed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelens.operators.audit import AUDIT_COUNTS, AUDIT_FLAGS, completeness_score, page_audit

PAGES_SCHEMA = "page_id bigint, url string, html string"


def read_page_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of ``pages`` arriving in ``folder``."""
    return spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder)


def stream_page_audit(pages: DataFrame, sink_path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Append each page's audit to a parquet sink as pages arrive."""
    w = page_audit(pages).writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.outputMode("append").start()


def site_audit_counts(pages: DataFrame) -> DataFrame:
    """Streaming per-site roll-up: flag counts and counters (state: one row per site)."""
    a = page_audit(pages)
    aggs = [F.max(F.col(f).cast("int")).alias(f) for f in AUDIT_FLAGS]
    aggs += [F.sum(c).alias(c) for c in AUDIT_COUNTS]
    aggs.append(F.count(F.lit(1)).alias("page_count"))
    s = a.groupBy("site").agg(*aggs)
    return s.select("site", *[(F.col(f) == 1).alias(f) for f in AUDIT_FLAGS], *AUDIT_COUNTS, "page_count").withColumn(
        "completeness_score", completeness_score()
    )


def stream_site_audit(pages: DataFrame, sink_path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Keep the per-site roll-up current: each micro-batch appends the sites it changed.

    ``foreachBatch`` writes the updated rows to the batch's own folder
    ``batch_id=<n>`` of a parquet table (a change log; the latest batch per site
    is current), so no state lives on the driver, a restart resumes from the
    checkpoint, and a batch that is replayed replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    w = site_audit_counts(pages).writeStream.outputMode("update").foreachBatch(write)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
