"""Continuous audit with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 64


def stream_audit(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str, check: Callable[[DataFrame], DataFrame], form: str = "parquet"):
    """ST1: audit reports as their files arrive; all rows of a report come in one file.

    check takes a batch's rows and returns findings with report_id. A report that is delivered again replaces its findings: those of the other reports of
    its bucket are kept. Runs over what has arrived, then stops; the query is returned.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        found = check(batch).withColumn("bucket", F.pmod(F.xxhash64("report_id"), F.lit(BUCKETS)).cast("int"))
        out = f"{out_dir}/batch={number:08d}"
        found.write.mode("overwrite").parquet(out)
        batch.select("report_id").distinct().write.mode("overwrite").parquet(f"{out_dir}_reports/batch={number:08d}")
        batch.unpersist()

    stream = spark.readStream.schema(schema).format(form).load(in_dir)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, out_dir: str) -> DataFrame:
    """What stream_audit has found, for each report as of its last delivery. Batches are overwritten whole if they are run again, so replays do no harm."""
    last = spark.read.parquet(f"{out_dir}_reports").groupBy("report_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(out_dir).join(last, ["report_id", "batch"]).drop("batch", "bucket")


PAGES = "report_id long, n_pages long, n_valid long, missing_pages array<int>, complete boolean"


def stream_page_completeness(pages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ST2: hold a report until as many pages have come as its page numbers declare, or the watermark passes its last page by the delay, then tell its missing pages.

    pages: report_id, current_page, total_pages, ts. The state of a report is its set of page numbers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, valid, total = state.get if state.exists else ([], 0, 0)
        n = valid
        seen = set(seen)
        if not state.hasTimedOut:
            latest = 0
            for frame in frames:
                n += len(frame)
                seen |= {int(p) for p in frame["current_page"] if p > 0}
                total = max([total, *(int(t) for t in frame["total_pages"])])
                latest = max([latest, *(int(t.timestamp() * 1000) for t in frame["ts"])])
            if not (total and len(seen) >= total):
                state.update((sorted(seen), n, total))
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
                return
        missing = sorted(set(range(1, max([total, *seen], default=0) + 1)) - seen)
        state.remove()
        yield pd.DataFrame({"report_id": [key[0]], "n_pages": [n], "n_valid": [len(seen)], "missing_pages": [missing], "complete": [not missing]})

    return pages.withWatermark("ts", delay).groupBy("report_id").applyInPandasWithState(step, PAGES, "seen array<int>, n long, total int", "append", GroupStateTimeout.EventTimeTimeout)


def findings_by_window(findings: DataFrame, ts: str = "ts", by: str = "check_id", window: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """ST3: counts by tumbling or sliding window; on a stream late rows count up to the delay."""
    at = F.window(ts, window, slide) if slide else F.window(ts, window)
    marked = findings.withWatermark(ts, delay) if findings.isStreaming else findings
    return marked.groupBy(at.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def findings_by_session(findings: DataFrame, ts: str = "ts", by: str = "check_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """ST3: counts by session."""
    marked = findings.withWatermark(ts, delay) if findings.isStreaming else findings
    return marked.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")
