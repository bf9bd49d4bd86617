"""Structured Streaming forms: ledger synchronisation in micro-batches, keyed failure streaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LEDGER = "filepath string, version long, content_hash string, complete boolean, batch long"


def sync_batches(files: DataFrame, path: str, checkpoint: str):
    """Keep the ledger at ``path`` in step with a stream of files (filepath, version, content, complete).

    Each micro-batch writes what it saw, the latest version of each file, to a folder of its number; a batch that is
    run again overwrites its own folder only, so the sink is idempotent, and no batch reads another. Null content
    means that the file is gone. Returns the started query; ``ledger_at`` reads the ledger.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("filepath").agg(F.max(F.struct("version", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "complete")).alias("f"))
        last.select("filepath", "f.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger (filepath, content_hash) that the batches so far make: each file's latest content unless it is gone
    or was never complete (what is loaded and unchanged is not looked at again); of equal versions the later batch's."""
    seen = spark.read.schema(LEDGER).parquet(path)
    contents = seen.groupBy("filepath", "content_hash").agg(F.max(F.struct("version", "batch")).alias("at"), F.max("complete").alias("complete"))
    last = contents.groupBy("filepath").agg(F.max_by(F.struct("content_hash", "complete"), "at").alias("f")).select("filepath", "f.*")
    return last.filter("complete and content_hash is not null").select("filepath", "content_hash")


def streaks(verdicts: DataFrame) -> DataFrame:
    """Streaming failure streaks of verdicts (stem, hid, seq, verdict, summary_sha): one row per input row.

    The state of a key is the last failed summary and the streak; rows of a key are taken by ``seq`` in each batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sha, streak = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            if r.verdict != "FAIL":
                sha, streak = "", 0
            elif r.summary_sha != sha:
                sha, streak = r.summary_sha, streak + 1
            out.append((*key, r.seq, streak))
        state.update((sha, streak))
        yield pd.DataFrame(out, columns=["stem", "hid", "seq", "streak"])

    return verdicts.groupBy("stem", "hid").applyInPandasWithState(step, "stem string, hid string, seq long, streak int", "sha string, streak int", "append", "NoTimeout")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts and sums with a watermark (a smoke check beyond the surveyed engine's own operators)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
