"""Run a streaming operator over a batch of rows: written as files, read as a stream, collected in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.functions.store import shared_folder


def run_to_table(spark: SparkSession, rows: DataFrame, operator, name: str) -> DataFrame:
    """All rows through ``operator`` as a stream that ends with them; the result is read from its sink."""
    top = shared_folder(spark)
    rows.write.parquet(f"{top}/in")
    out = operator(spark.readStream.schema(rows.schema).parquet(f"{top}/in"))
    query = out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


def ledger_of_rounds(spark: SparkSession, rounds: list[DataFrame]) -> DataFrame:
    """The streaming ledger after the rounds' files, one after another, each as a run of the stream that ends."""
    from corvid.streaming import stream

    top = shared_folder(spark)
    for rows in rounds:
        rows.write.mode("append").parquet(f"{top}/in")
        stream.sync_batches(spark.readStream.schema(rows.schema).parquet(f"{top}/in"), f"{top}/ledger", f"{top}/state").awaitTermination()
    return stream.ledger_at(spark, f"{top}/ledger")
