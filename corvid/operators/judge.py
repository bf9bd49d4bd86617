"""Judgement cache: hits, remaining calls, and the streak of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """Targets (stem, hid, prompt, summary) with hit and failing: the cached key is the prompt's digest; the cached
    verdict is FAIL for the present summary."""
    keyed = targets.select("stem", "hid", F.sha2("prompt", 256).alias("_key"), F.sha2("summary", 256).alias("_sha"))
    c = cache.select("stem", "hid", "key", "summary_sha", "verdict")
    joined = keyed.join(c, ["stem", "hid"], "left")
    return joined.select("stem", "hid", F.coalesce(F.col("key") == F.col("_key"), F.lit(False)).alias("hit"), F.coalesce((F.col("verdict") == "FAIL") & (F.col("summary_sha") == F.col("_sha")), F.lit(False)).alias("failing"))


def plan(units: DataFrame) -> DataFrame:
    """Per stem and in total (null stem): units, those to do, failing ones and calls.

    ``units`` has (stem, hid, has_summary, failing, manual, report_done). A report's own summary is one more call if
    it is missing or any of its units is new.
    """
    todo = ~F.col("has_summary") | (F.col("failing") & ~F.col("manual"))
    per = units.groupBy("stem").agg(F.count("*").alias("units"), F.sum(todo.cast("long")).alias("todo"), F.sum((F.col("failing") & ~F.col("manual")).cast("long")).alias("failing"), F.min(F.col("report_done").cast("int")).alias("_done"))
    per = per.withColumn("calls", F.col("todo") + ((F.col("todo") > 0) | (F.col("_done") == 0)).cast("long")).drop("_done")
    return per.rollup("stem").agg(*(F.sum(c).alias(c) for c in ("units", "todo", "failing", "calls")))


def streaks(verdicts: DataFrame) -> DataFrame:
    """Rows (stem, hid, seq, streak) of verdicts (stem, hid, seq, verdict, summary_sha): a FAIL of another summary
    than the last adds one, of the same summary leaves it, any other verdict resets it."""
    w = Window.partitionBy("stem", "hid").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fail = F.col("verdict") == "FAIL"
    rows = verdicts.withColumn("_island", F.sum((~fail).cast("int")).over(so_far))
    isle = Window.partitionBy("stem", "hid", "_island").orderBy("seq")
    before = F.last(F.when(fail, F.col("summary_sha")), True).over(isle.rowsBetween(Window.unboundedPreceding, -1))
    step = (fail & ~F.col("summary_sha").eqNullSafe(before)).cast("int")
    rows = rows.withColumn("_step", step)
    return rows.select("stem", "hid", "seq", F.when(fail, F.sum("_step").over(isle.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0).cast("int").alias("streak"))


def history(verdicts: DataFrame, most: int = 3) -> DataFrame:
    """Rows (stem, hid, last): when the last ``most`` FAILs were (the size of the kept history)."""
    fails = verdicts.filter("verdict = 'FAIL'").groupBy("stem", "hid").agg(F.array_sort(F.collect_list("seq")).alias("_all"))
    return fails.select("stem", "hid", F.slice("_all", F.greatest(F.size("_all") - (most - 1), F.lit(1)), F.lit(most)).alias("last"))


def escalation(streak: Column, escalated: Column, most: int = 3) -> Column:
    """Next step after a verdict: none, arbiter, or manual if the summary was regenerated already."""
    return F.when(streak < most, "none").when(escalated == "summary", "manual").otherwise("arbiter")
