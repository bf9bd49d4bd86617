"""Content-hash ledger, incremental synchronisation and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid import config
from corvid.functions import text as T


def ledger(files: DataFrame) -> DataFrame:
    """Rows (filepath, content_hash) of ``files`` (filepath, content)."""
    return files.select("filepath", T.digest("content").alias("content_hash"))


def missing_stamps(*stamps: str) -> Column:
    """Names of the blank stamps, in ladder order."""
    names = stamps or config.STAMPS
    return F.filter(F.array(*(F.when(F.coalesce(F.col(s).cast("string"), F.lit("")) == "", F.lit(s)) for s in names)), lambda x: x.isNotNull())


def ladder_breaks(*stamps: str) -> Column:
    """Stamps that are set though an earlier one is blank."""
    names = stamps or config.STAMPS
    blank = lambda s: F.coalesce(F.col(s).cast("string"), F.lit("")) == ""
    return F.filter(F.array(*(F.when(~blank(s) & reduce(lambda a, b: a | b, (blank(x) for x in names[:k]), F.lit(False)), F.lit(s)) for k, s in enumerate(names))), lambda x: x.isNotNull())


def diff(old: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (filepath, state) over a ledger and current files (filepath, content_hash, complete).

    removed: no longer there. gated: new or changed, but not complete. updated: new or changed. synced: the same
    hash (not looked at again, whatever its stamps).
    """
    joined = old.select("filepath", F.col("content_hash").alias("_old")).join(current, "filepath", "full_outer")
    state = (
        F.when(F.col("content_hash").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("content_hash")), "synced").when(~F.coalesce("complete", F.lit(False)), "gated").otherwise("updated")
    )
    return joined.select("filepath", state.alias("state"))


def gate(old: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (filepath, state) that make the index unfit for search: stale (new or changed) or orphan (no file)."""
    joined = old.select("filepath", F.col("content_hash").alias("_old")).join(current.select("filepath", "content_hash"), "filepath", "full_outer")
    state = F.when(F.col("content_hash").isNull(), "orphan").when(~F.col("_old").eqNullSafe(F.col("content_hash")), "stale")
    return joined.select("filepath", state.alias("state")).filter("state is not null")


def apply(old: DataFrame, current: DataFrame) -> DataFrame:
    """The ledger after synchronisation: retained rows and those of updated files."""
    states = diff(old, current)
    kept = old.select("filepath", "content_hash").join(states.filter("state = 'synced'").select("filepath"), "filepath", "left_semi")
    new = current.select("filepath", "content_hash").join(states.filter("state = 'updated'").select("filepath"), "filepath", "left_semi")
    return kept.unionByName(new)


def apply_rows(old_rows: DataFrame, new_rows: DataFrame, states: DataFrame) -> DataFrame:
    """Index rows (filepath, …) after synchronisation."""
    kept = old_rows.join(states.filter("state = 'synced'").select("filepath"), "filepath", "left_semi")
    return kept.unionByName(new_rows.join(states.filter("state = 'updated'").select("filepath"), "filepath", "left_semi"))


def catalogue(reports: DataFrame) -> DataFrame:
    """Catalogue entries (filepath, entry) of reports with all stamps; the report summary, never the abstract."""
    line = lambda label, c: F.when(T.text(c) != "", F.concat(F.lit(f"- {label}: "), F.col(c)))
    parts = [F.concat(F.lit("## "), F.col("title")), F.concat(F.lit("- 파일: "), F.col("filepath")), line("발간", "year"), line("연구책임자", "lead_researcher"), line("요약", "summary")]
    return reports.filter(F.size(missing_stamps()) == 0).select("filepath", F.concat_ws("\n", *parts).alias("entry"))
