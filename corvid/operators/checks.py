"""Verification: coverage, body text, ids, tables of contents, page statistics and runs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid import config
from corvid.functions import text as T
from corvid.operators.pages import TEMPLATE, is_leader

#: Folded characters by which a needle meets its candidates.
GRAM = 12
#: Bullets that are left over, the share of misses that is a drift, misses shown and logged.
RAW_BULLET = r"^\s*[□○ㅇ❍◉▸▪‣∙•Ÿ](\s|\z)"
DRIFT, SHOWN, LOGGED = 0.05, 20, 200


def passages(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (item_id, doc_id): the folded needle (without glyphs, not empty) is anywhere in the folded document.

    A handful of needles (up to LOOP) is broadcast and looked for in one pass: that costs less than cutting the
    documents into shingles. More of them meet their candidates on their first GRAM characters (shorter ones on all of
    theirs), an equi-join on the documents' shingles of these lengths, and are then verified. Shingles that no needle
    begins with don't leave the scan while the needles' beginnings are few enough to be broadcast.
    """
    sought = needles.select("item_id", T.fold_glyphs("text").alias("needle")).filter("needle <> ''").withColumn("gram", F.substring("needle", 1, GRAM))
    folded = docs.select("doc_id", T.fold_glyphs("text").alias("hay"))
    if sought.limit(LOOP + 1).count() <= LOOP:
        return folded.join(F.broadcast(sought), F.col("hay").contains(F.col("needle"))).select("item_id", "doc_id").distinct()
    lengths = sorted(r[0] for r in sought.select(F.length("gram")).distinct().collect())  # at most GRAM rows
    if not lengths:
        return sought.select("item_id").join(folded.select("doc_id"), F.lit(False))
    grams = folded.select("doc_id", F.explode(F.array_distinct(F.concat(*(T.shingles(F.col("hay"), n) for n in lengths)))).alias("gram"))
    starts = sought.select("gram").distinct()
    if starts.limit(FEW + 1).count() <= FEW:
        grams = grams.join(F.broadcast(starts), "gram", "left_semi")
    met = grams.join(sought.select("item_id", "gram"), "gram").select("item_id", "doc_id").distinct()
    return met.join(sought, "item_id").join(folded, "doc_id").filter(F.col("hay").contains(F.col("needle"))).select("item_id", "doc_id").distinct()


#: Needles that are looked for one by one, and beginnings of needles that are broadcast (some 5 MB).
LOOP, FEW = 500, 100_000


def uncovered(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Page lines (doc_id, page, line, text) with ``covered``: whether the document's folded text holds them.

    Blank lines, leaders and a template's residue are left out, as they don't go into a document.
    """
    template = F.lit(False)
    for t in TEMPLATE:
        template = template | F.col("_folded").contains(t)
    # generated, and so folded once a line: a filter on a selected column would be pushed down and fold for each use
    once = F.inline(F.array(F.struct(T.fold("text").alias("_folded"), is_leader("text").alias("_leader"))))
    rows = lines.select("doc_id", "page", "line", "text", once).filter(~F.col("_leader") & ~template)
    needles = rows.select("doc_id", "page", "line", "text", F.translate("_folded", config.GLYPHS, "").alias("_needle")).filter("_needle <> ''")
    hay = docs.select("doc_id", T.fold_glyphs("text").alias("_hay"))
    return needles.join(hay, "doc_id").select("doc_id", "page", "line", "text", F.col("_hay").contains(F.col("_needle")).alias("covered"))


def coverage(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, needles, misses, drift, listed, logged) of ``uncovered`` lines: over one line in twenty missing is
    one finding (drift); else the first misses are listed, and more of them logged (sizes of the report)."""
    miss = F.array_sort(F.collect_list(F.when(~F.col("covered"), F.struct("page", "line", "text"))))
    rows = lines.groupBy("doc_id").agg(F.count("*").alias("needles"), F.count_if(~F.col("covered")).alias("misses"), miss.alias("_m"))
    drift = F.col("misses") > DRIFT * F.col("needles")
    names = F.transform(F.slice("_m", 1, LOGGED), lambda x: F.concat(F.lit("p."), (x["page"] + 1).cast("string"), F.lit(" "), x["text"]))
    listed = F.when(drift, F.array().cast("array<string>")).otherwise(F.slice(names, 1, SHOWN))
    return rows.select("doc_id", "needles", "misses", drift.alias("drift"), listed.alias("listed"), F.size(names).alias("logged"))


def body_findings(lines: DataFrame) -> DataFrame:
    """Findings (doc_id, line, finding) of Markdown lines (doc_id, line, text)."""
    pipes = F.length(F.regexp_replace("text", r"\\\|", "")) - F.length(F.replace(F.regexp_replace("text", r"\\\|", ""), F.lit("|"), F.lit("")))
    is_table = F.col("text").startswith("|")
    w = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.withColumn("_t", is_table).withColumn("_pipes", pipes)
    rows = rows.withColumn("_new", F.when(F.col("_t") & ~F.coalesce(F.lag("_t").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "_run", "_t")
    rows = rows.withColumn("_lines", F.count("*").over(run)).withColumn("_kinds", F.size(F.collect_set("_pipes").over(run)))
    found = F.array(
        F.when(F.col("text").contains("\u00a0"), F.lit("no-break space")),
        F.when(F.col("text").contains("‒"), F.lit("figure dash")),
        F.when(F.col("text").rlike(RAW_BULLET) & ~F.col("text").startswith("<!--"), F.lit("raw bullet")),
        F.when(F.col("_t") & (F.col("_lines") == 1), F.lit("single table line")),
        F.when(F.col("_t") & (F.col("_kinds") > 1), F.lit("unequal pipes")),
    )
    return rows.select("doc_id", "line", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


def id_findings(heads: DataFrame, rid: Column) -> DataFrame:
    """Findings (doc_id, hid, finding) of headings (doc_id, hid, ordinal): malformed, repeated, or not the ordinal
    path of its place."""
    rows = heads.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "hid")))
    found = F.array(
        F.when(~F.col("hid").rlike(r"^[A-Za-z0-9-]+_c\d+(?:s\d+)*\z"), F.lit("form")),
        F.when(F.col("_n") > 1, F.lit("repeated")),
        F.when(F.col("hid") != F.concat(rid, F.lit("_"), "ordinal"), F.lit("path")),
    )
    return rows.select("doc_id", "hid", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding")).distinct()


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with ``side``."""
    return left.join(right, keys, "left_anti").select(*keys, F.lit("left").alias("side")).unionByName(right.join(left, keys, "left_anti").select(*keys, F.lit("right").alias("side")))


def modal_length(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, size, total): the line length that most text has (ties: the first seen)."""
    sized = lines.groupBy("doc_id", F.length("text").alias("size")).agg(F.sum(F.length("text")).alias("total"), F.min("line").alias("_first"))
    return sized.groupBy("doc_id").agg(F.max_by(F.struct("size", "total"), F.struct("total", -F.col("_first"))).alias("m")).select("doc_id", "m.size", "m.total")


def medians(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, median, upper): the true median and the upper middle of line lengths, and the index percentile p90."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_n"))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    rows = lines.select("doc_id", F.length("text").alias("_n")).withColumn("_k", rank).withColumn("_total", total)
    return rows.groupBy("doc_id").agg(F.median("_n").alias("median"), F.max(F.when(F.col("_k") == F.floor(F.col("_total") / 2) + 1, F.col("_n"))).alias("upper"), F.max(F.when(F.col("_k") == F.floor(F.col("_total") * 0.9) + 1, F.col("_n"))).alias("p90"))


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of ``value`` rising by one from row to row: keys, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_g", F.col(value) - F.row_number().over(w))
    return marked.groupBy(*keys, "_g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_g")


def table_covers(cells: Column, hay: Column) -> Column:
    """Whether every cell's words are in the folded text."""
    return F.forall(cells, lambda c: hay.contains(T.fold(c)) | F.forall(F.filter(F.split(c, T.SPACE), lambda t: t != ""), lambda t: hay.contains(t)))


def title_similarity(pairs: DataFrame) -> DataFrame:
    """Rows (id, ratio, match) of title pairs (id, a, b): equal, contained (four characters or more), or of a
    Ratcliff-Obershelp ratio of at least 0.8 (both eight or more). Spark has no such measure, so Arrow batches."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])

    rows = pairs.select("id", T.canon("a").alias("a"), T.canon("b").alias("b"))
    short = F.least(F.length("a"), F.length("b"))
    inside = (short >= 4) & (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    rows = rows.withColumn("ratio", F.round(ratio("a", "b"), 6))
    return rows.select("id", "ratio", ((F.col("a") == F.col("b")) | inside | ((short >= 8) & (F.col("ratio") >= 0.8))).alias("match"))
