"""Readers and writers: Markdown reports, registry tables, logs, page lines and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators.registry import COLUMNS


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Rows (filepath, stem, text) of Markdown files, exactly one closing line feed removed."""
    rows = spark.read.text(path, wholetext=True).withColumn("filepath", F.col("_metadata.file_path"))
    return rows.select("filepath", F.regexp_extract("filepath", r"([^/]+)\.md$", 1).alias("stem"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_markdown(docs: DataFrame, path: str) -> None:
    """One text file per partition, rows (text); the driver holds nothing."""
    docs.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def frontmatter(text: Column) -> Column:
    """Map of the keys between the opening and closing ``---`` to their raw values; null without front matter."""
    lines = F.split(text, "\n")
    end = F.array_position(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "---")
    block = F.slice(lines, F.lit(2), F.greatest(end - 1, F.lit(0)).cast("int"))
    pairs = F.filter(block, lambda x: x.rlike(r"^[a-z_]+:"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([a-z_]+):", 1).alias("k"), T.unquote(F.regexp_replace(x, r"^[a-z_]+:", "")).alias("v")))
    return F.when((F.element_at(lines, 1) == "---") & (end > 0), F.map_from_entries(entries))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows by column name: missing columns are blank, further ones ignored."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    return rows.select(*((F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in COLUMNS))


def write_registry(rows: DataFrame, path: str, order: Column) -> None:
    """Registry rows in order, tabs and line ends in values squeezed to spaces; one file, as the table is one."""
    clean = [F.regexp_replace(T.text(c), r"[\t\r\n]+", " ").alias(c) for c in COLUMNS]
    rows.orderBy(order).select(*clean).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="")


def read_log(spark: SparkSession, path: str, normal: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Entries of a JSON log whose status isn't normal."""
    files = spark.read.json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.*")
    return files.filter(~F.col("status").isin(*normal))


def page_lines(docs: DataFrame, per_page: int = 3) -> DataFrame:
    """Rows (doc_id, page, line, addr, text): documents' lines laid out as pages of ``per_page`` lines."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("addr", "text"))
    return rows.select("doc_id", F.floor(F.col("addr") / per_page).cast("int").alias("page"), (F.col("addr") % per_page).alias("line"), "addr", "text")


def html_text(html: Column) -> Column:
    """Visible text of simple HTML: scripts, styles and comments out, tags to spaces, usual entities resolved."""
    s = F.regexp_replace(T.text(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))
