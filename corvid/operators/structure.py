"""Structure detection in plain page lines: chapter profiles, the walk through chapters, sub-heading families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import text as T

#: Chapter grammars in the order in which they are tried; group 1 is the number.
PROFILES = [
    ("jang_split", r"^제\s*(\d{1,2})\s*장\z"),
    ("jang", r"^제\s*(\d{1,2})\s*장[.\s]+\S"),
    ("roman_unicode", r"^([Ⅰ-Ⅻ])\.\s*\S"),
    ("roman_ascii", r"^([IVX]{1,4})\.?\s+\S"),
    ("roman_mixed", r"^([IVXⅠ-Ⅻ]{1,4})\.?\s+\S"),
    ("arabic", r"^(\d{1,2})\.(?!\s*\d)\s+\S"),
    ("bare_digit_split", r"^(\d{1,2})\z"),
]
#: Ranks of bullet glyphs, and those that need a space behind them.
BULLET_RANKS = {1: "□", 2: "○ㅇ❍◉", 3: "▸▪‣", 4: "-–∙•Ÿ"}
DASHES = "-–"
#: Sub-heading grammars; a line belongs to the first that it matches.
FAMILIES = [
    ("jeol", r"^제\s*(\d{1,2})\s*절[.\s]*\S", 1),
    ("num_dot_num", r"^(\d{1,2})\.(\d{1,2})\.?\s+\S", 2),
    ("num_dot", r"^(\d{1,2})\.(?!\s*\d)\s*\S", 1),
    ("paren_num", r"^\((\d{1,2})\)\s*\S", 1),
    ("num_paren", r"^(\d{1,2})\)\s*\S", 1),
    ("ga_dot", r"^([가-힣])\.\s*\S", 1),
    ("ga_paren", r"^\(?([가-힣])\)\s*\S", 1),
]


def next_in_turn(values: Column) -> Column:
    """Positions (0-based) of the values that are each one more than the last accepted, from 1."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("at"))
    step = lambda a, x: F.when(x["value"] == a["last"] + 1, F.struct(x["value"].alias("last"), F.concat(a["at"], F.array(x["addr"])).alias("at"))).otherwise(a)
    return F.aggregate(values, start.cast("struct<last:int,at:array<int>>"), step, lambda a: a["at"])


def chapters(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, profile, addr, value): the chapters of the winning profile of lines (doc_id, addr, text).

    In each profile the lines whose number continues the count are its chapters. The first profile with two wins; a
    pure Roman one gives way to the mixed one if that finds more. Documents without a winner have no rows.
    """
    text = T.strip("text")
    matches = F.array(*(F.when(text.rlike(p), F.struct(F.lit(k).alias("k"), F.lit(n).alias("profile"), T.chapter_value(F.regexp_extract(text, p, 1)).alias("value"))) for k, (n, p) in enumerate(PROFILES)))
    found = lines.select("doc_id", "addr", F.explode(F.filter(matches, lambda m: m.isNotNull() & m["value"].isNotNull())).alias("m")).select("doc_id", "addr", "m.*")
    per = found.groupBy("doc_id", "k", "profile").agg(F.array_sort(F.collect_list(F.struct("addr", "value"))).alias("_all"))
    per = per.withColumn("_at", next_in_turn(F.col("_all"))).withColumn("_n", F.size("_at")).filter("_n >= 2")
    doc = Window.partitionBy("doc_id")
    mixed = F.max(F.when(F.col("profile") == "roman_mixed", F.col("_n"))).over(doc)
    first = F.min("k").over(doc)
    best = F.min_by("profile", "k").over(doc)
    chosen = F.when(best.isin("roman_unicode", "roman_ascii") & (mixed > F.max(F.when(F.col("k") == F.col("_first"), F.col("_n"))).over(doc)), F.lit("roman_mixed")).otherwise(best)
    per = per.withColumn("_first", first).withColumn("_chosen", chosen).filter("profile = _chosen")
    return per.select("doc_id", "profile", F.posexplode("_at").alias("_i", "addr")).withColumn("value", F.col("_i") + 1).drop("_i")


def families(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, chapter, family, depth, n): sub-heading families in lines (doc_id, chapter, addr, text).

    Families are ordered by where they first appear with the value 1; the first three get depths 2 to 4. ``n`` counts
    the headings whose value continues their family's count within the chapter.
    """
    text = T.strip("text")
    hits = F.coalesce(*(F.when(text.rlike(p), F.struct(F.lit(n).alias("family"), T.heading_number(F.regexp_extract(text, p, g)).alias("value"))) for n, p, g in FAMILIES))
    found = lines.select("doc_id", "chapter", "addr", hits.alias("h")).filter("h IS NOT NULL").select("doc_id", "chapter", "addr", "h.*").filter("value IS NOT NULL")
    seen = found.filter("value = 1").groupBy("doc_id", "family").agg(F.min("addr").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first"))
    depth = seen.withColumn("depth", rank + 1).filter("depth <= 4").drop("_first")
    per = found.groupBy("doc_id", "chapter", "family").agg(F.array_sort(F.collect_list(F.struct("addr", "value"))).alias("_all"))
    per = per.withColumn("n", F.size(next_in_turn(F.col("_all")))).filter("n > 0")
    return per.join(depth, ["doc_id", "family"]).select("doc_id", "chapter", "family", "depth", "n")


def bullets(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, glyph, depth): bullets in use; their ranks are made consecutive per document. Dashes need a
    space behind them."""
    t = T.strip("text")
    glyph = F.substring(t, 1, 1)
    rank = F.lit(None).cast("int")
    for n, glyphs in BULLET_RANKS.items():
        rank = F.when(F.instr(F.lit(glyphs), glyph) > 0, n).otherwise(rank)
    dash = F.instr(F.lit(DASHES), glyph) > 0
    rows = lines.select("doc_id", glyph.alias("glyph"), F.when((t != "") & (~dash | (F.substring(t, 2, 1) == " ")), rank).alias("_rank"))
    used = rows.filter("_rank is not null").distinct()
    return used.select("doc_id", "glyph", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_rank")).alias("depth"))


def part_starts(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page): pages (doc_id, page, footer) where numbering starts again at 1 after it went beyond 1."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.filter("footer IS NOT NULL")
    return rows.withColumn("_max", F.max("footer").over(w)).filter("footer = 1 AND _max > 1").select("doc_id", "page")


def body_start(pages: DataFrame, ahead: int = 25) -> DataFrame:
    """Rows (doc_id, page): the first page from the last footer 1 on that has a chapter candidate, isn't front
    matter, and has no front title on the next ``ahead`` pages. ``pages``: doc_id, page, footer, candidate, front."""
    doc = Window.partitionBy("doc_id")
    rows = pages.withColumn("_anchor", F.coalesce(F.max(F.when(F.col("footer") == 1, F.col("page"))).over(doc), F.min("page").over(doc)))
    later = doc.orderBy("page").rowsBetween(1, ahead)
    rows = rows.withColumn("_front", F.coalesce(F.max(F.col("front").cast("int")).over(later), F.lit(0)))
    return rows.filter("page >= _anchor AND candidate AND NOT front AND _front = 0").groupBy("doc_id").agg(F.min("page").alias("page"))


def clean_tables(tables: DataFrame) -> DataFrame:
    """``tables`` with ``md``: Markdown of the column ``rows`` (array of rows of cells).

    Repeated neighbours are blanked, empty columns and rows dropped; null if fewer than two rows or columns remain.
    Cells are stripped and their pipes escaped. Each step is a column of its own, so that it is computed once.
    """
    blank = F.lit("")
    cell = lambda c: F.replace(T.strip(c), F.lit("|"), F.lit("\\|"))
    some = lambda r: F.exists(r, lambda c: c != "")
    df = tables.withColumn("_grid", F.transform("rows", lambda r: F.transform(r, cell)))
    df = df.withColumn("_grid", F.transform("_grid", lambda r: F.transform(r, lambda c, i: F.when((i > 0) & (c == F.get(r, i - 1)), blank).otherwise(c))))
    # of all rows together, the columns in which any cell is filled
    used = F.array_distinct(F.flatten(F.transform("_grid", lambda r: F.filter(F.transform(r, lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull()))))
    df = df.withColumn("_keep", F.array_sort(used))
    df = df.withColumn("_grid", F.transform(F.filter("_grid", some), lambda r: F.transform("_keep", lambda j: F.coalesce(F.get(r, j), blank))))
    df = df.withColumn("_grid", F.filter("_grid", some))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("_keep", lambda j: F.lit(" --- ")), "|"), F.lit("|"))
    text = F.array_join(F.concat(F.array(line(F.get("_grid", F.lit(0))), rule), F.transform(F.slice("_grid", F.lit(2), F.greatest(F.size("_grid") - 1, F.lit(0))), line)), "\n")
    return df.withColumn("md", F.when((F.size("_grid") >= 2) & (F.size("_keep") >= 2), text)).drop("_grid", "_keep")
