"""Page lines of reports: leaders, front matter, running heads, footnotes, contents pages, geometry, tables on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import text as T

#: Patterns that results depend on.
LEADER = "[·‧․.]{4,}"
FOOTER = r"^\s*-\s*(\d+|[ivxlcdmIVXLCDM]+)\s*-\s*\z"
FRONT_TITLE = r"^\s*(요\s*약\s*문|SUMMARY|Summary|CONTENTS|Contents|목\s*차|제\s*출\s*문|표\s*차\s*례|그\s*림\s*차\s*례|표\s*목\s*차|그\s*림\s*목\s*차|List of Tables|List of Figures)\s*\z"
ABSTRACT_TITLE = r"최\s*종\s*보\s*고\s*서\s*초\s*록"
HEAD_THEN_NUMBER = r"^(\S.*?\S)\s*(?:[·･‧_|\-–—]\s*)?(\d{1,3})\z"
NUMBER_THEN_HEAD = r"^(\d{1,3})\s*(?:[·･‧_|\-–—]\s*)?([^\s.)\]}>]\S*.*)\z"
FOOTNOTE = r"^\d{1,3}\)\s*\S"
CAPTION = r"^\s*[\[<(〈［]?\s*(?:그림|표)\s*[\d.\-]+"
PAGE_COUNT_CELL = r"^\s*\d*\s*(?:페이지|쪽|면수|면)\s*\.?\s*\z|^\s*\d{1,4}\s*\z"
TEMPLATE = ("편집순서", "(정책과제관리번호기재)")
COLOPHON = ("개인적견해", "글꼴은문", "이하여백")
SUSPECT = "◈☐■◦▶►●◇◆▷▹✓✔"
CONTENTS_KO, CONTENTS_EN = r"^(?:목\s*차|차\s*례)\z", r"^(?:CONTENTS|Contents)\z"
#: Least leader lines of a contents page, lines looked at for a title, running-head limits.
LEADERS, SHARE, FRONT_LINES, TITLE_LINES, BARE = 3, 0.3, 6, 8, 3
HEAD_CHARS, HEAD_PAGES = 80, 3


def is_leader(text: Column | str) -> Column:
    return T.text(text).rlike(LEADER)


def is_front_title(text: Column | str) -> Column:
    return T.strip(text).rlike(FRONT_TITLE) | T.text(text).rlike(ABSTRACT_TITLE)


def page_stats(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page, chars, lines, leaders) of page lines."""
    return lines.groupBy("doc_id", "page").agg(F.sum(F.length(T.strip("text"))).alias("chars"), F.count("*").alias("lines"), F.sum(is_leader("text").cast("long")).alias("leaders"))


def front_pages(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page, front, titled) of page lines (doc_id, page, line, text).

    front: three leader lines, more than three in ten lines with leaders, or a front title in the first six lines;
    titled: a front title in the first eight.
    """
    title, leaders = is_front_title("text"), F.sum(is_leader("text").cast("int"))
    within = lambda n: F.max((title & (F.col("line") < n)).cast("int")) == 1
    front = (leaders >= LEADERS) | (leaders / F.count("*") > SHARE) | within(FRONT_LINES)
    return lines.groupBy("doc_id", "page").agg(front.alias("front"), within(TITLE_LINES).alias("titled"))


def running_heads(lines: DataFrame, least: int = HEAD_PAGES) -> DataFrame:
    """Rows (doc_id, pos, page, title, number): first and last lines of pages that are running heads.

    A candidate is a title with a number before or after it; candidates at the same place whose printed number is as
    far from the page's index belong together, and ``least`` of them make a running head. The title may change.
    """
    w = Window.partitionBy("doc_id", "page")
    places = F.array(F.when(F.col("line") == F.min("line").over(w), F.lit("top")), F.when(F.col("line") == F.max("line").over(w), F.lit("bottom")))
    rows = lines.withColumn("_places", places).withColumn("pos", F.explode(F.filter("_places", lambda x: x.isNotNull()))).withColumn("_t", T.strip("text"))
    rows = rows.filter((F.length("_t") <= HEAD_CHARS) & ~is_leader("text"))
    behind = F.col("_t").rlike(HEAD_THEN_NUMBER)
    title = F.when(behind, F.regexp_extract("_t", HEAD_THEN_NUMBER, 1)).otherwise(F.regexp_extract("_t", NUMBER_THEN_HEAD, 2))
    number = F.when(behind, F.regexp_extract("_t", HEAD_THEN_NUMBER, 2)).otherwise(F.regexp_extract("_t", NUMBER_THEN_HEAD, 1)).try_cast("int")
    rows = rows.withColumn("title", title).withColumn("number", number)
    letters = F.length(F.regexp_replace(T.fold("title"), r"^[·･‧_|\-–—]+|[·･‧_|\-–—]+\z", "")) >= 2
    rows = rows.filter(F.col("number").isNotNull() & letters & F.col("title").rlike(r"[^\d\s·･‧_|\-–—.,]"))
    group = Window.partitionBy("doc_id", "pos", F.col("number") - F.col("page"))
    return rows.withColumn("_n", F.count("*").over(group)).filter(F.col("_n") >= least).select("doc_id", "pos", "page", "title", "number")


def contents_title(text: Column | str) -> Column:
    """ko, en, other (another front title) or null, of a line that may carry a template's prefix or a bracket."""
    t = T.strip(F.regexp_replace(F.regexp_replace(T.text(text), r"^\s*편집순서\s*\d+\s*", ""), r"\s*\([^()]*\)\s*\z", ""))
    return F.when(t.rlike(CONTENTS_KO), "ko").when(t.rlike(CONTENTS_EN), "en").when(t.rlike(FRONT_TITLE) | t.rlike(ABSTRACT_TITLE), "other")


def contents_pages(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page, lane): pages of the table of contents, primary (leaders, or Korean) or secondary (English).

    A title starts a chain; it goes on over pages that look like contents (three leader or three bare-number lines)
    and ends at another front title or any other page. A page that ends a chain still belongs to it if lines like
    contents stand above that title.
    """
    kind = contents_title("text")
    first = F.min(F.when((kind == "other") | (kind.isin("ko", "en") & (F.col("line") < TITLE_LINES)), F.struct("line", kind.alias("kind"))))
    bare = T.strip("text").rlike(r"^\d{1,3}\z")
    pages = lines.groupBy("doc_id", "page").agg(
        first.alias("_t"),
        F.sum(is_leader("text").cast("int")).alias("_leaders"),
        F.sum(bare.cast("int")).alias("_bare"),
        F.min(F.when(is_leader("text") | bare, F.col("line"))).alias("_like"),
    )
    title, like = F.col("_t.kind"), (F.col("_leaders") >= LEADERS) | (F.col("_bare") >= BARE)
    # what a page does to the chain: starts one, ends it, or (null) leaves it
    effect = F.when(title.isin("ko", "en"), title).when((title == "other") | ~like, "end")
    order = Window.partitionBy("doc_id").orderBy("page")
    pages = pages.withColumn("_effect", effect)
    pages = pages.withColumn("_chain", F.last("_effect", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pages = pages.withColumn("_before", F.last("_effect", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    tail = F.when((title == "other") & (F.col("_like") < F.col("_t.line")), F.col("_before"))
    lane = F.coalesce(F.when(F.col("_chain") != "end", F.col("_chain")), F.when(tail != "end", tail))
    pages = pages.withColumn("lane", F.when((F.col("_leaders") >= LEADERS) | (lane == "ko"), "primary").when(lane == "en", "secondary"))
    return pages.filter("lane is not null").select("doc_id", "page", "lane")


def footnotes(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line) that are footnotes, of lines with size, y0, y1 and the page's height.

    A footnote begins with a small numbered line at the bottom and goes on over small lines right below it.
    """
    modal = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("_chars"), F.min(F.struct("page", "line")).alias("_at"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("_chars"), "_at")
    modal = modal.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("doc_id", F.col("size").alias("_modal"))
    page = Window.partitionBy("doc_id", "page").orderBy("line")
    low = (F.col("size") <= F.col("_modal") - 1.3) & (F.col("y0") > 0.66 * F.col("height"))
    rows = lines.join(modal, "doc_id").withColumn("_low", low)
    rows = rows.withColumn("_start", F.col("_low") & T.strip("text").rlike(FOOTNOTE))
    near = F.col("y0") - F.lag("y1").over(page) < 2.5 * F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    rows = rows.withColumn("_on", F.col("_low") & ~F.col("_start") & F.coalesce(near, F.lit(False)))
    # a run of lines that go on belongs to the line before it
    rows = rows.withColumn("_run", F.sum((~F.col("_on")).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    begun = F.max(F.col("_start").cast("int")).over(Window.partitionBy("doc_id", "page", "_run"))
    return rows.withColumn("_begun", begun).filter("_start or (_on and _begun = 1)").select("doc_id", "page", "line")


def geometry(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, page, line, wide, size_delta, full): wide, a line that reaches the right margin (the 90th
    percentile of lines of 20 characters) within 12; its size against the page's median; full, at 92 % of the page."""
    page = Window.partitionBy("doc_id", "page")
    long = F.when(F.length(T.strip("text")) >= 20, F.col("x1"))
    edges = lines.withColumn("_x", F.array_sort(F.collect_list(long).over(page)))
    margin = F.get("_x", F.floor(F.size("_x") * 0.9).cast("int"))
    return edges.select(
        "doc_id", "page", "line",
        F.coalesce(margin - F.col("x1") < 12, F.lit(False)).alias("wide"),
        (F.col("size") - F.median("size").over(page)).alias("size_delta"),
        (F.col("x1") >= 0.92 * F.max("x1").over(page)).alias("full"),
    )


def residue(text: Column | str) -> Column:
    """template, caption, page count, private (glyphs of the private area), or null for ordinary lines."""
    folded = T.fold(text)
    template = F.lit(False)
    for t in TEMPLATE:
        template = template | folded.contains(t)
    return F.when(template, "template").when(T.text(text).rlike(CAPTION), "caption").when(T.text(text).rlike(PAGE_COUNT_CELL), "page count").when(T.text(text).rlike("[\\uE000-\\uF8FF]"), "private")


def colophon_pages(lines: DataFrame, last: int = 3) -> DataFrame:
    """Pages (doc_id, page) among a document's ``last`` ones with a colophon's words, or headed by a caution."""
    folded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: T.fold(x["text"])), "")
    pages = lines.groupBy("doc_id", "page").agg(folded.alias("_f"), T.fold(F.min_by("text", "line")).alias("_first"))
    pages = pages.withColumn("_last", F.max("page").over(Window.partitionBy("doc_id"))).filter(F.col("page") > F.col("_last") - last)
    hint = F.col("_first") == "주의"
    for h in COLOPHON:
        hint = hint | F.col("_f").contains(h)
    return pages.filter(hint).select("doc_id", "page")


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with ``place``, their 1-based order on the page by rounded (y0, x0), then as they came."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.bround("y0", 1), F.bround("x0", 1), "line")
    return lines.withColumn("place", F.row_number().over(w))


def interleave(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows (doc_id, page, place, kind, item): lines (doc_id, page, line, y0) and tables (doc_id, page, tab, y0) of a
    page from top to bottom, a line before a table at the same height."""
    items = lines.select("doc_id", "page", F.col("line").alias("item"), "y0", F.lit("line").alias("kind"))
    items = items.unionByName(tables.select("doc_id", "page", F.col("tab").alias("item"), "y0", F.lit("table").alias("kind")))
    w = Window.partitionBy("doc_id", "page").orderBy("y0", F.col("kind") == "table", "item")
    return items.select("doc_id", "page", F.row_number().over(w).alias("place"), "kind", "item")


def lines_in_tables(lines: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows (doc_id, page, line, tab): lines (x0, y0, x1, y1) of which ``share`` of the area lies in a table; the
    first such table."""
    box = tables.select("doc_id", "page", "tab", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    met = lines.join(box, ["doc_id", "page"])
    side = lambda a, b: F.greatest(F.least(F.col(f"{b}"), F.col(f"_{b}")) - F.greatest(F.col(a), F.col(f"_{a}")), F.lit(0))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1.0))
    return met.filter(side("x0", "x1") * side("y0", "y1") / area >= share).groupBy("doc_id", "page", "line").agg(F.min("tab").alias("tab"))


def marked_blocks(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (doc_id, at, page): blocks (doc_id, at) with the page of the last mark (doc_id, at, page) at or before
    them (an as-of join in one sorted pass)."""
    both = blocks.select("doc_id", "at", F.lit(None).cast("int").alias("page"), F.lit(1).alias("_block"))
    both = both.unionByName(marks.select("doc_id", "at", F.col("page").cast("int").alias("page"), F.lit(0).alias("_block")))
    w = Window.partitionBy("doc_id").orderBy("at", "_block").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.last("page", True).over(w)).filter("_block = 1").select("doc_id", "at", "page")


def image_markers(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, first, last, marker) of runs of image-only pages (doc_id, page, image_only), pages from 0."""
    only = pages.filter("image_only")
    w = Window.partitionBy("doc_id").orderBy("page")
    runs = only.withColumn("_g", F.col("page") - F.row_number().over(w)).groupBy("doc_id", "_g").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    span = F.when(F.col("first") == F.col("last"), F.format_string("p.%d", F.col("first") + 1)).otherwise(F.format_string("p.%d-%d", F.col("first") + 1, F.col("last") + 1))
    return runs.select("doc_id", "first", "last", F.concat(F.lit("<!-- "), span, F.lit(": 이미지 전용 페이지, 텍스트 추출 불가 -->")).alias("marker"))


def suspects(lines: DataFrame, glyphs: str = SUSPECT, most: int = 30) -> DataFrame:
    """Rows (doc_id, rank, text): a document's first ``most`` distinct lines that begin with an unlisted bullet (the
    limit is the size of the report)."""
    t = T.strip("text")
    found = lines.select("doc_id", "addr", t.alias("text")).filter(F.instr(F.lit(glyphs), F.substring("text", 1, 1)) > 0).filter("text <> ''")
    first = found.groupBy("doc_id", "text").agg(F.min("addr").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "rank", "text")
