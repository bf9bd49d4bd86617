"""Queries of page lines: front matter, contents, running heads, footnotes, geometry, tables and marks on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.operators import pages as P
from corvid.plans.queries import query
from corvid.plans.tables import sql_fold, sql_strip, table
from corvid.sources import readers

#: Page lines made of the documents: pages of eight lines; by their place, whole lines get marks of running
#: heads (first and last lines), front matter, contents, footnotes, bullets and captions. Sizes and boxes follow from place and length.
REPORT_SQL = """WITH raw AS (SELECT doc_id, (u.i - 1)::INTEGER AS addr, u.x FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM documents)),
marked AS (SELECT doc_id, addr // 8 AS page, addr % 8 AS line, addr, CASE WHEN addr % 8 = 0 AND doc_id % 2 = 0 THEN (addr // 8 + 7) || ' _ 머리말 ' || doc_id || '호' WHEN addr % 8 = 7 AND addr // 8 % 3 > 0 THEN '꼬리말 ' || doc_id || '  ' || (addr // 8 + 7) ELSE CASE ((addr + doc_id) % 13)
  WHEN 0 THEN CASE (addr // 8) % 4 WHEN 0 THEN '편집순서 3 목 차' WHEN 1 THEN 'CONTENTS' WHEN 2 THEN '요 약 문' ELSE '표 차례 (계속)' END
  WHEN 1 THEN '제' || (addr // 13 + 1) || '장 ' || x WHEN 2 THEN x || ' ······ 3' WHEN 3 THEN x || ' .... 4' WHEN 4 THEN '5 ‧‧‧‧ ' || x WHEN 5 THEN x || '  ' || (addr // 8 + 7) WHEN 6 THEN (addr // 8 + 7) || ' _ ' || x
  WHEN 7 THEN '12' WHEN 8 THEN (addr % 9 + 1) || ') ' || x WHEN 9 THEN CASE WHEN addr % 2 = 0 THEN '■ ' ELSE '□ ' END || x WHEN 10 THEN '그림 1. ' || x ELSE x END END AS text FROM raw),
rl AS (SELECT *, (8 + length(text) % 4)::DOUBLE AS size, (addr % 3 * 10)::DOUBLE AS x0, (addr % 3 * 10 + 5 * length(text))::DOUBLE AS x1,
  CASE WHEN line < 5 THEN 100 * line ELSE 350 + 30 * line END::DOUBLE AS y0, CASE WHEN line < 5 THEN 100 * line ELSE 350 + 30 * line END::DOUBLE + 12 AS y1, 800.0::DOUBLE AS height FROM marked) """


def report_lines(spark, sf_dir):
    rows = readers.page_lines(table(spark, sf_dir, "documents"), 8)
    x, k, page = F.col("text"), F.pmod(F.col("addr") + F.col("doc_id"), F.lit(13)), F.col("page")
    number = (page + 7).cast("string")
    title = F.when(page % 4 == 0, "편집순서 3 목 차").when(page % 4 == 1, "CONTENTS").when(page % 4 == 2, "요 약 문").otherwise("표 차례 (계속)")
    chapter = F.concat(F.lit("제"), (F.floor(F.col("addr") / 13) + 1).cast("string"), F.lit("장 "), x)
    bullet = F.concat(F.when(F.col("addr") % 2 == 0, "■ ").otherwise("□ "), x)
    note = F.concat((F.col("addr") % 9 + 1).cast("string"), F.lit(") "), x)
    cases = [title, chapter, F.concat(x, F.lit(" ······ 3")), F.concat(x, F.lit(" .... 4")), F.concat(F.lit("5 ‧‧‧‧ "), x), F.concat(x, F.lit("  "), number), F.concat(number, F.lit(" _ "), x), F.lit("12"), note, bullet, F.concat(F.lit("그림 1. "), x)]
    doc = F.col("doc_id").cast("string")
    heads = F.concat(number, F.lit(" _ 머리말 "), doc, F.lit("호")), F.concat(F.lit("꼬리말 "), doc, F.lit("  "), number)
    text = F.when((F.col("line") == 0) & (F.col("doc_id") % 2 == 0), heads[0]).when((F.col("line") == 7) & (page % 3 > 0), heads[1])
    for n, c in enumerate(cases):
        text = text.when(k == n, c)
    y0 = F.when(F.col("line") < 5, 100 * F.col("line")).otherwise(350 + 30 * F.col("line")).cast("double")
    rows = rows.withColumn("text", text.otherwise(x))
    left = (F.col("addr") % 3 * 10).cast("double")
    return rows.select(
        "doc_id", "page", "line", "addr", "text", (8 + F.length("text") % 4).cast("double").alias("size"), left.alias("x0"), (left + 5 * F.length("text")).alias("x1"), y0.alias("y0"), (y0 + 12).alias("y1"), F.lit(800.0).alias("height")
    )


FRONT = rf"(regexp_matches({sql_strip('text')}, '{P.FRONT_TITLE}') OR regexp_matches(text, '{P.ABSTRACT_TITLE}'))"
LEADS = f"regexp_matches(text, '{P.LEADER}')"


@query("q_page_stats", REPORT_SQL + f"SELECT doc_id, page, sum(length({sql_strip('text')}))::BIGINT AS chars, count(*) AS lines, sum({LEADS}::INTEGER)::BIGINT AS leaders FROM rl GROUP BY doc_id, page")
def page_stats(spark, sf_dir):
    return P.page_stats(report_lines(spark, sf_dir))


@query("q_front_pages", REPORT_SQL + f"""SELECT doc_id, page, sum({LEADS}::INTEGER) >= 3 OR sum({LEADS}::INTEGER) / count(*) > 0.3 OR bool_or({FRONT} AND line < 6) AS front, bool_or({FRONT} AND line < 8) AS titled FROM rl GROUP BY doc_id, page""")
def front_pages(spark, sf_dir):
    return P.front_pages(report_lines(spark, sf_dir))


@query("q_running_heads", REPORT_SQL + rf""", e AS (SELECT *, {sql_strip('text')} AS t, min(line) OVER w AS f, max(line) OVER w AS l FROM rl WINDOW w AS (PARTITION BY doc_id, page)),
  p AS (SELECT *, 'top' AS pos FROM e WHERE line = f UNION ALL SELECT *, 'bottom' FROM e WHERE line = l),
  c AS (SELECT doc_id, page, pos, CASE WHEN regexp_matches(t, '{P.HEAD_THEN_NUMBER}') THEN regexp_extract(t, '{P.HEAD_THEN_NUMBER}', 1) ELSE regexp_extract(t, '{P.NUMBER_THEN_HEAD}', 2) END AS title,
    try_cast(CASE WHEN regexp_matches(t, '{P.HEAD_THEN_NUMBER}') THEN regexp_extract(t, '{P.HEAD_THEN_NUMBER}', 2) ELSE regexp_extract(t, '{P.NUMBER_THEN_HEAD}', 1) END AS INTEGER) AS number
    FROM p WHERE length(t) <= 80 AND NOT {LEADS}),
  d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pos, number - page) AS n FROM c WHERE number IS NOT NULL AND regexp_matches(title, '[^0-9\s·･‧_|\-–—.,]') AND length(regexp_replace({sql_fold('title')}, '^[·･‧_|\-–—]+|[·･‧_|\-–—]+$', '', 'g')) >= 2)
  SELECT doc_id, pos, page, title, number FROM d WHERE n >= 3""")
def running_heads(spark, sf_dir):
    return P.running_heads(report_lines(spark, sf_dir))


KIND = rf"""(SELECT CASE WHEN regexp_matches(z, '{P.CONTENTS_KO}') THEN 'ko' WHEN regexp_matches(z, '{P.CONTENTS_EN}') THEN 'en' WHEN regexp_matches(z, '{P.FRONT_TITLE}') OR regexp_matches(z, '{P.ABSTRACT_TITLE}') THEN 'other' END
  FROM (SELECT {sql_strip(r"regexp_replace(regexp_replace(text, '^\s*편집순서\s*[0-9]+\s*', ''), '\s*\([^()]*\)\s*$', '')")} AS z))"""


@query("q_contents_titles", REPORT_SQL + f"SELECT doc_id, addr, {KIND} AS kind FROM rl")
def contents_titles(spark, sf_dir):
    return report_lines(spark, sf_dir).select("doc_id", "addr", P.contents_title("text").alias("kind"))


@query("q_contents_pages", REPORT_SQL + rf""", k AS (SELECT *, {KIND} AS kind, {LEADS} AS leads, regexp_matches({sql_strip('text')}, '^[0-9]{{1,3}}$') AS bare FROM rl),
  g AS (SELECT doc_id, page, arg_min(kind, line) FILTER (kind = 'other' OR (kind IS NOT NULL AND line < 8)) AS title, min(line) FILTER (kind = 'other' OR (kind IS NOT NULL AND line < 8)) AS title_at,
    count(*) FILTER (leads) AS leaders, count(*) FILTER (bare) AS bares, min(line) FILTER (leads OR bare) AS first_like FROM k GROUP BY doc_id, page),
  f AS (SELECT *, CASE WHEN title IN ('ko', 'en') THEN title WHEN title = 'other' OR NOT (leaders >= 3 OR bares >= 3) THEN 'end' END AS effect FROM g),
  c AS (SELECT *, last_value(effect IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain,
    last_value(effect IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
  r AS (SELECT *, coalesce(nullif(chain, 'end'), CASE WHEN title = 'other' AND first_like < title_at THEN nullif(before, 'end') END) AS lane FROM c)
  SELECT doc_id, page, CASE WHEN leaders >= 3 OR lane = 'ko' THEN 'primary' ELSE 'secondary' END AS lane FROM r WHERE leaders >= 3 OR lane IS NOT NULL""")
def contents_pages(spark, sf_dir):
    return P.contents_pages(report_lines(spark, sf_dir))


@query("q_footnotes", REPORT_SQL + rf""", s AS (SELECT doc_id, size, sum(length(text)) AS n, min(addr) AS place FROM rl GROUP BY doc_id, size),
  m AS (SELECT doc_id, arg_max(size, n * 1000000 - place) AS modal FROM s GROUP BY doc_id),
  a AS (SELECT rl.*, size <= modal - 1.3 AND y0 > 0.66 * height AS low FROM rl JOIN m USING (doc_id)),
  b AS (SELECT *, low AND regexp_matches({sql_strip('text')}, '{P.FOOTNOTE}') AS start, coalesce(y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY line) < 2.5 * greatest(y1 - y0, 1), false) AS near FROM a),
  c AS (SELECT *, sum((NOT (low AND NOT start AND near))::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM b),
  d AS (SELECT *, bool_or(start) OVER (PARTITION BY doc_id, page, run) AS begun FROM c)
  SELECT doc_id, page, line FROM d WHERE start OR (low AND near AND begun)""")
def footnotes(spark, sf_dir):
    return P.footnotes(report_lines(spark, sf_dir))


@query("q_line_geometry", REPORT_SQL + f""", q AS (SELECT *, list_sort(list(CASE WHEN length({sql_strip('text')}) >= 20 THEN x1 END) FILTER (length({sql_strip('text')}) >= 20) OVER (PARTITION BY doc_id, page)) AS xs, median(size) OVER (PARTITION BY doc_id, page) AS med, max(x1) OVER (PARTITION BY doc_id, page) AS widest FROM rl)
  SELECT doc_id, page, line, coalesce(xs[floor(len(xs) * 0.9)::INTEGER + 1] - x1 < 12, false) AS wide, size - med AS size_delta, x1 >= 0.92::DOUBLE * widest AS "full" FROM q""")
def line_geometry(spark, sf_dir):
    return P.geometry(report_lines(spark, sf_dir))


@query("q_line_residue", REPORT_SQL + rf"""SELECT doc_id, addr, CASE WHEN contains({sql_fold('text')}, '편집순서') OR contains({sql_fold('text')}, '(정책과제관리번호기재)') THEN 'template' WHEN regexp_matches(text, '{P.CAPTION}') THEN 'caption'
  WHEN regexp_matches(text, '^\s*[0-9]*\s*(페이지|쪽|면수|면)\s*[.]?\s*$|^\s*[0-9]{{1,4}}\s*$') THEN 'page count' WHEN regexp_matches(text, '[\x{{E000}}-\x{{F8FF}}]') THEN 'private' END AS residue FROM rl""")
def line_residue(spark, sf_dir):
    return report_lines(spark, sf_dir).select("doc_id", "addr", P.residue("text").alias("residue"))


#: The last page of every document whose number of lines is even begins with a caution, of others it ends with a hint.
COLOPHON_SQL = REPORT_SQL + ", n AS (SELECT *, max(addr) OVER (PARTITION BY doc_id) AS top FROM rl), cl AS (SELECT doc_id, page, line, CASE WHEN top % 2 = 1 AND line = 0 AND page >= top // 8 - 3 THEN ' 주 의' WHEN top % 2 = 0 AND addr = top THEN text || ' 개인적 견해' ELSE text END AS text FROM n) "


@query("q_colophon_pages", COLOPHON_SQL + f""", g AS (SELECT doc_id, page, string_agg({sql_fold('text')}, '' ORDER BY line) AS f, {sql_fold('arg_min(text, line)')} AS head FROM cl GROUP BY doc_id, page), l AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last FROM g)
  SELECT doc_id, page FROM l WHERE page > last - 3 AND (head = '주의' OR contains(f, '개인적견해') OR contains(f, '글꼴은문') OR contains(f, '이하여백'))""")
def colophon_pages(spark, sf_dir):
    from pyspark.sql import Window

    top = F.max("addr").over(Window.partitionBy("doc_id"))
    rows = report_lines(spark, sf_dir).withColumn("top", top)
    caution = (F.col("top") % 2 == 1) & (F.col("line") == 0) & (F.col("page") >= F.floor(F.col("top") / 8) - 3)
    text = F.when(caution, " 주 의").when((F.col("top") % 2 == 0) & (F.col("addr") == F.col("top")), F.concat("text", F.lit(" 개인적 견해"))).otherwise(F.col("text"))
    return P.colophon_pages(rows.select("doc_id", "page", "line", text.alias("text")))


@query("q_reading_order", REPORT_SQL + "SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id, page ORDER BY length(text) % 5 * 10, x0, line)::INTEGER AS place FROM rl")
def reading_order(spark, sf_dir):
    rows = report_lines(spark, sf_dir).withColumn("y0", F.length("text") % 5 * 10 + F.lit(0.02))  # off by less than a tenth
    return P.reading_order(rows).select("doc_id", "page", "line", "place")


#: Two tables on every page: lines 1 to 3, and a box over the left half of line 3 and over line 5.
TABLES_SQL = REPORT_SQL + ", tb AS (SELECT DISTINCT doc_id, page, t.tab, t.x0, t.y0, t.x1, t.y1 FROM rl, (VALUES (0, 0.0::DOUBLE, 95.0::DOUBLE, 150.0::DOUBLE, 320.0::DOUBLE), (1, 0.0::DOUBLE, 300.0::DOUBLE, 400.0::DOUBLE, 512.0::DOUBLE)) AS t(tab, x0, y0, x1, y1)) "


def page_tables(spark, lines):
    boxes = F.array(*(F.struct(F.lit(t).alias("tab"), *(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), b))) for t, b in enumerate([(0.0, 95.0, 150.0, 320.0), (0.0, 300.0, 400.0, 512.0)])))
    return lines.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(boxes).alias("b")).select("doc_id", "page", "b.*")


@query("q_lines_in_tables", TABLES_SQL + """SELECT doc_id, page, line, min(tab) AS tab FROM rl JOIN (SELECT doc_id, page, tab, x0 AS a0, y0 AS b0, x1 AS a1, y1 AS b1 FROM tb) USING (doc_id, page)
  WHERE greatest(least(x1, a1) - greatest(x0, a0), 0) * greatest(least(y1, b1) - greatest(y0, b0), 0) / greatest((x1 - x0) * (y1 - y0), 1) >= 0.5 GROUP BY doc_id, page, line""")
def lines_in_tables(spark, sf_dir):
    rows = report_lines(spark, sf_dir)
    return P.lines_in_tables(rows, page_tables(spark, rows))


@query("q_interleave", TABLES_SQL + """, i AS (SELECT doc_id, page, line AS item, y0, 'line' AS kind FROM rl UNION ALL SELECT doc_id, page, tab, y0, 'table' FROM tb)
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, kind = 'table', item)::INTEGER AS place, kind, item FROM i""")
def interleave(spark, sf_dir):
    rows = report_lines(spark, sf_dir)
    return P.interleave(rows, page_tables(spark, rows))


@query("q_marked_blocks", REPORT_SQL + "SELECT doc_id, addr AS at, (SELECT max(m.page) FROM rl m WHERE m.doc_id = rl.doc_id AND m.addr <= rl.addr AND m.line = 2 AND length(m.text) % 2 = 0) AS page FROM rl")
def marked_blocks(spark, sf_dir):
    """The pages' marks are third lines of even length; every line asks for the last mark up to it."""
    rows = report_lines(spark, sf_dir)
    return P.marked_blocks(rows.select("doc_id", F.col("addr").alias("at")), rows.filter((F.col("line") == 2) & (F.length("text") % 2 == 0)).select("doc_id", F.col("addr").alias("at"), "page"))


@query("q_image_markers", REPORT_SQL + """, p AS (SELECT doc_id, page, sum(length(text)) % 3 > 0 AS image_only FROM rl GROUP BY doc_id, page), g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p WHERE image_only),
  r AS (SELECT doc_id, min(page) AS first, max(page) AS last FROM g GROUP BY doc_id, g)
  SELECT *, '<!-- p.' || (first + 1) || CASE WHEN last > first THEN '-' || (last + 1) ELSE '' END || ': 이미지 전용 페이지, 텍스트 추출 불가 -->' AS marker FROM r""")
def image_markers(spark, sf_dir):
    pages = report_lines(spark, sf_dir).groupBy("doc_id", "page").agg((F.sum(F.length("text")) % 3 > 0).alias("image_only"))
    return P.image_markers(pages)


@query("q_suspect_lines", REPORT_SQL + f""", s AS (SELECT doc_id, addr, {sql_strip('text')} AS text FROM rl), d AS (SELECT doc_id, text, min(addr) AS place FROM s WHERE text <> '' AND contains('{P.SUSPECT}', substr(text, 1, 1)) GROUP BY doc_id, text)
  SELECT doc_id, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place)::INTEGER AS rank FROM d) WHERE rank <= 30""")
def suspect_lines(spark, sf_dir):
    return P.suspects(report_lines(spark, sf_dir))


@query("q_bullets", REPORT_SQL + f""", b AS (SELECT DISTINCT doc_id, substr({sql_strip('text')}, 1, 1) AS glyph, substr({sql_strip('text')}, 2, 1) AS after FROM (SELECT doc_id, CASE (addr * 7 + doc_id) % 9 WHEN 0 THEN '○ ' WHEN 1 THEN 'ㅇ' WHEN 2 THEN '-' WHEN 3 THEN '- ' WHEN 4 THEN '•' WHEN 5 THEN '▪ ' ELSE '' END || text AS text FROM rl)),
  r AS (SELECT doc_id, glyph, min(CASE WHEN glyph = '□' THEN 1 WHEN contains('○ㅇ❍◉', glyph) THEN 2 WHEN contains('▸▪‣', glyph) THEN 3 ELSE 4 END) AS rank FROM b WHERE glyph <> '' AND (contains('□○ㅇ❍◉▸▪‣∙•Ÿ', glyph) OR (contains('-–', glyph) AND after = ' ')) GROUP BY doc_id, glyph)
  SELECT doc_id, glyph, dense_rank() OVER (PARTITION BY doc_id ORDER BY rank)::INTEGER AS depth FROM r""")
def bullets(spark, sf_dir):
    from corvid.operators import structure

    k = F.pmod(F.col("addr") * 7 + F.col("doc_id"), F.lit(9))
    mark = F.when(k == 0, "○ ").when(k == 1, "ㅇ").when(k == 2, "-").when(k == 3, "- ").when(k == 4, "•").when(k == 5, "▪ ").otherwise("")
    return structure.bullets(report_lines(spark, sf_dir).select("doc_id", F.concat(mark, F.col("text")).alias("text")))
