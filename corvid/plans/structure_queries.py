"""Queries of document structure, registry, verification, judgement and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid import config
from corvid.functions import text as T
from corvid.operators import checks, judge, registry, structure
from corvid.operators import sections as S
from corvid.plans.page_queries import REPORT_SQL, report_lines
from corvid.plans.queries import query
from corvid.plans.retrieval_queries import STAMPED, stamped
from corvid.plans.tables import literal, sql_fold, sql_strip, table, values
from corvid.sources import readers

# --- heading trees, from documents' lines ------------------------------------------------------------------------

#: Markdown made of the documents: lines 0, 5, 10, … become headings of depths 1, 2, 1, 3 in turn.
MARKDOWN_SQL = """WITH raw AS (SELECT doc_id, u.i - 1 AS i, u.x FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM documents)),
md AS (SELECT doc_id, i AS line, CASE WHEN i % 5 = 0 THEN repeat('#', CASE (i // 5) % 4 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END) || ' ' || substr(x, 1, 30) || ' <!-- id: ' || doc_id || '_h' || i || ' -->' ELSE x END AS text FROM raw),
hd AS (SELECT doc_id, line, length(regexp_extract(text, '^(#+) ', 1)) AS depth, regexp_extract(text, '^#+ (.*?) <!-- id: ', 1) AS title, regexp_extract(text, '<!-- id: ([^>]+?) -->$', 1) AS hid FROM md WHERE regexp_matches(text, '^#{1,4} .*? <!-- id: [^>]+? -->$')),
ends AS (SELECT doc_id, max(line) + 1 AS last FROM md GROUP BY doc_id),
tree AS (SELECT h.*, coalesce((SELECT min(n.line) FROM hd n WHERE n.doc_id = h.doc_id AND n.line > h.line), e.last) AS body_end,
  coalesce((SELECT min(n.line) FROM hd n WHERE n.doc_id = h.doc_id AND n.line > h.line AND n.depth <= h.depth), e.last) AS end_line,
  (SELECT arg_max(n.hid, n.line) FROM hd n WHERE n.doc_id = h.doc_id AND n.line < h.line AND n.depth < h.depth
     AND NOT EXISTS (SELECT 1 FROM hd m WHERE m.doc_id = h.doc_id AND m.line > n.line AND m.line < h.line AND m.depth < n.depth AND m.depth < h.depth AND false)) AS parent
  FROM hd h JOIN ends e USING (doc_id)) """


def markdown(spark, sf_dir, appendices: bool = False):
    lines = F.split("text", "\n")
    mark = lambda i: F.when((i % 40 == 20) & F.lit(appendices), "부록 ").otherwise("")
    depth = lambda i: F.when(F.floor(i / 5) % 4 == 1, "##").when(F.floor(i / 5) % 4 == 3, "###").otherwise("#")
    head = lambda x, i: F.concat(depth(i), F.lit(" "), mark(i), F.substring(x, 1, 30), F.lit(" <!-- id: "), F.col("doc_id").cast("string"), F.lit("_h"), i.cast("string"), F.lit(" -->"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.when(i % 5 == 0, head(x, i)).otherwise(x)), "\n").alias("text"))


@query("q_heading_tree", MARKDOWN_SQL + "SELECT doc_id, line::INTEGER AS line, depth::INTEGER AS depth, title, hid, body_end::INTEGER AS body_end, end_line::INTEGER AS end_line, parent FROM tree")
def heading_tree(spark, sf_dir):
    return S.headings(S.markdown_lines(markdown(spark, sf_dir)))


UNITS_SQL = (
    MARKDOWN_SQL
    + f""", dir AS (SELECT t.doc_id, t.hid, length({sql_strip("string_agg(m.text, chr(10) ORDER BY m.line)")}) AS direct FROM tree t LEFT JOIN md m ON m.doc_id = t.doc_id AND m.line > t.line AND m.line < t.body_end GROUP BY t.doc_id, t.hid),
sub AS (SELECT t.*, d.direct, (SELECT sum(dd.direct) FROM tree c JOIN dir dd USING (doc_id, hid) WHERE c.doc_id = t.doc_id AND c.line >= t.line AND c.line < t.end_line) AS total,
  (SELECT count(*) FROM tree c WHERE c.doc_id = t.doc_id AND c.line >= t.line AND c.line < t.end_line) > 1 AS kids FROM tree t JOIN dir d USING (doc_id, hid)),
act AS (SELECT * FROM sub WHERE parent IS NULL
  UNION ALL SELECT s.* FROM sub s JOIN act a ON a.doc_id = s.doc_id AND s.parent = a.hid WHERE a.total > 4000 AND a.kids)
SELECT doc_id, hid, CASE WHEN total <= 4000 OR NOT kids THEN 'subtree' ELSE 'intro' END AS kind, line::INTEGER AS start,
  CASE WHEN total <= 4000 OR NOT kids THEN end_line ELSE body_end END::INTEGER AS "end", CASE WHEN total <= 4000 OR NOT kids THEN total ELSE direct END::BIGINT AS chars
FROM act WHERE CASE WHEN total <= 4000 OR NOT kids THEN total ELSE direct END >= 200"""
).replace("WITH raw", "WITH RECURSIVE raw", 1)


@query("q_split_units", UNITS_SQL)
def split_units(spark, sf_dir):
    return S.units(markdown(spark, sf_dir))


PATHS_SQL = (
    MARKDOWN_SQL
    + """, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY line) AS r FROM tree),
pth AS (SELECT doc_id, hid, [title] AS path, 'c' || r AS ordinal FROM rk WHERE parent IS NULL
  UNION ALL SELECT k.doc_id, k.hid, list_append(p.path, k.title), p.ordinal || 's' || k.r FROM rk k JOIN pth p ON p.doc_id = k.doc_id AND p.hid = k.parent)
SELECT * FROM pth"""
).replace("WITH raw", "WITH RECURSIVE raw", 1)


@query("q_unit_paths", PATHS_SQL)
def unit_paths(spark, sf_dir):
    return S.paths(S.headings(S.markdown_lines(markdown(spark, sf_dir))))


#: The same Markdown with some chapters that are appendices, which are rows of their own without a summary.
ROWS_SQL = (
    UNITS_SQL.replace("' ' || substr(x, 1, 30) ||", "' ' || CASE WHEN i % 40 = 20 THEN '부록 ' ELSE '' END || substr(x, 1, 30) ||")
    .replace("act AS (SELECT * FROM sub WHERE parent IS NULL", "act AS (SELECT * FROM sub WHERE parent IS NULL AND NOT (depth = 1 AND starts_with(title, '부록 '))")
    .replace("SELECT doc_id, hid, CASE WHEN total <= 4000", ", un AS (SELECT doc_id, hid, CASE WHEN total <= 4000", 1)
    + f"""), sp AS (SELECT doc_id, hid, start, "end", false AS out FROM un UNION ALL SELECT doc_id, hid, line, end_line, true FROM tree WHERE depth = 1 AND starts_with(title, '부록 ')),
  bd AS (SELECT s.doc_id, s.hid, s.start, s.out, {sql_strip("string_agg(CASE WHEN regexp_matches(m.text, ' <!-- id: [^>]+? -->$') THEN regexp_replace(m.text, ' <!-- id: [^>]+? -->$', '') || chr(10) ELSE m.text END, chr(10) ORDER BY m.line)")} AS body FROM sp s LEFT JOIN md m ON m.doc_id = s.doc_id AND m.line > s.start AND m.line < s."end" GROUP BY ALL),
  pt AS (SELECT doc_id, hid, [title] AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.hid, list_append(p.path, t.title) FROM tree t JOIN pt p ON p.doc_id = t.doc_id AND p.hid = t.parent)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start)::INTEGER AS doc_order, hid, path[1] AS chapter, array_to_string(path[2:], ' > ') AS section, CASE WHEN out THEN '' ELSE '요약 ' || hid END AS summary, body, {sql_fold('body')} AS body_fold FROM bd JOIN pt USING (doc_id, hid)"""
)


@query("q_report_rows", ROWS_SQL)
def report_rows(spark, sf_dir):
    docs = markdown(spark, sf_dir, appendices=True)
    heads = S.headings(S.markdown_lines(docs)).select("doc_id", "hid", F.concat(F.lit("요약 "), "hid").alias("summary"))
    return S.report_rows(S.insert_summaries(docs.withColumn("text", F.replace("text", F.lit(" -->"), F.lit(" -->\n"))), heads))


def summarised(spark, sf_dir):
    docs = markdown(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" -->"), F.lit(" -->\n")))  # a blank line follows
    heads = S.headings(S.markdown_lines(docs)).select("doc_id", "hid", F.concat(F.lit("요약 "), "hid").alias("summary"))
    return docs, heads, S.insert_summaries(docs, heads)


@query("q_strip_summaries", MARKDOWN_SQL + "SELECT doc_id, replace(string_agg(text, chr(10) ORDER BY line), ' -->', ' -->' || chr(10)) AS text FROM md GROUP BY doc_id")
def strip_summaries(spark, sf_dir):
    """Stripping what was inserted gives the documents back."""
    return S.strip_summaries(summarised(spark, sf_dir)[2]).select("doc_id", "text")


@query("q_roundtrip", "SELECT count(*) AS n, count(*) AS same FROM documents")
def roundtrip(spark, sf_dir):
    docs, _, filled = summarised(spark, sf_dir)
    back = S.strip_summaries(filled).select("doc_id", F.col("text").alias("again"))
    return docs.join(back, "doc_id").agg(F.count("*").alias("n"), F.sum((F.col("text") == F.col("again")).cast("long")).alias("same"))


@query("q_summary_lines", MARKDOWN_SQL + "SELECT doc_id, hid, '요약 ' || hid AS summary FROM hd")
def summary_lines(spark, sf_dir):
    return S.summaries(summarised(spark, sf_dir)[2]).select("doc_id", "hid", "summary")


# --- pages, coverage, tables of contents --------------------------------------------------------------------------

LINES_SQL = """WITH ln AS (SELECT doc_id, ((u.i - 1) // 3)::INTEGER AS page, ((u.i - 1) % 3)::INTEGER AS line, (u.i - 1)::INTEGER AS addr, u.x AS text FROM (
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM documents)) """


def lines(spark, sf_dir):
    return readers.page_lines(table(spark, sf_dir, "documents"))


@query("q_modal_length", LINES_SQL + """, s AS (SELECT doc_id, length(text) AS size, sum(length(text)) AS total, min(addr) AS f FROM ln GROUP BY doc_id, length(text))
  SELECT doc_id, size::INTEGER AS size, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, f) AS k FROM s) WHERE k = 1""")
def modal_length(spark, sf_dir):
    return checks.modal_length(lines(spark, sf_dir).select("doc_id", F.col("addr").alias("line"), "text"))


@query("q_median_variants", LINES_SQL + """, r AS (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(text)) AS k, count(*) OVER (PARTITION BY doc_id) AS t FROM ln)
  SELECT doc_id, median(n) AS median, max(CASE WHEN k = t // 2 + 1 THEN n END)::INTEGER AS upper, max(CASE WHEN k = floor(t * 0.9) + 1 THEN n END)::INTEGER AS p90 FROM r GROUP BY doc_id""")
def median_variants(spark, sf_dir):
    return checks.medians(lines(spark, sf_dir))


@query("q_footer_runs", """WITH r AS (SELECT source, doc_id, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS g FROM documents)
  SELECT source, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM r GROUP BY source, g""")
def footer_runs(spark, sf_dir):
    """A source's documents stand for its pages: numbers in a row are one run."""
    return checks.islands(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", "doc_id")


GLYPHS = config.GLYPHS.replace("'", "''")


def sql_plain(c: str) -> str:
    return f"translate({sql_fold(c)}, '{GLYPHS}', '')"


COVER_SQL = f"WITH n AS (SELECT item_id, {sql_plain('text')} AS needle FROM benchmark), h AS (SELECT doc_id, {sql_plain('text')} AS hay FROM documents) "


@query("q_coverage_contains", COVER_SQL + "SELECT item_id, doc_id FROM n, h WHERE needle <> '' AND contains(hay, needle)")
def coverage_contains(spark, sf_dir):
    return checks.passages(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("q_coverage_ratio", COVER_SQL + "SELECT count(*) AS total, sum(found::INTEGER)::BIGINT AS found, round(sum(found::INTEGER) / count(*), 6) AS ratio FROM (SELECT EXISTS (SELECT 1 FROM h WHERE contains(h.hay, n.needle)) AS found FROM n WHERE needle <> '')")
def coverage_ratio(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").filter(T.fold_glyphs("text") != "")
    hit = checks.passages(items, table(spark, sf_dir, "documents")).select("item_id").distinct().withColumn("hit", F.lit(1))
    found = F.coalesce(F.sum("hit"), F.lit(0)).cast("long")
    return items.join(hit, "item_id", "left").agg(F.count("*").alias("total"), found.alias("found"), F.round(found / F.count("*"), 6).alias("ratio"))


#: The pages' lines as they would be scanned again: the report pages' marked lines, against the documents' own texts.
RESCAN_SQL = REPORT_SQL + f""", hay AS (SELECT doc_id, {sql_plain('text')} AS hay FROM documents), nd AS (SELECT doc_id, page, line, text, {sql_plain('text')} AS needle, regexp_matches(text, '[·‧․.]{{4,}}') AS leads, {sql_fold('text')} AS folded FROM rl),
  cv AS (SELECT doc_id, page, line, text, contains(hay, needle) AS covered FROM nd JOIN hay USING (doc_id) WHERE NOT leads AND needle <> '' AND NOT contains(folded, '편집순서') AND NOT contains(folded, '(정책과제관리번호기재)')) """


def rescanned(spark, sf_dir):
    return checks.uncovered(report_lines(spark, sf_dir), table(spark, sf_dir, "documents"))


@query("q_coverage_lines", RESCAN_SQL + "SELECT * FROM cv")
def coverage_lines(spark, sf_dir):
    return rescanned(spark, sf_dir)


@query("q_coverage_report", RESCAN_SQL + """, m AS (SELECT doc_id, count(*) AS needles, count(*) FILTER (NOT covered) AS misses, list({'page': page, 'line': line, 'text': text} ORDER BY page, line) FILTER (NOT covered) AS x FROM cv GROUP BY doc_id),
  z AS (SELECT doc_id, needles, misses, misses > 0.05 * needles AS drift, coalesce(list_transform(x, lambda s: 'p.' || (s.page + 1) || ' ' || s.text), []) AS names FROM m)
  SELECT doc_id, needles, misses, drift, CASE WHEN drift THEN [] ELSE names[:20] END AS listed, least(len(names), 200)::INTEGER AS logged FROM z""")
def coverage_report(spark, sf_dir):
    return checks.coverage(rescanned(spark, sf_dir))


HTML_SQL = r"""WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text, url FROM pages) """


def html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", readers.html_text(F.col("html")).alias("text"))


@query("q_html_extract", HTML_SQL + "SELECT page_id, text FROM t")
def html_extract(spark, sf_dir):
    return html(spark, sf_dir).select("page_id", "text")


@query("q_table_covers", HTML_SQL + f", o AS (SELECT page_id, {sql_fold('text')} AS hay, string_split(lead(text, 1, text) OVER (ORDER BY page_id), ' ') AS cells FROM t) SELECT page_id, len(list_filter(cells, lambda c: c <> '' AND NOT contains(hay, {sql_fold('c')}))) = 0 AS covered FROM o")
def table_covers(spark, sf_dir):
    """Whether all words of the next page, as cells of a table, are in a page."""
    rows = html(spark, sf_dir)
    after = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("text").alias("next"))
    rows = rows.join(after, "page_id", "left")
    return rows.select("page_id", checks.table_covers(F.split(F.coalesce("next", "text"), " "), T.fold("text")).alias("covered"))


TOC, HEADS = values("doc, value", (1, 1), (1, 2), (1, 3), (2, 1), (2, 2)), values("doc, value", (1, 1), (1, 2), (2, 1), (2, 2), (2, 4))


@query("q_toc_symmetric_diff", f"SELECT doc, value, 'left' AS side FROM (SELECT * FROM {TOC} EXCEPT SELECT * FROM {HEADS}) UNION ALL SELECT doc, value, 'right' FROM (SELECT * FROM {HEADS} EXCEPT SELECT * FROM {TOC})")
def toc_symmetric_diff(spark, sf_dir):
    return checks.symmetric_difference(literal(spark, TOC), literal(spark, HEADS), ["doc", "value"])


TITLE_PAIRS = values("id, a, b", (1, "연구의 필요성", "연구의 필요성"), (2, "연구의 필요성 및 목적", "연구의 필요성"), (3, "국내외 정책 동향 분석", "국내외 정책 동향 분식"), (4, "서론", "결론"), (5, "가나다라마바사아자차", "타파하거너더러머버서"))


@query("q_title_match")
def title_match(spark, sf_dir):
    return checks.title_similarity(literal(spark, TITLE_PAIRS))


# --- registry -----------------------------------------------------------------------------------------------------

REGISTRY = values(
    "file, pages, report_id, source, cover_title, registered, note",
    ("a.pdf", "", "2020-03", "cover", "탄소중립 이행 전략", "2026-01-01", ""),
    ("b.pdf", "1-100", "2020-01", "cover", "인공지능 활용", "2026-01-01", ""),
    ("b.pdf", "101-200", "2020-01-v2", "cover", "인공지능 활용 부록", "2026-01-01", ""),
    ("c.pdf", "", "", "cover", "표지만 있는 보고서", "2026-01-01", "표지 번호 2020-01 · 권 신호 제2권"),
    ("d.pdf", "", "2020-01-b", "manual", "다른 보고서", "2026-01-01", ""),
    ("e.pdf", "", "custom-id", "manual", "비표준", "2026-01-01", ""),
    ("f.pdf", "", "", "cover", "번호 없음", "2026-01-01", ""),
    ("g.pdf", "5-3", "2021-01", "cover", "잘못된 쪽수", "2026-01-01", ""),
    ("h.pdf", "1-50", "2021-02", "cover", "겹침", "2026-01-01", ""),
    ("h.pdf", "40-90", "2021-02-v2", "cover", "겹침 둘", "2026-01-01", ""),
    ("i.pdf", "", "2022-00", "cover", "전체", "2026-01-01", ""),
    ("i.pdf", "1-9", "2022-01", "cover", "부분", "2026-01-01", ""),
    ("j.pdf", "", "나쁜 번호", "manual", "잘못", "2026-01-01", ""),
)
REG_SQL = f"""WITH reg AS (SELECT *, regexp_extract(report_id, '^([0-9]{{4}}-[0-9]{{2}})(?:-([b-z]))?(?:-v([0-9]{{1,2}}))?$', 1) AS std,
  regexp_extract(report_id, '^([0-9]{{4}}-[0-9]{{2}})(?:-([b-z]))?(?:-v([0-9]{{1,2}}))?$', 2) AS letter, try_cast(regexp_extract(report_id, '^([0-9]{{4}}-[0-9]{{2}})(?:-([b-z]))?(?:-v([0-9]{{1,2}}))?$', 3) AS INTEGER) AS volume,
  regexp_extract(note, '(?:^| · )표지 번호 ([0-9]{{4}}-[0-9]{{2}})', 1) AS cover, try_cast(regexp_extract(pages, '^([0-9]+)-([0-9]+)$', 1) AS INTEGER) AS p1, try_cast(regexp_extract(pages, '^([0-9]+)-([0-9]+)$', 2) AS INTEGER) AS p2 FROM {REGISTRY}),
par AS (SELECT *, CASE WHEN std <> '' THEN std WHEN report_id = '' THEN cover ELSE '' END AS family, CASE WHEN p1 >= 1 AND p2 >= p1 THEN p1 - 1 END AS page_from, CASE WHEN p1 >= 1 AND p2 >= p1 THEN p2 - 1 END AS page_to FROM reg) """


@query("q_registry_parse", REG_SQL + "SELECT file, pages, report_id, family, letter, volume, page_from, page_to FROM par")
def registry_parse(spark, sf_dir):
    return registry.parsed(literal(spark, REGISTRY)).select("file", "pages", "report_id", "family", "letter", "volume", "page_from", "page_to")


@query("q_registry_sort", REG_SQL + """SELECT file, pages, report_id, row_number() OVER (ORDER BY CASE WHEN std <> '' OR (report_id = '' AND cover <> '') THEN 0 WHEN report_id <> '' THEN 1 ELSE 2 END,
  family, CASE WHEN std <> '' THEN 0 ELSE 1 END, CASE WHEN letter <> '' THEN ascii(letter) - 97 ELSE 0 END, coalesce(volume, 0), CASE WHEN std = '' THEN report_id ELSE '' END, file,
  CASE WHEN pages = '' THEN -1 ELSE coalesce(page_from, 1000000000) END)::INTEGER AS place FROM par""")
def registry_sort(spark, sf_dir):
    from pyspark.sql import Window

    p = registry.parsed(literal(spark, REGISTRY))
    return p.select("file", "pages", "report_id", F.row_number().over(Window.orderBy(registry.sort_key(p))).alias("place"))


@query("q_registry_overlap", REG_SQL + """, pr AS (SELECT *, CASE WHEN pages <> '' AND page_from IS NULL THEN 'bad pages' WHEN report_id = '' THEN 'blank id' WHEN NOT regexp_matches(report_id, '^[A-Za-z0-9][A-Za-z0-9-]*$') THEN 'bad id'
  WHEN bool_or(pages = '') OVER (PARTITION BY file) AND bool_or(pages <> '') OVER (PARTITION BY file) THEN 'whole and parts'
  WHEN page_from <= max(page_to) OVER (PARTITION BY file ORDER BY page_from NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'overlap' END AS problem FROM par)
  SELECT file, pages, report_id, problem, bool_or(problem IS NOT NULL) OVER (PARTITION BY file) AS blocked FROM pr""")
def registry_overlap(spark, sf_dir):
    return registry.problems(literal(spark, REGISTRY))


NEW = values("file, report_id, cover_title", ("n1.pdf", "2020-03", "탄소중립 이행전략"), ("n2.pdf", "2020-09", "새 보고서"), ("n3.pdf", "2021-05", "둘째"), ("n4.pdf", "2021-05-v2", "둘째"))


@query("q_collisions", f"""WITH n AS (SELECT *, regexp_extract(report_id, '^([0-9]{{4}}-[0-9]{{2}})', 1) AS f, lower({sql_fold('cover_title')}) AS t FROM {NEW}),
  o AS (SELECT regexp_extract(report_id, '^([0-9]{{4}}-[0-9]{{2}})(?:-[b-z])?(?:-v[0-9]+)?$', 1) AS f, file AS other, lower({sql_fold('cover_title')}) AS t FROM {REGISTRY} UNION ALL SELECT f, file, t FROM n),
  p AS (SELECT n.file, min(o.other) AS counterpart, bool_or(o.t = n.t) AS duplicate FROM n JOIN o ON o.f = n.f AND o.other <> n.file AND n.f <> '' GROUP BY n.file)
  SELECT n.file, CASE WHEN p.file IS NULL THEN n.report_id ELSE '' END AS report_id, p.counterpart, coalesce(p.duplicate, false) AS duplicate FROM n LEFT JOIN p USING (file)""")
def collisions(spark, sf_dir):
    return registry.collisions(literal(spark, REGISTRY), literal(spark, NEW))


@query("q_next_free", REG_SQL + """SELECT family, (SELECT min(chr(c::INTEGER)) FROM range(98, 123) AS r(c) WHERE chr(c::INTEGER) NOT IN (SELECT letter FROM par q WHERE q.family = p.family)) AS letter,
  (SELECT min(v)::INTEGER FROM range(1, 50) AS r(v) WHERE v NOT IN (SELECT volume FROM par q WHERE q.family = p.family AND volume IS NOT NULL)) AS volume FROM (SELECT DISTINCT family FROM par WHERE family <> '') p""")
def next_free(spark, sf_dir):
    return registry.next_free(literal(spark, REGISTRY))


@query("q_registry_summary", REG_SQL + "SELECT count(*) AS n, count(*) FILTER (pages <> '') AS parts, count(*) FILTER (source = 'cover') AS cover, count(*) FILTER (source = 'manual') AS manual, count(*) FILTER (volume IS NOT NULL) AS volumes, count(*) FILTER (letter <> '') AS letters FROM par")
def registry_summary(spark, sf_dir):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    p = registry.parsed(literal(spark, REGISTRY))
    return p.agg(F.count("*").alias("n"), n(F.col("pages") != "").alias("parts"), n(F.col("source") == "cover").alias("cover"), n(F.col("source") == "manual").alias("manual"), n(F.col("volume").isNotNull()).alias("volumes"), n(F.col("letter") != "").alias("letters"))


# --- verification of text -----------------------------------------------------------------------------------------

#: Report lines, in which some places get tables, single table lines, dashes and spaces that should be gone.
BODY_SQL = REPORT_SQL + """, b AS (SELECT doc_id, addr AS line, CASE addr % 11 WHEN 2 THEN '| a | ' || doc_id || ' |' WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN '| b |' ELSE '| b | c |' END WHEN 6 THEN '| only |' WHEN 8 THEN '1‒2 ' || text WHEN 9 THEN text || chr(160) ELSE text END AS text FROM rl) """


@query("q_verify_body", BODY_SQL + r""", t AS (SELECT *, starts_with(text, '|') AS t, length(text) - length(replace(text, '|', '')) AS p FROM b),
  r AS (SELECT *, sum(CASE WHEN t AND NOT coalesce(pt, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY line) AS pt FROM t)),
  g AS (SELECT doc_id, run, count(*) AS n, count(DISTINCT p) AS k FROM r WHERE t GROUP BY doc_id, run)
  SELECT doc_id, line, 'no-break space' AS finding FROM t WHERE contains(text, chr(160)) UNION ALL SELECT doc_id, line, 'figure dash' FROM t WHERE contains(text, '‒')
  UNION ALL SELECT doc_id, line, 'raw bullet' FROM t WHERE regexp_matches(text, '^\s*[□○ㅇ❍◉▸▪‣∙•Ÿ](\s|$)') AND NOT starts_with(text, '<!--')
  UNION ALL SELECT doc_id, line, 'single table line' FROM r JOIN g USING (doc_id, run) WHERE t AND n = 1 UNION ALL SELECT doc_id, line, 'unequal pipes' FROM r JOIN g USING (doc_id, run) WHERE t AND k > 1""".replace("\\\\", "\\"))
def verify_body(spark, sf_dir):
    k, text = F.col("addr") % 11, F.col("text")
    new = (
        F.when(k == 2, F.format_string("| a | %d |", "doc_id"))
        .when(k == 3, F.when(F.col("doc_id") % 3 == 0, "| b |").otherwise("| b | c |"))
        .when(k == 6, "| only |")
        .when(k == 8, F.concat(F.lit("1‒2 "), text))
        .when(k == 9, F.concat(text, F.lit("\u00a0")))
        .otherwise(text)
    )
    return checks.body_findings(report_lines(spark, sf_dir).select("doc_id", F.col("addr").alias("line"), new.alias("text")))


@query("q_verify_ids", PATHS_SQL.replace("SELECT * FROM pth", """, own AS (SELECT doc_id, ordinal, CASE WHEN (doc_id + length(ordinal) * 7 + len(path)) % 5 = 0 THEN doc_id || ' c1' WHEN (doc_id + length(ordinal)) % 4 = 0 THEN doc_id || '_c1' ELSE doc_id || '_' || ordinal END AS hid FROM pth),
  cnt AS (SELECT *, count(*) OVER (PARTITION BY doc_id, hid) AS n FROM own)
  SELECT DISTINCT doc_id, hid, 'form' AS finding FROM cnt WHERE NOT regexp_matches(hid, '^[A-Za-z0-9-]+_c[0-9]+(s[0-9]+)*$') UNION ALL SELECT DISTINCT doc_id, hid, 'repeated' FROM cnt WHERE n > 1 UNION ALL SELECT DISTINCT doc_id, hid, 'path' FROM cnt WHERE hid <> doc_id || '_' || ordinal"""))
def verify_ids(spark, sf_dir):
    """Ids made of the headings' places; some are malformed, some stand for another heading."""
    doc, size = F.col("doc_id"), F.length("ordinal")
    rid = doc.cast("string")
    rows = S.paths(S.headings(S.markdown_lines(markdown(spark, sf_dir))))
    hid = F.when((doc + size * 7 + F.size("path")) % 5 == 0, F.concat(rid, F.lit(" c1"))).when((doc + size) % 4 == 0, F.concat(rid, F.lit("_c1"))).otherwise(F.concat(rid, F.lit("_"), F.col("ordinal")))
    return checks.id_findings(rows.select("doc_id", "ordinal", hid.alias("hid")), rid)


# --- judgement ----------------------------------------------------------------------------------------------------

#: Every turn of the conversations as a verdict: by its length PASS, WARN or (mostly) FAIL, of a summary that changes.
VERDICTS = """(SELECT 'c' || conv_id % 7 AS stem, 'h' || conv_id AS hid, turn::BIGINT AS seq, CASE length(text) % 7 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS verdict, 's' || length(text) % 3 AS summary_sha
  FROM (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn))"""


def verdicts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(T.text("text")).alias("text"))
    n = F.length("text")
    verdict = F.when(n % 7 == 0, "PASS").when(n % 7 == 1, "WARN").otherwise("FAIL")
    return turns.select(F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")).alias("stem"), F.concat(F.lit("h"), F.col("conv_id").cast("string")).alias("hid"), F.col("turn").cast("long").alias("seq"), verdict.alias("verdict"), F.concat(F.lit("s"), (n % 3).cast("string")).alias("summary_sha"))


STREAK_SQL = f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY stem, hid ORDER BY seq) AS k FROM {VERDICTS}),
  r AS (SELECT stem, hid, seq, k, CASE WHEN verdict = 'FAIL' THEN 1 ELSE 0 END AS streak, CASE WHEN verdict = 'FAIL' THEN summary_sha ELSE '' END AS sha FROM v WHERE k = 1
    UNION ALL SELECT v.stem, v.hid, v.seq, v.k, CASE WHEN v.verdict <> 'FAIL' THEN 0 WHEN v.summary_sha <> r.sha THEN r.streak + 1 ELSE r.streak END, CASE WHEN v.verdict = 'FAIL' THEN v.summary_sha ELSE '' END
    FROM r JOIN v ON v.stem = r.stem AND v.hid = r.hid AND v.k = r.k + 1) """


@query("q_fail_streak", STREAK_SQL + "SELECT stem, hid, seq, streak FROM r")
def fail_streak(spark, sf_dir):
    return judge.streaks(verdicts(spark, sf_dir))


@query("q_escalation", STREAK_SQL + """, l AS (SELECT stem, hid, arg_max(streak, k) AS streak FROM r GROUP BY stem, hid) SELECT stem, hid, streak, CASE WHEN streak < 3 THEN 'none' WHEN stem = 'c2' THEN 'manual' ELSE 'arbiter' END AS step FROM l""")
def escalation(spark, sf_dir):
    """The step after each summary's last verdict; those of one stem were regenerated before."""
    last = judge.streaks(verdicts(spark, sf_dir)).groupBy("stem", "hid").agg(F.max_by("streak", "seq").alias("streak"))
    return last.select("stem", "hid", "streak", judge.escalation(F.col("streak"), F.when(F.col("stem") == "c2", "summary").otherwise("")).alias("step"))


@query("q_fail_history", f"""SELECT stem, hid, list(seq ORDER BY seq)[-3:] AS last FROM {VERDICTS} WHERE verdict = 'FAIL' GROUP BY stem, hid""")
def fail_history(spark, sf_dir):
    return judge.history(verdicts(spark, sf_dir))


JUDGED_SQL = """WITH t AS (SELECT source AS stem, 'h' || doc_id AS hid, 'judge: ' || text AS prompt, string_split(text, chr(10))[-1] AS summary, doc_id FROM documents),
  c AS (SELECT t.stem, t.hid, CASE WHEN t.doc_id % 2 = 0 THEN sha256(prompt) ELSE 'old' END AS key, CASE WHEN t.doc_id % 3 = 0 THEN sha256(summary) ELSE 'old' END AS summary_sha, CASE WHEN l.quality = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM t JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
  h AS (SELECT t.stem, t.hid, coalesce(c.key = sha256(t.prompt), false) AS hit, coalesce(c.verdict = 'FAIL' AND c.summary_sha = sha256(t.summary), false) AS failing FROM t LEFT JOIN c USING (stem, hid)) """


def judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    targets = docs.select(F.col("source").alias("stem"), F.format_string("h%d", "doc_id").alias("hid"), F.concat(F.lit("judge: "), "text").alias("prompt"), F.element_at(F.split("text", "\n"), -1).alias("summary"), "doc_id")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    cache = targets.join(labels, "doc_id").select("stem", "hid", F.when(even, F.sha2("prompt", 256)).otherwise("old").alias("key"), F.when(third, F.sha2("summary", 256)).otherwise("old").alias("summary_sha"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"))
    return targets, judge.hits(targets, cache)


@query("q_judge_hits", JUDGED_SQL + "SELECT * FROM h")
def judge_hits(spark, sf_dir):
    return judged(spark, sf_dir)[1]


@query("q_judge_plan", JUDGED_SQL + """, u AS (SELECT stem, hid, hit OR hid LIKE '%5' AS has_summary, failing, hid LIKE '%9' AS manual, stem < 'src2' AS report_done FROM h),
  p AS (SELECT stem, count(*) AS units, count(*) FILTER (NOT has_summary OR (failing AND NOT manual)) AS todo, count(*) FILTER (failing AND NOT manual) AS failing, bool_and(report_done) AS done FROM u GROUP BY stem),
  q AS (SELECT stem, units, todo, failing, todo + (todo > 0 OR NOT done)::INTEGER AS calls FROM p)
  SELECT stem, sum(units)::BIGINT AS units, sum(todo)::BIGINT AS todo, sum(failing)::BIGINT AS failing, sum(calls)::BIGINT AS calls FROM q GROUP BY ROLLUP (stem)""")
def judge_plan(spark, sf_dir):
    h = judged(spark, sf_dir)[1]
    return judge.plan(h.select("stem", "hid", (F.col("hit") | F.col("hid").endswith("5")).alias("has_summary"), "failing", F.col("hid").endswith("9").alias("manual"), (F.col("stem") < "src2").alias("report_done")))


@query("q_verdict_counts", JUDGED_SQL + "SELECT stem, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'FAIL') AS fail FROM c GROUP BY stem")
def verdict_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("source").alias("stem"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"))
    wide = rows.groupBy("stem").pivot("verdict", ["PASS", "FAIL"]).count()
    return wide.select("stem", F.coalesce("PASS", F.lit(0)).alias("pass"), F.coalesce("FAIL", F.lit(0)).alias("fail"))


JSON = values("id, raw", (1, 'x {"verdict": "PASS", "issues": []} y'), (2, '{"verdict": "MAYBE"}'), (3, "none"), (4, '{"verdict": "FAIL", "issues": [1]}'))


@query("q_verdict_json", f"SELECT id, CASE WHEN v IN ('PASS', 'WARN', 'FAIL') THEN v END AS verdict FROM (SELECT id, regexp_extract(raw, '\"verdict\": \"([A-Z]+)\"', 1) AS v FROM {JSON})")
def verdict_json(spark, sf_dir):
    v = F.get_json_object(F.regexp_extract("raw", r"(?s)\{.*\}", 0), "$.verdict")
    return literal(spark, JSON).select("id", F.when(v.isin("PASS", "WARN", "FAIL"), v).alias("verdict"))


# --- status -------------------------------------------------------------------------------------------------------

STATUS_SQL = STAMPED + """, st AS (SELECT doc_id, CASE WHEN verified_extract = '' THEN 'unverified' WHEN verified_annotate = '' THEN 'extract' ELSE 'complete' END AS verify,
  CASE WHEN verified_annotate = '' THEN 'absent' WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'synced' END AS db, source FROM s) """


def status(spark, sf_dir):
    return stamped(spark, sf_dir).select("doc_id", "source", F.when(F.col("verified_extract") == "", "unverified").when(F.col("verified_annotate") == "", "extract").otherwise("complete").alias("verify"), F.when(F.col("verified_annotate") == "", "absent").when(F.col("doc_id") % 4 == 0, "stale").otherwise("synced").alias("db"))


@query("q_plan_sets", STATUS_SQL + """, v1 AS (SELECT doc_id FROM st WHERE verify = 'unverified'), an AS (SELECT doc_id FROM v1 UNION SELECT doc_id FROM st WHERE verify = 'extract'), v2 AS (SELECT doc_id FROM an UNION SELECT doc_id FROM st WHERE db = 'stale')
  SELECT 'verify' AS stage, count(*) AS n FROM v1 UNION ALL SELECT 'annotate', count(*) FROM an UNION ALL SELECT 'verify2', count(*) FROM v2""")
def plan_sets(spark, sf_dir):
    """Targets grow from stage to stage: each stage takes its predecessor's and its own."""
    s = status(spark, sf_dir)
    since = F.when(F.col("verify") == "unverified", 0).when(F.col("verify") == "extract", 1).when(F.col("db") == "stale", 2)
    stages = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("stage")) for k, n in enumerate(("verify", "annotate", "verify2"))))
    rows = s.select(F.explode(stages).alias("s"), since.alias("since"))
    return rows.groupBy("s.stage").agg(F.sum(F.when(F.col("since") <= F.col("s.k"), 1).otherwise(0)).cast("long").alias("n"))


# --- structure detection ------------------------------------------------------------------------------------------

#: Lines of all documents, every third a chapter in the grammar of its document; numbers are skipped now and then, so
#: that only those in turn count. Documents of one kind have none.
WALK_SQL = r"""WITH RECURSIVE raw AS (SELECT doc_id, (u.i - 1)::INTEGER AS addr, u.x FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM documents)),
num AS (SELECT *, addr // 3 + 1 + CASE WHEN addr % 15 = 12 THEN 1 ELSE 0 END AS v, doc_id % 7 AS kind FROM raw),
ln AS (SELECT doc_id, addr, CASE WHEN addr % 3 > 0 THEN 'x ' || x WHEN kind = 0 THEN '제' || v || '장 ' || 'T' WHEN kind = 1 THEN v || '. T' WHEN kind = 2 AND v <= 12 THEN substr('ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ', v, 1) || '. T'
  WHEN kind = 3 AND v <= 12 THEN ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'][v] || '. T' WHEN kind = 4 AND v <= 12 THEN CASE WHEN v % 2 = 0 THEN substr('ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ', v, 1) ELSE ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'][v] END || '. T'
  WHEN kind = 5 THEN '제 ' || v || ' 장' ELSE 'x ' || x END AS text FROM num),
pr(k, profile, pat) AS (VALUES (0, 'jang_split', '^제\s*([0-9]{1,2})\s*장$'), (1, 'jang', '^제\s*([0-9]{1,2})\s*장[.\s]+\S'), (2, 'roman_unicode', '^([Ⅰ-Ⅻ])\.\s*\S'), (3, 'roman_ascii', '^([IVX]{1,4})\.?\s+\S'), (4, 'roman_mixed', '^([IVXⅠ-Ⅻ]{1,4})\.?\s+\S'), (5, 'arabic', '^([0-9]{1,2})\.\s+\S')),
hit AS (SELECT doc_id, k, profile, addr, regexp_extract(text, pat, 1) AS t FROM ln JOIN pr ON regexp_matches(text, pat)),
val AS (SELECT *, CASE WHEN regexp_matches(t, '^[Ⅰ-Ⅻ]$') THEN instr('ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ', t) WHEN regexp_matches(t, '^[IVX]+$') THEN list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'], t) ELSE try_cast(t AS INTEGER) END AS value FROM hit),
walk AS (SELECT doc_id, k, profile, min(addr) AS addr, 1 AS value FROM val WHERE value = 1 GROUP BY doc_id, k, profile
  UNION ALL SELECT v.doc_id, v.k, v.profile, min(v.addr), v.value FROM walk w JOIN val v ON v.doc_id = w.doc_id AND v.k = w.k AND v.value = w.value + 1 AND v.addr > w.addr GROUP BY v.doc_id, v.k, v.profile, v.value),
cnt AS (SELECT doc_id, k, profile, count(*) AS n FROM walk GROUP BY doc_id, k, profile HAVING count(*) >= 2),
win AS (SELECT doc_id, arg_min(profile, k) AS best, arg_min(n, k) AS n, max(n) FILTER (profile = 'roman_mixed') AS mixed FROM cnt GROUP BY doc_id),
cho AS (SELECT doc_id, CASE WHEN best IN ('roman_unicode', 'roman_ascii') AND mixed > n THEN 'roman_mixed' ELSE best END AS profile FROM win) """


@query("q_structure_walk", WALK_SQL + "SELECT doc_id, profile, addr, value::INTEGER AS value FROM walk JOIN cho USING (doc_id, profile)")
def structure_walk(spark, sf_dir):
    rows = readers.page_lines(table(spark, sf_dir, "documents"))
    a, kind, x = F.col("addr"), F.col("doc_id") % 7, F.concat(F.lit("x "), F.col("text"))
    v = (F.floor(a / 3) + 1 + F.when(a % 15 == 12, 1).otherwise(0)).cast("int")
    unicode, ascii_ = F.substring(F.lit("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"), v, F.lit(1)), F.get(F.array(*map(F.lit, "I II III IV V VI VII VIII IX X XI XII".split())), v - 1)
    few, tail = v <= 12, F.lit(". T")
    text = (
        F.when(a % 3 > 0, x)
        .when(kind == 0, F.concat(F.lit("제"), v.cast("string"), F.lit("장 T")))
        .when(kind == 1, F.concat(v.cast("string"), tail))
        .when((kind == 2) & few, F.concat(unicode, tail))
        .when((kind == 3) & few, F.concat(ascii_, tail))
        .when((kind == 4) & few, F.concat(F.when(v % 2 == 0, unicode).otherwise(ascii_), tail))
        .when(kind == 5, F.concat(F.lit("제 "), v.cast("string"), F.lit(" 장")))
        .otherwise(x)
    )
    return structure.chapters(rows.select("doc_id", "addr", text.alias("text")))


#: Lines of all documents in chapters of 24 lines, with sub-headings of several grammars, not all of them in turn.
FAMILY_SQL = r"""WITH RECURSIVE raw AS (SELECT doc_id, (u.i - 1)::INTEGER AS addr, u.x FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM documents)),
ln AS (SELECT doc_id, addr // 24 + 1 AS chapter, addr, CASE addr % 6 WHEN 0 THEN '제' || (addr % 24 // 6 + 1) || '절 T' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN (addr % 24 // 6 + 1) || '. T' ELSE '(' || (addr % 24 // 6 + 1) || ') T' END
  WHEN 2 THEN substr('가나라다', addr % 24 // 6 + 1, 1) || '. T' WHEN 3 THEN '(' || (addr % 24 // 6 * 2 + 1) || ') T' ELSE '= ' || x END AS text FROM raw),
fam(k, family, pat) AS (VALUES (0, 'jeol', '^제\s*([0-9]{1,2})\s*절[.\s]*\S'), (1, 'num_dot', '^([0-9]{1,2})\.\s*[^0-9\s]'), (2, 'paren_num', '^\(([0-9]{1,2})\)\s*\S'), (3, 'ga_dot', '^([가-힣])\.\s*\S')),
val AS (SELECT doc_id, chapter, family, addr, CASE WHEN family = 'ga_dot' THEN instr('가나다라마바사아자차카타파하', regexp_extract(text, pat, 1)) ELSE try_cast(regexp_extract(text, pat, 1) AS INTEGER) END AS value FROM ln JOIN fam ON regexp_matches(text, pat)),
dep AS (SELECT doc_id, family, row_number() OVER (PARTITION BY doc_id ORDER BY min(addr)) + 1 AS depth FROM val WHERE value = 1 GROUP BY doc_id, family),
walk AS (SELECT doc_id, chapter, family, min(addr) AS addr, 1 AS value FROM val WHERE value = 1 GROUP BY doc_id, chapter, family
  UNION ALL SELECT v.doc_id, v.chapter, v.family, min(v.addr), v.value FROM walk w JOIN val v ON v.doc_id = w.doc_id AND v.chapter = w.chapter AND v.family = w.family AND v.value = w.value + 1 AND v.addr > w.addr GROUP BY v.doc_id, v.chapter, v.family, v.value)
SELECT doc_id, chapter, family, depth::INTEGER AS depth, count(*)::INTEGER AS n FROM walk JOIN dep USING (doc_id, family) WHERE depth <= 4 GROUP BY ALL"""


@query("q_sub_families", FAMILY_SQL)
def sub_families(spark, sf_dir):
    rows = readers.page_lines(table(spark, sf_dir, "documents"))
    a = F.col("addr")
    k = (F.floor(a % 24 / 6) + 1).cast("int")
    n = k.cast("string")
    bracket = lambda c: F.concat(F.lit("("), c, F.lit(") T"))
    text = (
        F.when(a % 6 == 0, F.concat(F.lit("제"), n, F.lit("절 T")))
        .when(a % 6 == 1, F.when(F.col("doc_id") % 2 == 0, F.concat(n, F.lit(". T"))).otherwise(bracket(n)))
        .when(a % 6 == 2, F.concat(F.substring(F.lit("가나라다"), k, F.lit(1)), F.lit(". T")))
        .when(a % 6 == 3, bracket((k * 2 - 1).cast("string")))
        .otherwise(F.concat(F.lit("= "), F.col("text")))
    )
    return structure.families(rows.select("doc_id", (F.floor(a / 24) + 1).cast("int").alias("chapter"), "addr", text.alias("text")))


FOOTERS = values("doc_id, page, footer, candidate, front", (1, 0, None, False, True), (1, 1, 1, True, False), (1, 2, 2, False, False), (1, 3, 3, False, False), (1, 4, 1, True, False), (1, 5, 2, False, False), (2, 0, 1, True, True), (2, 1, 2, True, False))


@query("q_part_split", f"SELECT doc_id, page FROM (SELECT *, max(footer) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {FOOTERS} WHERE footer IS NOT NULL) WHERE footer = 1 AND m > 1")
def part_split(spark, sf_dir):
    return structure.part_starts(literal(spark, FOOTERS))


@query("q_body_start", f"""SELECT doc_id, min(page) AS page FROM (SELECT *, max(CASE WHEN footer = 1 THEN page END) OVER (PARTITION BY doc_id) AS a, bool_or(front) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING) AS f FROM {FOOTERS})
  WHERE page >= a AND candidate AND NOT front AND NOT coalesce(f, false) GROUP BY doc_id""")
def body_start(spark, sf_dir):
    return structure.body_start(literal(spark, FOOTERS))


CLEAN_SQL = f"""WITH r AS (SELECT doc_id, u.i AS i, string_split(u.x, ' ') AS r FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'i': i, 'x': x}})) AS u FROM documents)),
c AS (SELECT doc_id, i, unnest(range(1, len(r) + 1)) AS j, unnest(r) AS x FROM r),
e AS (SELECT doc_id, i, j, replace({sql_strip('x')}, '|', chr(92) || '|') AS x FROM c),
b AS (SELECT doc_id, i, j, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id, i ORDER BY j) THEN '' ELSE x END AS x FROM e),
kc AS (SELECT DISTINCT doc_id, j FROM b WHERE x <> ''), kr AS (SELECT DISTINCT doc_id, i FROM b WHERE x <> ''),
l AS (SELECT kr.doc_id, kr.i, string_agg(coalesce(b.x, ''), ' | ' ORDER BY kc.j) AS line FROM kr JOIN kc USING (doc_id) LEFT JOIN b ON b.doc_id = kr.doc_id AND b.i = kr.i AND b.j = kc.j GROUP BY kr.doc_id, kr.i),
n AS (SELECT doc_id, count(*) AS width FROM kc GROUP BY doc_id),
t AS (SELECT doc_id, list('| ' || line || ' |' ORDER BY i) AS ls FROM l GROUP BY doc_id)
SELECT d.doc_id, sha256(CASE WHEN len(ls) >= 2 AND width >= 2 THEN ls[1] || chr(10) || '|' || repeat(' --- |', width::INTEGER) || chr(10) || array_to_string(ls[2:], chr(10)) END) AS sha256 FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query("q_clean_table", CLEAN_SQL)
def clean_table(spark, sf_dir):
    """Every document as a table: its lines are rows, their words cells."""
    rows = F.transform(F.split("text", "\n"), lambda r: F.split(r, " "))
    tables = structure.clean_tables(table(spark, sf_dir, "documents").select("doc_id", rows.alias("rows")))
    return tables.select("doc_id", F.sha2("md", 256).alias("sha256"))


@query("q_stream_streak", STREAK_SQL + "SELECT stem, hid, seq, streak FROM r")
def stream_streak(spark, sf_dir):
    """Streaks from a stream of the verdicts, by keyed state."""
    import os

    from corvid.plans.streams import run_to_table
    from corvid.streaming import stream

    return run_to_table(spark, verdicts(spark, sf_dir), stream.streaks, os.path.basename(sf_dir))


@query("q_stream_sync", "WITH lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) SELECT 'reports/' || d.doc_id || '.md' AS filepath, sha256(CASE WHEN d.n_chars % 4 = 1 THEN text || '2' ELSE text END) AS content_hash FROM documents d JOIN lab USING (doc_id) WHERE quality = 1 AND d.n_chars % 4 <> 2")
def stream_sync(spark, sf_dir):
    """The ledger after a stream of all documents in three rounds: all of them, changes of some, the removal of some."""
    from corvid.plans.streams import ledger_of_rounds

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = F.col("n_chars") % 4
    rows = docs.join(labels, "doc_id", "left").select(F.format_string("reports/%d.md", "doc_id").alias("filepath"), "text", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("complete"), n.alias("n"))
    rounds = [
        rows.select("filepath", F.lit(1).cast("long").alias("version"), F.col("text").alias("content"), "complete"),
        rows.filter("n = 1").select("filepath", F.lit(2).cast("long").alias("version"), F.concat("text", F.lit("2")).alias("content"), "complete"),
        rows.filter("n = 2").select("filepath", F.lit(3).cast("long").alias("version"), F.lit(None).cast("string").alias("content"), "complete"),
    ]
    return ledger_of_rounds(spark, rounds)


@query("q_events_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark, sf_dir):
    """The streaming aggregation's plan on a batch (a smoke check beyond the surveyed engine)."""
    from corvid.streaming import stream

    counts = stream.event_counts(table(spark, sf_dir, "events"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
