"""Queries of registration, over a registry and covers made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid import config
from corvid.operators import register as G
from corvid.operators import registry
from corvid.plans.queries import query
from corvid.plans.tables import table

#: Covers of the documents: numbers on page one, on an inner and on the last page, as far as ids and sizes say so.
COVERS_SQL = r"""WITH cv AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '정책연구-' || printf('%04d-%02d', 2000 + doc_id % 25, n_chars % 60) || '.pdf' WHEN 1 THEN '(' || (2000 + doc_id % 25) || '-' || (n_chars % 60) || ') doc' || doc_id || '.pdf' ELSE 'f' || doc_id || '.pdf' END AS file,
  5 + doc_id % 30 AS n_pages, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE length(text) END AS text_chars,
  printf('%04d-%02d', 2000 + doc_id % 25, n_chars % 60) AS a, printf('%04d-%02d', 2000 + doc_id % 25, (n_chars + doc_id % 2) % 60) AS b,
  CASE doc_id % 6 WHEN 0 THEN [2] WHEN 1 THEN [1, 2] ELSE [] END AS vols, doc_id % 5 < 2 AS p1, doc_id % 5 IN (0, 2) AS p1b, doc_id % 4 = 0 AS p3, doc_id % 3 = 0 AS pl FROM documents),
found AS (SELECT doc_id, 1 AS page, a AS number FROM cv WHERE p1 UNION ALL SELECT doc_id, 1, b FROM cv WHERE p1b UNION ALL SELECT doc_id, 3, b FROM cv WHERE p3 UNION ALL SELECT doc_id, n_pages, a FROM cv WHERE pl) """


def covers(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    number = lambda plus: F.format_string("%04d-%02d", 2000 + i % 25, (n + plus) % 60)
    a, b = number(F.lit(0)), number(i % 2)
    name = F.when(i % 4 == 0, F.concat(F.lit("정책연구-"), a, F.lit(".pdf"))).when(i % 4 == 1, F.format_string("(%d-%d) doc%d.pdf", 2000 + i % 25, n % 60, i)).otherwise(F.format_string("f%d.pdf", i))
    pages = (5 + i % 30).cast("int")
    on = lambda test, page, number: F.when(test, F.struct(page.alias("page"), number.alias("number")))
    found = F.array(on(i % 5 < 2, F.lit(1), a), on((i % 5).isin(0, 2), F.lit(1), b), on(i % 4 == 0, F.lit(3), b), on(i % 3 == 0, pages, a))
    vols = F.when(i % 6 == 0, F.array(F.lit(2))).when(i % 6 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("file"), pages.alias("n_pages"), F.when(i % 17 == 0, 0).otherwise(F.length("text")).alias("text_chars"), F.filter(found, lambda x: x.isNotNull()).alias("found"), vols.alias("vols"))


@query("q_decide", COVERS_SQL + r""", t AS (SELECT cv.*, list_sort(list(DISTINCT number) FILTER (page = 1)) AS c1, list_sort(list(DISTINCT number) FILTER (page <= least(n_pages, 6))) AS c2,
    list_sort(list(DISTINCT number) FILTER (page <= least(n_pages, 6) OR page > n_pages - 2)) AS c3, list(DISTINCT number || '(p' || page || ')') AS every
    FROM cv LEFT JOIN found USING (doc_id) GROUP BY ALL),
  s AS (SELECT *, CASE WHEN len(c1) > 0 AND c1[1] IS NOT NULL THEN c1 WHEN len(c2) > 0 AND c2[1] IS NOT NULL THEN c2 WHEN c3[1] IS NOT NULL THEN c3 ELSE [] END AS c, CASE WHEN len(c1) > 0 THEN '1쪽' WHEN len(c2) > 0 THEN '1~' || least(n_pages, 6) || '쪽' ELSE '뒷표지 포함' END AS label,
    CASE doc_id % 4 WHEN 0 THEN a WHEN 1 THEN a END AS fn FROM t),
  d AS (SELECT *, CASE WHEN len(c) = 1 THEN c[1] END AS base FROM s),
  o AS (SELECT *, list_sort(list_filter(every, lambda x: x IS NOT NULL AND NOT starts_with(x, base))) AS others FROM d)
  SELECT file, CASE WHEN base IS NULL THEN '' WHEN len(vols) = 1 THEN base || '-v2' ELSE base END AS report_id, CASE WHEN base IS NULL THEN '' ELSE 'cover' END AS source,
    concat_ws(' · ', CASE WHEN base IS NOT NULL THEN '표지 번호 ' || base WHEN len(c) > 1 THEN '후보 여러 개(' || label || ': ' || array_to_string(c, ', ') || ')' WHEN text_chars = 0 THEN '표지 이미지(텍스트 없음)' ELSE '표지 번호 없음' END,
      CASE len(vols) WHEN 1 THEN '권 신호 제2권' WHEN 2 THEN '권 신호 여러 개(제1권, 제2권) — 접미 미부여, 확인 필요' END,
      CASE WHEN base IS NULL THEN '힌트: 파일명 번호 ' || fn WHEN fn <> base THEN '파일명 번호 ' || fn || '와 다름(표지 채택)' END,
      CASE WHEN base IS NOT NULL AND len(others) > 0 THEN '다른 후보: ' || array_to_string(others, ', ') END) AS note FROM o""")
def decide(spark, sf_dir):
    return G.decide(covers(spark, sf_dir))


#: A registry of the documents: two rows for each file with parts, ids of every kind, repeated ones among them.
TABLE_SQL = r"""WITH base AS (SELECT doc_id, printf('%04d-%02d', 2000 + doc_id % 25, n_chars % 60) AS no, n_chars FROM documents),
reg AS (SELECT 'f' || CASE WHEN doc_id % 6 < 2 THEN doc_id // 6 * 6 ELSE doc_id END || '.pdf' AS file, CASE doc_id % 6 WHEN 0 THEN '1-20' WHEN 1 THEN CASE WHEN doc_id % 5 = 0 THEN '15-40' ELSE '21-40' END WHEN 2 THEN CASE WHEN doc_id % 4 = 0 THEN '9-3' ELSE '' END ELSE '' END AS pages,
  CASE WHEN doc_id % 7 IN (0, 5) THEN '' WHEN doc_id % 7 = 1 THEN no WHEN doc_id % 7 = 2 THEN no || '-b' WHEN doc_id % 7 = 3 THEN no || '-v' || (1 + doc_id % 3) WHEN doc_id % 7 = 4 THEN 'own-' || doc_id // 2 ELSE '나쁜 번호' END AS report_id,
  CASE doc_id % 11 WHEN 0 THEN 'manual' WHEN 1 THEN '2026-01-01' ELSE 'cover' END AS source, 'Report ' || doc_id AS cover_title, CASE doc_id % 13 WHEN 0 THEN 'x' ELSE '2026-01-01' END AS registered,
  CASE doc_id % 7 WHEN 0 THEN '표지 번호 ' || no || ' · 권 신호 제2권' WHEN 5 THEN '표지 번호 없음' ELSE CASE WHEN n_chars % 5 = 0 THEN '다른 후보: x' ELSE '' END END AS note FROM base),
std AS (SELECT *, regexp_extract(report_id, '^([0-9]{4}-[0-9]{2})(?:-([b-z]))?(?:-v([0-9]{1,2}))?$', 1) AS sid, regexp_extract(note, '^표지 번호 ([0-9]{4}-[0-9]{2})', 1) AS cover FROM reg),
par AS (SELECT *, CASE WHEN sid <> '' THEN sid WHEN report_id = '' THEN cover ELSE '' END AS family FROM std) """


def registry_table(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    no = F.format_string("%04d-%02d", 2000 + i % 25, n % 60)
    k, part = i % 7, i % 6
    rid = F.when(k.isin(0, 5), "").when(k == 1, no).when(k == 2, F.concat(no, F.lit("-b"))).when(k == 3, F.concat(no, F.lit("-v"), (1 + i % 3).cast("string"))).when(k == 4, F.concat(F.lit("own-"), F.floor(i / 2).cast("string"))).otherwise("나쁜 번호")
    pages = F.when(part == 0, "1-20").when(part == 1, F.when(i % 5 == 0, "15-40").otherwise("21-40")).when((part == 2) & (i % 4 == 0), "9-3").otherwise("")
    note = F.when(k == 0, F.concat(F.lit("표지 번호 "), no, F.lit(" · 권 신호 제2권"))).when(k == 5, "표지 번호 없음").when(n % 5 == 0, "다른 후보: x").otherwise("")
    file = F.format_string("f%d.pdf", F.when(part < 2, F.floor(i / 6) * 6).otherwise(i))
    return table(spark, sf_dir, "documents").select(
        file.alias("file"), pages.alias("pages"), rid.alias("report_id"), F.when(i % 11 == 0, "manual").when(i % 11 == 1, "2026-01-01").otherwise("cover").alias("source"),
        F.format_string("Report %d", i).alias("cover_title"), F.when(i % 13 == 0, "x").otherwise("2026-01-01").alias("registered"), note.alias("note"),
    )


@query("q_suggest_ids", TABLE_SQL + r""", mem AS (SELECT DISTINCT family, report_id FROM par WHERE family <> '' AND report_id <> ''),
  docs AS (SELECT family, report_id AS d, row_number() OVER (PARTITION BY family ORDER BY report_id) AS r FROM mem WHERE regexp_matches(report_id, '^[0-9]{4}-[0-9]{2}(-[b-z])?$')),
  letters AS (SELECT family, list_filter(list_transform(range(98, 123), lambda c: chr(c::INTEGER)), lambda l: NOT list_contains(list(regexp_extract(report_id, '^[0-9]{4}-[0-9]{2}-([b-z])', 1)), l))[1] AS letter FROM mem GROUP BY family),
  nextv AS (SELECT d.family, d.d, d.r, (SELECT min(v) FROM range(1, 60) AS q(v) WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.family = d.family AND m.report_id = d.d || '-v' || v)) AS v FROM docs d),
  bl AS (SELECT *, contains(note, '권 신호') AS one FROM par WHERE report_id = ''),
  parts AS (SELECT DISTINCT file, report_id AS d FROM par WHERE report_id <> '' AND pages <> ''),
  offers AS (SELECT file, pages, 0 AS k, 0 AS r, family AS rid, 'own' AS label FROM bl WHERE family <> ''
    UNION ALL SELECT file, pages, 1, 0, family || '-v2', 'cover volume' FROM bl WHERE family <> '' AND one
    UNION ALL SELECT file, pages, 2, docs.r, d || '-v2', 'cover volume' FROM bl JOIN docs USING (family) WHERE one AND d <> family
    UNION ALL SELECT file, pages, 3, 0, family || '-' || coalesce(letter, 'b'), 'another report' FROM bl LEFT JOIN letters USING (family) WHERE family <> ''
    UNION ALL SELECT file, pages, 4, nextv.r, d || '-v' || v, 'volume of' FROM bl JOIN nextv USING (family)
    UNION ALL SELECT bl.file, pages, 5, row_number() OVER (PARTITION BY bl.file, bl.pages, bl.note ORDER BY parts.d), parts.d || '-v1', 'volume of part' FROM bl JOIN parts ON parts.file = bl.file WHERE pages <> ''),
  fresh AS (SELECT * FROM offers WHERE rid NOT IN (SELECT report_id FROM reg)),
  first AS (SELECT file, pages, rid, min({'k': k, 'r': r, 'label': label}) AS f FROM fresh GROUP BY file, pages, rid)
  SELECT file, pages, row_number() OVER (PARTITION BY file, pages ORDER BY f)::INTEGER AS rank, rid, f.label AS label FROM first""")
def suggest_ids(spark, sf_dir):
    return G.suggestions(registry_table(spark, sf_dir))


def pdf_files(spark, sf_dir):
    """The files that are there: every document has one but for those of one language; some are held."""
    i = F.col("doc_id")
    file = F.when(F.col("lang") == "de", F.format_string("g%d.pdf", i)).otherwise(F.format_string("f%d.pdf", i))
    return table(spark, sf_dir, "documents").select(file.alias("file"), (F.col("n_chars") % 9 == 0).alias("held"))


@query("q_check_table", TABLE_SQL + r""", pdf AS (SELECT CASE WHEN lang = 'de' THEN 'g' ELSE 'f' END || doc_id || '.pdf' AS file, n_chars % 9 = 0 AS held FROM documents), there AS (SELECT file FROM pdf WHERE NOT held),
  pg AS (SELECT *, try_cast(regexp_extract(pages, '^([0-9]+)-([0-9]+)$', 1) AS INTEGER) - 1 AS lo, try_cast(regexp_extract(pages, '^([0-9]+)-([0-9]+)$', 2) AS INTEGER) - 1 AS hi FROM par),
  pr AS (SELECT file, CASE WHEN pages <> '' AND NOT coalesce(hi >= lo, false) THEN true WHEN report_id = '' OR NOT regexp_matches(report_id, '^[A-Za-z0-9][A-Za-z0-9-]*$') THEN false
    ELSE (bool_or(pages = '') OVER w AND bool_or(pages <> '') OVER w) OR coalesce(CASE WHEN hi >= lo THEN lo END <= max(CASE WHEN hi >= lo THEN hi END) OVER (PARTITION BY file ORDER BY CASE WHEN hi >= lo THEN lo END NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) END AS bad FROM pg WINDOW w AS (PARTITION BY file)),
  here AS (SELECT p.* FROM par p SEMI JOIN there USING (file)),
  ok AS (SELECT *, regexp_matches(report_id, '^[A-Za-z0-9][A-Za-z0-9-]*$') AS good, count(*) OVER (PARTITION BY report_id) AS same FROM here)
  SELECT 'shifted' AS kind, file, pages FROM ok WHERE source NOT IN ('cover', 'manual', '') OR NOT regexp_matches(registered, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
  UNION ALL SELECT CASE WHEN report_id = '' THEN 'fill in' WHEN NOT good THEN 'form' ELSE 'review' END, file, pages FROM ok WHERE report_id = '' OR NOT good OR sid = '' OR contains(note, '다른 후보') OR contains(note, '와 다름(표지 채택)')
  UNION ALL SELECT 'repeated', file, pages FROM ok WHERE good AND report_id <> '' AND same > 1
  UNION ALL SELECT DISTINCT 'pages', file, '' FROM here SEMI JOIN (SELECT file FROM pr WHERE bad) USING (file)
  UNION ALL SELECT DISTINCT 'delete', file, '' FROM par WHERE file NOT IN (SELECT file FROM there)
  UNION ALL SELECT 'not listed', file, '' FROM there WHERE file NOT IN (SELECT file FROM par)""")
def check_table(spark, sf_dir):
    return G.check_table(registry_table(spark, sf_dir), pdf_files(spark, sf_dir))


def one_row_each(spark, sf_dir):
    return registry_table(spark, sf_dir).withColumn("file", F.concat(F.col("cover_title"), F.lit(".pdf"))).withColumn("pages", F.lit(""))


#: One row for each document, and changes of every row in batches: new, unknown, blank, malformed and taken ids.
ASSIGN_SQL = TABLE_SQL + r""", own AS (SELECT * REPLACE (cover_title || '.pdf' AS file, '' AS pages) FROM reg), src AS (SELECT 'Report ' || doc_id || '.pdf' AS file, source AS batch, doc_id, n_chars FROM documents),
  asked AS (SELECT batch, file, CASE doc_id % 8 WHEN 0 THEN (2000 + doc_id % 25) || '-00' WHEN 1 THEN 'new-' || doc_id WHEN 2 THEN '' WHEN 3 THEN CASE WHEN n_chars % 211 = 0 THEN 'no good' ELSE 'n' || doc_id END ELSE '2030-' || lpad((doc_id % 90)::VARCHAR, 2, '0') || '-v' || doc_id END AS typed, doc_id FROM src),
  turn AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY batch, file) AS t FROM asked),
  final AS (SELECT batch, file, CASE WHEN regexp_matches(typed, '^[0-9]{4}-00$') THEN typed || '-v' || t ELSE typed END AS report_id FROM turn),
  checked AS (SELECT *, CASE WHEN report_id <> '' AND NOT regexp_matches(report_id, '^[A-Za-z0-9][A-Za-z0-9-]*$') THEN 'form' WHEN report_id <> '' AND count(*) OVER (PARTITION BY report_id) > 1 THEN 'taken' END AS error FROM final) """


def changes(spark, sf_dir):
    i = F.col("doc_id")
    typed = (
        F.when(i % 8 == 0, F.concat((2000 + i % 25).cast("string"), F.lit("-00")))
        .when(i % 8 == 1, F.format_string("new-%d", i))
        .when(i % 8 == 2, "")
        .when(i % 8 == 3, F.when(F.col("n_chars") % 211 == 0, "no good").otherwise(F.format_string("n%d", i)))
        .otherwise(F.format_string("2030-%02d-v%d", i % 90, i))
    )
    return table(spark, sf_dir, "documents").select(F.col("source").alias("batch"), F.format_string("Report %d.pdf", i).alias("file"), F.lit("").alias("pages"), typed.alias("report_id"))


@query("q_validate_ids", ASSIGN_SQL + "SELECT batch, file, '' AS pages, report_id, error FROM checked")
def validate_ids(spark, sf_dir):
    return G.validated(one_row_each(spark, sf_dir), changes(spark, sf_dir))


@query("q_assign_ids", ASSIGN_SQL + """, good AS (SELECT file, report_id AS new FROM checked WHERE batch NOT IN (SELECT batch FROM checked WHERE error IS NOT NULL)),
  j AS (SELECT own.*, new, new IS NOT NULL AND new <> report_id AS changed FROM own LEFT JOIN good USING (file))
  SELECT file, pages, CASE WHEN changed THEN new ELSE report_id END AS report_id, CASE WHEN changed THEN CASE WHEN new = '' THEN '' ELSE 'manual' END ELSE source END AS source, cover_title,
    CASE WHEN changed THEN CASE WHEN new = '' THEN '' ELSE '2026-09-01' END ELSE registered END AS registered, note FROM j""")
def assign_ids(spark, sf_dir):
    return G.assign(one_row_each(spark, sf_dir), changes(spark, sf_dir), "2026-09-01")


@query("q_rename_reports", r"""WITH p AS (SELECT doc_id, printf('%04d-%02d', 2000 + doc_id % 25, doc_id % 60) || '-' || chr((98 + doc_id // 300 % 25)::INTEGER) || '-v' || (1 + doc_id // 7500) AS old, CASE WHEN doc_id % 3 = 0 THEN 'own-' || doc_id ELSE printf('%04d-%02d', 2001 + doc_id % 25, doc_id % 60) || '-' || chr((98 + doc_id // 300 % 25)::INTEGER) || '-v' || (1 + doc_id // 7500) END AS new, text FROM documents)
  SELECT new AS rid, '---' || chr(10) || 'report_id: ' || new || chr(10) || 'year: ' || CASE WHEN doc_id % 3 = 0 THEN 2000 + doc_id % 25 ELSE 2001 + doc_id % 25 END || chr(10) || 'summary_reviewed: ' || new || '_c1 ' || new || '_c2s1' || chr(10) || '---' || chr(10)
    || '# One <!-- id: ' || new || '_c1 -->' || chr(10) || text || chr(10) || 'see ' || old || '_c1' AS text FROM p""")
def rename_reports(spark, sf_dir):
    i = F.col("doc_id")
    letter = F.char((98 + F.floor(i / 300) % 25).cast("int"))
    tail = F.format_string("-%02d-%s-v%d", i % 60, letter, 1 + F.floor(i / 7500))
    old, moved = F.concat((2000 + i % 25).cast("string"), tail), F.concat((2001 + i % 25).cast("string"), tail)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", old.alias("old"), F.when(i % 3 == 0, F.format_string("own-%d", i)).otherwise(moved).alias("new"))
    head = F.concat(F.lit("---\nreport_id: "), F.col("old"), F.lit("\nyear: "), (2000 + i % 25).cast("string"), F.lit("\nsummary_reviewed: "), F.col("old"), F.lit("_c1 "), F.col("old"), F.lit("_c2s1\n---\n# One <!-- id: "), F.col("old"), F.lit("_c1 -->\n"))
    docs = rows.select(F.col("old").alias("rid"), F.concat(head, F.col("text"), F.lit("\nsee "), F.col("old"), F.lit("_c1")).alias("text"))
    return G.renamed(docs, rows.select("old", "new"))


#: Titles of two words spelled by ids and sizes: some are shared, some stand inside longer ones.
TITLES_SQL = """WITH t AS (SELECT doc_id AS id, translate(lpad((doc_id // 3)::VARCHAR, 4, '0'), '0123456789', '가나다라마바사아자차') || '기관 ' || translate(lpad((n_chars % 997)::VARCHAR, 3, '0'), '0123456789', '타파하거너더러머버서') || CASE WHEN doc_id % 2 = 0 THEN '분야' ELSE '' END || ' 보고서' AS title FROM documents) """


@query("q_similar_registered", TITLES_SQL + f""",
  w AS (SELECT id, title, unnest(list_distinct(list_filter(regexp_extract_all(title, '[가-힣]{{3,}}'), lambda x: NOT list_contains({config.TITLE_STOP!r}, x)))) AS word FROM t),
  h AS (SELECT w.id, t.id AS other, word FROM w JOIN t ON t.id <> w.id AND contains(t.title, word)),
  b AS (SELECT id, other, word FROM h UNION SELECT other, id, word FROM h),
  s AS (SELECT id, other, sum(length(word))::BIGINT AS shared FROM b GROUP BY id, other)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other)::INTEGER AS rank FROM s) WHERE rank <= 3""")
def similar_registered(spark, sf_dir):
    spelled = lambda n, width, letters: F.translate(F.lpad(n.cast("string"), width, "0"), "0123456789", letters)
    i = F.col("doc_id")
    field = F.concat(spelled(F.col("n_chars") % 997, 3, "타파하거너더러머버서"), F.when(i % 2 == 0, "분야").otherwise(""))
    title = F.concat(spelled(F.floor(i / 3), 4, "가나다라마바사아자차"), F.lit("기관 "), field, F.lit(" 보고서"))
    return registry.similar(table(spark, sf_dir, "documents").select(i.alias("id"), title.alias("title")))
