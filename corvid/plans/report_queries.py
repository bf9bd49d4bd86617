"""Queries of front matter, stamps, status and cards, over reports made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid import config
from corvid.operators import cards as C
from corvid.operators import frontmatter as M
from corvid.plans.queries import query
from corvid.plans.tables import sql_strip, table

#: Markdown reports of all documents; which keys and stamps they have and which values are wrong follows from ids.
REPORTS_SQL = r"""WITH md AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'own-' || doc_id WHEN doc_id % 31 = 0 THEN '0000-00-v1' ELSE printf('%04d-%02d', 2000 + doc_id % 25, doc_id % 60) END AS stem, text, n_chars, source,
  CASE WHEN doc_id % 3 > 0 OR doc_id % 11 = 0 THEN '2026-01-01' ELSE '' END AS r, CASE WHEN doc_id % 5 > 0 THEN '2026-01-02' ELSE '' END AS x, CASE WHEN doc_id % 7 > 2 THEN '2026-01-03' ELSE '' END AS a FROM documents),
rep AS (SELECT *, '---' || chr(10) || 'report_id: ' || CASE WHEN doc_id % 10 = 0 THEN '"R 1"' ELSE stem END || chr(10) || 'title: ' || CASE WHEN doc_id % 9 = 0 THEN '""' ELSE '"Report ' || doc_id || '"' END || chr(10)
  || CASE WHEN doc_id % 6 = 1 THEN '' ELSE 'title_en: ""' || chr(10) END || 'year: ' || CASE doc_id % 8 WHEN 0 THEN '1999' WHEN 4 THEN 'unknown' ELSE (2000 + doc_id % 25)::VARCHAR END || chr(10) || 'lead_researcher: ' || source || chr(10)
  || CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'institution: here' || chr(10) END || 'keywords_ko: []' || chr(10) || 'keywords_en: []' || chr(10) || 'abstract: |' || chr(10) || '  year: 1' || chr(10) || 'source_pdf: f.pdf' || chr(10)
  || CASE doc_id % 12 WHEN 3 THEN 'structure: flat' || chr(10) WHEN 4 THEN 'structure: tree' || chr(10) ELSE '' END || CASE WHEN doc_id % 15 < 2 THEN 'pdf_pages: "1-20"' || chr(10) ELSE '' END
  || CASE WHEN r <> '' THEN 'verified_register: ' || r || chr(10) ELSE '' END || CASE WHEN x <> '' THEN 'verified_extract: ' || x || chr(10) ELSE '' END || CASE WHEN a <> '' THEN 'verified_annotate: ' || a || chr(10) ELSE '' END
  || '---' || chr(10) || text AS body FROM md) """


def reports(spark, sf_dir):
    i = F.col("doc_id")
    number = F.format_string("%04d-%02d", 2000 + i % 25, i % 60)
    stem = F.when(i % 4 == 0, F.format_string("own-%d", i)).when(i % 31 == 0, "0000-00-v1").otherwise(number)
    stamp = lambda test, day: F.when(test, day).otherwise("")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", stem.alias("stem"), "text", "n_chars", "source", stamp((i % 3 > 0) | (i % 11 == 0), "2026-01-01").alias("r"), stamp(i % 5 > 0, "2026-01-02").alias("x"), stamp(i % 7 > 2, "2026-01-03").alias("a")
    )
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))
    none = F.lit("")
    year = F.when(i % 8 == 0, "1999").when(i % 8 == 4, "unknown").otherwise((2000 + i % 25).cast("string"))
    body = F.concat(
        F.lit("---\n"),
        line("report_id: ", F.when(i % 10 == 0, '"R 1"').otherwise(F.col("stem"))),
        line("title: ", F.when(i % 9 == 0, '""').otherwise(F.format_string('"Report %d"', i))),
        F.when(i % 6 == 1, none).otherwise('title_en: ""\n'),
        line("year: ", year),
        line("lead_researcher: ", F.col("source")),
        F.when(i % 6 == 0, none).otherwise("institution: here\n"),
        F.lit("keywords_ko: []\nkeywords_en: []\nabstract: |\n  year: 1\nsource_pdf: f.pdf\n"),
        F.when(i % 12 == 3, "structure: flat\n").when(i % 12 == 4, "structure: tree\n").otherwise(none),
        F.when(i % 15 < 2, 'pdf_pages: "1-20"\n').otherwise(none),
        *(F.when(F.col(c) != "", line(f"{s}: ", F.col(c))).otherwise(none) for s, c in zip(config.STAMPS, "rxa")),
        F.lit("---\n"),
        F.col("text"),
    )
    return rows.withColumn("body", body)


@query("q_frontmatter_findings", REPORTS_SQL + r""", f AS (SELECT doc_id, stem, CASE WHEN doc_id % 10 = 0 THEN 'R 1' ELSE stem END AS rid, CASE doc_id % 8 WHEN 0 THEN '1999' WHEN 4 THEN 'unknown' ELSE (2000 + doc_id % 25)::VARCHAR END AS year, regexp_matches(stem, '^[0-9]{4}-[0-9]{2}') AS std,
    CASE WHEN doc_id % 15 < 2 THEN '"1-20"' END AS pages, 1 + doc_id % 3 // 2 AS parts, CASE doc_id % 2 WHEN 0 THEN '"1-20"' ELSE '"21-40"' END AS span FROM md)
  SELECT doc_id, 'missing keys' AS finding, CASE WHEN doc_id % 6 = 1 THEN 'title_en' ELSE 'institution' END AS detail FROM f WHERE doc_id % 6 < 2 UNION ALL SELECT doc_id, 'report id', rid FROM f WHERE rid <> stem
  UNION ALL SELECT doc_id, 'year', year FROM f WHERE CASE WHEN std THEN year <> CASE WHEN starts_with(stem, '0000') THEN '' ELSE substr(stem, 1, 4) END ELSE NOT regexp_matches(year, '^[0-9]{4}$') END
  UNION ALL SELECT doc_id, 'structure', 'tree' FROM f WHERE doc_id % 12 = 4 UNION ALL SELECT doc_id, 'blank title', '' FROM f WHERE doc_id % 9 = 0
  UNION ALL SELECT doc_id, CASE WHEN parts > 1 THEN 'part drift' ELSE 'pages of a whole' END, coalesce(pages, '') FROM f WHERE (parts > 1 AND pages IS DISTINCT FROM span) OR (parts = 1 AND pages IS NOT NULL)""")
def frontmatter_findings(spark, sf_dir):
    i = F.col("doc_id")
    low = F.when(i % 2 == 0, 0).otherwise(20)
    rows = reports(spark, sf_dir).select("doc_id", "stem", F.col("body").alias("text"), low.alias("part_from"), (low + 19).alias("part_to"), F.when(i % 3 == 2, 2).otherwise(1).alias("n_parts"))
    return M.findings(rows)


@query("q_frontmatter", REPORTS_SQL + """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'R 1' ELSE stem END AS rid, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'Report ' || doc_id END AS title, CASE doc_id % 12 WHEN 3 THEN 'flat' WHEN 4 THEN 'tree' END AS structure FROM md""")
def frontmatter(spark, sf_dir):
    from corvid.sources import readers

    rows = reports(spark, sf_dir).select("doc_id", readers.frontmatter(F.col("body")).alias("m"))
    return rows.select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(n) for n, k in (("rid", "report_id"), ("title", "title"), ("structure", "structure"))))


@query("q_check_scope", REPORTS_SQL + """SELECT doc_id, CASE WHEN x = '' THEN 'full' WHEN a = '' THEN 'promote' WHEN r = '' THEN 'register' ELSE 'skip' END AS scope,
  CASE WHEN x = '' THEN 'full' WHEN a <> '' THEN 'reaudit' ELSE 'promote' END AS again FROM md""")
def check_scope(spark, sf_dir):
    stamps = [M.raw_value(F.col("body"), s) for s in config.STAMPS]
    rows = reports(spark, sf_dir).select("doc_id", *(F.coalesce(s, F.lit("")).alias(c) for s, c in zip(stamps, "rxa")))
    s = [F.col(c) for c in "rxa"]
    return rows.select("doc_id", M.scope(*s).alias("scope"), M.scope(*s, again=True).alias("again"))


STRIPPED = "replace(replace(replace(body, 'verified_register: 2026-01-01' || chr(10), ''), 'verified_extract: 2026-01-02' || chr(10), ''), 'verified_annotate: 2026-01-03' || chr(10), '')"
NEW_STAMPS = "CASE WHEN n1 <> '' THEN 'verified_register: ' || n1 || chr(10) ELSE '' END || CASE WHEN n2 <> '' THEN 'verified_extract: ' || n2 || chr(10) ELSE '' END || CASE WHEN n3 <> '' THEN 'verified_annotate: ' || n3 || chr(10) ELSE '' END"


@query("q_write_stamps", REPORTS_SQL + f""", w AS (SELECT *, CASE WHEN doc_id % 4 < 3 THEN '2026-09-01' ELSE '' END AS n1, CASE WHEN doc_id % 4 < 2 THEN '2026-09-02' ELSE '' END AS n2, CASE WHEN doc_id % 4 < 1 OR doc_id % 13 = 0 THEN '2026-09-03' ELSE '' END AS n3 FROM rep),
  h AS (SELECT doc_id, CASE WHEN (n2 <> '' AND n1 = '') OR (n3 <> '' AND n2 = '') THEN NULL ELSE replace({STRIPPED}, chr(10) || '---' || chr(10) || text, chr(10) || {NEW_STAMPS} || '---' || chr(10) || text) END AS stamped FROM w)
  SELECT doc_id, sha256(stamped) AS stamped_sha256, stamped IS NOT NULL AS guarded FROM h""")
def write_stamps(spark, sf_dir):
    i = F.col("doc_id")
    new = [F.when(t, d).otherwise("") for t, d in ((i % 4 < 3, "2026-09-01"), (i % 4 < 2, "2026-09-02"), ((i % 4 < 1) | (i % 13 == 0), "2026-09-03"))]
    rows = reports(spark, sf_dir).select("doc_id", "body", *(v.alias(f"n{k}") for k, v in enumerate(new, 1)))
    values = [F.col(f"n{k}") for k in (1, 2, 3)]
    rows = rows.withColumn("stamped", M.with_stamps(F.col("body"), *values))
    return rows.select("doc_id", F.sha2("stamped", 256).alias("stamped_sha256"), M.stamp_guard(F.col("body"), F.col("stamped"), *values).alias("guarded"))


@query("q_reviewed_lines", REPORTS_SQL + f""", v AS (SELECT *, 'summary_reviewed: ' || CASE WHEN source < lang THEN source || ' ' || lang ELSE CASE WHEN source = lang THEN lang ELSE lang || ' ' || source END END || chr(10) AS line FROM rep JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
  t AS (SELECT *, CASE WHEN r <> '' THEN 'verified_register: ' || r || chr(10) ELSE '' END || CASE WHEN x <> '' THEN 'verified_extract: ' || x || chr(10) ELSE '' END || CASE WHEN a <> '' THEN 'verified_annotate: ' || a || chr(10) ELSE '' END AS stamps FROM v)
  SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN body ELSE replace(body, chr(10) || stamps || '---' || chr(10) || text, chr(10) || line || stamps || '---' || chr(10) || text) END) AS sha256 FROM t""")
def reviewed_lines(spark, sf_dir):
    """Reviewed ids stand for source and language; a third of the reports had a line that goes as none is left."""
    rows = reports(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    none = F.array().cast("array<string>")
    had = F.when(F.col("doc_id") % 3 == 0, M.with_reviewed(F.col("body"), F.array(F.lit("old")))).otherwise(F.col("body"))
    rows = rows.select("doc_id", had.alias("body"), F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.array("source", "lang", "source")).alias("hids"))
    return rows.select("doc_id", F.sha2(M.with_reviewed(F.col("body"), F.col("hids")), 256).alias("sha256"))


@query("q_stamps_after", REPORTS_SQL + """, m AS (SELECT *, CASE WHEN x = '' THEN 'full' WHEN a = '' THEN 'promote' WHEN r = '' THEN 'register' ELSE 'skip' END AS mode, n_chars % 5 = 0 AS failed, n_chars % 7 = 0 AS quality, n_chars % 3 > 0 AS complete FROM md)
  SELECT doc_id, CASE WHEN mode = 'skip' OR failed THEN r WHEN r <> '' THEN r ELSE '2026-09-01' END AS register, CASE WHEN mode = 'skip' THEN x WHEN failed THEN '' WHEN mode = 'full' OR x = '' THEN '2026-09-01' ELSE x END AS extract,
    CASE WHEN mode = 'skip' THEN a WHEN failed OR quality OR NOT complete THEN '' WHEN mode = 'register' OR a <> '' THEN a ELSE '2026-09-01' END AS annotate FROM m""")
def stamps_after(spark, sf_dir):
    n = F.col("n_chars")
    rows = reports(spark, sf_dir).select("doc_id", "n_chars", *"rxa")
    s = [F.col(c) for c in "rxa"]
    new = M.stamps_after(M.scope(*s), n % 5 == 0, n % 7 == 0, n % 3 > 0, *s, "2026-09-01")
    return rows.select("doc_id", new.alias("s")).select("doc_id", "s.*")


# --- status and cards ---------------------------------------------------------------------------------------------

#: What is known of each report: units and summaries from ids and sizes, stamps as above, files' times, hashes.
STATE_SQL = REPORTS_SQL + r""", st AS (SELECT 'r' || doc_id AS report_id, doc_id % 19 > 0 AS parsed, doc_id % 12 = 3 AS flat, n_chars % 9 AS units, least(n_chars % 9, n_chars % 10) AS done, CASE WHEN doc_id % 14 = 0 THEN 2 ELSE 0 END AS regen, CASE WHEN doc_id % 21 = 0 THEN 1 ELSE 0 END AS manual,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars % 4 END AS calls, n_chars % 2 = 0 AS summarised, r, x, a, CASE WHEN doc_id % 16 = 0 THEN 'other' ELSE 'r' || doc_id END AS fm_id, doc_id % 18 > 0 AS round_trip, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 107 WHEN 2 THEN 101 ELSE 50 END AS pdf_time,
  CASE WHEN a = '' THEN NULL WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS ledger, sha256(text) AS hash, 'f' || CASE WHEN doc_id % 6 = 0 THEN 'gone' ELSE '' END || doc_id // 2 || '.pdf' AS file, doc_id, n_chars, source FROM md),
status AS (SELECT *, list_filter([CASE WHEN flat THEN '플랫 구조(구간 청킹)' END, CASE WHEN regen > 0 THEN '품질 FAIL 재생성 대기 ' || regen || '건 — annotate가 자동 재생성' END, CASE WHEN manual > 0 THEN '품질 FAIL 수동 검토 필요 ' || manual || '건' END,
    CASE WHEN a <> '' AND x = '' THEN '스탬프 사다리 위반 — verified_extract 없이 verified_annotate 존재' END, CASE WHEN a <> '' AND calls > 0 THEN '검증 후 변경 — 재검증 필요' END, CASE WHEN a = '' AND x <> '' AND units > 0 AND calls = 0 AND manual = 0 THEN 'verify 승격 대기 — D 품질 판정 후 verified_annotate 기록' END,
    CASE WHEN x <> '' AND r = '' THEN '등록 스탬프 없음 — verify 실행 시 verified_register 기록(PDF 재스캔 없음)' END, CASE WHEN fm_id <> report_id THEN 'frontmatter report_id(other) ≠ 파일명' END, CASE WHEN NOT round_trip THEN '요약 배치 규약 불일치 — annotate가 이 파일을 건너뜀' END,
    CASE WHEN pdf_time IS NULL THEN '원본 PDF 대응 없음(삭제·개명 또는 미등록 — report_ids.tsv 확인)' WHEN pdf_time > 102 THEN 'PDF가 .md보다 최신 — 재추출 검토(--force 시 요약 소실 주의)' END], lambda n: n IS NOT NULL) AS all_notes FROM st),
row AS (SELECT report_id, CASE WHEN parsed THEN '완료' ELSE '파싱 실패' END AS extracted, CASE WHEN parsed THEN done || '/' || units ELSE '-' END AS summary, CASE WHEN parsed THEN calls ELSE 0 END::INTEGER AS remaining, CASE WHEN NOT parsed THEN '-' WHEN summarised THEN '완료' WHEN units > 0 THEN '대기' ELSE '-' END AS report_summary,
  CASE WHEN NOT parsed THEN 'unverified' WHEN a <> '' THEN 'annotate' WHEN x <> '' THEN 'extract' WHEN r <> '' THEN 'register' ELSE 'unverified' END AS verify, CASE WHEN ledger IS NULL THEN '-' WHEN ledger = hash THEN '동기화' ELSE '미반영' END AS db, CASE WHEN parsed THEN regen ELSE 0 END AS regen, CASE WHEN parsed THEN manual ELSE 0 END AS manual,
  CASE WHEN parsed THEN all_notes ELSE ['unreadable'] END AS notes, file FROM status) """


def state(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    rows = reports(spark, sf_dir)
    hash_ = F.sha2(F.col("text").cast("binary"), 256)
    name = F.format_string("r%d", i)
    return rows.select(
        "doc_id", "n_chars", "source", name.alias("report_id"), (i % 19 > 0).alias("parsed"), (i % 12 == 3).alias("flat"), (n % 9).cast("int").alias("units"), F.least(n % 9, n % 10).cast("int").alias("done"),
        F.when(i % 14 == 0, 2).otherwise(0).alias("regen"), F.when(i % 21 == 0, 1).otherwise(0).alias("manual"), F.when(i % 3 == 0, 0).otherwise(n % 4).cast("int").alias("calls"), (n % 2 == 0).alias("summarised"),
        *(F.col(c).alias(s) for s, c in zip(config.STAMPS, "rxa")), F.when(i % 16 == 0, "other").otherwise(name).alias("fm_id"), (i % 18 > 0).alias("round_trip"),
        F.when(i % 6 == 0, None).when(i % 6 == 1, 107.0).when(i % 6 == 2, 101.0).otherwise(50.0).alias("pdf_time"), F.lit(100.0).alias("md_time"), hash_.alias("content_hash"),
        F.when(F.col("a") == "", None).when(i % 4 == 0, "old").otherwise(hash_).alias("ledger_hash"), F.concat(F.lit("f"), F.when(i % 6 == 0, "gone").otherwise(""), F.floor(i / 2).cast("string"), F.lit(".pdf")).alias("file"),
    )


@query("q_status", STATE_SQL + "SELECT * EXCLUDE (file) FROM row")
def status_rows(spark, sf_dir):
    return C.status(state(spark, sf_dir))


@query("q_status_totals", STATE_SQL + "SELECT verify, db, count(*) AS n, sum(remaining)::BIGINT AS calls, sum(len(notes))::BIGINT AS notes FROM row GROUP BY ROLLUP (verify, db)")
def status_totals(spark, sf_dir):
    return C.status(state(spark, sf_dir)).rollup("verify", "db").agg(F.count("*").alias("n"), F.sum("remaining").alias("calls"), F.sum(F.size("notes")).cast("long").alias("notes"))


@query("q_loaded", STATE_SQL + "SELECT report_id, db = '동기화' AS loaded, verify IN ('unverified', 'register') OR list_contains(notes, '등록 스탬프 없음 — verify 실행 시 verified_register 기록(PDF 재스캔 없음)') AS to_verify FROM row")
def loaded(spark, sf_dir):
    s = C.status(state(spark, sf_dir))
    return s.select("report_id", C.is_loaded(F.col("db")).alias("loaded"), C.needs_verify(F.col("verify"), F.col("notes")).alias("to_verify"))


FILES_SQL = STATE_SQL + r""", pdf AS (SELECT 'f' || doc_id // 2 || '.pdf' AS file, CASE WHEN doc_id % 10 < 2 THEN NULL WHEN doc_id % 10 = 2 THEN 'new' || doc_id // 20 ELSE 'r' || doc_id END AS rid, doc_id % 10 = 1 OR doc_id % 10 > 1 AS listed,
    CASE doc_id % 50 WHEN 2 THEN 'skipped_no_profile' WHEN 12 THEN 'skipped_flat_guard' WHEN 22 THEN 'error' WHEN 32 THEN 'skipped_duplicate' END AS log FROM documents),
  rg AS (SELECT 'f' || CASE WHEN doc_id % 23 = 0 THEN 'lost' ELSE '' END || doc_id // 2 || '.pdf' AS file, CASE WHEN doc_id % 15 = 1 THEN '' ELSE 'r' || doc_id END AS report_id, CASE WHEN doc_id % 2 = 1 THEN '2020-' || lpad((n_chars % 60)::VARCHAR, 2, '0') ELSE '' END AS family FROM documents),
  bl AS (SELECT * FROM rg WHERE report_id = '' AND file IN (SELECT file FROM pdf)), nw AS (SELECT * FROM pdf WHERE rid IS NOT NULL AND rid NOT IN (SELECT report_id FROM row)),
  ag AS (SELECT file, CASE WHEN bool_or(extracted = '파싱 실패') THEN 'err' ELSE 'warn' END AS severity, count(*) AS n FROM row WHERE extracted = '파싱 실패' OR len(list_filter(notes, lambda x: starts_with(x, 'PDF가 .md보다 최신'))) > 0 GROUP BY file),
  mn AS (SELECT len(list_filter(notes, lambda x: NOT regexp_matches(x, '^(verify 승격 대기|검증 후 변경|플랫 구조|등록 스탬프 없음|품질 FAIL 재생성 대기|PDF가 .md보다 최신|품질 FAIL 수동 검토 필요)'))) AS n FROM row WHERE extracted = '완료') """


@query("q_cards", FILES_SQL + r"""SELECT 'dup_id' AS kind, 'err' AS severity, rid AS subject, count(*) AS n FROM pdf WHERE rid IS NOT NULL GROUP BY rid HAVING count(*) > 1
  UNION ALL SELECT 'register', 'warn', file, count(*) FROM pdf WHERE rid IS NULL AND NOT listed GROUP BY file
  UNION ALL SELECT 'register_family', 'err', CASE WHEN family <> '' THEN family ELSE 'file:' || file END AS s, count(*) FROM bl GROUP BY s
  UNION ALL SELECT 'register_broken', 'err', file, count(*) FROM pdf WHERE rid IS NULL AND listed AND file NOT IN (SELECT file FROM bl) GROUP BY file
  UNION ALL SELECT 'register_orphan', 'warn', file, count(*) FROM rg WHERE file NOT IN (SELECT file FROM pdf) GROUP BY file
  UNION ALL SELECT 'new_pdf', 'warn', file, count(*) FROM nw WHERE log IS NULL GROUP BY file UNION ALL SELECT 'detect_fail', 'warn', file, count(*) FROM nw WHERE log = 'skipped_no_profile' GROUP BY file
  UNION ALL SELECT 'flat_guard', 'warn', file, count(*) FROM nw WHERE log = 'skipped_flat_guard' GROUP BY file UNION ALL SELECT 'extract_error', 'err', file, count(*) FROM nw WHERE log = 'error' GROUP BY file
  UNION ALL SELECT CASE WHEN file IN (SELECT file FROM pdf) THEN 'reextract' ELSE 'manual_file' END, severity, file, n FROM ag
  UNION ALL SELECT 'verify_needed', 'warn', '', count(*) FROM row WHERE extracted = '완료' AND (verify IN ('unverified', 'register') OR list_contains(notes, '등록 스탬프 없음 — verify 실행 시 verified_register 기록(PDF 재스캔 없음)'))
  UNION ALL SELECT 'summarize_needed', 'warn', '', count(*) FROM row WHERE remaining > 0 UNION ALL SELECT 'quality_wait', 'warn', '', count(*) FROM row WHERE verify = 'extract' AND remaining = 0 AND manual = 0
  UNION ALL SELECT 'db_stale', 'warn', '', count(*) FROM row WHERE db = '미반영' UNION ALL SELECT 'summary_manual', 'err', report_id, sum(manual)::BIGINT FROM row WHERE extracted = '완료' AND manual > 0 GROUP BY report_id
  UNION ALL SELECT 'manual', 'info', '', sum(n)::BIGINT FROM mn UNION ALL SELECT 'index_stale', 'warn', '', 0""")
def cards(spark, sf_dir):
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    pair = F.floor(i / 2).cast("string")
    log = F.when(i % 50 == 2, "skipped_no_profile").when(i % 50 == 12, "skipped_flat_guard").when(i % 50 == 22, "error").when(i % 50 == 32, "skipped_duplicate")
    rid = F.when(i % 10 < 2, None).when(i % 10 == 2, F.concat(F.lit("new"), F.floor(i / 20).cast("string"))).otherwise(F.format_string("r%d", i))
    files = docs.select(F.concat(F.lit("f"), pair, F.lit(".pdf")).alias("file"), rid.alias("rid"), (i % 10 > 0).alias("listed"), log.alias("log"))
    family = F.when(i % 2 == 1, F.format_string("2020-%02d", F.col("n_chars") % 60)).otherwise("")
    registry = docs.select(F.concat(F.lit("f"), F.when(i % 23 == 0, "lost").otherwise(""), pair, F.lit(".pdf")).alias("file"), F.when(i % 15 == 1, "").otherwise(F.format_string("r%d", i)).alias("report_id"), family.alias("family"))
    known = state(spark, sf_dir)
    rows = C.status(known).join(known.select("report_id", "file"), "report_id")
    return C.cards(rows, files, registry, catalogue_stale=True)
