"""Status of reports and the cards that list what is to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import text as T

#: Notes, their automatic ones, seconds by which a file may be newer.
FLAT = "플랫 구조(구간 청킹)"
REGEN, MANUAL = "품질 FAIL 재생성 대기", "품질 FAIL 수동 검토 필요"
LADDER = "스탬프 사다리 위반 — verified_extract 없이 verified_annotate 존재"
CHANGED = "검증 후 변경 — 재검증 필요"
PROMOTE = "verify 승격 대기 — D 품질 판정 후 verified_annotate 기록"
REGISTER = "등록 스탬프 없음 — verify 실행 시 verified_register 기록(PDF 재스캔 없음)"
ROUNDTRIP = "요약 배치 규약 불일치 — annotate가 이 파일을 건너뜀"
NO_PDF = "원본 PDF 대응 없음(삭제·개명 또는 미등록 — report_ids.tsv 확인)"
NEWER = "PDF가 .md보다 최신 — 재추출 검토(--force 시 요약 소실 주의)"
AUTOMATIC = ("verify 승격 대기", "검증 후 변경", "플랫 구조", REGISTER, REGEN)
REEXTRACT = "PDF가 .md보다 최신"
TOLERANCE = 2.0


def status(reports: DataFrame) -> DataFrame:
    """Rows (report_id, extracted, summary, remaining, report_summary, verify, db, regen, manual, notes) of reports.

    ``reports`` has report_id, parsed, flat, units, done, regen, manual (of these, for a person), calls, summarised,
    the three stamps, fm_id, round_trip, pdf_time and md_time (seconds, null: no file), content_hash and ledger_hash.
    """
    r, x, a = T.text("verified_register") != "", T.text("verified_extract") != "", T.text("verified_annotate") != ""
    notes = F.array(
        F.when(F.col("flat"), FLAT),
        F.when(F.col("regen") > 0, F.concat(F.lit(REGEN), F.format_string(" %d건 — annotate가 자동 재생성", "regen"))),
        F.when(F.col("manual") > 0, F.concat(F.lit(MANUAL), F.format_string(" %d건", "manual"))),
        F.when(a & ~x, LADDER),
        F.when(a & (F.col("calls") > 0), CHANGED),
        F.when(~a & x & (F.col("units") > 0) & (F.col("calls") == 0) & (F.col("manual") == 0), PROMOTE),
        F.when(x & ~r, REGISTER),
        F.when(F.col("fm_id") != F.col("report_id"), F.concat(F.lit("frontmatter report_id("), F.col("fm_id"), F.lit(") ≠ 파일명"))),
        F.when(~F.col("round_trip"), ROUNDTRIP),
        F.when(F.col("pdf_time").isNull(), NO_PDF).when(F.col("pdf_time") > F.col("md_time") + TOLERANCE, NEWER),
    )
    good = F.col("parsed")
    only = lambda c, other: F.when(good, c).otherwise(other)
    synced = F.when(F.col("ledger_hash").isNull(), "-").when(F.col("ledger_hash") == F.col("content_hash"), "동기화").otherwise("미반영")
    return reports.select(
        "report_id",
        only(F.lit("완료"), "파싱 실패").alias("extracted"),
        only(F.format_string("%d/%d", "done", "units"), "-").alias("summary"),
        only(F.col("calls"), 0).alias("remaining"),
        only(F.when(F.col("summarised"), "완료").when(F.col("units") > 0, "대기").otherwise("-"), "-").alias("report_summary"),
        only(F.when(a, "annotate").when(x, "extract").when(r, "register").otherwise("unverified"), "unverified").alias("verify"),
        synced.alias("db"),
        only(F.col("regen"), 0).alias("regen"),
        only(F.col("manual"), 0).alias("manual"),
        only(F.filter(notes, lambda n: n.isNotNull()), F.array(F.lit("unreadable"))).alias("notes"),
    )


def is_loaded(db: Column) -> Column:
    return db == "동기화"


def needs_verify(verify: Column, notes: Column) -> Column:
    """No stamp of the extraction check, or only the register stamp is lacking."""
    return verify.isin("unverified", "register") | F.array_contains(notes, REGISTER)


def begins(note: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | note.startswith(p)
    return out


def cards(rows: DataFrame, files: DataFrame, registry: DataFrame, catalogue_stale: bool = False) -> DataFrame:
    """Cards (kind, severity, subject, n): one per subject, with how many items it lists.

    ``rows`` is the status with ``file`` (the PDF each report came from); ``files`` the PDFs that are there (file, rid
    (null: not usable), listed, problem, log: status of the last extraction, null if none); ``registry`` its rows
    (file, pages, report_id, family, held).
    """

    def card(df: DataFrame, kind: str, severity: str | Column, subject: Column, n: Column | None = None) -> DataFrame:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return df.groupBy(subject.alias("subject")).agg(F.max(severity).alias("severity"), (F.count("*") if n is None else n).alias("n")).select(F.lit(kind).alias("kind"), "severity", "subject", F.col("n").cast("long").alias("n"))

    one = F.lit("")
    by_rid = files.filter("rid is not null").groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1")
    blank = registry.filter("report_id = ''").join(files.select("file").distinct(), "file", "left_semi")
    family = F.when(F.col("family") != "", F.col("family")).otherwise(F.concat(F.lit("file:"), F.col("file")))
    waiting = files.filter("rid is null")
    broken = waiting.filter("listed").join(blank.select("file").distinct(), "file", "left_anti")
    gone = registry.join(files.select("file").distinct(), "file", "left_anti")
    new = files.filter("rid is not null").join(rows.select(F.col("report_id").alias("rid")), "rid", "left_anti")
    log = F.col("log")
    stale = F.exists("notes", lambda x: x.startswith(REEXTRACT))
    failed = F.col("extracted") == "파싱 실패"
    again = rows.filter(failed | stale)
    known = files.select("file").distinct()
    # 'warn' sorts behind 'err': the greatest of a group would be the mildest
    worst = F.when(F.max(failed.cast("int")).over(_by("file")) == 1, "err").otherwise("warn")
    done = F.col("extracted") == "완료"
    manual = F.filter("notes", lambda x: ~begins(x, (*AUTOMATIC, REEXTRACT, MANUAL)))
    parts = [
        by_rid.select(F.lit("dup_id").alias("kind"), F.lit("err").alias("severity"), F.col("rid").alias("subject"), F.col("n").cast("long").alias("n")),
        card(waiting.filter("not listed"), "register", "warn", F.col("file")),
        card(blank, "register_family", "err", family),
        card(broken, "register_broken", "err", F.col("file")),
        card(gone, "register_orphan", "warn", F.col("file")),
        card(new.filter(log.isNull()), "new_pdf", "warn", F.col("file")),
        card(new.filter(log.isin("skipped_no_profile", "skipped_no_body_start")), "detect_fail", "warn", F.col("file")),
        card(new.filter(log == "skipped_flat_guard"), "flat_guard", "warn", F.col("file")),
        card(new.filter(~log.isin("skipped_no_profile", "skipped_no_body_start", "skipped_flat_guard", "skipped_duplicate", "skipped_id_collision")), "extract_error", "err", F.col("file")),
        card(again.withColumn("_s", worst).join(known, "file", "left_anti"), "manual_file", F.col("_s"), F.col("file")),
        card(again.withColumn("_s", worst).join(known, "file", "left_semi"), "reextract", F.col("_s"), F.col("file")),
        card(rows.filter(done & needs_verify(F.col("verify"), F.col("notes"))), "verify_needed", "warn", one),
        card(rows.filter("remaining > 0"), "summarize_needed", "warn", one),
        card(rows.filter((F.col("verify") == "extract") & (F.col("remaining") == 0) & (F.col("manual") == 0)), "quality_wait", "warn", one),
        card(rows.filter("db = '미반영'"), "db_stale", "warn", one),
        card(rows.filter(done & (F.col("manual") > 0)), "summary_manual", "err", F.col("report_id"), F.sum("manual")),
        card(rows.filter(done & (F.size(manual) > 0)).withColumn("_m", F.size(manual)), "manual", "info", one, F.sum("_m")),
    ]
    if catalogue_stale:
        parts.append(rows.sparkSession.sql("SELECT 'index_stale' AS kind, 'warn' AS severity, '' AS subject, 0L AS n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)
