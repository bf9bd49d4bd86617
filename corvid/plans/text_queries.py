"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid import config
from corvid.functions import text as T
from corvid.plans.queries import query
from corvid.plans.tables import SQL_SPACE, literal, sql_fold, sql_strip, table, values

_ = SQL_SPACE


@query("q_fold_text", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold("text").alias("folded"))


@query("q_fold_glyph", f"SELECT doc_id, translate({sql_fold('text')}, '{config.GLYPHS}', '') AS folded FROM documents")
def fold_glyph(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_glyphs("text").alias("folded"))


@query("q_canon", "SELECT doc_id, regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g') AS canon FROM documents")
def canon(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.canon("text").alias("canon"))


@query("q_fold_title", f"SELECT doc_id, lower({sql_fold('text')}) AS title FROM documents")
def fold_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_title("text").alias("title"))


CAP = 2000
_HEAD = f"substr(text, 1, {int(CAP * 0.75)})"
TRUNCATE_SQL = f"""
WITH h AS (
  SELECT doc_id, text, CASE WHEN contains({_HEAD}, chr(10)) AND length({_HEAD}) - instr(reverse({_HEAD}), chr(10)) > 0
      THEN substr({_HEAD}, 1, length({_HEAD}) - instr(reverse({_HEAD}), chr(10))) ELSE {_HEAD} END AS head,
    right(text, {CAP - int(CAP * 0.75)}) AS t FROM documents
), p AS (SELECT *, CASE WHEN contains(t, chr(10)) THEN substr(t, instr(t, chr(10)) + 1) ELSE t END AS tail FROM h)
SELECT doc_id, CASE WHEN length(text) <= {CAP} THEN text ELSE head || chr(10) || chr(10) || '[... 중략: 전체 ' || format('{{:,}}', length(text))
  || '자 중 ' || format('{{:,}}', length(text) - length(head) - length(tail)) || '자 생략 ...]' || chr(10) || chr(10) || tail END AS cut FROM p
"""


@query("q_truncate_input", TRUNCATE_SQL)
def truncate_input(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_middle("text", CAP).alias("cut"))


POST_SQL = r"""
WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), '"''“”‘’ ') AS s FROM (SELECT doc_id, regexp_replace(text, '^(?:[-*•>]\s+)+', '') AS text FROM documents)),
b AS (SELECT *, substr(s, 1, 400) AS c FROM a),
p AS (SELECT *, CASE WHEN contains(c, '. ') THEN length(c) - instr(reverse(c), ' .') - 1 ELSE -1 END AS cut_at FROM b)
SELECT doc_id, nullif(CASE WHEN length(s) <= 400 THEN s WHEN cut_at >= 100 THEN rtrim(substr(c, 1, cut_at + 2)) END, '') AS summary FROM p
"""


@query("q_postprocess_summary", POST_SQL)
def postprocess_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tidy_summary("text").alias("summary"))


ROMANS = values("r", *[(x,) for x in ("I", "II", "III", "IV", "V", "VI", "IX", "X", "XI", "XIV", "XIX", "XL", "XLIX", "XC", "C", "MX", "")])


@query(
    "q_roman_to_int",
    f"""SELECT r, coalesce((SELECT sum(CASE WHEN nx > v THEN -v ELSE v END) FROM (
      SELECT i, v, coalesce(lead(v) OVER (ORDER BY i), 0) AS nx FROM (
        SELECT i, CASE substr(r, i, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 ELSE 0 END AS v
        FROM unnest(range(1, length(r) + 1)) AS u(i)))), 0)::INTEGER AS n FROM {ROMANS}""",
)
def roman(spark, sf_dir):
    return literal(spark, ROMANS).select("r", T.roman_to_int("r").alias("n"))


TITLES = values("id, title", (1, "참 고 문 헌"), (2, "[참고문헌]"), (3, "<부록 1>"), (4, "부 록"), (5, "부록. 설문지"), (6, "첨부 자료"), (7, "제1장 서론"), (8, "국내 참고문헌 목록"), (9, "본문 부록"), (10, "붙임"), (11, ""))


@query(
    "q_excluded_title",
    f"SELECT id, contains(c, '참고문헌') OR starts_with(c, '부록') OR starts_with(c, '첨부') AS excluded FROM (SELECT id, regexp_replace(title, '[^0-9A-Za-z가-힣]', '', 'g') AS c FROM {TITLES})",
)
def excluded_title(spark, sf_dir):
    return literal(spark, TITLES).select("id", T.excluded_chapter("title").alias("excluded"))


JOIN_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, x FROM (
    SELECT doc_id, u.i, {sql_strip('u.x')} AS x FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'i': i, 'x': x}})) AS u FROM documents)) WHERE x <> ''
), r AS (
  SELECT doc_id, n, x AS joined FROM f WHERE n = 1
  UNION ALL
  SELECT r.doc_id, f.n, r.joined || CASE WHEN (regexp_matches(r.joined, '[A-Za-z0-9%).]$') AND regexp_matches(f.x, '^[A-Za-z0-9(]'))
    OR (regexp_matches(r.joined, '[가-힣]$') AND regexp_matches(f.x, '^[A-Za-z0-9]')) THEN ' ' ELSE '' END || f.x
  FROM r JOIN f ON f.doc_id = r.doc_id AND f.n = r.n + 1
)
SELECT d.doc_id, coalesce(arg_max(r.joined, r.n), '') AS joined FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""


@query("q_join_fragments", JOIN_SQL)
def join_fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.join_fragments(F.split("text", "\n")).alias("joined"))


@query(
    "q_split_keywords",
    """WITH t AS (SELECT doc_id, regexp_replace(trim(string_split(text, chr(10))[1]), '\\.+$', '') AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN [] WHEN contains(t, ',') THEN list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') ELSE [t] END AS keywords FROM t""",
)
def split_keywords(spark, sf_dir):
    first = F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", T.split_keywords(first).alias("keywords"))


KOREAN = values("id, title", (1, "인공지능 기반 정책연구 보고서"), (2, "탄소중립 이행을 위한 산업구조 개선 방안"), (3, "산업구조 전환과 탄소중립"), (4, "AI 2030"), (5, ""))


@query(
    "q_title_tokens",
    f"SELECT id, list_sort(list_filter(list_distinct(regexp_extract_all(title, '[가-힣]{{3,}}')), lambda x: NOT list_contains({config.TITLE_STOP!r}, x))) AS tokens FROM {KOREAN}",
)
def title_tokens(spark, sf_dir):
    return literal(spark, KOREAN).select("id", T.title_tokens("title").alias("tokens"))


@query("q_sha_ledger", "SELECT 'reports/' || doc_id || '.md' AS filepath, sha256(text) AS content_hash FROM documents")
def sha_ledger(spark, sf_dir):
    from corvid.operators.sync import ledger

    return ledger(table(spark, sf_dir, "documents").select(F.format_string("reports/%d.md", "doc_id").alias("filepath"), F.col("text").alias("content")))


TOKENS = values("token", *[(x,) for x in ("Ⅰ", "Ⅳ", "Ⅻ", "I", "IV", "XII", "3", "12", "가", "x")])


@query(
    "q_chapter_value",
    f"""SELECT token, CASE WHEN regexp_matches(token, '^[Ⅰ-Ⅻ]$') THEN instr('ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ', token)
      WHEN token = 'I' THEN 1 WHEN token = 'IV' THEN 4 WHEN token = 'XII' THEN 12 ELSE try_cast(token AS INTEGER) END::INTEGER AS value,
      instr('가나다라마바사아자차카타파하', token)::INTEGER AS hangul FROM {TOKENS}""",
)
def chapter_value(spark, sf_dir):
    return literal(spark, TOKENS).select("token", T.chapter_value("token").alias("value"), T.hangul_ordinal("token").alias("hangul"))


QUOTED = values("id, v", (1, '"a b"'), (2, "plain"), (3, '"'), (4, '""'), (5, ' "x" '))


@query("q_unquote", f"SELECT id, CASE WHEN length(t) >= 2 AND t LIKE '\"%\"' THEN substr(t, 2, length(t) - 2) ELSE t END AS v FROM (SELECT id, trim(v) AS t FROM {QUOTED})")
def unquote(spark, sf_dir):
    return literal(spark, QUOTED).select("id", T.unquote("v").alias("v"))
