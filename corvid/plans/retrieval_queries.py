"""Queries of the index, of retrieval and of synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid import config
from corvid.functions import text as T
from corvid.functions.store import built, stored
from corvid.operators import retrieval as R
from corvid.operators import sections as S
from corvid.operators import sync
from corvid.plans.queries import query
from corvid.plans.tables import literal, source, sql_fold, sql_strip, table, values

#: Sections of the flat documents in SQL, as CTEs ``chunk`` and ``sec``.
CHUNKS = f"""WITH RECURSIVE blk AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, b FROM (
    SELECT doc_id, u.i, u.b FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda b, i: {{'i': i, 'b': b}})) AS u FROM documents)) WHERE b <> ''
), walk AS (
  SELECT doc_id, i, 1 AS k, b AS cur FROM blk WHERE i = 1
  UNION ALL
  SELECT w.doc_id, b.i,
    CASE WHEN length({sql_strip("w.cur || chr(10) || chr(10) || b.b")}) > {config.MAX_CHARS} THEN w.k + 1 ELSE w.k END,
    CASE WHEN length({sql_strip("w.cur || chr(10) || chr(10) || b.b")}) > {config.MAX_CHARS} THEN b.b ELSE w.cur || chr(10) || chr(10) || b.b END
  FROM walk w JOIN blk b ON b.doc_id = w.doc_id AND b.i = w.i + 1
), raw AS (SELECT doc_id, k, arg_max(cur, i) AS body FROM walk GROUP BY doc_id, k),
tail AS (SELECT *, max(k) OVER (PARTITION BY doc_id) AS n, length({sql_strip("body")}) AS size FROM raw),
last AS (SELECT doc_id, n, body FROM tail WHERE k = n AND n > 1 AND size < {config.MIN_CHARS}),
chunk AS (
  SELECT t.doc_id, t.k, CASE WHEN l.doc_id IS NOT NULL AND t.k = t.n - 1 THEN t.body || chr(10) || chr(10) || l.body ELSE t.body END AS body,
    CASE WHEN l.doc_id IS NOT NULL THEN t.n - 1 ELSE t.n END AS n
  FROM tail t LEFT JOIN last l USING (doc_id) WHERE NOT (l.doc_id IS NOT NULL AND t.k = t.n)
), sec AS (
  SELECT c.doc_id, c.k AS doc_order, c.doc_id || '_c' || c.k AS section_id, 'reports/' || c.doc_id || '.md' AS filepath, 'Report ' || c.doc_id AS report_title,
    d.lang AS chapter, '구간 ' || c.k AS section,
    CASE WHEN c.n > 1 AND c.k = c.n THEN '' ELSE substr(CASE WHEN contains(c.body, '.') THEN substr(c.body, 1, instr(c.body, '.')) ELSE c.body END, 1, 400) END AS summary,
    c.body, {sql_fold("c.body")} AS body_fold, (2000 + c.doc_id % 25)::VARCHAR AS year, '' AS lead_researcher, d.source AS institution
  FROM chunk c JOIN documents d USING (doc_id)
)
"""


def index(spark, sf_dir):
    return S.index_rows(table(spark, sf_dir, "documents"))


def stored_index(spark, sf_dir):
    """The index as a stored table with the sections' lengths, built once and again when the documents' files change."""
    return built("index", source(spark, sf_dir, "documents"), lambda: index(spark, sf_dir).withColumn("d", R.length()))


def stored_postings(spark, sf_dir, build: bool = True):
    """The index's trigram lists, sorted by trigram in each file, built with it; without ``build`` None if they aren't."""
    make = (lambda: R.postings(stored_index(spark, sf_dir))) if build else None
    return built("postings", source(spark, sf_dir, "documents"), make, order=["gram"])


@query("q_flat_chunks", CHUNKS + "SELECT doc_id, k::INTEGER AS k, body FROM chunk")
def flat_chunks(spark, sf_dir):
    return S.flat_sections(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "k", "body")


@query("q_sections_index", CHUNKS + "SELECT * REPLACE (doc_order::INTEGER AS doc_order) FROM sec")
def sections_index(spark, sf_dir):
    return index(spark, sf_dir)


@query("q_section_sizes", CHUNKS + "SELECT count(*) AS n, median(length(body)) AS median, sum((length(body) > 4000)::INTEGER)::BIGINT AS over_4000, max(length(body))::BIGINT AS longest FROM sec")
def section_sizes(spark, sf_dir):
    size = F.length("body")
    return index(spark, sf_dir).agg(F.count("*").alias("n"), F.median(size).alias("median"), F.sum((size > 4000).cast("long")).alias("over_4000"), F.max(size).cast("long").alias("longest"))


@query("q_report_rollup", CHUNKS + "SELECT filepath, min(report_title) AS report_title, min(year) AS year, count(*) AS sections, sum(CASE WHEN summary <> '' THEN 1 ELSE 0 END)::BIGINT AS summarised FROM sec GROUP BY filepath")
def report_rollup(spark, sf_dir):
    return S.report_rollup(index(spark, sf_dir))


@query("q_toc", CHUNKS + "SELECT filepath, doc_order::INTEGER AS doc_order, section_id, chapter, section, length(body)::BIGINT AS chars FROM sec")
def toc(spark, sf_dir):
    return S.contents(index(spark, sf_dir))


@query("q_adjacent", CHUNKS + "SELECT section_id, lag(section_id) OVER w AS previous, lead(section_id) OVER w AS next FROM sec WINDOW w AS (PARTITION BY filepath ORDER BY doc_order)")
def adjacent(spark, sf_dir):
    return S.adjacent(index(spark, sf_dir))


@query("q_section_lookup", CHUNKS + "SELECT * REPLACE (doc_order::INTEGER AS doc_order) FROM sec WHERE section_id = '5_c1'")
def section_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id = 5")  # the id names the document: the scan is pruned
    return S.index_rows(docs).filter("section_id = '5_c1'")


@query("q_indexed_files", CHUNKS + "SELECT DISTINCT filepath FROM sec")
def indexed_files(spark, sf_dir):
    return index(spark, sf_dir).select("filepath").distinct()


@query("q_index_count", CHUNKS + "SELECT count(*) AS n FROM sec")
def index_count(spark, sf_dir):
    return index(spark, sf_dir).agg(F.count("*").alias("n"))


VARIANTS = ["nicht", "the of", "Lic ense", "el"]


def _count(col: str, q: str) -> str:
    return f"((length(lower({col})) - length(replace(lower({col}), '{q}', ''))) / {len(q)})"


def bm25_sql(wanted: list[tuple[int, str, str]], limit: int = config.PATH_LIMIT) -> str:
    d = " + ".join(f"greatest(length({c}) - 2, 0)" for c in R.COLUMNS)
    lists = []
    for no, v, path in wanted:
        f = _count("body_fold", "".join(v.split()).lower()) if path == "fold" else "(" + " + ".join(f"{w} * {_count(c, v.lower())}" for c, w in config.WEIGHTS.items()) + ")"
        lists.append(f"SELECT {no} AS list_no, '{v}' AS variant, '{path}' AS path, section_id, ({d})::DOUBLE AS d, ({f})::DOUBLE AS f FROM sec")
    return (
        CHUNKS
        + f""", hit AS (SELECT * FROM ({" UNION ALL ".join(lists)}) WHERE f > 0),
    size AS (SELECT count(*) AS N, avg({d}) AS avg_d FROM sec),
    scored AS (SELECT *, count(*) OVER (PARTITION BY list_no) AS hits FROM hit, size),
    ranked AS (SELECT list_no, variant, path, section_id, f, hits AS n, round(-greatest(ln((N - hits + 0.5) / (hits + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg_d)), 9) AS score FROM scored),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_no ORDER BY score, section_id)::INTEGER AS rank FROM ranked) WHERE rank <= {limit})
    """
    )


PLAIN = [(0, "nicht", "plain"), (1, "the of", "plain"), (2, "Lic ense", "plain")]
LISTS = [*PLAIN, (3, "nicht", "fold"), (4, "the of", "fold"), (5, "Lic ense", "fold")]


@query("q_bm25_plain", bm25_sql([(0, "nicht", "plain")]) + "SELECT section_id, f, n, score, rank FROM bm")
def bm25_plain(spark, sf_dir):
    return R.bm25(stored_index(spark, sf_dir), ["nicht"]).filter("path = 'plain'").select("section_id", "f", "n", "score", "rank")


@query("q_bm25_fold", bm25_sql([(0, "the of", "fold")]) + "SELECT section_id, f, n, score, rank FROM bm")
def bm25_fold(spark, sf_dir):
    return R.bm25(stored_index(spark, sf_dir), ["the of"]).filter("path = 'fold'").select("section_id", "f", "n", "score", "rank")


@query("q_bm25_weighted", bm25_sql(LISTS) + "SELECT * FROM bm")
def bm25_weighted(spark, sf_dir):
    return R.bm25(stored_index(spark, sf_dir), VARIANTS)


@query("q_variant_counts", bm25_sql(LISTS, 10**9) + "SELECT variant, path, max(n) AS hits FROM bm GROUP BY variant, path")
def variant_counts(spark, sf_dir):
    return R.bm25(stored_index(spark, sf_dir), VARIANTS).groupBy("variant", "path").agg(F.max("n").alias("hits"))


ADMIT = values("v", ("el",), ("a b",), ("ab c",), ("abc",), ("   ",), ("공유",), ("공 유 지",))


@query("q_variant_admission", f"SELECT v, (length({sql_strip('v')}) > 0 AND (length(v) >= 3 OR length({sql_fold('v')}) >= 3)) AS admitted FROM {ADMIT}")
def variant_admission(spark, sf_dir):
    rows = literal(spark, ADMIT)
    return rows.select("v", ((F.length(T.strip("v")) > 0) & ((F.length("v") >= 3) | (F.length(T.fold("v")) >= 3))).alias("admitted"))


def fused(spark, sf_dir, penalty: bool):
    rows = stored_index(spark, sf_dir)
    return R.rrf(R.bm25(rows, VARIANTS), rows.filter("summary = ''").select("section_id") if penalty else None)


RRF_SQL = bm25_sql(LISTS) + """, fz AS (SELECT section_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(list_no * 1000 + rank) AS seen FROM bm GROUP BY section_id)"""


@query("q_rrf", RRF_SQL + "SELECT section_id, round(s, 9) AS score, row_number() OVER (ORDER BY round(s, 9) DESC, seen, section_id)::INTEGER AS position FROM fz")
def rrf(spark, sf_dir):
    return fused(spark, sf_dir, False)


PENALTY = RRF_SQL + ", pz AS (SELECT section_id, round(s * CASE WHEN sec.summary = '' THEN 0.3 ELSE 1 END, 9) AS score, seen FROM fz JOIN sec USING (section_id)) SELECT section_id, score, row_number() OVER (ORDER BY score DESC, seen, section_id)::INTEGER AS position FROM pz"


@query("q_rrf_penalty", PENALTY)
def rrf_penalty(spark, sf_dir):
    return fused(spark, sf_dir, True)


@query("q_top_n", f"SELECT * FROM ({PENALTY}) WHERE position <= 8")
def top_n(spark, sf_dir):
    return fused(spark, sf_dir, True).filter(F.col("position") <= config.TOP_SECTIONS)


CANDIDATES_SQL = CHUNKS + """, al AS (SELECT section_id, lower(report_title || chr(1) || chapter || chr(1) || section || chr(1) || summary || chr(1) || body || chr(1) || body_fold || chr(1) || lead_researcher || chr(1) || institution) AS t FROM sec) """


def _grams(phrase: str) -> str:
    return " AND ".join(f"contains(t, '{g}')" for g in R.trigrams(phrase))


@query("q_postings_candidates", CANDIDATES_SQL + f"SELECT section_id FROM al WHERE ({_grams('nicht')}) OR ({_grams('theof')})")
def postings_candidates(spark, sf_dir):
    return R.candidates(stored_postings(spark, sf_dir), ["nicht", "theof"])


@query("q_bm25_postings", bm25_sql(LISTS) + "SELECT * FROM bm")
def bm25_postings(spark, sf_dir):
    """The same as q_bm25_weighted, through the lists of the phrases' trigrams."""
    return R.bm25(stored_index(spark, sf_dir), VARIANTS, lists=stored_postings(spark, sf_dir))


@query("q_snippet", CHUNKS + """, h AS (SELECT section_id, body, instr(lower(body), 'nicht') AS p FROM sec), w AS (SELECT *, greatest(p - 8, 1) AS s, least(p + 13, length(body) + 1) AS e FROM h WHERE p > 0)
  SELECT section_id, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(body, s, p - s) || '[' || substr(body, p, 5) || ']' || substr(body, p + 5, e - p - 5) || CASE WHEN e <= length(body) THEN '…' ELSE '' END AS snippet FROM w""")
def snippet(spark, sf_dir):
    return stored_index(spark, sf_dir).select("section_id", R.snippet(F.col("body"), "nicht").alias("snippet")).filter("snippet is not null")


@query("q_get_body", CHUNKS + f""", w AS (SELECT *, lag(body) OVER o AS pb, lead(body) OVER o AS nb FROM sec WINDOW o AS (PARTITION BY filepath ORDER BY doc_order)),
  r AS (SELECT section_id, unnest(['full', 'prev', 'next', 'over']) AS mode, body, pb, nb FROM w),
  t AS (SELECT *, CASE mode WHEN 'full' THEN body WHEN 'prev' THEN pb WHEN 'next' THEN nb END AS b FROM r)
  SELECT section_id || mode AS id, section_id, mode, CASE WHEN mode = 'full' OR length(b) <= 8000 THEN b ELSE CASE WHEN 8000 - instr(reverse(substr(b, 1, 8000)), chr(10)) > 4000 AND contains(substr(b, 1, 8000), chr(10)) THEN substr(b, 1, 8000 - instr(reverse(substr(b, 1, 8000)), chr(10))) ELSE substr(b, 1, 8000) END || chr(10) || '{config.MARK_TAIL}' END AS evidence FROM t""")
def get_body(spark, sf_dir):
    """Every section asked for in full and for its neighbours; a mode that doesn't exist has no evidence."""
    rows = stored_index(spark, sf_dir)
    modes = F.explode(F.array(*map(F.lit, ("full", "prev", "next", "over"))))
    asked = rows.select("section_id", modes.alias("mode"))
    return R.body(rows, asked.withColumn("id", F.concat("section_id", "mode")))


@query("q_render_units", CHUNKS + """SELECT section_id, '### [' || section_id || '] ' || report_title || ' (' || year || ') — report_id: ' || doc_id || chr(10) || '위치: ' || chapter || ' > ' || section || chr(10)
  || CASE WHEN summary <> '' THEN '요약(맥락 파악용 — 인용 금지): ' || summary || chr(10) ELSE '' END || '본문:' || chr(10) || body AS text FROM sec""")
def render_units(spark, sf_dir):
    return R.rendered(stored_index(spark, sf_dir).withColumn("evidence", F.col("body")))


@query("q_search_evidence")
def search_evidence(spark, sf_dir):
    """The whole question-to-evidence plan: variants, two paths, fusion, the best eight, their evidence."""
    rows = stored_index(spark, sf_dir)
    best = R.rrf(R.search(rows, VARIANTS, lambda: stored_postings(spark, sf_dir, build=False)), rows.filter("summary = ''").select("section_id")).filter(F.col("position") <= config.TOP_SECTIONS)
    return R.deliver(rows.join(F.broadcast(best.select("section_id", "position")), "section_id"), VARIANTS).join(F.broadcast(best), "section_id")


SPAN_SQL = """SELECT doc_id, s, s + 4 AS e FROM (SELECT doc_id, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 4) = ' the'))::INTEGER AS s FROM documents)"""


@query("q_find_spans", SPAN_SQL)
def find_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter(F.col("text").contains(" the")).select("doc_id", F.explode(R.spans(F.col("text"), " the")).alias("x")).select("doc_id", "x.s", "x.e")


#: Documents by words of two letters with any white space in between: 'e' and 't' as letters of a folded word.
@query("q_fold_spans", f"""WITH c AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, ''), lambda x, i: {{'x': x, 'i': i - 1}}), lambda c: {sql_fold('c.x')} <> '') AS c FROM documents),
  p AS (SELECT doc_id, unnest(list_filter(range(1, len(c) - 5), lambda k: c[k].x = 'n' AND c[k + 1].x = 'a' AND c[k + 2].x = 't' AND c[k + 3].x = 't' AND c[k + 4].x = 'h' AND c[k + 5].x = 'e')) AS k, c, text FROM c WHERE NOT contains(text, 'nat the'))
  SELECT doc_id, c[k].i::INTEGER AS s, (c[k + 5].i + 1)::INTEGER AS e FROM p""")
def fold_spans(spark, sf_dir):
    """Where the letters stand with any white space between them, in documents that lack the phrase itself."""
    docs = table(spark, sf_dir, "documents").filter(~F.col("text").contains("nat the") & T.fold("text").contains("natthe"))
    return docs.select("doc_id", F.explode(R.spans(F.col("text"), "nat the")).alias("x")).select("doc_id", "x.s", "x.e")


WINDOW_SQL = """
WITH sp AS (SELECT doc_id, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 5) = ' that')) AS p, length(text) AS n FROM documents),
wi AS (SELECT doc_id, greatest(p - 100, 0) AS s, least(p + 105, n) AS e FROM sp),
isl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM wi),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS w FROM isl),
mer AS (SELECT doc_id, w, min(s) AS s, max(e) AS e FROM num GROUP BY doc_id, w HAVING w <= 3),
bud AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY doc_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM mer),
cut AS (SELECT doc_id, w, s, least(e, s + 500 - used) AS e FROM bud WHERE used < 500)
SELECT c.doc_id, CASE WHEN min(s) > 0 THEN '…(전략)…' || chr(10) ELSE '' END || string_agg(substr(d.text, (s + 1)::INTEGER, (e - s)::INTEGER), chr(10) || '…(중략)…' || chr(10) ORDER BY w)
  || CASE WHEN max(e) < max(length(d.text)) THEN chr(10) || '…(후략)…' ELSE '' END AS evidence
FROM cut c JOIN documents d USING (doc_id) GROUP BY c.doc_id
"""


@query("q_cut_windows", WINDOW_SQL)
def cut_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.col("text").contains(" that")).select(F.col("doc_id").alias("section_id"), F.col("text").alias("body"))
    return R.cut_windows(rows, [" that"], radius=100, most=3, budget=500).withColumnRenamed("section_id", "doc_id")


@query("q_head_cut", """SELECT doc_id, CASE WHEN contains(c, chr(10)) AND 8000 - instr(reverse(c), chr(10)) > 4000 THEN substr(c, 1, length(c) - instr(reverse(c), chr(10))) ELSE c END || chr(10) || '…(후략)…' AS cut
  FROM (SELECT doc_id, substr(text, 1, 8000) AS c FROM documents WHERE length(text) > 8000)""")
def head_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") > config.BODY_CHARS).select("doc_id", R.head_cut(F.col("text")).alias("cut"))


ANSWERS = values("id, answer", (1, "근거: 12_c1, 12_c2s3에서 확인"), (2, "보고서2018-54_c3s1과 99_c9"), (3, "출처 없음"), (4, "(7_c1)(7_c1)"))
DELIVERED = values("id, section_id", (1, "12_c1"), (1, "12_c3"), (2, "99_c9"), (4, "7_c1"))
CITED_SQL = f"WITH c AS (SELECT id, unnest(list_distinct(regexp_extract_all(answer, '[\\pL\\pN_-]+_c[0-9]+(?:s[0-9]+)*'))) AS section_id FROM {ANSWERS}) "


@query("q_citation_audit", CITED_SQL + f"SELECT c.id, c.section_id, d.id IS NOT NULL AS delivered FROM c LEFT JOIN {DELIVERED} d ON d.id = c.id AND d.section_id = c.section_id")
def citation_audit(spark, sf_dir):
    return R.audit(R.citations(literal(spark, ANSWERS)), literal(spark, DELIVERED))


@query("q_sources_semi", CITED_SQL + f"SELECT c.id, c.section_id FROM c SEMI JOIN {DELIVERED} d ON d.id = c.id AND d.section_id = c.section_id")
def sources_semi(spark, sf_dir):
    return R.citations(literal(spark, ANSWERS)).join(literal(spark, DELIVERED), ["id", "section_id"], "left_semi")


@query("q_answer_citations", "SELECT conv_id AS id, turn, len(list_distinct(regexp_extract_all(text, '[\\pL\\pN_-]+_c[0-9]+(?:s[0-9]+)*')))::INTEGER AS cited FROM conversations WHERE role = 'assistant'")
def answer_citations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.select(F.col("conv_id").alias("id"), "turn", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(config.SECTION_ID), F.lit(0)))).alias("cited"))


SESSION = values("section_id, rank", ("1_c1", 1), ("2_c1", 2), ("3_c1", 3))
CHOSEN = values("section_id, filepath, rank", ("2_c1", "b", 1), ("4_c1", "d", 2), ("2_c1", "b", 3))
SEEN = values("filepath", ("b",), ("d",))


@query("q_select_sections", f"""WITH l AS (SELECT 0 AS no, section_id, rank FROM {SESSION} UNION ALL SELECT 1, section_id, rank FROM {CHOSEN}),
  z AS (SELECT section_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(no * 1000 + rank) AS seen FROM l GROUP BY section_id),
  p AS (SELECT section_id, score, row_number() OVER (ORDER BY score DESC, seen)::INTEGER AS position FROM z)
  SELECT * FROM p WHERE section_id IN (SELECT section_id FROM {CHOSEN})""")
def select_sections(spark, sf_dir):
    return R.select_sections(literal(spark, SESSION), literal(spark, CHOSEN), literal(spark, SEEN))


# --- synchronisation ----------------------------------------------------------------------------------------------


def files(spark, sf_dir):
    """Current files: their hash, and complete if the labels' stamp is there."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.format_string("reports/%d.md", "doc_id").alias("filepath"), T.digest("text").alias("content_hash"), F.col("quality"), (F.col("quality") == 1).alias("complete")
    )


def old_ledger(spark, sf_dir):
    """A ledger of an earlier state: the labelled documents, the poor ones with another content, and the benchmark's
    items, of which no file is left."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("least"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id")
    known = docs.select(F.format_string("reports/%d.md", "doc_id").alias("filepath"), F.when(F.col("least") == 0, F.concat(F.lit("old"), (F.col("doc_id") % 2).cast("string"))).otherwise(T.digest("text")).alias("content_hash"))
    gone = table(spark, sf_dir, "benchmark").select(F.format_string("reports/b%d.md", "item_id").alias("filepath"), T.digest("text").alias("content_hash"))
    return known.unionByName(gone)


FILES_SQL = """WITH lab AS (SELECT doc_id, max(quality) AS quality, min(quality) AS least FROM labels GROUP BY doc_id),
cur AS (SELECT 'reports/' || d.doc_id || '.md' AS filepath, sha256(d.text) AS content_hash, quality = 1 AS complete FROM documents d LEFT JOIN lab USING (doc_id)),
old AS (SELECT 'reports/' || doc_id || '.md' AS filepath, CASE WHEN least = 0 THEN 'old' || doc_id % 2 ELSE sha256(text) END AS content_hash FROM documents JOIN lab USING (doc_id) UNION ALL SELECT 'reports/b' || item_id || '.md', sha256(text) FROM benchmark),
dif AS (SELECT filepath, CASE WHEN c.content_hash IS NULL THEN 'removed' WHEN o.content_hash = c.content_hash THEN 'synced' WHEN NOT coalesce(c.complete, false) THEN 'gated' ELSE 'updated' END AS state
  FROM old o FULL JOIN cur c USING (filepath)) """


@query("q_sync_diff", FILES_SQL + "SELECT * FROM dif")
def sync_diff(spark, sf_dir):
    return sync.diff(old_ledger(spark, sf_dir), files(spark, sf_dir))


@query("q_sync_apply", FILES_SQL + "SELECT old.* FROM old SEMI JOIN (SELECT * FROM dif WHERE state = 'synced') USING (filepath) UNION ALL SELECT filepath, content_hash FROM cur SEMI JOIN (SELECT * FROM dif WHERE state = 'updated') USING (filepath)")
def sync_apply(spark, sf_dir):
    return sync.apply(old_ledger(spark, sf_dir), files(spark, sf_dir))


@query("q_stale_orphans", FILES_SQL + "SELECT state, count(*) AS n FROM dif GROUP BY state")
def stale_orphans(spark, sf_dir):
    return sync.diff(old_ledger(spark, sf_dir), files(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query("q_freshness_gate", FILES_SQL + "SELECT filepath, CASE WHEN c.content_hash IS NULL THEN 'orphan' ELSE 'stale' END AS state FROM old o FULL JOIN cur c USING (filepath) WHERE c.content_hash IS NULL OR o.content_hash IS DISTINCT FROM c.content_hash")
def freshness_gate(spark, sf_dir):
    return sync.gate(old_ledger(spark, sf_dir), files(spark, sf_dir))


@query("q_rebuild_equivalence", FILES_SQL + "SELECT count(*) AS rebuilt, 0::BIGINT AS missing, 0::BIGINT AS surplus FROM cur WHERE complete")
def rebuild_equivalence(spark, sf_dir):
    """Synchronising step by step leads to the ledger that a rebuild makes: from nothing, from an earlier state with
    all files complete, and again with nothing to do."""
    now = files(spark, sf_dir)
    empty = now.select("filepath", "content_hash").limit(0)
    rebuilt = stored(sync.apply(empty, now))
    earlier = stored(sync.apply(old_ledger(spark, sf_dir), now))
    # what was synced before is not looked at again, so its stamps may be gone: the gate of a rebuild takes it out
    step = sync.apply(earlier, now).join(now.filter("complete").select("filepath"), "filepath", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(rebuilt, "rebuilt").crossJoin(count(rebuilt.exceptAll(step), "missing")).crossJoin(count(step.exceptAll(rebuilt), "surplus"))


STAMPED = """WITH s AS (SELECT d.doc_id, '2026-01-01' AS verified_register, CASE WHEN l.doc_id IS NOT NULL THEN '2026-01-02' ELSE '' END AS verified_extract,
  CASE WHEN l.quality = 1 THEN '2026-01-03' ELSE '' END AS verified_annotate, d.source, d.text FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)) """


def stamped(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select("doc_id", "source", "text", F.lit("2026-01-01").alias("verified_register"), F.when(F.col("quality").isNotNull(), "2026-01-02").otherwise("").alias("verified_extract"), F.when(F.col("quality") == 1, "2026-01-03").otherwise("").alias("verified_annotate"))


@query("q_missing_stamps", STAMPED + "SELECT doc_id, list_filter([CASE WHEN verified_extract = '' THEN 'verified_extract' END, CASE WHEN verified_annotate = '' THEN 'verified_annotate' END], lambda x: x IS NOT NULL) AS missing FROM s")
def missing_stamps(spark, sf_dir):
    return stamped(spark, sf_dir).select("doc_id", sync.missing_stamps().alias("missing"))


@query("q_gate_stamps", STAMPED + "SELECT doc_id FROM s WHERE verified_extract <> '' AND verified_annotate <> ''")
def gate_stamps(spark, sf_dir):
    return stamped(spark, sf_dir).filter(F.size(sync.missing_stamps()) == 0).select("doc_id")


LADDER = values("id, verified_register, verified_extract, verified_annotate", *[(k, "d" if k & 1 else "", "d" if k & 2 else "", "d" if k & 4 else "") for k in range(8)])


@query("q_stamp_ladder", f"""SELECT id, list_filter([CASE WHEN verified_extract <> '' AND verified_register = '' THEN 'verified_extract' END,
  CASE WHEN verified_annotate <> '' AND (verified_register = '' OR verified_extract = '') THEN 'verified_annotate' END], lambda x: x IS NOT NULL) AS breaks FROM {LADDER}""")
def stamp_ladder(spark, sf_dir):
    return literal(spark, LADDER).select("id", sync.ladder_breaks().alias("breaks"))


@query("q_catalog", STAMPED + """SELECT 'reports/' || doc_id || '.md' AS filepath, '## Report ' || doc_id || chr(10) || '- 파일: reports/' || doc_id || '.md' || chr(10) || '- 발간: ' || (2000 + doc_id % 25)
  || chr(10) || '- 연구책임자: ' || source || chr(10) || '- 요약: ' || text AS entry FROM s WHERE verified_extract <> '' AND verified_annotate <> ''""")
def catalog(spark, sf_dir):
    rows = stamped(spark, sf_dir).select("*", F.format_string("Report %d", "doc_id").alias("title"), F.format_string("reports/%d.md", "doc_id").alias("filepath"), (F.lit(2000) + F.col("doc_id") % 25).cast("string").alias("year"), F.col("source").alias("lead_researcher"), F.col("text").alias("summary"))
    return sync.catalogue(rows)
