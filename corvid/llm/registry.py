"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from corvid.llm import bpe, digest, licenses, lines, mixing, paragraphs, quality, sharding, simhash, suffixes
from corvid.llm.common import documents


def op1_line_dedup(spark, sf_dir):
    """Later copies of repeated line runs per document."""
    return lines.report(documents(spark, sf_dir))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS line, u.x FROM (
    SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM documents)
), s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), w AS (
  SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY seq) AS y FROM s
), r AS (
  SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, seq) AS k FROM w WHERE y IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, seq FROM (SELECT doc_id, seq FROM r WHERE k > 1 UNION ALL SELECT doc_id, seq + 1 FROM r WHERE k > 1)
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (d) AS n_runs
  FROM (SELECT doc_id, seq - lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) IS DISTINCT FROM 1 AS d FROM g) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.line) AS t
  FROM l LEFT JOIN s USING (doc_id, line) LEFT JOIN g ON g.doc_id = s.doc_id AND g.seq = s.seq WHERE g.seq IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(runs.n_removed, 0) AS n_removed, coalesce(runs.n_runs, 0) AS n_runs,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) n USING (doc_id)
LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op2_byte_bpe(spark, sf_dir):
    """Encode every whole text with a public byte-level vocabulary and decode it again."""
    import public_tokenizers

    raw = bpe.vocabulary_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(documents(spark, sf_dir), raw, public_tokenizers.PATTERN)


def op3_substring_dedup(spark, sf_dir):
    """Paragraphs and passages that repeat across documents, per document."""
    return paragraphs.report(documents(spark, sf_dir))


def op4_simhash(spark, sf_dir):
    """Near-duplicate classes of all documents by SimHash."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_mixing(spark, sf_dir):
    """Mix all documents: words taken per document, the training position of its first use and its place in order."""
    return mixing.mix(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, [3.0, 1.0, 2.0][((r - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
    [1.5, 0.5, 1.0][((r - 1) % 3 + 1)::INTEGER]::DOUBLE AS w0, [0.5, 1.5, 1.0][((r - 1) % 3 + 1)::INTEGER]::DOUBLE AS w1
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source)
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT *, least(coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level < cap / w) * w, cap), cap) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget, w0, w1,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
), k AS (
  SELECT *, (least(greatest(budget - place, 0), size) + least(greatest(budget - source_size - place, 0), size))::BIGINT AS taken FROM p
)
, o AS (SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN place = 0 THEN 0 ELSE 2 * (place / budget) / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * (place / budget))) END, 6) END AS position
FROM k)
SELECT *, CASE WHEN position IS NOT NULL THEN row_number() OVER (PARTITION BY position IS NULL ORDER BY position, doc_id NULLS FIRST, size) - 1 END AS place FROM o
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM wins) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least(5, coalesce(n - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM twice) GROUP BY doc_id
), l AS (
  SELECT doc_id, source, t, x, trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS y
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), common AS (
  SELECT l.source, y FROM l JOIN (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source) h ON h.source IS NOT DISTINCT FROM l.source
  GROUP BY l.source, y HAVING count(DISTINCT t) >= 10 AND count(DISTINCT t) > 0.10 * max(texts)
), per AS (
  SELECT l.doc_id, count(*) - count(DISTINCT x) AS dup, count(c.y) AS gone, coalesce(sum(CASE WHEN c.y IS NOT NULL THEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) END), 0) AS words
  FROM l LEFT JOIN common c ON c.source IS NOT DISTINCT FROM l.source AND c.y = l.y GROUP BY l.doc_id
), b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone, 0)::BIGINT AS n_removed_lines, (len(ws) - coalesce(words, 0))::BIGINT AS n_left
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_lines > 0 AND (n_left < 10 OR n_left < 0.25 * n_words)) AS kept
FROM b
"""


def op6_quality_rules(spark, sf_dir):
    """Base figures and verdict of the line-frequency rules per document."""
    return quality.judge(documents(spark, sf_dir))


def op7_fingerprints(spark, sf_dir):
    """Improbable-feature digests of all documents and of their edited texts."""
    return digest.compare_edited(documents(spark, sf_dir))


def op8_suffix_array(spark, sf_dir):
    """Remove the bytes of all 200-byte strings that start more than once."""
    return suffixes.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op9_sharding(spark, sf_dir):
    """All documents in 40 shards by balanced label propagation."""
    return sharding.assign(documents(spark, sf_dir)).drop("group")


def op10_license_scan(spark, sf_dir):
    """License texts and notices in all documents."""
    return licenses.scan(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_substring_dedup, op4_simhash, op5_mixing, op6_quality_rules, op7_fingerprints, op8_suffix_array, op9_sharding, op10_license_scan)}
ORACLE: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op6_quality_rules": OP6_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
