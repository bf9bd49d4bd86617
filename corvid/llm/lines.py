"""Line dedup: repeated runs of lines from a suffix array over line identifiers, built by distributed prefix doubling.

Every line with a word has an identifier (two 64-bit hashes), and a document is the sequence of its lines'
identifiers. Suffixes are ordered by names: the name of the first h lines of a suffix and the name of the h lines
after them make the name of its first 2h lines. Suffixes with equal names are the interval of the suffix array whose
longest common prefix is at least h; what is alone in its interval leaves the doubling, which ends when every suffix
is alone. In each interval the first suffix in order of (doc_id, line) is the original and the others are copies; a
suffix keeps the deepest interval in which it is a copy. Where the prefixes of copies touch or overlap they are one
maximal run, and its lines are deleted. With ``single``, later copies of single lines of at least so many words are
deleted, too, whatever stands around them.

Defined cases: a null text is empty; lines without a word are never deleted and don't interrupt a run; a null
doc_id comes last; of ties (equal doc_id) the document with the smaller hash is first; rows repeated in full are one
document and get the same result; documents of which every line with a word is deleted are dropped by ``dedup``; a
very long text is one sequence like any other, its lines being rows; an empty table gives an empty result; extra
columns, whatever their names, are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import checked_broadcast, joined_where, n_words, packed, release, scratch

LEAST = 2
#: Suffixes of an interval above which its first one is broadcast to them (so there are at most rows / HOT of these).
HOT = 100_000
A_WORD = r"[^\x20\x09-\x0D]"


def with_key(docs: DataFrame) -> DataFrame:
    name = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    return docs.withColumn("_key", F.unhex(F.md5(name.cast("binary"))))


def line_table(docs: DataFrame, single: int | None = None) -> DataFrame:
    """Rows (_key, _doc, line, seq, a, b): lines with a word, ``seq`` counting them and ``line`` all lines; with
    ``single`` also _alone, whether the line has that many words."""
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    rows = with_key(docs).select("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), F.filter(split, lambda s: s["x"].rlike(A_WORD)).alias("_lines"))
    rows = rows.select("_key", "_doc", F.posexplode("_lines").alias("seq", "_l"))
    alone = [] if single is None else [(n_words(F.col("_l.x")) >= single).alias("_alone")]
    return rows.select("_key", "_doc", F.col("_l.line").alias("line"), "seq", F.xxhash64("_l.x").alias("a"), F.xxhash64(F.lit("2"), "_l.x").alias("b"), *alone)


def intervals(names: DataFrame) -> DataFrame:
    """The suffixes (_key, _doc, seq, a, b) that aren't alone in their interval, with ``copy``, whether another is first.

    An interval's first suffix is found by partial aggregation and joined back; to the suffixes of a large interval
    it is broadcast, so that they never meet in one task.
    """
    of = scratch(names.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min(F.struct("_doc", "_key", "seq")).alias("_first")).filter("_n > 1"), "intervals")
    large = of.filter(F.col("_n") > HOT).drop("_n")
    if large.isEmpty():
        found = names.join(of.drop("_n"), ["a", "b"])
    else:
        large = checked_broadcast(large)
        rest = names.join(large, ["a", "b"], "left_anti").join(of.filter(F.col("_n") <= HOT).drop("_n"), ["a", "b"])
        found = names.join(large, ["a", "b"]).unionByName(rest)
    return found.select("_key", "_doc", "seq", "a", "b", (F.struct("_doc", "_key", "seq") > F.col("_first")).alias("copy"))


def longer(rows: DataFrame, shift: int) -> DataFrame:
    """Names of each suffix's lines and the lines from ``shift`` on, as one."""
    later = rows.select("_key", (F.col("seq") - shift).alias("seq"), F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    both = rows.join(later, ["_key", "seq"])
    return both.select("_key", "_doc", "seq", F.xxhash64("a", "b", "_a", "_b").alias("a"), F.xxhash64(F.lit("2"), "_b", "b", "_a", "a").alias("b"))


def copies(lines: DataFrame, least: int) -> DataFrame:
    """Rows (_key, seq, length): suffixes of which the first ``length`` lines are a copy, by the intervals of common
    prefixes of ``least`` lines, twice as many, four times as many and so on to the end."""
    names, h, found = scratch(intervals(lines.select("_key", "_doc", "seq", "a", "b")), "suffixes"), 1, []
    while h < least:
        shift = min(h, least - h)
        names, h = scratch(intervals(longer(names, shift)), "suffixes"), h + shift
    while not names.isEmpty():
        found.append(names.filter("copy").select("_key", "seq", F.lit(h).alias("length")))
        names, h = scratch(intervals(longer(names, h)), "suffixes"), 2 * h
    out = names.select("_key", "seq", F.lit(0).alias("length"))
    for rows in found:
        out = out.union(rows)
    return out


def deletions(docs: DataFrame, least: int = LEAST, single: int | None = None) -> DataFrame:
    """Rows (_key, _gone): the numbers of the lines to delete, ascending."""
    lines = scratch(line_table(docs, single), "lines")
    found = copies(lines, least)
    if single is not None:
        found = found.union(intervals(lines.filter("_alone").select("_key", "_doc", "seq", "a", "b")).filter("copy").select("_key", "seq", F.lit(1).alias("length")))
    found = scratch(found, "copies")
    # per document the copies' reach so far, in order: lines within it are in a maximal run
    marks = lines.join(checked_broadcast(found.select("_key").distinct()), "_key", "left_semi").select("_key", "seq", "line", F.lit(0).alias("length")).union(found.select("_key", "seq", F.lit(None).cast("int").alias("line"), "length"))
    so_far = Window.partitionBy("_key").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = marks.withColumn("_reach", F.max(F.col("seq") + F.col("length")).over(so_far)).filter("line is not null and _reach > seq")
    return reach.groupBy("_key").agg(F.sort_array(F.collect_set("line")).alias("_gone"))


def marked(docs: DataFrame, least: int = LEAST, single: int | None = None) -> DataFrame:
    """``docs`` with _gone."""
    return joined_where(with_key(docs), scratch(deletions(docs, least, single), "deletions"), "_key").drop("_key")


def without(text: str, gone: list[int]) -> str:
    if not gone:
        return text
    out = set(gone)
    return "\n".join([x for k, x in enumerate(text.split("\n")) if k not in out])


def dedup(docs: DataFrame, least: int = LEAST, single: int | None = None) -> DataFrame:
    """``docs`` without later copies of runs of at least ``least`` lines and, with ``single``, of lines of so many
    words, and without documents left without words."""
    slim, columns = packed(docs, "doc_id", "text")
    rows = marked(slim, least, single)
    names = slim.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = b.column(names.index("text")).to_pylist(), b.column("_gone").to_pylist()
            new = [without(t, g) if g else t for t, g in zip(texts, gone)]
            keep = pa.array([not g or bool(n.split()) for n, g in zip(new, gone)], pa.bool_())
            columns = [pa.array(new, pa.string()) if n == "text" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)
        release()

    return rows.select(*names, "_gone").mapInArrow(run, slim.schema).select(*columns)


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_removed, n_runs, kept_sha256 of the remaining text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, g in zip(*(c.to_pylist() for c in b.columns)):
                t, g = t or "", g or []
                words = [k for k, x in enumerate(t.split("\n")) if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
                place = {k: n for n, k in enumerate(words)}
                at = [place[k] for k in g]
                runs = sum(1 for k, p in enumerate(at) if not k or p != at[k - 1] + 1)
                out.append((i, len(words), len(g), runs, hashlib.sha256(without(t, g).encode()).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    rows = marked(docs.select("doc_id", "text"), least).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_gone")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string")
