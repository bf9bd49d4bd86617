"""Indexing units: greedy chunks of flat documents, heading trees of structured ones, and the index rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvid import config
from corvid.functions import text as T
from corvid.functions.store import stored


def chunks(blocks: Column, most: int = config.MAX_CHARS, least: int = config.MIN_CHARS) -> Column:
    """Blocks joined by blank lines into chunks: a block that would pass ``most`` starts a new chunk, unless it is
    the first; a last chunk under ``least`` joins the one before. Sizes are of the stripped text."""
    state = "struct<done:array<string>,open:string>"
    joined = lambda a, b: F.concat(a, F.lit("\n\n"), b)

    def add(acc, block):
        longer = joined(acc["open"], block)
        full = (F.length(longer) > most) & (F.length(T.strip(longer)) > most)
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), block.alias("open")))
            .when(full, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), block.alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), longer.alias("open")))
        )

    def end(acc):
        done, last = acc["done"], acc["open"]
        n = F.size(done)
        merged = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(joined(F.element_at(done, -1), last)))
        return F.when(last == "", done).when((n > 0) & (F.length(T.strip(last)) < least), merged).otherwise(F.concat(done, F.array(last)))

    return F.aggregate(blocks, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")).cast(state), add, end)


def cut(text: str, most: int = config.MAX_CHARS, least: int = config.MIN_CHARS) -> list[str]:
    """``chunks`` of a text's lines that aren't empty. An open chunk's blocks are joined once, when it ends: what
    is measured is their size so far, less the white space at both ends."""
    done, held, size = [], [], 0
    for block in text.split("\n"):
        if not block:
            continue
        longer = size + 2 + len(block)
        if held and longer > most and len("\n\n".join([*held, block]).strip()) > most:
            done.append("\n\n".join(held))
            held, size = [block], len(block)
        else:
            size = longer if held else len(block)
            held.append(block)
    last = "\n\n".join(held)
    if done and len(last.strip()) < least:
        done[-1] += "\n\n" + last
    elif held:
        done.append(last)
    return done


#: Documents whose sections a worker holds at a time.
AT_ONCE = 500


def flat_sections(docs: DataFrame, folded: bool = False) -> DataFrame:
    """Rows (doc_id, k, n, section_id, body) of the documents' chunks; every line that isn't empty is a block. With
    ``folded`` also body_fold, the body without white space (Python's, as ``T.fold`` has it).

    Arrow batches: as a fold of columns every block copies its chunk, and patterns go over every character.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]

    def cut_all(batches):
        for whole in batches:
            for part in (whole.slice(k, AT_ONCE) for k in range(0, whole.num_rows, AT_ONCE)):
                found = [cut(t or "") for t in part.column("text").to_pylist()]
                rows = part.drop_columns(["text"]).take(pa.array([r for r, c in enumerate(found) for _ in c], pa.int32()))
                body = [b for c in found for b in c]
                new = {"n": pa.array([len(c) for c in found for _ in c], pa.int32()), "body": pa.array(body, pa.string()), "k": pa.array([k for c in found for k in range(1, len(c) + 1)], pa.int32())}
                if folded:
                    new["body_fold"] = pa.array(["".join(b.split()) for b in body], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, *new.values()], [*rows.schema.names, *new])

    kinds = StructType(others[:]).add("n", "integer").add("body", "string").add("k", "integer")
    rows = docs.select(*(F.col(f"`{f.name}`") for f in others), "text").mapInArrow(cut_all, kinds.add("body_fold", "string") if folded else kinds)
    return rows.withColumn("section_id", F.format_string("%d_c%d", "doc_id", "k"))


def first_sentence(body: Column) -> Column:
    """Stand-in for a written summary: up to the first full stop, at most 400 characters."""
    at = F.locate(".", body)
    return F.substring(F.when(at > 0, F.substring(body, F.lit(1), at)).otherwise(body), 1, config.SUMMARY_CHARS)


def index_rows(docs: DataFrame) -> DataFrame:
    """Index rows of flat documents. The last of several chunks stands in for an appendix: it has no summary."""
    rows = flat_sections(docs.select("doc_id", "lang", "source", "text"), folded=True)
    appendix = (F.col("n") > 1) & (F.col("k") == F.col("n"))
    return rows.select(
        "doc_id",
        F.col("k").alias("doc_order"),
        "section_id",
        F.format_string("reports/%d.md", "doc_id").alias("filepath"),
        F.format_string("Report %d", "doc_id").alias("report_title"),
        F.col("lang").alias("chapter"),
        F.format_string("구간 %d", "k").alias("section"),
        F.when(appendix, F.lit("")).otherwise(first_sentence(F.col("body"))).alias("summary"),
        "body",
        "body_fold",
        (F.lit(2000) + F.col("doc_id") % 25).cast("string").alias("year"),
        F.lit("").alias("lead_researcher"),
        F.col("source").alias("institution"),
    )


def report_rollup(rows: DataFrame) -> DataFrame:
    """Rows (filepath, report_title, year, sections, summarised)."""
    return rows.groupBy("filepath").agg(F.min("report_title").alias("report_title"), F.min("year").alias("year"), F.count("*").alias("sections"), F.sum((F.col("summary") != "").cast("long")).alias("summarised"))


def contents(rows: DataFrame) -> DataFrame:
    """Table of contents: sections in document order with body sizes."""
    return rows.select("filepath", "doc_order", "section_id", "chapter", "section", F.length("body").cast("long").alias("chars"))


def adjacent(rows: DataFrame) -> DataFrame:
    """Each section's neighbours in its document."""
    w = Window.partitionBy("filepath").orderBy("doc_order")
    return rows.select("section_id", F.lag("section_id").over(w).alias("previous"), F.lead("section_id").over(w).alias("next"))


# --- heading trees -----------------------------------------------------------------------------------------------


def markdown_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line, text) of Markdown ``docs`` (doc_id, text), lines counted from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def headings(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, line, depth, title, hid, body_end, end_line, parent) of the headings after the front matter.

    A heading's own body ends at the next heading, its subtree at the next one of at most its depth; its parent is
    the nearest earlier heading of a smaller depth. Depths are 1 to 4, so three running values do.
    """
    fence = F.when(F.col("text") == "---", F.col("line"))
    doc = Window.partitionBy("doc_id")
    opened = F.max(F.when((F.col("line") == 0) & (F.col("text") == "---"), F.lit(True))).over(doc)
    body = F.when(opened, F.min(F.when(fence > 0, fence)).over(doc)).otherwise(F.lit(-1))
    rows = lines.withColumn("_body", F.coalesce(body, F.lit(-1))).withColumn("_last", F.max("line").over(doc) + 1)
    rows = rows.filter((F.col("line") > F.col("_body")) & F.col("text").rlike(config.HEADING))
    part = lambda k: F.regexp_extract("text", config.HEADING, k)
    rows = rows.select("doc_id", "line", F.length(part(1)).alias("depth"), part(2).alias("title"), part(3).alias("hid"), "_last")
    order = Window.partitionBy("doc_id").orderBy("line")
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, 5):
        rows = rows.withColumn(f"_next{k}", F.min(F.when(F.col("depth") <= k, F.col("line"))).over(after))
        rows = rows.withColumn(f"_up{k}", F.max(F.when(F.col("depth") == k, F.struct("line", "hid"))).over(before))
    end = F.coalesce(*[F.when(F.col("depth") == k, F.col(f"_next{k}")) for k in range(1, 5)], F.col("_last"))
    parent = F.array_max(F.array(*[F.when(F.col("depth") > k, F.col(f"_up{k}")) for k in range(1, 4)]))["hid"]
    return rows.withColumn("body_end", F.coalesce(F.col("_next4"), F.col("_last"))).withColumn("end_line", end).withColumn("parent", parent).select(
        "doc_id", "line", "depth", "title", "hid", "body_end", "end_line", "parent"
    )


def units(docs: DataFrame, least: int = config.MIN_CHARS, most: int = config.MAX_CHARS, heads: DataFrame | None = None) -> DataFrame:
    """Indexing units of Markdown documents: (doc_id, hid, kind, start, end, chars).

    Top down in four passes: an active heading whose subtree fits, or that has no children, is a unit; of others the
    direct body is one (``intro``) and the children become active. Excluded chapters are left out. ``heads``: the
    documents' ``headings``, if they are stored.
    """
    lines = markdown_lines(docs)
    heads = headings(lines) if heads is None else heads
    summary = F.col("text").startswith(config.UNIT_SUMMARY) | F.col("text").startswith(config.REPORT_SUMMARY)
    # each line belongs to the last heading before it
    at = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marks = lines.join(heads.select("doc_id", "line", "hid"), ["doc_id", "line"], "left").withColumn("_own", F.last("hid", True).over(at))
    own = marks.filter(F.col("_own").isNotNull() & F.col("hid").isNull() & ~summary)
    direct = own.groupBy("doc_id", F.col("_own").alias("hid")).agg(F.length(T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n"))).alias("direct"))
    heads = stored(heads.join(direct, ["doc_id", "hid"], "left").withColumn("direct", F.coalesce("direct", F.lit(0))))
    # a heading of depth k and its subtree are the run of headings up to the next one of depth k or less
    so_far = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 5):
        heads = heads.withColumn(f"_run{k}", F.sum((F.col("depth") <= k).cast("int")).over(so_far))
    of = lambda what: F.coalesce(*(F.when(F.col("depth") == k, what.over(Window.partitionBy("doc_id", f"_run{k}"))) for k in range(1, 5)))
    heads = heads.withColumn("sub", of(F.sum("direct"))).withColumn("has_children", of(F.count("*")) > 1)
    heads = stored(heads.drop(*(f"_run{k}" for k in range(1, 5))))
    whole = (F.col("sub") <= most) | ~F.col("has_children")
    active = heads.filter(F.col("parent").isNull() & ~((F.col("depth") == 1) & T.excluded_chapter("title")))
    out = None
    for level in range(4):
        found = active.filter(F.when(whole, F.col("sub") >= least).otherwise(F.col("direct") >= least)).select(
            "doc_id", "hid", F.when(whole, "subtree").otherwise("intro").alias("kind"), F.col("line").alias("start"), F.when(whole, F.col("end_line")).otherwise(F.col("body_end")).alias("end"), F.when(whole, F.col("sub")).otherwise(F.col("direct")).alias("chars")
        )
        out = found if out is None else out.unionByName(found)
        split = active.filter(~whole).select("doc_id", F.col("hid").alias("parent"))
        active = heads.join(split, ["doc_id", "parent"], "left_semi")
    return out


def unit_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (doc_id, hid, text) of spans (doc_id, hid, start, end): the lines after the heading, without summaries
    and without the ids of further headings. Spans don't overlap, so each line has one at most."""
    lines = markdown_lines(docs)
    begun = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    marks = lines.join(spans.select("doc_id", F.col("start").alias("line"), F.struct("hid", "end").alias("_u")), ["doc_id", "line"], "left")
    marks = marks.withColumn("_in", F.last("_u", True).over(begun)).filter(F.col("line") < F.col("_in.end"))
    marks = marks.filter(~(F.col("text").startswith(config.UNIT_SUMMARY) | F.col("text").startswith(config.REPORT_SUMMARY)))
    plain = F.when(F.col("text").rlike(config.HEADING), F.concat(F.regexp_extract("text", config.HEADING, 1), F.lit(" "), F.regexp_extract("text", config.HEADING, 2))).otherwise(F.col("text"))
    rows = marks.select("doc_id", F.col("_in.hid").alias("hid"), "line", plain.alias("text"))
    return rows.groupBy("doc_id", "hid").agg(T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("text"))


def report_rows(docs: DataFrame) -> DataFrame:
    """Index rows (doc_id, doc_order, hid, chapter, section, summary, body, body_fold) of Markdown documents: their
    units, and each excluded chapter as one row without a summary, in order of their headings.

    Documents and headings are read by every step, so they are stored: what makes them isn't run again for each."""
    docs = stored(docs.select("doc_id", "text"))
    base = stored(strip_summaries(docs))
    heads = stored(headings(markdown_lines(base)))
    found = units(base, heads=heads).select("doc_id", "hid", "start", "end", F.lit(False).alias("_out"))
    out = heads.filter((F.col("depth") == 1) & F.col("parent").isNull() & T.excluded_chapter("title"))
    found = stored(found.unionByName(out.select("doc_id", "hid", F.col("line").alias("start"), F.col("end_line").alias("end"), F.lit(True).alias("_out"))))
    rows = found.join(unit_texts(base, found), ["doc_id", "hid"], "left").join(paths(heads).select("doc_id", "hid", "path"), ["doc_id", "hid"])
    rows = rows.join(summaries(docs).select("doc_id", "hid", "summary"), ["doc_id", "hid"], "left")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    rest = F.array_join(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), " > ")
    body = T.text("text")
    return rows.select("doc_id", order.alias("doc_order"), "hid", F.element_at("path", 1).alias("chapter"), rest.alias("section"), F.when(F.col("_out"), "").otherwise(T.text("summary")).alias("summary"), body.alias("body"), T.fold(body).alias("body_fold"))


def paths(heads: DataFrame) -> DataFrame:
    """Rows (doc_id, hid, path): titles from the root, and the ordinal path c{i}s{j}… that ids are built from."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("line"))
    rows = heads.withColumn("_rank", rank)
    level = rows.filter(F.col("parent").isNull()).select("doc_id", "hid", F.array("title").alias("path"), F.format_string("c%d", "_rank").alias("ordinal"))
    out = level
    for _ in range(3):
        up = level.select("doc_id", F.col("hid").alias("parent"), F.col("path").alias("_path"), F.col("ordinal").alias("_ordinal"))
        level = rows.join(up, ["doc_id", "parent"]).select("doc_id", "hid", F.concat("_path", F.array("title")).alias("path"), F.format_string("%ss%d", "_ordinal", "_rank").alias("ordinal"))
        out = out.unionByName(level)
    return out


def strip_summaries(docs: DataFrame) -> DataFrame:
    """Documents without summary lines and the blank line after each."""
    parts = F.split("text", "\n")
    is_summary = lambda x: x.startswith(config.UNIT_SUMMARY) | x.startswith(config.REPORT_SUMMARY)
    kept = F.filter(parts, lambda x, i: ~(is_summary(x) | ((x == "") & (i > 0) & F.coalesce(is_summary(F.get(parts, i - 1)), F.lit(False)))))
    return docs.withColumn("text", F.array_join(kept, "\n"))


def summaries(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, hid, summary, line): the summary two lines after each heading."""
    lines = markdown_lines(docs)
    w = Window.partitionBy("doc_id").orderBy("line")
    heads = headings(lines).select("doc_id", F.col("hid"), (F.col("line") + 2).alias("line"))
    found = lines.withColumn("_blank", F.lag("text").over(w) == "").filter(F.col("text").startswith(config.UNIT_SUMMARY) & F.col("_blank"))
    return found.join(heads, ["doc_id", "line"]).select("doc_id", "hid", F.substring("text", F.lit(len(config.UNIT_SUMMARY) + 1), F.length("text")).alias("summary"), "line")


def insert_summaries(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The inverse of ``strip_summaries`` for unit summaries: each goes below its heading, with a blank line after."""
    lines = markdown_lines(docs)
    heads = headings(lines).join(found.select("doc_id", "hid", "summary"), ["doc_id", "hid"])
    new = heads.select("doc_id", (F.col("line") + F.lit(1.4)).alias("at"), F.concat(F.lit(config.UNIT_SUMMARY), F.col("summary")).alias("text"))
    new = new.unionByName(new.select("doc_id", (F.col("at") + 0.2).alias("at"), F.lit("").alias("text")))
    every = lines.select("doc_id", F.col("line").cast("double").alias("at"), "text").unionByName(new)
    return every.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
