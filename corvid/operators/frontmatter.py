"""Front matter of Markdown reports: checks, verification stamps, reviewed summaries, and the scope of a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid import config
from corvid.functions import text as T
from corvid.operators.registry import STEM

#: Keys that every report has.
KEYS = ["report_id", "title", "title_en", "year", "lead_researcher", "institution", "keywords_ko", "keywords_en", "abstract", "source_pdf"]
REVIEWED = "summary_reviewed:"


def head(text: Column) -> Column:
    """``---`` and the lines of the front matter, each with its line feed; blank without front matter."""
    at = F.locate("\n---\n", F.concat(text, F.lit("\n")), 4)
    return F.when(text.startswith("---\n") & (at > 0), F.substring(text, F.lit(1), at)).otherwise(F.when(text.isNotNull(), ""))


def rest(text: Column) -> Column:
    """What follows ``head``, from the closing fence on."""
    return F.substring(text, F.length(head(text)) + 1, F.length(text))


def raw_value(text: Column, key: str) -> Column:
    """The value of a key as it is written (the last, if it is repeated); null without the key."""
    found = F.regexp_extract_all(head(text), F.lit(f"(?md)^{key}:(.*)$"), F.lit(1))
    return F.when(F.size(found) > 0, T.strip(F.element_at(found, -1)))


def findings(docs: DataFrame) -> DataFrame:
    """Findings (doc_id, finding, detail) of reports (doc_id, stem, text, part_from, part_to, n_parts).

    A page range is checked against the parts where their number is known.
    """
    value = {k: raw_value(F.col("text"), k) for k in (*KEYS, "structure", "pdf_pages")}
    rows = docs.select("doc_id", "stem", "part_from", "part_to", "n_parts", *(v.alias(f"_{k}") for k, v in value.items()))
    missing = F.filter(F.array(*(F.when(F.col(f"_{k}").isNull(), k) for k in KEYS)), lambda x: x.isNotNull())
    rid, year = T.unquote(T.text("_report_id")), T.text("_year")
    standard = F.regexp_extract("stem", STEM, 1) != ""
    expected = F.when(F.col("stem").startswith("0000"), "").otherwise(F.substring("stem", 1, 4))
    span = F.format_string('"%d-%d"', F.col("part_from") + 1, F.col("part_to") + 1)
    found = F.array(
        F.when(F.size(missing) > 0, F.struct(F.lit("missing keys").alias("finding"), F.array_join(missing, ", ").alias("detail"))),
        F.when(rid != F.col("stem"), F.struct(F.lit("report id").alias("finding"), rid.alias("detail"))),
        F.when(standard & (year != expected), F.struct(F.lit("year").alias("finding"), year.alias("detail"))).when(~standard & (year != "") & ~year.rlike(r"^\d{4}\z"), F.struct(F.lit("year").alias("finding"), year.alias("detail"))),
        F.when(F.col("_structure").isNotNull() & (F.col("_structure") != "flat"), F.struct(F.lit("structure").alias("finding"), F.col("_structure").alias("detail"))),
        F.when(T.unquote(T.text("_title")) == "", F.struct(F.lit("blank title").alias("finding"), F.lit("").alias("detail"))),
        F.when((F.col("n_parts") > 1) & ~F.col("_pdf_pages").eqNullSafe(span), F.struct(F.lit("part drift").alias("finding"), F.coalesce("_pdf_pages", F.lit("")).alias("detail"))).when(
            (F.col("n_parts") == 1) & F.col("_pdf_pages").isNotNull(), F.struct(F.lit("pages of a whole").alias("finding"), F.col("_pdf_pages").alias("detail"))
        ),
    )
    return rows.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.finding", "f.detail")


STAMP_LINE = f"(?:{'|'.join(config.STAMPS)}):.*\\n"


def _bare(text: Column) -> Column:
    return F.regexp_replace(head(text), f"(?md)^{STAMP_LINE}", "")


def without_stamps(text: Column) -> Column:
    """``text`` without the stamp lines of its front matter."""
    return F.concat(_bare(text), rest(text))


def with_stamps(text: Column, register: Column, extract: Column, annotate: Column) -> Column:
    """``text`` with these stamps (blank: none) before the closing fence; null if one stands on a blank one, or if there
    is no front matter for them."""
    values = (register, extract, annotate)
    stamps = F.concat(*(F.when(v != "", F.concat(F.lit(f"{s}: "), v, F.lit("\n"))).otherwise("") for s, v in zip(config.STAMPS, values)))
    broken = ((extract != "") & (register == "")) | ((annotate != "") & (extract == "")) | ((stamps != "") & (head(text) == ""))
    return F.when(~broken, F.concat(_bare(text), stamps, rest(text)))


def stamp_guard(old: Column, new: Column, register: Column, extract: Column, annotate: Column) -> Column:
    """Whether nothing but stamps differs and the new text holds just these."""
    same = without_stamps(old) == without_stamps(new)
    return F.coalesce(reduce(lambda a, b: a & b, (F.coalesce(raw_value(new, s), F.lit("")) == v for s, v in zip(config.STAMPS, (register, extract, annotate))), same), F.lit(False))


def with_reviewed(text: Column, hids: Column) -> Column:
    """``text`` with the sorted distinct ``hids`` as its reviewed line, before the stamps that end its front matter;
    without one if there are none, and unchanged without front matter."""
    bare = F.regexp_replace(head(text), f"(?md)^{REVIEWED}.*\\n", "")
    stamps = F.regexp_extract(bare, f"(?md)((?:^{STAMP_LINE})*)\\z", 1)
    ids = F.array_sort(F.array_distinct(hids))
    line = F.when((F.size(ids) > 0) & (bare != ""), F.concat(F.lit(f"{REVIEWED} "), F.array_join(ids, " "), F.lit("\n"))).otherwise("")
    return F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(stamps)), line, stamps, rest(text))


def scope(register: Column, extract: Column, annotate: Column, full: bool = False, again: bool = False) -> Column:
    """What a check of a report covers: full, promote, register, reaudit or skip."""
    return (
        F.when(F.lit(full) | (extract == ""), "full")
        .when((annotate != "") & F.lit(again), "reaudit")
        .when(annotate == "", "promote")
        .when(register == "", "register")
        .otherwise("skip")
    )


def stamps_after(mode: Column, failed: Column, quality_failed: Column, complete: Column, register: Column, extract: Column, annotate: Column, today: str) -> Column:
    """The stamps (register, extract, annotate) after a check: what is proven is set or kept, what failed is taken back.

    A failed check takes back extract and annotate, a failed quality check only annotate; annotate is set where the
    summaries are complete and passed.
    """
    day = F.lit(today)
    keep = lambda old: F.when(old != "", old).otherwise(day)
    passed = F.struct(keep(register).alias("register"), F.when(mode == "full", day).otherwise(keep(extract)).alias("extract"), F.when(quality_failed | ~complete, F.lit("")).when(mode == "register", annotate).otherwise(keep(annotate)).alias("annotate"))
    gone = F.struct(register.alias("register"), F.lit("").alias("extract"), F.lit("").alias("annotate"))
    same = F.struct(register.alias("register"), extract.alias("extract"), annotate.alias("annotate"))
    return F.when(mode == "skip", same).when(failed, gone).otherwise(passed)
