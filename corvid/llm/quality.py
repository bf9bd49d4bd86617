"""Quality rules by cross-document line frequency.

Method: normalised lines are hashed, the distinct texts of a host that hold each line are counted, lines above
the limit are removed, and documents left with too little are rejected. Built-in functions only.

The host of a document is its ``source``. Equal texts count as one document, so copies don't condemn each other.
Defined cases: a null text is empty (and fails the word rule); a null source is a host of its own; an empty table
gives an empty result; repeated rows each get the same verdict; very long texts are taken whole, their lines and
windows being arrays of one row; of lines that tie at the limit all stay (over the limit is meant); extra columns are
not read (``clean`` returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import BROADCAST_ROWS, WORD, packed, scratch

WINDOW = 5  # words
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is removed if more than this share of the host's distinct texts hold it, and at least MIN_TEXTS do.
MAX_SHARE = 0.10
MIN_TEXTS = 10
#: A document is depleted if its removed lines leave fewer words than MIN_WORDS or than this share.
MIN_LEFT = 0.25
SPACE = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), SPACE, " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def with_base(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines (hash, words) for column ``_text``."""
    text = F.col("_text")
    df = df.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_wins", F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    ordered = F.sort_array(F.transform("_wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("_wins")) < F.size("_wins")
    df = df.withColumn("_sorted", F.when(some, ordered))
    near = lambda k, x: F.coalesce(F.get(F.col("_sorted"), k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_twice", F.array_sort(F.transform(F.filter("_sorted", lambda x, k: near(k - 1, x) | near(k + 1, x)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_twice", lambda p, k: F.least(F.coalesce(F.get(F.col("_twice"), k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x
    )
    df = df.withColumn("_split", F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD)))
    lines = F.transform("_split", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    return (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_split") - F.size(F.array_distinct("_split"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("_lines", lines)
        .drop("_words", "_wins", "_sorted", "_twice", "_split")
    )


def common_lines(lines: DataFrame, share: float = MAX_SHARE, least: int = MIN_TEXTS) -> DataFrame:
    """Rows (_host, _common: hashes of the lines above the limit) from rows (_host, _text_id, _lines).

    At most (lines per text / share) lines of a host can be above the limit, so the arrays stay short.
    """
    per_host = lines.groupBy("_host").agg(F.count_distinct("_text_id").alias("_texts"))
    counts = lines.select("_host", "_text_id", F.explode("_lines.h").alias("_h")).groupBy("_host", "_h").agg(F.count_distinct("_text_id").alias("_n"))
    above = counts.filter(F.col("_n") >= least).join(per_host, "_host").filter(F.col("_n") > share * F.col("_texts"))
    return above.groupBy("_host").agg(F.sort_array(F.collect_list("_h")).alias("_common"))


def bounded(common: DataFrame) -> DataFrame:
    """``common`` for a broadcast if its hosts and hashes are few (some 1 MB); else for a shuffled join."""
    n = common.agg(F.count("*") + F.coalesce(F.sum(F.size("_common")), F.lit(0))).first()[0]
    return F.broadcast(common) if n <= BROADCAST_ROWS else common


def verdict(df: DataFrame) -> DataFrame:
    """Adds n_removed_lines, n_left, base_failed and kept to rows with base figures, _lines and _common."""
    gone = F.filter("_lines", lambda x: F.array_contains("_common", x["h"]))
    df = df.withColumn("_gone", F.when(F.col("_common").isNotNull(), gone))
    df = df.withColumn("n_removed_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    df = df.withColumn("n_left", F.col("n_words") - F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, x: a + x["w"]), F.lit(0)))
    df = df.withColumn("n_removed_lines", F.greatest("n_removed_lines", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_removed_lines") > 0) & ((F.col("n_left") < MIN_WORDS) | (F.col("n_left") < MIN_LEFT * F.col("n_words")))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("_gone")


def host(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), source), F.lit("n"))


def judge(docs: DataFrame, share: float = MAX_SHARE, least: int = MIN_TEXTS) -> DataFrame:
    """One row per document: doc_id, base figures, base_failed, n_removed_lines, n_left, kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", host(F.col("source")).alias("_host"), text.alias("_text"), F.xxhash64(text).alias("_text_id"))
    rows = scratch(with_base(rows).drop("_text"), "quality")
    rows = rows.join(bounded(scratch(common_lines(rows, share, least), "common-lines")), "_host", "left")
    return verdict(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_left", "kept"
    )


def clean(docs: DataFrame, share: float = MAX_SHARE, least: int = MIN_TEXTS) -> DataFrame:
    """The kept documents, without the lines above the limit; columns as they came."""
    slim, columns = packed(docs, "text", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = slim.withColumn("_host", host(F.col("source"))).withColumn("_text", text)
    split = F.filter(F.split("_text", "\n"), lambda x: x.rlike(A_WORD))
    lines = keyed.select("_host", F.xxhash64("_text").alias("_text_id"), F.transform(split, lambda x: F.struct(line_hash(x).alias("h"))).alias("_lines"))
    common = scratch(common_lines(lines, share, least), "common-lines")
    # a number that Spark can't compute twice alike: no filter passes it, so the base figures are computed once
    rows = with_base(keyed).drop("text").withColumn("_once", F.monotonically_increasing_id())
    rows = verdict(rows.join(bounded(common), "_host", "left")).filter("kept and _once >= 0")
    stays = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~(x.rlike(A_WORD) & F.array_contains("_common", line_hash(x)))), "\n")
    rows = rows.withColumn("_new", F.when(F.col("n_removed_lines") > 0, stays).otherwise(F.col("_text")))
    return rows.withColumn("text", F.col("_new")).select(*columns)
