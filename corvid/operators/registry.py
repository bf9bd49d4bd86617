"""Report registry: parsing, natural order, problems, collisions, free numbers, similar titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.functions.store import stored

STEM = r"^(\d{4}-\d{2})(?:-([b-z]))?(?:-v(\d{1,2}))?\z"
PAGES = r"^(\d+)-(\d+)\z"
COLUMNS = ("file", "pages", "report_id", "source", "cover_title", "registered", "note")


def family(rid: Column | str) -> Column:
    """YYYY-NN of a standard id, else blank."""
    return F.regexp_extract(T.text(rid), STEM, 1)


def cover_number(note: Column | str) -> Column:
    return F.regexp_extract(T.text(note), r"(?:^| · )\s*표지 번호 (\d{4}-\d{2})\s*(?= · |\z)", 1)


def parsed(rows: DataFrame) -> DataFrame:
    """Registry rows with family, letter, volume and 0-based page range (null if blank or malformed)."""
    rid, first, last = T.text("report_id"), F.regexp_extract("pages", PAGES, 1).try_cast("int"), F.regexp_extract("pages", PAGES, 2).try_cast("int")
    good = (first >= 1) & (last >= first)
    return rows.select(
        "*",
        F.when(family(rid) != "", family(rid)).when(rid == "", cover_number("note")).otherwise("").alias("family"),
        F.regexp_extract(rid, STEM, 2).alias("letter"),
        F.regexp_extract(rid, STEM, 3).try_cast("int").alias("volume"),
        F.when(good, first - 1).alias("page_from"),
        F.when(good, last - 1).alias("page_to"),
    )


def sort_key(rows: DataFrame) -> Column:
    """Natural order of ``parsed`` rows: standard ids, blanks right behind their family, other ids, other blanks."""
    rid = T.text("report_id")
    standard, placed = family(rid) != "", (rid == "") & (F.col("family") != "")
    group = F.when(standard | placed, 0).when(rid != "", 1).otherwise(2)
    pages = F.when(T.text("pages") == "", -1).otherwise(F.coalesce("page_from", F.lit(10**9)))
    letter = F.when(F.col("letter") != "", F.ascii("letter") - F.ascii(F.lit("a"))).otherwise(0)
    return F.struct(group.alias("g"), F.when(group == 0, F.col("family")).otherwise("").alias("f"), placed.cast("int").alias("b"), F.when(standard, letter).otherwise(0).alias("l"), F.when(standard, F.coalesce("volume", F.lit(0))).otherwise(0).alias("v"), F.when(group == 1, rid).otherwise("").alias("r"), F.col("file").alias("n"), pages.alias("p"))


def problems(rows: DataFrame) -> DataFrame:
    """First problem of each row (null if none): bad pages, blank id, bad id, whole and parts mixed, overlap.

    One bad row blocks its whole file (``blocked``).
    """
    p = parsed(rows)
    by_file = Window.partitionBy("file")
    order = by_file.orderBy("page_from").rowsBetween(Window.unboundedPreceding, -1)
    whole, part = F.max((T.text("pages") == "").cast("int")).over(by_file), F.max((T.text("pages") != "").cast("int")).over(by_file)
    problem = (
        F.when((T.text("pages") != "") & F.col("page_from").isNull(), "bad pages")
        .when(T.text("report_id") == "", "blank id")
        .when(~F.col("report_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*\z"), "bad id")
        .when((whole == 1) & (part == 1), "whole and parts")
        .when(F.col("page_from") <= F.max("page_to").over(order), "overlap")
    )
    return p.withColumn("problem", problem).withColumn("blocked", F.max(F.col("problem").isNotNull()).over(by_file)).select("file", "pages", "report_id", "problem", "blocked")


def collisions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (file, report_id, cover_title) with the registered row of their family: their id goes blank.

    The counterpart is the first by file; equal folded titles make it a suspected duplicate.
    """
    old = existing.select(family("report_id").alias("f"), F.col("file").alias("other"), T.fold_title("cover_title").alias("t")).filter("f <> ''")
    fresh = new.select("file", "report_id", family("report_id").alias("f"), T.fold_title("cover_title").alias("mine"))
    again = fresh.select("f", F.col("file").alias("other"), F.col("mine").alias("t"))
    pairs = fresh.join(old.unionByName(again), "f", "left").filter("other IS NULL OR other <> file")
    found = pairs.filter("other IS NOT NULL AND f <> ''").groupBy("file", "report_id").agg(F.min("other").alias("counterpart"), F.max(F.col("t") == F.col("mine")).alias("duplicate"))
    return new.join(found.drop("report_id"), "file", "left").select("file", F.when(F.col("counterpart").isNull(), F.col("report_id")).otherwise("").alias("report_id"), "counterpart", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


def next_free(rows: DataFrame) -> DataFrame:
    """Per family the first unused letter (from b) and volume (from 1)."""
    p = parsed(rows).filter("family <> ''")
    used = p.groupBy("family").agg(F.collect_set("letter").alias("_letters"), F.collect_set("volume").alias("_volumes"))
    letters = F.array(*(F.lit(chr(c)) for c in range(ord("b"), ord("z") + 1)))
    return used.select("family", F.element_at(F.array_except(letters, "_letters"), 1).alias("letter"), F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_volumes") + 1), "_volumes")).alias("volume"))


#: Words of a title up to which its sets of words are listed (3 to the power of it at most).
MOST = 6


def similar(rows: DataFrame, k: int = 3) -> DataFrame:
    """For each row (id, title) the ``k`` others whose title shares words with its own, by shared characters, then id.

    A word counts if it is a title word of either side and stands anywhere in the other title, also inside a longer
    word; ``k`` is the size of the report. Words meet titles through their three-character pieces and are verified.

    Titles that share a word are not paired: a title is offered under every set of its words, marked where it must be
    the one whose title word it is, and only the first ``k`` + 1 ids of a set are kept. One that shares exactly this set
    and isn't among them has ``k`` others before it, which share no less. Titles of more than MOST words that others
    hold, too, are paired word by word.
    """
    pieces = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))))
    titles = rows.select("id", T.text("title").alias("title")).distinct().withColumn("_own", T.title_tokens("title"))
    # a word's first three characters are one of the pieces of every title that holds it
    words = titles.select(F.explode("_own").alias("word")).distinct().withColumn("piece", F.substring("word", 1, 3))
    places = titles.filter(F.length("title") >= 3).select("id", "title", "_own", pieces(F.col("title")).alias("piece"))
    met = places.join(words, "piece").filter(F.col("title").contains(F.col("word")))
    held = stored(met.groupBy("id", "word").agg(F.max(F.array_contains("_own", F.col("word"))).alias("own")))
    common = held.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word")
    profile = stored(held.join(common, "word", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("word", "own"))).alias("_w")))

    def sets(marks):
        none = F.array().cast("array<string>")
        longer = lambda found, x: [F.when(test, F.transform(found, lambda t: F.concat(t, x["word"], F.lit(mark)))).otherwise(none) for mark, test in marks(x)]
        every = F.aggregate("_w", F.array(F.lit("")), lambda found, x: F.concat(found, *longer(found, x)))
        return F.explode(F.filter(every, lambda t: t != "")).alias("key")

    # "!": whoever is found must have it as a title word; "?": that doesn't matter
    few = profile.filter(F.size("_w") <= MOST)
    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    offered = few.select("id", "_w", sets(lambda x: [("?", F.lit(True)), ("!", x["own"])])).withColumn("_first", first).filter(F.col("_first") <= k + 1)
    asked = few.select("id", "_w", sets(lambda x: [("?", x["own"]), ("!", ~x["own"])]))
    found = asked.join(offered.select("key", F.col("id").alias("other"), F.col("_w").alias("_v")), "key").select("id", "_w", "other", "_v")
    many = F.size("_w") > MOST
    if not profile.filter(many).isEmpty():
        one = profile.select("id", "_w", many.alias("_many"), F.explode("_w").alias("x")).select("*", "x.word")
        two = one.select("word", F.col("id").alias("other"), F.col("_w").alias("_v"), F.col("_many").alias("_more"), F.col("x").alias("y"))
        found = found.unionByName(one.join(two, "word").filter((F.col("_many") | F.col("_more")) & (F.col("x.own") | F.col("y.own"))).select("id", "_w", "other", "_v"))
    both = F.filter("_w", lambda x: F.exists("_v", lambda y: (x["word"] == y["word"]) & (x["own"] | y["own"])))
    shared = F.aggregate(both, F.lit(0).cast("long"), lambda n, x: n + F.length(x["word"]))
    pairs = found.filter("id <> other").select("id", "other", shared.alias("shared")).distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "other"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
