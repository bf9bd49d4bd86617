"""Registration: numbers decided from covers, suggestions for blank rows, checks of the table, assignment, renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import registry as R

#: Forms of ids and file names, pages of a cover, marks and words of notes.
RID = r"^[A-Za-z0-9][A-Za-z0-9-]*\z"
UNKNOWN = r"^\d{4}-00\z"
FILE_NUMBER, FILE_YEAR = r"정책연구-(\d{4}-\d{2})", r"^\s*\((\d{4})-(\d{1,2})\)"
FRONT_PAGES, BACK_PAGES = 6, 2
SEPARATOR = " · "
REVIEW = ("다른 후보", "와 다름(표지 채택)")
SOURCES = ("cover", "manual", "")


def file_number(name: Column | str) -> Column:
    """YYYY-NN that a file name carries, or null."""
    n = T.text(name)
    year, no = F.regexp_extract(n, FILE_YEAR, 1), F.regexp_extract(n, FILE_YEAR, 2)
    plain = F.regexp_extract(n, FILE_NUMBER, 1)
    return F.when(plain != "", plain).when(year != "", F.concat(year, F.lit("-"), F.lpad(no, 2, "0")))


def decide(covers: DataFrame) -> DataFrame:
    """New rows (file, report_id, source, note) of covers (file, n_pages, text_chars, found, vols).

    ``found`` holds (page, number) of the pages looked at, ``vols`` the volume signals. Page one is asked first, then
    the front pages, then the back cover, too; a single number at a stage is taken, several stop the search. Exactly
    one volume signal becomes a suffix.
    """
    front = F.least(F.col("n_pages"), F.lit(FRONT_PAGES))
    at = lambda test: F.array_sort(F.array_distinct(F.transform(F.filter("found", test), lambda x: x["number"])))
    first, early = at(lambda x: x["page"] == 1), at(lambda x: x["page"] <= front)
    every = at(lambda x: (x["page"] <= front) | (x["page"] > F.col("n_pages") - BACK_PAGES))
    stage = F.when(F.size(first) > 0, F.struct(F.lit("1쪽").alias("label"), first.alias("c"))).when(F.size(early) > 0, F.struct(F.format_string("1~%d쪽", front).alias("label"), early.alias("c")))
    rows = covers.withColumn("_s", stage.otherwise(F.struct(F.lit("뒷표지 포함").alias("label"), every.alias("c"))))
    n = F.size("_s.c")
    rows = rows.withColumn("_base", F.when(n == 1, F.element_at("_s.c", 1)))
    several = F.concat(F.lit("후보 여러 개("), F.col("_s.label"), F.lit(": "), F.array_join("_s.c", ", "), F.lit(")"))
    reason = F.when(n > 1, several).when(F.col("text_chars") == 0, "표지 이미지(텍스트 없음)").otherwise("표지 번호 없음")
    base, number, one = F.col("_base"), file_number("file"), F.size("vols") == 1
    volumes = F.when(one, F.format_string("권 신호 제%d권", F.element_at("vols", 1))).when(
        F.size("vols") > 1, F.concat(F.lit("권 신호 여러 개("), F.array_join(F.transform("vols", lambda v: F.format_string("제%d권", v)), ", "), F.lit(") — 접미 미부여, 확인 필요"))
    )
    others = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["number"] != base), lambda x: F.format_string("%s(p%d)", x["number"], x["page"]))))
    segments = F.array(
        F.coalesce(F.concat(F.lit("표지 번호 "), base), reason),
        volumes,
        F.when(base.isNull(), F.concat(F.lit("힌트: 파일명 번호 "), number)).when(number != base, F.concat(F.lit("파일명 번호 "), number, F.lit("와 다름(표지 채택)"))),
        F.when(F.size(others) > 0, F.concat(F.lit("다른 후보: "), F.array_join(others, ", "))),
    )
    rid = F.when(base.isNull(), "").when(one, F.concat(base, F.format_string("-v%d", F.element_at("vols", 1)))).otherwise(base)
    return rows.select("file", rid.alias("report_id"), F.when(base.isNull(), "").otherwise("cover").alias("source"), F.array_join(segments, SEPARATOR).alias("note"))


def volumes(note: Column | str) -> Column:
    """Volume numbers that a note's signal names."""
    segment = F.get(F.filter(F.split(T.text(note), SEPARATOR), lambda s: T.strip(s).startswith("권 신호 ")), F.lit(0))
    return F.transform(F.regexp_extract_all(T.text(segment), F.lit(r"제(\d{1,2})권"), F.lit(1)), lambda x: x.cast("int"))


def suggestions(rows: DataFrame) -> DataFrame:
    """Rows (file, pages, rank, rid, label): ids that a blank row could take, from its cover, its family and its file.

    In this order: the family's own number if free; the cover's volume of it and of the family's other documents; the
    next free letter; for each document the next free volume; the same for the other parts of the file. Ids in use
    are left out.
    """
    p = R.parsed(rows)
    members = p.filter("family <> ''").groupBy("family").agg(F.array_sort(F.collect_set(T.text("report_id"))).alias("_ids"))
    parts = rows.filter((T.text("report_id") != "") & (T.text("pages") != "")).groupBy("file").agg(F.array_sort(F.collect_set("report_id")).alias("_parts"))
    blank = p.filter(T.text("report_id") == "").select("file", "pages", "family", volumes("note").alias("_vols")).join(members, "family", "left").join(parts, "file", "left")
    none = F.array().cast("array<string>")
    ids = F.filter(F.coalesce("_ids", none), lambda r: r != "")
    docs = F.filter(ids, lambda r: (R.family(r) == F.col("family")) & (F.regexp_extract(r, R.STEM, 3) == ""))
    letters = F.array(*(F.lit(chr(c)) for c in range(ord("b"), ord("z") + 1)))
    used = F.transform(F.filter(ids, lambda r: R.family(r) == F.col("family")), lambda r: F.regexp_extract(r, R.STEM, 2))
    letter = F.coalesce(F.get(F.array_except(letters, used), F.lit(0)), F.lit("z"))

    def next_volume(doc: Column, among: Column) -> Column:
        taken = F.transform(F.filter(among, lambda r: r.startswith(F.concat(doc, F.lit("-v"))) & F.substring(r, F.length(doc) + 3, F.length(r)).rlike(r"^\d{1,2}\z")), lambda r: F.substring(r, F.length(doc) + 3, F.length(r)).cast("int"))
        return F.concat(doc, F.lit("-v"), F.array_min(F.array_except(F.sequence(F.lit(1), F.size(taken) + 1), taken)).cast("string"))

    offer = lambda rid, label: F.struct(rid.alias("rid"), F.lit(label).alias("label"))
    family, one = F.col("family"), F.size("_vols") == 1
    volume = F.concat(F.lit("-v"), F.get("_vols", F.lit(0)).cast("string"))
    in_family = F.concat(
        F.array(offer(family, "own")),
        F.when(one, F.concat(F.array(offer(F.concat(family, volume), "cover volume")), F.transform(F.filter(docs, lambda d: d != family), lambda d: offer(F.concat(d, volume), "cover volume")))).otherwise(F.array().cast("array<struct<rid:string,label:string>>")),
        F.array(offer(F.concat(family, F.lit("-"), letter), "another report")),
        F.transform(docs, lambda d: offer(next_volume(d, ids), "volume of")),
    )
    empty = F.array().cast("array<struct<rid:string,label:string>>")
    in_file = F.when(T.text("pages") != "", F.transform(F.coalesce("_parts", none), lambda d: offer(F.concat(d, F.lit("-v"), F.lit("1")), "volume of part")))
    every = F.concat(F.when(family != "", in_family).otherwise(empty), F.coalesce(in_file, empty))
    listed = blank.select("file", "pages", F.posexplode(every).alias("_k", "_s")).select("file", "pages", "_k", "_s.*")
    free = listed.join(rows.select(F.col("report_id").alias("rid")).filter("rid <> ''").distinct(), "rid", "left_anti")
    first = free.groupBy("file", "pages", "rid").agg(F.min(F.struct("_k", "label")).alias("_f"))
    rank = F.row_number().over(Window.partitionBy("file", "pages").orderBy("_f._k"))
    return first.select("file", "pages", rank.alias("rank"), "rid", "_f.label")


def check_table(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Issues (kind, file, pages) of the registry against the files that are there (file, held).

    not listed: a file without rows; delete: rows of a file that is gone or held; pages: a problem of the page
    ranges; shifted: a value of another column; fill in: no id; form: a malformed id; repeated: an id of several
    rows; review: not of the standard form, or taken against another signal.
    """
    there = files.filter(~F.col("held")).select("file")
    listed = R.parsed(rows).join(there.withColumn("_there", F.lit(True)), "file", "left")
    problem = R.problems(rows).filter(F.col("problem").isin("bad pages", "whole and parts", "overlap")).select("file").distinct().withColumn("_pages", F.lit(True))
    n = Window.partitionBy("report_id", F.col("report_id").rlike(RID) & F.col("_there").isNotNull())
    rid, date = T.text("report_id"), T.text("registered")
    good = rid.rlike(RID)
    standard = R.family(rid) != ""
    marks = F.lit(False)
    for m in REVIEW:
        marks = marks | T.text("note").contains(m)
    row = F.array(
        F.when(~T.text("source").isin(*SOURCES) | ((date != "") & ~date.rlike(r"^\d{4}-\d{2}-\d{2}\z")), "shifted"),
        F.when(rid == "", "fill in").when(~good, "form").when(~standard | marks, "review"),
        F.when((rid != "") & good & (F.col("_same") > 1), "repeated"),
    )
    present = listed.filter("_there").withColumn("_same", F.count("*").over(n))
    found = present.select("file", "pages", F.explode(F.filter(row, lambda x: x.isNotNull())).alias("kind"))
    whole = lambda df, kind: df.select("file", F.lit("").alias("pages"), F.lit(kind).alias("kind"))
    found = found.unionByName(whole(present.join(problem, "file").select("file").distinct(), "pages"))
    found = found.unionByName(whole(listed.filter("_there is null").select("file").distinct(), "delete"))
    found = found.unionByName(whole(there.join(rows.select("file").distinct(), "file", "left_anti"), "not listed"))
    return found.select("kind", "file", "pages")


def validated(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (batch, file, pages, report_id) with the id they get and ``error``: absent, twice, form, taken, or null.

    The rows of all changes are blank while ids are checked, so ids can be swapped. An unknown number (YYYY-00) gets
    the next free volume.
    """
    rows = rows.select("file", F.coalesce("pages", F.lit("")).alias("pages"), T.text("report_id").alias("_old"))
    wanted = changes.select("batch", "file", F.coalesce("pages", F.lit("")).alias("pages"), T.strip("report_id").alias("_typed"))
    probe = rows.join(wanted.select("file", "pages").distinct(), ["file", "pages"], "left_anti").select(F.col("_old").alias("rid")).filter("rid <> ''").distinct()
    unknown = F.col("_typed").rlike(UNKNOWN)
    used = probe.select(F.regexp_extract("rid", r"^(\d{4}-00)-v\d+\z", 1).alias("_typed"), F.regexp_extract("rid", r"^\d{4}-00-v(\d+)\z", 1).try_cast("int").alias("v")).filter("v is not null")
    used = used.groupBy("_typed").agg(F.collect_set("v").alias("_used"))
    turn = F.row_number().over(Window.partitionBy("_typed").orderBy("batch", "file", "pages"))
    taken = F.coalesce("_used", F.array().cast("array<int>"))
    asked = wanted.withColumn("_turn", turn).join(used, "_typed", "left")
    free = F.get(F.array_sort(F.array_except(F.sequence(F.lit(1), F.size(taken) + F.col("_turn")), taken)), F.col("_turn") - 1)
    final = asked.withColumn("report_id", F.when(unknown, F.concat("_typed", F.lit("-v"), free.cast("string"))).otherwise(F.col("_typed"))).drop("_used", "_turn")
    final = final.join(rows, ["file", "pages"], "left").join(probe.withColumn("_taken", F.lit(True)), F.col("rid") == F.col("report_id"), "left")
    twice = F.count("*").over(Window.partitionBy("file", "pages"))
    same = F.count("*").over(Window.partitionBy("report_id"))
    error = (
        F.when(F.col("_old").isNull(), "absent")
        .when(twice > 1, "twice")
        .when((F.col("report_id") != "") & ~F.col("report_id").rlike(RID), "form")
        .when((F.col("report_id") != "") & (F.col("_taken") | (same > 1)), "taken")
    )
    return final.withColumn("error", error).select("batch", "file", "pages", "report_id", "error")


def assign(rows: DataFrame, changes: DataFrame, today: str) -> DataFrame:
    """The registry after the changes: a batch with any error changes nothing; others set id, source and date."""
    v = validated(rows, changes)
    good = v.withColumn("_bad", F.max(F.col("error").isNotNull()).over(Window.partitionBy("batch"))).filter(~F.col("_bad"))
    new = good.select("file", "pages", F.col("report_id").alias("_new"))
    both = rows.join(new, ["file", "pages"], "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != T.text("report_id"))
    pick = lambda c, value: F.when(changed, F.when(F.col("_new") == "", "").otherwise(value)).otherwise(F.col(c)).alias(c)
    out = [pick("report_id", F.col("_new")) if c == "report_id" else pick(c, F.lit("manual")) if c == "source" else pick(c, F.lit(today)) if c == "registered" else F.col(c) for c in rows.columns]
    return both.select(*out)


def renamed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Markdown (rid, text) of the reports of ``pairs`` (old, new) under their new ids: the id line, heading ids, the
    reviewed list and, between standard ids, the year."""
    old, new = F.col("old"), F.col("new")
    lines = F.split("text", "\n")
    prefix = lambda s: F.replace(s, F.concat(old, F.lit("_c")), F.concat(new, F.lit("_c")))
    year = F.when(new.startswith("0000"), "year:").otherwise(F.concat(F.lit("year: "), F.substring(new, 1, 4)))
    moved = (R.family(old) != "") & (R.family(new) != "") & (F.substring(old, 1, 4) != F.substring(new, 1, 4))
    each = lambda x: (
        F.when(x == F.concat(F.lit("report_id: "), old), F.concat(F.lit("report_id: "), new))
        .when(x.startswith("summary_reviewed:"), prefix(x))
        .when(x.startswith("year:") & moved, year)
        .otherwise(F.replace(x, F.concat(F.lit("<!-- id: "), old, F.lit("_c")), F.concat(F.lit("<!-- id: "), new, F.lit("_c"))))
    )
    both = docs.join(pairs, docs["rid"] == pairs["old"])
    return both.select(new.alias("rid"), F.array_join(F.transform(lines, each), "\n").alias("text"))
