"""Phrase BM25, rank fusion, evidence windows and citation audit."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid import config
from corvid.functions import text as T
from corvid.functions.store import stored

COLUMNS = list(config.WEIGHTS)


def admitted(variants: list[str]) -> list[str]:
    """Distinct variants in order, blank and too short ones left out."""
    return [v for v in dict.fromkeys(variants) if v.strip() and (len(v) >= 3 or len("".join(v.split())) >= 3)]


def corpus_size(rows: DataFrame) -> DataFrame:
    """One row (total, avg_d): rows and mean length in trigrams over all indexed columns."""
    return rows.agg(F.count("*").alias("total"), F.avg("d" if "d" in rows.columns else length()).alias("avg_d"))


def length() -> Column:
    return reduce(lambda a, b: a + b, (F.greatest(F.length(T.text(c)) - 2, F.lit(0)) for c in COLUMNS)).cast("double")


def lowered(rows: DataFrame) -> DataFrame:
    """``rows`` with the indexed columns in lower case, and d, their length."""
    d = F.col("d") if "d" in rows.columns else length()
    return rows.select("section_id", "filepath", "doc_order", d.alias("d"), *(F.lower(T.text(c)).alias(c) for c in COLUMNS))


def frequency(phrase: str, path: str = "plain") -> Column:
    """Weighted occurrences of a phrase in ``lowered`` rows; on the fold path in the folded body only."""
    if path == "fold":
        return T.overlapping_count(F.col("body_fold"), "".join(phrase.split()).lower()) * config.WEIGHTS["body_fold"]
    return reduce(lambda a, b: a + b, (T.overlapping_count(F.col(c), phrase.lower()) * w for c, w in config.WEIGHTS.items()))


def trigrams(text: str) -> list[str]:
    return sorted({text[k : k + 3] for k in range(len(text) - 2)})


#: Characters of a segment of the lists (a bound of a worker's memory, some 200 MB), and the gram of its section names.
SEGMENT, NAMES = 4_000_000, -1


def gram_code(gram: str) -> int:
    """A trigram as one number: three code points of 21 bits, so that different trigrams have different numbers."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def segment_lists(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Codes of the texts' distinct trigrams in order, where each one's list begins, and the lists: the texts'
    numbers in order. \x01 is in no trigram. None if so many texts of so many signs don't fit numbers of 63 bits."""
    codes = np.frombuffer("\x01".join([*texts, "\x01"]).encode("utf-32-le"), "<u4")
    there = np.zeros(0x110000, bool)
    there[codes] = True
    signs = np.flatnonzero(there).astype(np.int64)
    b, w = (len(signs) - 1).bit_length(), (len(texts) - 1).bit_length()
    if 3 * b + w > 63:
        return None
    small = np.cumsum(there)[codes] - 1
    who = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(codes) - 2]
    key = ((small[:-2] << b | small[1:-1]) << b | small[2:]) << w | who
    key = np.unique(key[(codes[:-2] != 1) & (codes[1:-1] != 1) & (codes[2:] != 1)])
    gram, at = key >> w, (key & ((1 << w) - 1)).astype(np.int32)
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    gram, mask = gram[starts], (1 << b) - 1
    return signs[gram >> 2 * b] << 42 | signs[gram >> b & mask] << 21 | signs[gram & mask], starts, at


def _segments(names: list[str], texts: list[str]):
    """(names, lists) of sections as one segment, or as more where one doesn't fit."""
    if (lists := segment_lists(texts)) is not None:
        yield names, lists
    else:
        half = len(texts) // 2
        yield from _segments(names[:half], texts[:half])
        yield from _segments(names[half:], texts[half:])


def _runs(batches):
    """The sections (names, texts) of Arrow batches in runs of SEGMENT characters, one section at least."""
    names, texts, size = [], [], 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and size + len(text) > SEGMENT:
                yield names, texts
                names, texts, size = [], [], 0
            names.append(name)
            texts.append(text)
            size += len(text)
    if texts:
        yield names, texts


def postings(rows: DataFrame) -> DataFrame:
    """Rows (gram, segment, at, names): for every distinct trigram of a segment's sections (of their indexed columns, in
    lower case), the sections' numbers; and one row of the segment's section names, its gram being NAMES.

    Segments are runs of sections as they lie, so nothing is shuffled: each is sorted on its own. To be stored sorted
    by gram in each partition: a query then reads the pages of its phrases' trigrams and of the names only. Arrow
    batches, since Spark would make a row of every trigram of every section.
    """
    every = F.concat_ws("\x01", *(F.lower(T.text(c)) for c in COLUMNS))
    kinds = pa.schema([("gram", pa.int64()), ("segment", pa.int64()), ("at", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))])

    def lists(batches):
        segment = TaskContext.get().partitionId() << 32
        for run in _runs(batches):
            for names, (gram, starts, at) in _segments(*run):
                ends = np.append(starts, len(at)).astype(np.int32)
                for k in range(0, len(gram), 10_000):
                    n = min(10_000, len(gram) - k)
                    found = pa.ListArray.from_arrays(pa.array(ends[k : k + n + 1] - ends[k]), pa.array(at[ends[k] : ends[k + n]]))
                    yield pa.RecordBatch.from_arrays([pa.array(gram[k : k + n]), pa.array(np.full(n, segment)), found, pa.nulls(n, pa.list_(pa.string()))], schema=kinds)
                yield pa.RecordBatch.from_pylist([{"gram": NAMES, "segment": segment, "names": names}], kinds)
                segment += 1

    return rows.select("section_id", every.alias("_text")).mapInArrow(lists, "gram long, segment long, at array<int>, names array<string>")


def candidates(lists: DataFrame, phrases: list[str]) -> DataFrame:
    """Sections (section_id) that hold all trigrams of any of the phrases, from stored ``postings``."""
    wanted = {p: trigrams(p) for p in phrases if len(p) >= 3}
    every = sorted({gram_code(g) for gs in wanted.values() for g in gs})
    gram = F.col("gram")
    # one test for each: a list of more than ten values would be read as a range
    read = lists.filter(reduce(lambda a, b: a | b, (gram == g for g in every), gram == NAMES))
    per = read.groupBy("segment").agg(F.first("names", True).alias("_names"), *(F.first(F.when(gram == g, F.col("at")), True).alias(f"_{g}") for g in every))
    none = F.array().cast("array<int>")
    hits = [F.coalesce(reduce(F.array_intersect, (F.col(f"_{gram_code(g)}") for g in gs)), none) for gs in wanted.values()]
    found = per.select("_names", F.explode(reduce(F.array_union, hits, none)).alias("_at"))
    return found.select(F.get("_names", F.col("_at")).alias("section_id"))


def bm25(rows: DataFrame, variants: list[str], limit: int = config.PATH_LIMIT, lists: DataFrame | None = None) -> DataFrame:
    """Rows (variant, path, section_id, score, rank): the best ``limit`` of each variant and path.

    One pass over the index counts all variants, of the sections only that ``lists`` (stored ``postings``) names if
    given; its hits are stored, as they are counted and ranked. The window's limit is applied in each partition before
    the shuffle. Scores are negative, the best first; ties go by section id. Phrases under three characters don't match.
    """
    wanted = [(v, "plain") for v in admitted(variants) if len(v) >= 3] + [(v, "fold") for v in admitted(variants) if len("".join(v.split())) >= 3]
    counted = F.explode(F.array(*(F.struct(F.lit(k).alias("list_no"), F.lit(v).alias("variant"), F.lit(p).alias("path"), frequency(v, p).cast("double").alias("f")) for k, (v, p) in enumerate(wanted))))
    size = corpus_size(rows)
    if lists is not None:
        rows = rows.join(candidates(lists, [(v if p == "plain" else "".join(v.split())).lower() for v, p in wanted]), "section_id", "left_semi")
    hits = lowered(rows).select("section_id", "doc_order", "filepath", "d", counted.alias("h")).select("section_id", "filepath", "doc_order", "d", "h.*")
    hits = stored(hits.filter("f > 0"))
    found = hits.groupBy("list_no").agg(F.count("*").alias("n"))
    scored = hits.join(F.broadcast(found), "list_no").crossJoin(F.broadcast(size))  # one row per list; one row
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    score = -idf * F.col("f") * (config.K1 + 1) / (F.col("f") + config.K1 * (1 - config.B + config.B * F.col("d") / F.col("avg_d")))
    order = Window.partitionBy("list_no").orderBy("score", "section_id")
    return scored.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("list_no", "variant", "path", "section_id", "f", "n", "score", "rank")


def search(rows: DataFrame, variants: list[str], lists, limit: int = config.PATH_LIMIT) -> DataFrame:
    """``bm25`` through the stored lists that ``lists`` gives, if there are any; the rows are the same without. One
    search doesn't build them: that takes longer than to scan the index."""
    return bm25(rows, variants, limit, lists())


def rrf(ranked: DataFrame, penalised: DataFrame | None = None, k: int = config.RRF_K, factor: float = config.APPENDIX_FACTOR) -> DataFrame:
    """Fuse rows (list_no, section_id, rank) into (section_id, score, position).

    Sum of 1/(k + rank); sections in ``penalised`` are multiplied after summing. Ties keep the order in which the
    sections were first seen.
    """
    fused = ranked.groupBy("section_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("_seen"))
    if penalised is not None:
        fused = fused.join(penalised.select("section_id", F.lit(factor).alias("_factor")).distinct(), "section_id", "left")
        fused = fused.withColumn("score", F.col("score") * F.coalesce("_factor", F.lit(1.0))).drop("_factor")
    fused = fused.withColumn("score", F.round("score", 9))
    return fused.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "_seen", "section_id"))).drop("_seen")


def positions(text: Column, word: str) -> Column:
    """0-based starts of a word in a text, overlaps included.

    A word that can't overlap itself is found by splitting at it, in one pass; others place by place.
    """
    n = len(word)
    if any(word[:k] == word[-k:] for k in range(1, n)):
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(F.filter(places, lambda i: F.substring(text, i, F.lit(n)) == word), lambda i: i - 1)
    parts = F.split(text, "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast("struct<at:int,out:array<int>>")
    step = lambda a, x: F.struct((a["at"] + F.length(x) + n).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(x))).alias("out"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda a: a["out"])


def spans(body: Column, word: str) -> Column:
    """Occurrences (s, e) of a word, overlaps included; only if there is none, of its letters with white space between."""
    plain = F.transform(positions(body, word), lambda i: F.struct(i.alias("s"), (i + len(word)).alias("e")))
    return F.when(body.contains(word), plain).otherwise(folded_spans(body, "".join(word.split())))


def folded_spans(body: Column, letters: str) -> Column:
    """Occurrences of ``letters`` with any white space between them, mapped to places in ``body``."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    if not letters:
        return none
    chars = F.filter(F.transform(F.split(body, ""), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda c: ~c["x"].rlike(T.SPACE) & (c["x"] != ""))
    n = len(letters)
    # bound once, as the only item of an array: within the mapping they aren't computed again
    once = F.array(F.struct(positions(T.fold(body), letters).alias("at"), F.transform(chars, lambda c: c["i"]).alias("i")))
    mapped = F.flatten(F.transform(once, lambda o: F.transform(o["at"], lambda k: F.struct(F.get(o["i"], k).alias("s"), (F.get(o["i"], k + n - 1) + 1).alias("e")))))
    return F.when(T.fold(body).contains(letters), mapped).otherwise(none)


def windows(found: DataFrame, body_length: Column, radius: int = config.WINDOW_RADIUS, most: int = config.MAX_WINDOWS, budget: int = config.BODY_CHARS) -> DataFrame:
    """Rows (section_id, w, s, e) from rows (section_id, _n, s, e): spans widened by ``radius``, touching ones merged,
    the first ``most`` kept, cut to ``budget`` characters in total."""
    by = Window.partitionBy("section_id").orderBy("s", "e")
    wide = found.withColumn("s", F.greatest(F.col("s") - radius, F.lit(0))).withColumn("e", F.least(F.col("e") + radius, body_length))
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    island = wide.withColumn("_new", new).withColumn("w", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("section_id", "w").agg(F.min("s").alias("s"), F.max("e").alias("e")).filter(F.col("w") <= most)
    used = F.coalesce(F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("section_id").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.withColumn("_used", used).filter(F.col("_used") < budget).withColumn("e", F.least(F.col("e"), F.col("s") + budget - F.col("_used"))).drop("_used")


def cut_windows(rows: DataFrame, words: list[str], **limits) -> DataFrame:
    """Rows (section_id, evidence): the text around the words, with marks where something is left out."""
    every = reduce(lambda a, b: F.concat(a, b), (spans(F.col("body"), w) for w in words))
    found = rows.select("section_id", F.length("body").alias("_n"), F.explode(every).alias("x")).select("section_id", "_n", "x.s", "x.e")
    cut = windows(found, F.col("_n"), **limits)
    listed = cut.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("w", "s", "e"))).alias("_w"))
    joined = rows.join(listed, "section_id")
    pieces = F.array_join(F.transform("_w", lambda x: F.substring(F.col("body"), x["s"] + 1, x["e"] - x["s"])), f"\n{config.MARK_MIDDLE}\n")
    head = F.when(F.element_at("_w", 1)["s"] > 0, F.lit(config.MARK_HEAD + "\n")).otherwise("")
    tail = F.when(F.element_at("_w", -1)["e"] < F.length("body"), F.lit("\n" + config.MARK_TAIL)).otherwise("")
    return joined.select("section_id", F.concat(head, pieces, tail).alias("evidence"))


def head_cut(body: Column, most: int = config.BODY_CHARS) -> Column:
    """The first ``most`` characters, back to the last line end if that is past the middle, and a mark."""
    cut = F.substring(body, 1, most)
    at = T.last_index(cut, "\n")
    return F.concat(F.when(at > most // 2, F.substring(cut, F.lit(1), at)).otherwise(cut), F.lit("\n" + config.MARK_TAIL))


def deliver(rows: DataFrame, words: list[str], most: int = config.BODY_CHARS) -> DataFrame:
    """Rows (section_id, evidence): the whole body if it is short, else windows around the words, else its head."""
    if not words:
        return rows.select("section_id", F.when(F.length("body") <= most, F.col("body")).otherwise(head_cut(F.col("body"), most)).alias("evidence"))
    cut = cut_windows(rows.filter(F.length("body") > most), words)
    return rows.join(cut, "section_id", "left").select("section_id", F.when(F.length("body") <= most, F.col("body")).otherwise(F.coalesce("evidence", head_cut(F.col("body"), most))).alias("evidence"))


def body(rows: DataFrame, requests: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Rows (id, section_id, mode, evidence) of requests (id, section_id, mode): the full body, the text around
    ``words``, or the section before or after (delivered as evidence is). What isn't there has no evidence."""
    near = rows.select("section_id", F.lag("section_id").over(_order()).alias("prev"), F.lead("section_id").over(_order()).alias("next"))
    asked = requests.join(near, "section_id", "left")
    target = F.when(F.col("mode") == "prev", F.col("prev")).when(F.col("mode") == "next", F.col("next")).otherwise(F.col("section_id"))
    asked = asked.withColumn("_target", target).drop("prev", "next")
    wanted = rows.select("section_id", "body").join(asked.select(F.col("_target").alias("section_id")).distinct(), "section_id", "left_semi")
    whole = deliver(wanted, []).select("section_id", F.col("evidence").alias("_delivered"))
    around = cut_windows(wanted, words).select("section_id", F.col("evidence").alias("_around")) if words else whole.select("section_id", F.lit(None).cast("string").alias("_around"))
    found = wanted.join(whole, "section_id").join(around, "section_id", "left").withColumnRenamed("section_id", "_target")
    evidence = F.when(F.col("mode") == "full", F.col("body")).when(F.col("mode") == "around", F.col("_around")).when(F.col("mode").isin("prev", "next"), F.col("_delivered"))
    return asked.join(found, "_target", "left").select("id", "section_id", "mode", evidence.alias("evidence"))


def _order() -> Window:
    return Window.partitionBy("filepath").orderBy("doc_order")


def snippet(body: Column, phrase: str, width: int = 20) -> Column:
    """The first occurrence of a phrase (case ignored) in brackets, with ``width`` trigrams' characters around it and
    an ellipsis where the body goes on; null without one."""
    at = F.locate(phrase.lower(), F.lower(body))
    room = (width + 2 - len(phrase)) // 2 if len(phrase) < width + 2 else 0
    start = F.greatest(at - room, F.lit(1))
    end = F.least(at + len(phrase) + room, F.length(body) + 1)
    text = F.concat(F.substring(body, start, at - start), F.lit("["), F.substring(body, at, F.lit(len(phrase))), F.lit("]"), F.substring(body, at + len(phrase), F.greatest(end - at - len(phrase), F.lit(0))))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), text, F.when(end <= F.length(body), "…").otherwise("")))


def rendered(rows: DataFrame) -> DataFrame:
    """Rows (section_id, text) of sections with evidence: head, place, summary (not to be cited) and body."""
    place = F.concat_ws(" > ", *(F.when(T.text(c) != "", F.col(c)) for c in ("chapter", "section")))
    head = F.concat(F.lit("### ["), "section_id", F.lit("] "), T.text("report_title"), F.lit(" ("), T.text("year"), F.lit(") — report_id: "), F.regexp_extract("filepath", r"([^/]+)\.md$", 1))
    lines = F.array(head, F.concat(F.lit("위치: "), place), F.when(T.text("summary") != "", F.concat(F.lit("요약(맥락 파악용 — 인용 금지): "), "summary")), F.lit("본문:"), F.col("evidence"))
    return rows.select("section_id", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"))


def citations(answers: DataFrame) -> DataFrame:
    """Rows (id, section_id): distinct section ids cited in ``answers`` (id, answer)."""
    return answers.select("id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(config.SECTION_ID), F.lit(0)))).alias("section_id"))


def audit(cited: DataFrame, delivered: DataFrame) -> DataFrame:
    """Cited ids with whether they were delivered."""
    known = delivered.select("id", "section_id", F.lit(True).alias("_known")).distinct()
    return cited.join(known, ["id", "section_id"], "left").select("id", "section_id", F.coalesce("_known", F.lit(False)).alias("delivered"))


def select_sections(session: DataFrame, chosen: DataFrame, viewed: DataFrame, top: int = config.TOP_SECTIONS, k: int = config.RRF_K) -> DataFrame:
    """Fuse the session's ranking (section_id, rank) with the chosen order (section_id, filepath, rank).

    Nothing is delivered if any chosen report's contents were not viewed (``viewed``: filepath). Ids chosen twice
    count twice.
    """
    unseen = chosen.join(viewed, "filepath", "left_anti").agg(F.count("*").alias("_unseen"))
    lists = session.select(F.lit(0).alias("list_no"), "section_id", "rank").unionByName(chosen.select(F.lit(1).alias("list_no"), "section_id", "rank"))
    wanted = chosen.select("section_id").distinct()
    fused = rrf(lists, k=k).join(wanted, "section_id", "left_semi").crossJoin(F.broadcast(unseen)).filter("_unseen = 0").drop("_unseen")
    return fused.orderBy("position").limit(top)
