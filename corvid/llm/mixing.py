"""Mixing sources to target weights under a time-varying curriculum.

Method: every source has a weight schedule over training time 0..1 (piecewise linear knots). Its integral
gives the source's cumulative token demand; inverting that demand at the running word count of a document
gives the document's training position, and documents are range-sorted by position. Built-in functions only.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, ordered last;
an empty table gives an empty result; rows repeated in full are taken as rows of their own, side by side;
extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import n_words, packed, running_total, scratch, spread

#: Weights by rank of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Shapes of the curriculum by rank, repeating: knots (time, factor); each integrates to 1.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
#: Digits of a position, and slices of the training time in which places are counted.
DIGITS, SLICES = 6, 4096
SEGMENTS = "array<struct<t0:double,t1:double,w0:double,w1:double,c0:double,c1:double>>"


def segments(knots) -> Column:
    """Knots as segments with the integral before (c0) and after (c1) each."""
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        out.append(F.struct(*(F.lit(float(x)).alias(n) for n, x in zip(("t0", "t1", "w0", "w1", "c0", "c1"), (t0, t1, w0, w1, total, total + area)))))
        total += area
    return F.array(*out).cast(SEGMENTS)


def cycle(rank: Column, items: list[Column]) -> Column:
    return F.element_at(F.array(*items), (F.pmod(rank - 1, F.lit(len(items))) + 1).cast("int"))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, shapes=SHAPES) -> DataFrame:
    """Targets per source of ``sizes`` (source, size): one row per source.

    ``share`` times all sizes is dealt by weight; a target stops at ``most`` times its source's size and the
    excess is reshared by weight. The level at which that ends has a closed form over the sources sorted by
    cap/weight. The window has one row per source, not per document.
    """
    one = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = one.withColumn("_rank", F.row_number().over(by_name))
    one = one.withColumn("weight", cycle(F.col("_rank"), [F.lit(float(w)) for w in weights]))
    one = one.withColumn("_cap", most * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("_full", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    one = one.withColumn(
        "_level",
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    below = F.col("_level") < F.col("_full")
    one = one.withColumn("_final", F.min_by(F.when(below, F.col("_level")), F.when(below, F.struct("_full", "_rank"))).over(everything))
    target = F.least(F.coalesce(F.col("_final") * F.col("weight"), F.col("_cap")), F.col("_cap"))
    return one.select("source", "source_size", "weight", target.alias("target"), cycle(F.col("_rank"), [segments(k) for k in shapes]).alias("segments"))


def position(progress: Column, segs: Column) -> Column:
    """Training time at which the share ``progress`` (0..1) of a source's demand is met."""
    last = F.element_at(segs, -1)
    demand = progress * last["c1"]
    seg = F.coalesce(F.get(F.filter(segs, lambda s: demand < s["c1"]), F.lit(0)), last)
    left = demand - seg["c0"]
    slope = (seg["w1"] - seg["w0"]) / (seg["t1"] - seg["t0"])
    root = seg["w0"] + F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2 * slope * left, F.lit(0.0)))
    return F.least(seg["t0"] + F.when(left <= 0, F.lit(0.0)).otherwise(2 * left / root), F.lit(1.0))


def plan(docs: DataFrame, *, share: float = 1.5, most: int = 2, weights=WEIGHTS, shapes=SHAPES) -> DataFrame:
    """Where each document (doc_id, source, size) lies in its source's passes; sizes are kept in a scratch table.

    Adds source_size, target, segments, _budget (whole words the source gives) and _at (words of the source
    before the document, in an order by MD5 of the id).
    """
    sized = scratch(docs, "mixing")
    targets = source_targets(sized, share, most, weights, shapes).withColumn("_budget", F.round("target").cast("long"))
    name = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))  # noqa: E731  null-safe key
    rows = sized.withColumn("_source", name(F.col("source"))).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("_bucket", spread("_id")).withColumn("_order", F.md5(F.col("_id").cast("binary")))
    placed = running_total(rows, ["_source"], "_bucket", ["_order", "doc_id", "size"], "size", "_at")
    targets = targets.withColumn("_source", name(F.col("source"))).drop("source")
    return placed.join(targets, "_source").drop("_source", "_bucket", "_order", "_id")


def words_taken(turn: Column) -> Column:
    """Words taken in pass ``turn`` (from 0): the passes are laid end to end and cut at the budget."""
    start = turn * F.col("source_size") + F.col("_at")
    return F.least(F.greatest(F.col("_budget") - start, F.lit(0)), F.col("size")).cast("long")


def mix(docs: DataFrame, *, share: float = 1.5, most: int = 2, weights=WEIGHTS, shapes=SHAPES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position of its first use and its place among
    the first uses (from 0; both null if unused), range-sorted by position, the unused ones last.

    Places are counted in two levels, by slices of the training time and within them.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = plan(sized, share=share, most=most, weights=weights, shapes=shapes)
    taken = sum((words_taken(F.lit(k)) for k in range(most)), F.lit(0))
    first = position(F.col("_at") / F.col("_budget"), F.col("segments"))
    rows = rows.withColumn("taken", taken.cast("long")).withColumn("position", F.when(F.col("taken") > 0, F.round(first, DIGITS)))
    rows = scratch(rows.select("doc_id", "size", "source_size", "target", "taken", "position"), "positions")
    used = rows.filter("position is not null").withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    used = used.withColumn("_slice", F.floor(F.col("position") * SLICES).cast("int"))
    used = running_total(used, ["_all"], "_slice", ["position", F.col("doc_id").asc_nulls_first(), "size"], "_one", "place").drop("_all", "_one", "_slice")
    rows = used.withColumn("place", F.col("place").cast("long")).unionByName(rows.filter("position is null").withColumn("place", F.lit(None).cast("long")))
    return rows.repartitionByRange(F.col("place").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("place").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, *, share: float = 1.5, most: int = 2, weights=WEIGHTS, shapes=SHAPES) -> DataFrame:
    """The mixed corpus itself: whole documents, each as often as it is used, range-sorted by position.

    A use counts if at least half of its words lie within the source's budget, so documents are never cut.
    The documents' rows and columns are returned; those never used are left out.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("\x1f", F.when(F.col("doc_id").isNull(), "n").otherwise("i"), some("doc_id"), F.when(F.col("source").isNull(), "n").otherwise("s"), some("source"), some("text")).cast("binary"))
    slim, columns = packed(docs, "doc_id", "text", "source")
    keyed = slim.withColumn("_key", key)
    sized = keyed.select("doc_id", "source", n_words(F.col("text")).alias("size"), "_key")
    rows = plan(sized, share=share, most=most, weights=weights, shapes=shapes)
    uses = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).filter(
        (F.col("size") > 0) & (2 * words_taken(F.col("_turn")) >= F.col("size"))
    )
    when = position((F.col("_turn") * F.col("source_size") + F.col("_at")) / F.col("_budget"), F.col("segments"))
    uses = uses.select("_key", when.alias("_position"))
    # rows repeated in full are one text with several uses
    return (
        keyed.dropDuplicates(["_key"]).join(uses, "_key").repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key").select(*columns)
    )
