"""Sharding by balanced label propagation, with Spark joins only.

Documents with equal texts are linked. Labels (shards) start balanced; in each round every linked document may
move to the shard that holds most bytes of its group, as far as the shard's capacity quota goes, whole groups
first come by an MD5 order. Documents without links have no edge to cut and fill what the linked ones leave,
large ones first, so sizes end near equal. Law: ``bytes``.

Defined cases: a null text counts as empty; a null doc_id is an id of its own; repeated rows are linked rows of
their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import running_total, scratch, spread

#: Documents without links are dealt in tiers: over 1/20 of a shard, over 1/400, the rest.
TIERS = (20, 400)


def cut(at: Column, bounds: list[float]) -> Column:
    """Number of ``bounds`` (ascending, one per shard but the last) at or below ``at``."""
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b <= at)) if bounds else F.lit(0)


def loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes by shard; one row per shard comes to the driver."""
    got = dict(rows.groupBy("shard").agg(F.sum("size")).collect())
    return [got.get(k) or 0 for k in range(shards)]


def deal(rows: DataFrame, room: list[float]) -> DataFrame:
    """Give each row of ``rows`` a shard, the shards' shares of the bytes being as ``room``."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    whole = sum(room) or 1.0
    bounds, x = [], 0.0
    for r in room[:-1]:
        x += r * total / whole if sum(room) else total / len(room)
        bounds.append(x)
    placed = running_total(rows.withColumn("_all", F.lit(0)), ["_all"], "_bucket", ["_order", "doc_id", "_copy"], "size", "_at")
    return placed.withColumn("shard", cut(F.col("_at") + F.col("size") / 2, bounds).cast("int")).drop("_at", "_all")


def move(linked: DataFrame, cap: float, shards: int) -> DataFrame:
    """One round of propagation over ``linked``."""
    room = [max(0.0, cap - x) for x in loads(linked, shards)]
    open_ = F.element_at(F.array(*(F.lit(r) for r in room)), F.col("shard") + 1) > 0
    held = linked.groupBy("_group", "shard").agg(F.sum("size").alias("_held"))
    best = held.filter(open_).groupBy("_group").agg(F.max_by("shard", F.struct("_held", -F.col("shard"))).alias("_to"), F.max("_held").alias("_there"))
    rows = linked.join(held, ["_group", "shard"]).join(best, "_group", "left")
    wants = (F.col("_to") != F.col("shard")) & (F.struct("_there", -F.col("_to")) > F.struct("_held", -F.col("shard")))
    rows = rows.withColumn("_to", F.when(wants, F.col("_to")).otherwise(F.lit(-1))).withColumn("_moving", F.when(F.col("_to") >= 0, F.col("size")).otherwise(0))
    stay, go = rows.filter("_to < 0"), rows.filter("_to >= 0")
    go = running_total(go.withColumn("_gb", spread("_group")), ["_to"], "_gb", ["_group", "_order", "doc_id", "_copy"], "size", "_in")
    fits = F.col("_in") + F.col("size") <= F.element_at(F.array(*(F.lit(r) for r in room)), F.col("_to") + 1)
    go = go.withColumn("shard", F.when(fits, F.col("_to")).otherwise(F.col("shard")))
    return go.select(*linked.columns).union(stay.select(*linked.columns))


def assign(docs: DataFrame, shards: int = 40, rounds: int = 3) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), group (MD5 of the text)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_group"))
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_group").orderBy("size")))
    rows = scratch(rows.withColumn("_bucket", spread("_id")).withColumn("_order", F.md5(F.col("_id").cast("binary"))).drop("_id"), "shards")
    groups = rows.groupBy("_group").agg(F.count("*").alias("_n")).filter("_n > 1").select("_group", F.lit(True).alias("_linked"))
    rows = scratch(rows.join(groups, "_group", "left"), "shards")
    linked, free = rows.filter("_linked").drop("_linked"), rows.filter("_linked is null").drop("_linked")
    cap = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    linked = scratch(deal(linked, [1.0] * shards), "shards")
    for _ in range(rounds):
        linked = scratch(move(linked, cap, shards), "shards")
    done, low = [linked], None
    for tier in (*TIERS, None):
        here = F.lit(True)
        if tier:
            here &= F.col("size") > cap / tier
        if low is not None:
            here &= F.col("size") <= low
        low = cap / tier if tier else None
        used = [sum(x) for x in zip(*(loads(d, shards) for d in done))]
        done.append(scratch(deal(free.filter(here), [max(0.0, cap - x) for x in used]), "shards"))
    everything = done[0]
    for d in done[1:]:
        everything = everything.unionByName(d)
    everything = everything.withColumn("_one", F.lit(1))
    placed = running_total(everything, ["shard"], "_bucket", ["_order", "doc_id", "_copy", "_group"], "_one", "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_group").alias("group")
    )
