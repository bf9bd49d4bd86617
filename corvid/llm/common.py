"""What the training-data operators share: scratch tables, checked broadcasts, running totals, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions.store import shared_root

#: The tables of the running ``cleared`` block.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many short rows may be broadcast.
BROADCAST_ROWS = 100_000
#: A table of at most this many longs may be broadcast (some 16 MB).
BROADCAST_KEYS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` as the needed columns and one of all others, and what selects the original columns from it.

    An operator that carries columns along works on the packed form, so no name can clash with its own.
    """
    quoted = lambda c: F.col(f"`{c}`")
    others = [c for c in docs.columns if c not in needed]
    rest = F.struct(*map(quoted, others)) if others else F.lit(None).cast("string")
    return docs.select(*map(quoted, needed), rest.alias("_rest")), [quoted(c) if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode, where none is set in tests."""
    return shared_root(spark)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a ``scratch`` that also removes the tables written before it within this block: the next step reads its
    result only, and that is complete in the shared folder."""
    made: list[str] = []
    token = _MADE.set(made)

    def settled(df: DataFrame, name: str) -> DataFrame:
        out = scratch(df, name)
        spark = df.sparkSession
        for path in made[:-1]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del made[:-1]
        return out

    try:
        yield settled
    finally:
        _MADE.reset(token)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What is written within this block goes to Python in Arrow batches of at most ``rows`` rows.

    A batch is held by the executor and by its worker, both in buffers of up to twice its size.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``rows`` rows; else leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release() -> None:
    """Give freed memory of this Python worker back: it may live on, idle, while others need the room."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def texts_of(docs: DataFrame, found: DataFrame, key: str = "key", rows: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` joined with ``found`` on ``key`` (a long); of ``docs`` only the rows found move if their keys are few."""
    keys = found.select(key).distinct()
    if keys.limit(rows + 1).count() <= rows:
        docs = docs.join(F.broadcast(keys), key, "left_semi")
    return docs.join(found, key)


def joined_where(docs: DataFrame, found: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` left-joined with ``found`` on ``key``; if few keys are found, the rows of others stay where they are."""
    if found.limit(rows + 1).count() > rows:
        return docs.join(found, key, "left")
    keys = F.broadcast(found.select(key))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name != key]
    rest = docs.join(keys, key, "left_anti").select("*", *none)
    return rest.unionByName(docs.join(keys, key, "left_semi").join(found, key, "left"))


def n_words(text: Column) -> Column:
    """Number of words, null counting 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(*cols: Column | str, bits: int = 12) -> Column:
    """A bucket number from the first ``bits`` (a multiple of 4) bits of an MD5; null-safe."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cols).cast("binary")), 1, bits // 4), 16, 10).cast("int")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each, per ``keys``, by (``bucket``, ``order``).

    In two levels: totals of the buckets of a key are summed first, so that no task sorts all of a hot key.
    ``keys`` and ``bucket`` must not be null.
    """
    part = [*keys, bucket]
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy(*part).agg(F.sum(value).alias("_sum")).select(*part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(start, part)
        .withColumn(out, F.col("_start") + F.col("_inner"))
        .drop("_start", "_inner")
    )


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): rows (node, component), the smallest node of each.

    Alternating large-star and small-star steps; each step is two joins on aggregated minima, each round's
    edges are written to the shared folder. Isolated nodes don't occur in ``edges`` and get no row.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.filter("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = near.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = scratch(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    sign = None
    for _ in range(rounds):
        edges = scratch(star(star(edges, True), False), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge leads from a node to the smallest one
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
