"""Tables written to the cluster's shared folder, to be read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUILT: dict[tuple, tuple] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where there is no other machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: the cluster needs a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="corvid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what follows scans the result instead of computing it again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def built(name: str, source: DataFrame, build: Callable[[], DataFrame] | None, **layout) -> DataFrame | None:
    """The table that ``build`` makes of ``source``, kept while the source's files stay as they are; without ``build``
    None if there is none yet.

    What tells versions apart is the path, size and time of every file of the source; a changed file builds anew.
    ``layout``: ``order``, columns by which each file's rows are sorted, so that its pages hold few of their values.
    """
    spark = source.sparkSession
    files = source.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"), F.col("_metadata.file_modification_time").cast("string").alias("t"))
    sign = files.distinct().agg(F.count("*"), F.sum(F.xxhash64("p", "n", "t").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, name, *source.inputFiles()[:1], *sign)
    if key not in _BUILT or not exists(spark, _BUILT[key][0]):
        if build is None:
            return None
        df, path = build(), shared_folder(spark)
        if order := layout.get("order"):
            df = df.sortWithinPartitions(*order)
        df.write.parquet(path)
        _BUILT[key] = (path, df.schema)
    path, schema = _BUILT[key]
    return spark.read.schema(schema).parquet(path)
