"""What queries read: driver tables, literal tables, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: DuckDB's form of the white space class.
SQL_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. One of fewer splits than there are cores (small, or written as one row group) is dealt
    over the cores first; larger ones are read as they lie."""
    df, cores = source(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def values(columns: str, *rows: tuple) -> str:
    """A literal table in SQL that Spark and DuckDB both read (no backslashes in strings)."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns}))"


def literal(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {sql}")


def sql_fold(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '{SQL_SPACE}', '', 'g')"


def sql_strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"
