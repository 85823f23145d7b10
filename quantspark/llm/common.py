"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.sources.shared import shared_dir

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Has Arrow batches hold so many rows and bytes at most from now on, in this session: texts are long, and a worker holds a few batches at once.

    Settings that are lower already stay. They have to hold when a plan runs, so they are not put back.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= most:
            spark.conf.set(key, most)


def packed_rows(docs: DataFrame, *cols: str, name: str = "doc") -> DataFrame:
    """The given columns of docs, and all columns as the struct `name`, so that no name of docs can clash with an operator's own."""
    return docs.select(*[docs[c] for c in cols], F.struct(*[docs[c] for c in docs.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], name: str = "doc") -> DataFrame:
    return df.select(*[F.col(name)[c].alias(c) for c in columns])


#: Copies of one row that a task numbers at a time.
CHUNK = 4096


def copied(rows: DataFrame, count: str, nth: str, keys: list[str]) -> DataFrame:
    """Each row as often as its column `count` says, numbered from 0 in a column `nth`; chunks of copies are dealt by keys to many tasks."""
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK)))).repartition(*keys, "_part")
    last = F.least(F.col(count), (F.col("_part") + 1) * CHUNK) - 1
    return parts.withColumn(nth, F.explode(F.sequence(F.col("_part") * CHUNK, last))).drop("_part", count)


def numbered(rows: DataFrame, nth: str = "nth") -> DataFrame:
    """rows with a column that numbers rows that agree in all columns from 0, and so tells them apart.

    They are counted first, combined before the shuffle, and numbered in chunks on many tasks; so the numbers do not
    depend on how Spark dealt the rows, and a row that is there very often meets no single task.
    """
    return copied(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "_n", nth, rows.columns)


#: Bytes up to which the rows of hot keys are broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows of a key above which it is hot.
HOT_ROWS = 8192


def hot_join(left: DataFrame, right: DataFrame, key: str, size: str, width: Column | int = 64, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once and in `size` how many rows of left have it; size is dropped.

    Rows with keys of more than HOT_ROWS rows stay where they are: their part of right, which has one row for HOT_ROWS
    rows of left at most, is broadcast if its bytes (`width` for a row) are within BROADCAST_BYTES. Other rows are shuffled.
    """
    hot = right.filter(F.col(size) > HOT_ROWS)
    cost = hot.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0]
    right_of = lambda df: df.drop(size)
    if not cost or cost > BROADCAST_BYTES:
        return left.join(right_of(right), key, how)
    near = left.join(F.broadcast(right_of(hot)), key)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return near.unionByName(far.join(right_of(right.filter(F.col(size) <= HOT_ROWS)), key, how))


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))
