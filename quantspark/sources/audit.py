"""Append-only audit tables as partitioned Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quantspark.schemas import AUDIT, AUDIT_VERSION


#: Tables that are looked up by order, and buckets of their order ids.
BY_ORDER, ORDER_BUCKETS = ("orders", "order_status_events"), 16


def create_audit_tables(spark: SparkSession, database: str = "default", buckets: int = ORDER_BUCKETS) -> None:
    """Makes the tables that do not exist yet; the schema's version is a table property.

    Parts by run stand for an index of run_id, and buckets of order_id for one of order_id: grouping or joining by order
    then needs no shuffle.
    """
    for name, ddl in AUDIT.items():
        bucketed = f"CLUSTERED BY (order_id) SORTED BY (order_id) INTO {buckets} BUCKETS" if name in BY_ORDER else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.audit_{name} ({ddl}) USING parquet PARTITIONED BY (run_id) {bucketed} TBLPROPERTIES ('audit.version' = '{AUDIT_VERSION}')")


def insert_audit(df: DataFrame, name: str, database: str = "default", buckets: int = ORDER_BUCKETS) -> None:
    """Appends rows to a table of create_audit_tables(). Tables by order get one file a run and bucket: a task has whole buckets, and salts deal a bucket's runs to more tasks."""
    table = f"{database}.audit_{name}"
    columns = df.sparkSession.table(table).schema
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in columns])
    if name in BY_ORDER:
        rows = rows.repartition(F.pmod(F.hash("order_id"), F.lit(buckets)), F.pmod(F.xxhash64("run_id"), F.lit(16)))
    rows.write.insertInto(table)


def latest_audit_status(spark: SparkSession, database: str = "default") -> DataFrame:
    """The last status that was recorded of each order, by time and seq; no shuffle, as the table is bucketed by order."""
    return spark.table(f"{database}.audit_order_status_events").groupBy("order_id").agg(F.max_by("status", F.struct("ts_epoch_s", "seq")).alias("status"))


def current_audit_orders(spark: SparkSession, database: str = "default") -> DataFrame:
    """All orders with their last recorded status, else the one they were placed with; the join needs no shuffle either."""
    latest = latest_audit_status(spark, database).withColumnRenamed("status", "_latest")
    return spark.table(f"{database}.audit_orders").join(latest.hint("merge"), "order_id", "left").withColumn("status", F.coalesce("_latest", "status")).drop("_latest")


def append_audit(df: DataFrame, name: str, path: str, batch_id: int | None = None) -> None:
    """Appends rows to an audit table, by run. With a batch id the batch's own folder, of all its runs, is replaced, so a retried batch adds nothing."""
    cols = StructType.fromDDL(AUDIT[name])
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in cols])
    if batch_id is None:
        rows.write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")
    else:
        rows.write.mode("overwrite").parquet(f"{path}/{name}_batches/batch={batch_id}")


def read_audit(spark: SparkSession, name: str, path: str) -> DataFrame:
    """All rows of an audit table: those that jobs have appended, compacted ones, and those of later micro-batches. Without any it is empty.

    A filter on run_id reads the folders of these runs, but for micro-batches that are not compacted yet.
    """
    schema = StructType.fromDDL(AUDIT[name])
    done = _manifest(spark, name, path)
    out = spark.createDataFrame([], schema)
    for folder in (f"{path}/{name}", *[f"{path}/{name}_compacted/{c}" for c in done["folders"]]):
        if (found := _found(spark, folder, schema)) is not None:
            out = out.unionByName(found.select(*schema.names))
    batches = _found(spark, f"{path}/{name}_batches", StructType([*schema, StructField("batch", LongType())]))
    return out if batches is None else out.unionByName(batches.filter(F.col("batch") > done["upto"]).select(*schema.names))


def _found(spark: SparkSession, folder: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def compact_audit(spark: SparkSession, name: str, path: str) -> int:
    """Rewrites the micro-batches that are there as run partitions; returns the last batch that is compacted, -1 without any.

    The new folder counts once the manifest names it, and its batches no longer count from then on. The manifest is one
    file that is renamed into place, so readers see each row once at any time, and a job that dies before or after that
    loses and doubles nothing: what it left behind counts for nothing, and the next run writes its own folder. One
    compaction runs at a time. A batch that is written again after it was compacted counts for nothing either.
    """
    done = _manifest(spark, name, path)
    schema = StructType.fromDDL(AUDIT[name])
    batches = _found(spark, f"{path}/{name}_batches", StructType([*schema, StructField("batch", LongType())]))
    last = None if batches is None else batches.agg(F.max("batch")).first()[0]
    if last is None or last <= done["upto"]:
        return done["upto"]
    folder = f"upto={last}-{uuid.uuid4().hex}"
    rows = batches.filter((F.col("batch") > done["upto"]) & (F.col("batch") <= last)).select(*schema.names)
    rows.repartition("run_id", F.pmod(F.xxhash64("seq") if "seq" in schema.names else F.lit(0).cast("long"), F.lit(4))).write.partitionBy("run_id").parquet(f"{path}/{name}_compacted/{folder}")
    _publish(spark, name, path, {"upto": last, "folders": [*done["folders"], folder]})
    return last


def drop_compacted_batches(spark: SparkSession, name: str, path: str) -> None:
    """Deletes folders of micro-batches that are compacted; for a time at which no reader uses an older manifest."""
    upto = _manifest(spark, name, path)["upto"]
    fs, folder = _file_system(spark, f"{path}/{name}_batches")
    if fs.exists(folder):
        for s in fs.listStatus(folder):
            batch = s.getPath().getName().removeprefix("batch=")
            if batch.isdigit() and int(batch) <= upto:
                fs.delete(s.getPath(), True)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _manifest(spark: SparkSession, name: str, path: str) -> dict:
    """What the newest manifest says: the last batch that is compacted, and the folders that hold them all."""
    fs, folder = _file_system(spark, f"{path}/{name}_manifests")
    found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    versions = sorted(int(f.removesuffix(".json")) for f in found if f.removesuffix(".json").isdigit())
    if not versions:
        return {"upto": -1, "folders": []}
    return json.loads(spark.read.text(f"{path}/{name}_manifests/{versions[-1]}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, name: str, path: str, manifest: dict) -> None:
    """Puts a manifest in place under its last batch, by renaming; the file has all its content when it gets its name."""
    fs, folder = _file_system(spark, f"{path}/{name}_manifests")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs.mkdirs(folder)
    draft = hadoop.Path(folder, f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(draft, hadoop.Path(folder, f"{manifest['upto']}.json")):
        raise OSError(f"manifest of {name} could not be put in place")


def runs_view(run_events: DataFrame) -> DataFrame:
    """run_id, event start or end, ts_epoch_s -> one row per run; the end is null while a run goes on."""
    at = lambda e: F.when(F.col("event") == e, F.col("ts_epoch_s"))
    return run_events.groupBy("run_id").agg(F.min(at("start")).alias("started_epoch_s"), F.max(at("end")).alias("ended_epoch_s"))
