"""Reading a table as a stream, and running a stream over what is there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.sources.shared import shared_dir, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream; a file's name is written as a pattern, since Spark takes a plain path to be a folder."""
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(re.sub(r"[A-Za-z0-9](?=[^A-Za-z0-9]*$)", lambda c: f"[{c[0]}]", path, count=1))


#: Rows of a micro-batch for each of its files, and files of a batch at most.
FILE_ROWS, FILES = 1 << 18, 4096


def in_files(rows: DataFrame, order: str, files: int = 3) -> str:
    """Writes rows to a folder as so many files, one after another, the least values of order first; for streams of several batches.

    Each file passes one task; fed() is for tables of any size.
    """
    return _in_batches(rows, order, files, 1)[0]


def fed(rows: DataFrame, order: str, batches: int = 3) -> DataFrame:
    """rows as a stream of so many micro-batches, the least values of order first.

    All batches have the same number of files, as FILE_ROWS asks for in the smallest, and a trigger reads so many. So tasks
    that write and read a batch grow in number with it.
    """
    path, files = _in_batches(rows, order, batches, FILES)
    return read_stream(rows.sparkSession, path, files)


def _in_batches(rows: DataFrame, order: str, batches: int, most: int) -> tuple[str, int]:
    """Writes rows batch after batch to a folder; returns it and the number of files of each batch, up to `most`.

    Rows are made once. They are dealt to files in turn, so no file is left out, as some task has more rows than there are files.
    """
    rows = written(rows, "rows") if batches > 1 or most > 1 else rows
    path = f"{shared_dir(rows.sparkSession)}/feed-{uuid.uuid4().hex}"
    cuts = rows.agg(F.percentile_approx(order, [(k + 1) / batches for k in range(batches - 1)])).first()[0] or [] if batches > 1 else []
    own = lambda k: (F.lit(True) if k == 0 else F.col(order) > F.lit(cuts[k - 1])) & (F.col(order) <= F.lit(cuts[k]) if k < len(cuts) else F.lit(True))
    files = 1
    if most > 1:
        sizes = rows.agg(*[F.count(F.when(own(k), 1)) for k in range(len(cuts) + 1)]).first()
        files = max(1, min(most, min(sizes) // FILE_ROWS))
    for k in range(len(cuts) + 1):
        rows.filter(own(k)).repartition(files).write.mode("append").parquet(path)
    return path, files


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now and returns what its sink, a Parquet table in the shared folder, then holds."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
