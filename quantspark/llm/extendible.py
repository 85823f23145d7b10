"""Sharding by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed_rows, table, written

#: Bits of the hash; rows that agree in all of them are cut into overflow pages.
BITS = 60
#: Bits that the directory grows by where some of its entries still hold too much.
STEP = 8


def hash_of(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _entry(deep: int) -> Column:
    return F.shiftright("h", BITS - deep)


def directory(sizes: DataFrame, limit: int, slack_bits: int = 4) -> list[tuple[int, DataFrame]]:
    """sizes(h, bytes), one row for each hash -> [(bits, entries(entry, depth, prefix, shard_bytes)), ...].

    An entry of the first table covers the hashes with that prefix of so many bits; entries that lead to a bucket over
    the limit are missing there and are split on STEP more bits in the next table, and so on. A hash that alone is over
    the limit cannot be split: it is left out of the tables, though its bytes count in all buckets above it.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    lo, deep = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + slack_bits))
    found = []
    while True:
        cells = sizes.groupBy(_entry(deep).alias("cell")).agg(F.sum("bytes").alias("b"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(lo), F.lit(deep))))
        sums = written(levels.groupBy("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix")).agg(F.sum("b").alias("shard_bytes")), "bucket-sums")
        # a bucket is one that fits and whose parent does not; a parent has two children at most
        over = sums.filter(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        buckets = sums.filter((F.col("shard_bytes") <= limit) & (F.col("depth") == lo)).unionByName(sums.filter((F.col("shard_bytes") <= limit) & (F.col("depth") > lo)).join(over, ["depth", "prefix"]))
        first = F.expr(f"shiftleft(prefix, {deep} - depth)")
        entries = buckets.withColumn("entry", F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {deep} - depth)") - 1)))
        found.append((deep, written(entries.select("entry", "depth", "prefix", "shard_bytes"), "directory")))
        full = sums.filter((F.col("depth") == deep) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("cell"))
        left = sizes.withColumn("cell", _entry(deep)).join(full, "cell").drop("cell")
        shared = left.groupBy(_entry(deep).alias("cell")).agg(F.count("*").alias("n")).filter("n > 1").select("cell")
        sizes = written(left.withColumn("cell", _entry(deep)).join(shared, "cell").drop("cell"), "unplaced")
        if deep == BITS or sizes.isEmpty():
            return found
        lo, deep = deep + 1, min(BITS, deep + STEP)


def place(rows: DataFrame, sizes: DataFrame, limit: int, slack_bits: int = 4) -> DataFrame:
    """rows(h, n_bytes, row, ...) with shard, depth, page, shard_bytes; sizes is that of directory(), of the same rows."""
    parts, left, own = [], rows, rows.columns
    for deep, entries in directory(sizes, limit, slack_bits):
        # most rows of a hot hash meet one entry; adaptive execution splits such a join
        met = left.withColumn("entry", _entry(deep)).join(entries, "entry", "left").drop("entry")
        parts.append(met.filter("depth is not null"))
        left = met.filter("depth is null").select(*own)
    fit = parts[0]
    for p in parts[1:]:
        fit = fit.unionByName(p)
    fit = fit.withColumn("page", F.lit(0).cast("long"))
    hot = sizes.filter(F.col("bytes") > limit).select(F.col("h").alias("_h"), F.col("bytes").alias("_bytes"))
    if not hot.isEmpty():
        full = left.join(hot, F.col("h") == F.col("_h"))
        # in a salt, a row over half the limit is a page of its own; others whose running sums end in the same half come to the limit at most
        salts = F.ceil(2 * F.col("_bytes") / limit)
        alone = 2 * F.col("n_bytes") > limit
        full = full.withColumn("_salts", salts).withColumn("_salt", F.pmod(F.xxhash64("row"), F.col("_salts"))).withColumn("_alone", alone)
        order = W.partitionBy("h", "_salt", "_alone").orderBy("n_bytes", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
        full = full.withColumn("_nth", F.when(F.col("_alone"), F.row_number().over(W.partitionBy("h", "_salt", "_alone").orderBy("n_bytes", "row"))).otherwise(F.floor(2 * (F.greatest(F.sum("n_bytes").over(order), F.lit(1)) - 1) / limit)))
        full = full.withColumn("shard_bytes", F.sum("n_bytes").over(W.partitionBy("h", "_salt", "_alone", "_nth")))
        number = (2 * F.col("_nth") + F.col("_alone").cast("long")) * F.col("_salts") + F.col("_salt")
        fit = fit.unionByName(full.select(*own, F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", number.cast("long").alias("page")))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return fit.select(*own, bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "page", "shard_bytes")


def _rows(docs: DataFrame, key: str, *more: Column | str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(*more, hash_of(key).alias("h"), size.alias("n_bytes"), F.monotonically_increasing_id().alias("row"))


def _sizes(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("h").agg(F.sum("n_bytes").alias("bytes")), "hash-sizes")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", slack_bits: int = 4) -> DataFrame:
    """docs(key, text, ...) -> key, n_bytes, shard, depth, page, shard_bytes: one row per row of docs.

    The hash of the key is read bit by bit. A bucket over `limit` bytes splits on the next bit and others stay, so shards
    have prefixes of different depths: the shortest prefixes whose bytes fit. The text itself is never shuffled, and is
    read once: byte counts are summed by hash and then by prefix, the directory maps prefixes a few bits longer than the
    average shard needs to shards, and only entries that are too large even there are refined.

    shard is the prefix as a string of bits ('' at depth 0), page is 0. Rows that agree in all bits (repeated keys, null
    keys) cannot be told apart by splitting; where they exceed the limit, their shard has all bits and they are cut, by
    row size, into numbered pages within the limit (numbers may have gaps). A single row above the limit is a page of
    its own. Null text has 0 bytes. An empty table gives no rows. Columns other than the two are not read.
    """
    rows = written(_rows(docs, key, F.col(key).alias("key")), "row-sizes")
    out = place(rows, _sizes(rows), limit, slack_bits)
    return out.select(F.col("key").alias(key), "n_bytes", "shard", "depth", "page", "shard_bytes")


def write_shards(docs: DataFrame, limit: int, path: str, key: str = "doc_id") -> None:
    """Writes docs, each row once, with one folder per shard and page below path: shard=s<bits>-<page>.

    A column of docs that is itself named shard is written as shard_column.
    """
    columns = docs.columns
    rows = packed_rows(docs, *dict.fromkeys([key, "text"]))
    placed = place(_rows(rows, key, "doc"), _sizes(_rows(docs, key)), limit)
    names = {c: "shard_column" if c == "shard" else c for c in columns}
    flat = placed.select(F.concat_ws("-", F.concat(F.lit("s"), "shard"), F.col("page").cast("string")).alias("_folder"), "doc")
    flat = flat.select("_folder", *[F.col("doc")[c].alias(names[c]) for c in columns])
    flat.withColumnRenamed("_folder", "shard").write.partitionBy("shard").parquet(path)


LIMIT = 1 << 20


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), LIMIT)


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes) AS shard_bytes
      FROM d CROSS JOIN (SELECT unnest(range(0, 41))::INTEGER AS depth) GROUP BY ALL HAVING sum(n_bytes) <= {LIMIT}),
leaf AS (SELECT d.doc_id, d.n_bytes, s.depth, s.prefix, s.shard_bytes
         FROM d JOIN s ON s.prefix = d.h >> ({BITS} - s.depth)
         QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY s.depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM leaf
"""
