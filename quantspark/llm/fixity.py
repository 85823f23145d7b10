"""Fixity audit of web archives by Merkle trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import copied, table, written

#: Bytes of an archive file that one leaf covers, and children of an inner node.
LEAF_BYTES, FANOUT = 64 << 10, 16


def warc_records(pages: DataFrame, per_file: int = 1024) -> DataFrame:
    """pages(page_id, url, html, ...) -> file, page_id, record: the pages as WARC records, dealt to files.

    A file takes the pages of per_file consecutive ids; pages with null ids are dealt over files -1, -2, ... by hash, so
    many that each has about per_file of them. Null url and html are empty.
    """
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    without_id = pages.filter("page_id is null").count()
    file = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(without_id // per_file + 1)))
    return pages.select(file.alias("file"), "page_id", F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def record_digests(records: DataFrame) -> DataFrame:
    """records(file, page_id, record, ...) -> the manifest (file, offset, length, page_id, digest, ...) of files that hold them by id.

    Lengths and SHA-256 digests are taken where records are read; no record is shuffled. offset is the byte at which a
    record starts in its file, where records are ordered by id (null last) and digest. Sums by id and the start of the
    digest come first, then sums within such a bucket, and records that are equal are numbered in chunks, so that an id
    that very many records share spreads over many tasks. Further columns are kept as they are, whatever their names, but
    for those that have the names of the manifest's own.
    """
    own = ("file", "offset", "length", "page_id", "digest")
    kept = [c for c in records.columns if c not in (*own, "record")]
    more = ["more"] if kept else []
    light = records.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *([F.struct(*[records[c] for c in kept]).alias("more")] if kept else []))
    bucket = ["file", "page_id", "bucket"]
    before = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kinds = light.groupBy(*light.columns).agg(F.count("*").alias("copies"))
    kinds = kinds.withColumn("bytes", F.col("copies") * F.col("length")).withColumn("bucket", F.substring("digest", 1, 2))
    starts = kinds.groupBy(*bucket).agg(F.sum("bytes").alias("bytes")).withColumn("start", before(W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), "bucket")))
    kinds = kinds.withColumn("within", before(W.partitionBy(*bucket).orderBy("digest", *more)))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in bucket]
    placed = kinds.alias("k").join(starts.select(*bucket, "start").alias("s"), same).select("k.*", "start")
    placed = copied(placed, "copies", "nth", ["file", "page_id", "digest"])
    offset = F.col("start") + F.col("within") + F.col("nth") * F.col("length")
    return placed.select("file", offset.cast("long").alias("offset"), "length", "page_id", "digest", *[F.col("more")[c].alias(c) for c in kept])


def _hash_children(order: str, *parts: Column | str) -> Column:
    """SHA-256 over children in order; a node has FANOUT children, or the records that start in one leaf, at most."""
    return F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(order, *parts)))), 256)


def merkle_nodes(digests: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree of every file, level by level: leaves, ..., roots, as (file, node, hash).

    Leaf n covers the records that start in bytes n * leaf_bytes up to the next leaf; node n of a level covers nodes
    n * fanout, ... of the level below. Each file has a root of its own, and files build their trees side by side.
    """
    leaf = F.floor(F.col("offset") / leaf_bytes)
    levels = [written(digests.groupBy("file", leaf.alias("node")).agg(_hash_children("offset", "length", "page_id", "digest").alias("hash")), "merkle-leaves")]
    most = (digests.agg(F.max("offset")).first()[0] or 0) // leaf_bytes
    while most:
        levels.append(_level_above(levels[-1], fanout))
        most //= fanout
    return levels


def _level_above(level: DataFrame, fanout: int) -> DataFrame:
    below = level.select("file", "node", "hash", F.floor(F.col("node") / fanout).alias("up"))
    return written(below.groupBy("file", F.col("up").alias("node")).agg(_hash_children("node", "hash").alias("hash")), "merkle-nodes")


def audit(mine: DataFrame, theirs: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Two manifests (file, offset, length, page_id, digest) -> file, leaf, offset, length, page_id, digest, replica_digest, fault.

    Roots are compared first; each level compares only children of nodes that differ, and records are compared only
    in leaves that differ. One row per record that is not the same in both: fault is changed, missing (not in theirs)
    or extra (only in theirs). The record's place, id and digest are those of mine, for extra records those of theirs.
    Repeated records at one offset are told apart by id and digest. Empty manifests are allowed.
    """
    a, b = written(mine, "manifest"), written(theirs, "replica-manifest")
    ours, other = merkle_nodes(a, leaf_bytes, fanout), merkle_nodes(b, leaf_bytes, fanout)
    while len(ours) != len(other):  # replicas of unlike length: the shorter tree gets levels of single nodes
        less = min(ours, other, key=len)
        less.append(_level_above(less[-1], fanout))
    wrong = None
    for x, y in zip(reversed(ours), reversed(other), strict=True):
        if wrong is not None:
            pick = lambda n: n.withColumn("up", F.floor(F.col("node") / fanout)).join(wrong.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi").drop("up")  # noqa: B023, E731
            x, y = pick(x), pick(y)
        both = x.join(y.withColumnRenamed("hash", "other"), ["file", "node"], "full")
        wrong = written(both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"), "mismatches")
    leaves = wrong.withColumnRenamed("node", "leaf")
    inside = lambda m: m.withColumn("leaf", F.floor(F.col("offset") / leaf_bytes)).join(leaves, ["file", "leaf"], "left_semi")
    same = ["file", "leaf", "offset", "page_id", "again"]
    again = F.row_number().over(W.partitionBy("file", "offset", "page_id").orderBy("digest"))
    p = inside(a).withColumn("again", again)
    q = inside(b).withColumn("again", again).withColumnsRenamed({"length": "other_length", "digest": "replica_digest"})
    ids = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in same]
    on = ids[0]
    for c in ids[1:]:
        on = on & c
    both = p.alias("p").join(q.alias("q"), on, "full")
    fault = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when((F.col("digest") != F.col("replica_digest")) | (F.col("length") != F.col("other_length")), "changed")
    at = lambda c: F.coalesce(f"p.{c}", f"q.{c}").alias(c)
    return both.select(at("file"), at("leaf"), at("offset"), F.coalesce("length", "other_length").alias("length"), at("page_id"), "digest", "replica_digest", fault.alias("fault")).filter("fault is not null")


def damaged_copy(records: DataFrame) -> DataFrame:
    """records(page_id, record, ...) with replica: the record as failing disks leave it in a copy. Of each 97 ids one record
    has a byte changed, and one is lost (null)."""
    k = F.pmod(F.col("page_id") * 31, F.lit(97))
    spoilt = F.when(k == 5, F.concat(F.expr("left(record, length(record) - 5)"), F.lit("#"), F.expr("right(record, 4)"))).otherwise(F.col("record"))
    return records.withColumn("replica", F.when(F.coalesce(k, F.lit(0)) != 11, spoilt))


def op1_warc_fixity(spark, sf_dir: str) -> DataFrame:
    records = damaged_copy(warc_records(table(spark, sf_dir, "pages")))
    manifest = written(record_digests(records.withColumn("replica", F.sha2("replica", 256))), "manifests")
    theirs = manifest.filter("replica is not null").drop("digest").withColumnRenamed("replica", "digest")
    return audit(manifest.drop("replica"), theirs).drop("leaf")


OP1_SQL = r"""
WITH r AS (
  SELECT CAST(floor(page_id / 1024) AS BIGINT) AS file, page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
o AS (SELECT *, CAST(strlen(record) AS BIGINT) AS length,
             CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
      FROM r)
SELECT file, "offset", length, page_id, sha256(record) AS digest,
       CASE WHEN page_id * 31 % 97 = 5 THEN sha256(left(record, length(record) - 5) || '#' || right(record, 4)) END AS replica_digest,
       CASE WHEN page_id * 31 % 97 = 5 THEN 'changed' ELSE 'missing' END AS fault
FROM o WHERE page_id * 31 % 97 IN (5, 11)
"""
