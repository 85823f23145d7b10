"""Near-duplicates among embedding vectors by an exact metric range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .components import connected_components, forest

#: Pivots (one cell each) for so many distinct vectors, and the most pivots of one length, which are all the vectors on the driver.
CELL, MOST_PIVOTS = 16384, 1024
#: Vectors of one length from which on they have pivots, and so many pivots at least.
FEW, LEAST_PIVOTS = 64, 4
#: Lengths that have pivots, at most; each takes a small job. Vectors of further lengths are compared in blocks of one cell.
MOST_LENGTHS = 64
#: Home vectors and cell members that one task compares at a time, in bytes of single precision.
HOME_BYTES, MEMBER_BYTES = 4 << 20, 16 << 20
STRIP = 512
#: Cells up to which their numbers of blocks are broadcast; beyond it, a shuffled join gives the same rows.
BROADCAST_CELLS = 1 << 16


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(classes: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """cid, copies, dim, embedding, home, cells: the cell of the nearest pivot, and the later cells that may hold a neighbour.

    Two vectors nearer than reach lie at most reach apart in their distance from the plane half-way between two pivots
    (triangle inequality). So two neighbours with homes i < j both lie within reach of the plane between these pivots,
    and it is enough to send the vector at home in i to cell j: every pair meets once, in the later of its two cells.
    """
    gaps = {dim: np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-12)) for dim, p in pivots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.asarray(whole.column("dim"))
            for dim in np.unique(dims):
                b = whole.filter(pa.array(dims == dim))
                home, cells = np.zeros(b.num_rows, np.int32), pa.array([[]] * b.num_rows, pa.list_(pa.int32()))
                if dim in pivots:
                    near = _unit(_matrix(b.column("embedding"), int(dim))) @ pivots[dim].T
                    home = near.argmax(axis=1)
                    lead = near[np.arange(len(home)), home][:, None] - near
                    inside = (lead <= (reach + 1e-9) * gaps[dim][home]) & (np.arange(near.shape[1]) > home[:, None])
                    cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inside.sum(axis=1))]), pa.int32()), pa.array(np.nonzero(inside)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("copies"), b.column("dim"), b.column("embedding"), pa.array(home, pa.int32()), cells], ["cid", "copies", "dim", "embedding", "home", "cells"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("cid", "copies", "dim", "embedding").mapInArrow(place, f"cid long, copies long, dim int, embedding {kind}, home int, cells array<int>")


def _compare(least: float):
    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        """n_links that home vectors of this block and members have with each other, and a forest with the components of the links.

        Members are the vectors that came from other cells, and the home vectors themselves; two home vectors meet where
        the one with the smaller cid is a member.
        """
        dim, side = key[0].as_py(), np.asarray(rows.column("side"))
        cid, copies, x = np.asarray(rows.column("cid")), np.asarray(rows.column("copies")), _unit(_matrix(rows.column("embedding"), dim))
        h, m = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        inner = side == 1
        x32 = x.astype(np.float32)
        xm = np.ascontiguousarray(x32[m].T)
        links, a, b = np.zeros(len(cid), np.int64), [], []
        for at in range(0, len(h), STRIP):
            own = h[at : at + STRIP]
            i, j = np.nonzero(x32[own] @ xm >= least - 1e-4)
            i, j = own[i], m[j]
            keep = ~inner[j] | (cid[j] < cid[i])
            i, j = i[keep], j[keep]
            for part in range(0, len(i), 1 << 16):
                p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                good = np.einsum("ij,ij->i", x[p], x[q]) >= least
                p, q = p[good], q[good]
                links += np.bincount(p, weights=copies[q], minlength=len(cid)).astype(np.int64) + np.bincount(q, weights=copies[p], minlength=len(cid)).astype(np.int64)
                fi, fj = forest(p, q, len(cid))
                a.append(fi)
                b.append(fj)
        a, b = forest(np.concatenate(a), np.concatenate(b), len(cid)) if a else (np.empty(0, np.int64),) * 2
        some = np.flatnonzero(links)
        blank = np.concatenate([np.ones(len(some), bool), np.zeros(len(b), bool)])
        return pa.table({"cid": pa.array(cid[np.concatenate([some, a])], pa.int64()), "other": pa.array(cid[np.concatenate([some, b])], pa.int64(), mask=blank), "links": pa.array(np.concatenate([links[some], np.zeros(len(b), np.int64)]), pa.int64())})

    return compare


def _pivots(classes: DataFrame, dim: int, n: int) -> np.ndarray:
    sample = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "cid").limit(min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-n // CELL)))).select("embedding").collect()
    return _unit(np.array([r[0] for r in sample], dtype=np.float64))


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> vec_id, n_links, component_id, kept: one row per row of vectors.

    Links pairs with cosine >= least, compared in double precision (single precision only rules out pairs that are
    clearly below). Equal vectors are one class with a count, so copies are never paired. Pivots are a bounded sample
    by hash; each class goes to its nearest pivot's cell and to every later cell within reach, and each cell compares its
    own vectors with each other and with those that came to it, in blocks of bounded size. Only counts and spanning
    forests leave a block, never pairs. Where distances concentrate (unrelated vectors of many dimensions), nearly all
    cells are within reach and the join compares nearly all pairs of classes, as any exact join would.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Arrays of any numbers will do; those that are no float are compared as doubles. Repeated ids are
    vectors of their own; null ids link like others, and a component's id is its smallest id that is not null. Columns
    other than the two are not read. An empty table gives no rows.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding")
    rows = vectors.select("vec_id", (e if kind == "array<float>" else e.cast("array<double>")).alias("embedding"))
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    grouped = rows.filter(sound).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), "copies", "least_id", "embedding", F.size("embedding").alias("dim")), "vector-classes")
    # the most usual lengths of more than FEW vectors have pivots; the vectors of any other length are one cell
    large = classes.groupBy("dim").count().filter(F.col("count") > FEW).orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    pivots = {dim: _pivots(classes, dim, n) for dim, n in large}
    placed = written(_cells(classes, pivots, math.sqrt(2 - 2 * least)), "vector-cells")
    homes = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.count("*").alias("n_home"))
    members = placed.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("n_member"))
    blocks = lambda n, size: F.greatest(F.ceil(n * F.col("dim") * 4 / size), F.lit(1)).cast("int")
    cells = homes.join(members, ["dim", "cell"], "left").withColumn("n_member", F.coalesce("n_member", F.lit(0)) + F.col("n_home"))
    cells = written(cells.select("dim", "cell", blocks(F.col("n_home"), HOME_BYTES).alias("hbs"), blocks(F.col("n_member"), MEMBER_BYTES).alias("mbs")), "cells")
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = F.xxhash64("cid")
    own = ["cid", "copies", "embedding", "dim"]
    home = placed.select(*own, F.col("home").alias("cell"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    came = placed.select(*own, F.explode("cells").alias("cell"), F.lit(2).alias("side"))
    both = home.unionByName(came).join(cells, ["dim", "cell"])
    as_home = both.filter("side = 0").withColumn("hb", F.pmod(hashed, F.col("hbs")).cast("int")).withColumn("mb", every("mbs"))
    as_member = both.filter("side > 0").withColumn("mb", F.pmod(hashed, F.col("mbs")).cast("int")).withColumn("hb", every("hbs"))
    dealt = as_home.unionByName(as_member).select("dim", "cell", "hb", "mb", "side", "cid", "copies", "embedding")
    found = dealt.groupBy("dim", "cell", "hb", "mb").applyInArrow(_compare(least), "cid long, other long, links long")
    found = written(found, "vector-links")
    links = found.filter("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("other is not null").select(F.col("cid").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "cid")
    rooted = classes.join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least_ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = rooted.join(least_ids, "root").select(F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(of_class, F.col("embedding") == F.col("_e"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_metric_range_join(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs; for small tables.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b ON a.vec_id <> b.vec_id
         WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(i, j) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN link l ON l.i = r.j),
component AS (SELECT i AS vec_id, min(j) AS component_id FROM reach GROUP BY i)
SELECT e.vec_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id)
LEFT JOIN (SELECT i AS vec_id, count(*) AS n_links FROM link GROUP BY i) c USING (vec_id)
"""
