"""Near-duplicate documents by SetSketch registers, banded, estimated by likelihood and verified on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, packed_rows, table, text_batches, unpacked, written
from .components import connected_components, forest

#: Registers of a sketch, and how many of them make a band. At similarity 0.8 two documents share no band with
#: probability (1 - 0.8 ** 4) ** 32, about 5e-8.
REGISTERS, BAND = 128, 4
#: Base of the exponential spacing of register values.
BASE = 1.001
#: Standard errors below the threshold at which an estimate still goes to verification.
ERRORS = 5
#: Rows of a bucket, and bytes of their texts, that one task holds on each side of a comparison, about.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Columns of a dense block of shingles when many intersections are counted.
COLUMNS = 4096
#: Rows up to which a list of ids is broadcast; beyond it, a shuffled join does the same.
BROADCAST_ROWS = 1 << 18

_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_TOP = math.log(40) / math.log(BASE)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * m
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: runs of `words` words, A to Z in lower case; shorter texts are one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(len(each) - words + 1, 1)
    out = np.full(n, min(len(each), words), np.uint64)
    for k in range(min(words, len(each))):
        out = _mix(out ^ each[k : k + n], _M1)
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Minima of REGISTERS hash functions, truncated to exponentially spaced values; the maximum merges two sketches."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (np.multiply.outer(_A, x[at : at + 2048]) + _B[:, None]).min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(_TOP - np.log(exponential) / math.log(BASE)), 0, 65535).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    own = regs.view("<u8")
    return _mix(_mix(own, _M1) + np.arange(1, len(own) + 1, dtype=np.uint64) * _M2, _M1).view(np.int64)


_GRID = np.linspace(0, 1, 101)[None, :]


def estimate(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the registers that are equal, larger in a and larger in b, and both set sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = _GRID * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    in_a, in_b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = more[:, None] * np.log(in_a + tiny) + less[:, None] * np.log(in_b + tiny) + equal[:, None] * np.log(np.maximum(1 - in_a - in_b, 0) + tiny)
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketch(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, regs, keys = [], [], [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text, words)
                n.append(len(h))
                d1.append(int(_mix(h, _M1).sum().view(np.int64)))
                d2.append(int(_mix(h ^ _M1, _M2).sum().view(np.int64)))
                r = registers(h) if len(h) else None
                regs.append(None if r is None else r.tobytes())
                keys.append(None if r is None else band_keys(r))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), b.column("bytes"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tie", "bytes", "n", "d1", "d2", "regs", "keys"])

    return sketch


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, classes: DataFrame, cut: float) -> DataFrame:
    """pairs(a, b) whose estimated similarity is at least cut."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                p, q = _regs(x.column("r_a")), _regs(x.column("r_b"))
                near = estimate((p == q).sum(axis=1), (p > q).sum(axis=1), (p < q).sum(axis=1), np.asarray(x.column("n_a"), float), np.asarray(x.column("n_b"), float)) >= cut
                yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(near)), x.column("b").filter(pa.array(near))], ["a", "b"])

    counts = pairs.groupBy("a").agg(F.count("*").alias("size"))
    both = hot_join(pairs.join(two, "b"), one.join(counts, "a"), "a", "size", width=4 * REGISTERS)
    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs(a, b) that reach the similarity on their full sets. The text of an a with very many partners goes to them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(64)(lambda t: shingles(t, words))
        for x in batches:
            a, b = [], []
            for i, j, s, t in zip(*(x.column(c).to_pylist() for c in ("a", "b", "t_a", "t_b")), strict=True):
                p, q = cached(s), cached(t)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    one, two = texts.toDF("a", "t_a"), texts.toDF("b", "t_b")
    counts = pairs.groupBy("a").agg(F.count("*").alias("size"))
    both = hot_join(pairs.join(two, "b"), one.join(counts, "a"), "a", "size", width=F.octet_length("t_a") + 64)
    return both.select("a", "b", "t_a", "t_b").mapInArrow(check, "a long, b long")


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and sets j: singly for few pairs, else as products of blocks of columns."""
    if len(i) < 2000:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    left, li = np.unique(i, return_inverse=True)
    right, rj = np.unique(j, return_inverse=True)
    both = np.concatenate([left, right])
    row = np.repeat(np.arange(len(both)), [len(sets[k]) for k in both])
    _, column, count = np.unique(np.concatenate([sets[k] for k in both]), return_inverse=True, return_counts=True)
    often = count[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        own = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        dense = np.zeros((len(both), COLUMNS), np.float32)
        dense[row[own], column[own] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out[li, rj].astype(np.int64)


def _across(words: int, percent: int, cut: float):
    def across(key: tuple, rows: pa.Table) -> pa.Table:
        """A forest with the components of the links between rows of one bucket that were in different components.

        Rows of side 0 are outside the bucket's largest component; they meet those of side 1, which are of any. A pair that
        shares several bands is looked at in the first of them only. Registers rule out most pairs, and the others are
        verified on their full sets.
        """
        cid, root, n, side = (np.asarray(rows.column(c)) for c in ("cid", "root", "n", "side"))
        major = np.asarray(rows.column("major"))
        regs = _regs(rows.column("regs"))
        keys = np.asarray(rows.column("keys").combine_chunks().flatten()).reshape(len(cid), -1)
        band = int((keys[0] == key[0].as_py()).argmax())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        texts, sets = rows.column("text"), {}
        out_i, out_j = [], []
        step = max(1, (1 << 20) // (len(right) + 1))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            small, large = np.minimum(n[own][:, None], n[right]), np.maximum(n[own][:, None], n[right])
            once = major[right] | (cid[own][:, None] < cid[right])
            i, j = np.nonzero((root[own][:, None] != root[right]) & once & (100 * small >= percent * large))
            i, j = own[i], right[j]
            good = np.zeros(len(i), bool)
            for a in range(0, len(i), 1 << 14):
                p, q = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                here = ~(keys[p, :band] == keys[q, :band]).any(axis=1)
                p, q = p[here], q[here]
                near = estimate((regs[p] == regs[q]).sum(axis=1), (regs[p] > regs[q]).sum(axis=1), (regs[p] < regs[q]).sum(axis=1), n[p].astype(float), n[q].astype(float)) >= cut
                good[a + np.flatnonzero(here)[near]] = True
            i, j = i[good], j[good]
            if len(i):
                used = np.unique(np.concatenate([i, j]))
                for k in used:
                    if k not in sets:
                        sets[k] = shingles(texts[int(k)].as_py(), words)
                both = _shared(sets, i, j)
                linked = 100 * both >= percent * (n[i] + n[j] - both)
                out_i.append(i[linked])
                out_j.append(j[linked])
        node, top = forest(np.concatenate(out_i), np.concatenate(out_j), len(cid)) if out_i else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(cid[node], pa.int64()), "b": pa.array(cid[top], pa.int64())})

    return across


def _in_buckets(members: DataFrame, classes: DataFrame, texts: DataFrame, roots: DataFrame, words: int, percent: int, cut: float) -> DataFrame:
    """Links (a, b) that join components within buckets that hold several.

    What is outside a bucket's largest component is dealt to blocks (mb), and all of the bucket to others (blk); a task
    takes one of each. So a bucket of very many rows, nearly all of which are in one component, is split into tasks and
    its rows are copied once.

    The placed rows are written before they are dealt: where there are hot buckets they are a union, and Spark may plan a
    union of such unions as partitioned by cid and then run it as not partitioned, which fails in the next join by cid.
    """
    rooted = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    per = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max(F.struct("n", "root", "bytes"))
    mixed = per.groupBy("key").agg(F.sum("n").alias("size"), F.sum("bytes").alias("bytes"), most.alias("most"), F.count("*").alias("roots")).filter("roots > 1 and size > 2")
    blocks = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("int")
    mixed = mixed.select("key", F.col("most.root").alias("top"), blocks(F.col("size"), F.col("bytes")).alias("blks"), blocks(F.col("size") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("mbs"), "size")
    placed = hot_join(rooted.select("key", "cid", "root", "n"), written(mixed, "mixed-buckets"), "key", "size")
    placed = written(placed, "placed").withColumn("major", F.col("root") == F.col("top"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    all_rows = placed.withColumns({"side": F.lit(1), "blk": at("blks", 1)}).withColumn("mb", every("mbs"))
    outside = placed.filter("not major").withColumns({"side": F.lit(0), "mb": at("mbs", 2)}).withColumn("blk", every("blks"))
    dealt = all_rows.unionByName(outside).select("key", "mb", "blk", "side", "major", "cid", "root", "n")
    rows = dealt.join(classes.select("cid", "regs", "keys"), "cid").join(texts, "cid")
    return rows.groupBy("key", "mb", "blk").applyInArrow(_across(words, percent, cut), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, tie, n_shingles, component_id, kept, stays: one row per row of docs.

    Two documents are linked where 100 * |A n B| >= percent * |A u B| for their sets of shingles. Equal texts are one
    class (by 64 bits of the text's hash, 128 of the set's and its size), so copies are never paired; texts that differ are
    linked on their full sets only, even where these are equal. Each class has a sketch, whose bands deal it to buckets.
    In every bucket the class with the least number is estimated and then verified against the others; that joins nearly
    all of a group of near copies with one pair for each. What is in different components afterwards within one bucket is
    compared there, block by block, by registers first and then on full sets. So no pair that shares a band, and whose
    estimate is within ERRORS standard errors of the threshold, goes unseen; a task hands on a spanning forest of the links
    it finds, never pairs.

    component_id is the smallest id reachable by links; kept holds where it is the row's own id, and stays holds for
    one row of each component, that with the least (doc_id, tie), tie being a hash of the text. Documents without
    words have n_shingles 0, link with nothing and stay. Repeated rows and ids are rows of their own. Null ids come
    after all others in a component; a component of null ids only has a null id, and kept is false there.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    sketches = written(rows.mapInArrow(_sketch(words), "doc_id long, tie long, bytes long, n long, d1 long, d2 long, regs binary, keys array<long>"), "sketches")
    same = ["tie", "d1", "d2", "n"]
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    grouped = sketches.filter("n > 0").groupBy(*same).agg(F.min(who).alias("who"), F.count("*").alias("size"), F.first("bytes").alias("bytes"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "set-classes")
    bands = classes.select("cid", "n", "bytes", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("centre")).filter("size > 1")
    members = written(hot_join(bands, written(shared, "shared-bands"), "key", "size"), "buckets")

    cut = percent / 100 - ERRORS * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    stars = written(members.filter("cid != centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct(), "stars")
    near = written(_estimated(stars, classes, cut), "candidates")
    texts = _texts(docs, classes, members)
    links = written(_verified(near, texts, words, percent), "links")
    roots = connected_components(links.toDF("src", "dst"))
    more = written(_in_buckets(members, classes, texts, roots, words, percent, cut), "links")
    if not more.isEmpty():
        of = lambda c: roots.toDF(c, f"root_{c}")
        between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("src"), F.coalesce("root_b", "b").alias("dst"))
        upper = connected_components(between)
        roots = classes.select(F.col("cid").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = written(roots.join(upper.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")

    rooted = classes.select(*same, "who", "size", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = rooted.groupBy("root").agg(F.min("who").alias("first"))
    of_class = written(rooted.join(first, "root").select(F.struct(*same).alias("class"), "size", "first"), "classes-first")
    out = hot_join(sketches.select("doc_id", "tie", "n", F.struct(*same).alias("class")), of_class, "class", "size", how="left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), stays.alias("stays"))


def _texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """cid, text of the classes that share a bucket with another."""
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("who.doc_id").alias("_id"), F.col("who.tie").alias("_tie"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tie")))
    return written(rows.select("cid", "text").dropDuplicates(["cid"]), "texts")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of docs, and all rows without words, in the columns of docs."""
    found = written(near_duplicates(docs, **options).select("doc_id", "tie", "stays"), "near-duplicates")
    out = packed_rows(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("tie"), "doc")
    drop = found.filter("not stays").select(F.col("doc_id").alias("drop_id"), F.col("tie").alias("drop_tie")).distinct()
    again = found.filter("stays").groupBy("doc_id", "tie").count().filter("count > 1")
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    out = out.join(drop, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("tie") == F.col("drop_tie")), "left_anti")
    if not again.isEmpty():
        out = out.dropDuplicates(["doc_id", "tie"])
    return unpacked(out, docs.columns)


def op8_setsketch(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
