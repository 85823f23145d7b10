"""Canonical exact digests of documents."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, uniform, written

#: Documents in a range of ids that one window task orders, on average.
RANGE_DOCS = 2048
#: Stretches of the order at most whose bounds are sampled, and sampled rows for each of them; their ids and hashes are all
#: that the driver gets. A stretch is cut evenly into as many ranges as it needs, so their number has no bound.
STRETCHES, SAMPLED = 4096, 32
#: Ranges whose neighbours one window task finds.
NEIGHBOURS = 4096
#: Digests (32 characters each) up to which the list of repeated ones is broadcast; beyond it, a shuffled join does the same.
BROADCAST_KEYS = 1 << 19


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, and white-space runs as one blank, none at the ends; null is ''."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\p{Z}\x85]+", " "))


def wide_hash(c: Column) -> Column:
    """128 bits: two chained xxhash64 values in hexadecimal."""
    h = lambda *x: F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")
    return F.concat(h(c), h(F.lit("wide"), c))


def _within(place: dict[str, Column], lo: Column, hi: Column, parts: int, key: str) -> Column:
    """Which of the `parts` ranges of the stretch from lo to hi a place is in: by the first column in which the two differ, evenly."""
    own = F.struct(*[c.alias(name) for name, c in place.items()])
    number = lambda c: c.try_cast("double")
    share = F.lit(0.0)
    for name in ("row", "tie", key):
        low, high = number(lo[name]), number(hi[name])
        share = F.when(low < high, (number(place[name]) - low) / (high - low)).otherwise(share)
    share = F.when(lo["no_id"] != hi["no_id"], place["no_id"].cast("double")).otherwise(share)
    inside = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(F.coalesce(share, F.lit(0.0)) * parts)))
    return F.when(own < lo, 0).when(own >= hi, parts - 1).otherwise(inside)


def _range(placed: DataFrame, key: str) -> Column:
    """The number of the range that the row's place (no_id, key, tie, row) falls in; ranges hold about as many rows each.

    Bounds of stretches come from a sample by hash, and a row finds its stretch among them in two steps; a stretch of more
    than RANGE_DOCS rows is cut evenly between its bounds. As a place says which text and which row it is besides the
    key, a key that very many rows share takes many ranges.
    """
    n = placed.count()
    ranges = math.ceil(n / RANGE_DOCS)
    stretches = min(STRETCHES, ranges)
    if ranges < 2:
        return F.lit(0).cast("long")
    names = ("no_id", key, "tie", "row")
    place = F.struct(*names)
    some = placed.filter(uniform(F.lit("bounds"), key, "tie", "row") < min(1.0, stretches * SAMPLED / n)).select(*names)
    found = [dict(zip(names, r, strict=True)) for r in some.orderBy(*names).collect()]
    if not found:
        return F.lit(0).cast("long")
    bounds = [found[len(found) * k // stretches] for k in range(1, stretches)]
    kind = placed.select(place.alias("p")).schema["p"].dataType.simpleString()
    listed = lambda x, of: F.from_json(F.lit(json.dumps(x, default=str)), of)
    stretch = F.lit(0)
    if bounds:
        step = math.isqrt(len(bounds)) + 1
        heads = listed(bounds[::step], f"array<{kind}>")
        groups = listed([bounds[k : k + step] for k in range(0, len(bounds), step)], f"array<array<{kind}>>")
        group = F.size(F.filter(heads, lambda b: b <= place)) - 1
        stretch = F.when(group < 0, 0).otherwise(group * step + F.size(F.filter(F.get(groups, group), lambda b: b <= place)))
    parts = math.ceil(ranges / stretches)
    if parts == 1:
        return stretch.cast("long")
    edges = listed([found[0], *bounds, found[-1]], f"array<{kind}>")
    within = _within({c: F.col(c) for c in names}, F.get(edges, stretch), F.get(edges, stretch + 1), parts, key)
    return stretch.cast("long") * parts + within


def _in_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs(key, text) -> key, tie, range, is_head, text, h, s, next (text, h, s): rows with the next one in order of key.

    h and s are wide hash and SHA-256 of the canonical text, which is made once for each row. Rows with one key are
    ordered by a hash of the text, tie. Text is shuffled once, by ranges of that order; the last row of a range has no
    next, and its first has is_head.
    """
    text = F.coalesce("text", F.lit(""))
    placed = docs.select(F.col(key).isNull().alias("no_id"), key, text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    placed = placed.withColumn("range", F.coalesce(_range(placed, key), F.lit(0).cast("long"))).withColumn("c", canonical(F.col("text")))
    placed = placed.select("range", "no_id", key, "tie", "row", "text", wide_hash(F.col("c")).alias("h"), F.unhex(F.sha2("c", 256)).alias("s"))
    w = W.partitionBy("range").orderBy("no_id", key, "tie", "row")
    return placed.select(key, "tie", "range", F.lag(F.lit(1)).over(w).isNull().alias("is_head"), "text", "h", "s", F.lead(F.struct("text", "h", "s")).over(w).alias("next"))


_MADE = ("n_chars", "edited_sha256", "h", "s", "he", "se", "hn", "sn")


def _edited(rows: DataFrame) -> DataFrame:
    """rows(text, h, s, next, ...) with the columns _MADE."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = rows.withColumns({"n_chars": n.cast("long"), "edited": edited, "hn": F.col("next.h"), "sn": F.col("next.s")}).withColumn("ce", canonical(F.col("edited")))
    return out.withColumns({"edited_sha256": F.sha2("edited", 256), "he": wide_hash(F.col("ce")), "se": F.unhex(F.sha2("ce", 256))})


def _following(ranges: DataFrame) -> DataFrame:
    """ranges(range), each once -> range, following: the next number that is there, and for the last one the first.

    Numbers are put in order in blocks of NEIGHBOURS; only one row for each block passes through one task.
    """
    own = ranges.select("range", F.floor(F.col("range") / NEIGHBOURS).alias("block"))
    blocks = own.groupBy("block").agg(F.min("range").alias("first"))
    blocks = blocks.select("block", F.coalesce(F.lead("first").over(W.orderBy("block")), F.min("first").over(W.partitionBy())).alias("beyond"))
    near = own.withColumn("near", F.lead("range").over(W.partitionBy("block").orderBy("range")))
    return near.join(blocks, "block").select("range", F.coalesce("near", "beyond").alias("following"))


def _with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, tie and _MADE of each row. After the last document comes the first.

    All but the last rows of ranges are done where the range is sorted; those, one for each range, then take the heads of
    the next ranges that have rows.
    """
    rows, own = _edited(_in_order(docs)), F.struct("text", "h", "s")
    kept = ("doc_id", "tie", *_MADE)
    first = written(rows.select(*kept, "range", F.when(F.col("is_head"), own).alias("head"), F.when(F.col("next").isNull(), own).alias("open")), "fingerprints")
    heads = first.filter("head is not null").select("range", "head")
    following = _following(heads).join(heads.select(F.col("range").alias("following"), F.col("head").alias("next")), "following").select("range", "next")
    ends = first.filter("open is not null").select("doc_id", "tie", "range", "open.*").join(following, "range")
    return first.filter("open is null").select(*kept).unionByName(written(_edited(ends).select(*kept), "range-ends"))


def _clashes(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Wide hashes h that different canonical texts have.

    In buckets of documents, texts are compared byte by byte: rows with one hash of the raw text by its smallest and
    largest text, and then a bucket's different raw texts by their canonical forms. Edited texts are compared with
    those of their bucket by SHA-256.
    """
    seen = first.select("h", "s").unionByName(first.select(F.col("he").alias("h"), F.col("se").alias("s")))
    by_digest = seen.groupBy("h").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo != hi").select("h")
    again = first.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    ties = written(first.select("h", "tie").join(again, "h", "left_semi").select(F.col("tie").alias("_tie")).distinct(), "repeated")
    if ties.count() <= BROADCAST_KEYS:
        ties = F.broadcast(ties)
    text = F.coalesce("text", F.lit(""))
    own = docs.select(text.alias("text")).withColumn("_tie", F.xxhash64("text")).join(ties, "_tie", "left_semi")
    ends = own.groupBy("_tie").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    raw = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("text"))
    canon = raw.select(canonical(F.col("text")).alias("c")).withColumn("h", wide_hash(F.col("c")))
    by_bytes = canon.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("h")
    return written(by_digest.unionByName(by_bytes).distinct(), "clashes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the wide hash of the canonical text. Buckets of equal hashes are compared (see _clashes); in one
    that fails, fingerprints get the SHA-256 of the canonical text appended, those of edited texts too. So texts have
    one fingerprint if and only if their canonical texts are equal. Likeness is that of two fingerprints: 1 where they
    are equal, else 0. Minima and maxima are combined before the shuffle, so a group of copies that holds a third of
    all rows sends one text for each task.

    Null text is empty text. Repeated rows and ids each give a row; rows of one id are ordered by a hash of the text. A
    table of one document follows itself. Null ids come last. An empty table gives no rows. Columns other than the two
    are not read.
    """
    first = _with_edited(docs)
    clashes = _clashes(docs, first)
    out = first
    for hashed, sha, name in (("h", "s", "fingerprint"), ("he", "se", "edited_fingerprint"), ("hn", "sn", "next_fingerprint")):
        marked = clashes.select(F.col("h").alias("_h"), F.lit(True).alias("_clash"))
        out = out.join(marked, F.col(hashed) == F.col("_h"), "left")
        out = out.withColumn(name, F.when(F.col("_clash"), F.concat(hashed, F.lit("-"), F.lower(F.hex(sha)))).otherwise(F.col(hashed))).drop("_h", "_clash")
    like = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
