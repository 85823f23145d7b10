"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, numbered, packed_rows, table, uniform, unpacked, written

#: Documents that one fold pairs up in turn; the next level folds what is left of as many blocks.
BLOCK = 128
#: Sources up to which their table is broadcast; beyond it, a shuffled join gives the same rows.
BROADCAST_SOURCES = 1 << 16


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, size) -> source, source_size, n_docs, target: one row per source.

    Sources, by code point with null last, take the weights in turn and share `share` of all sizes. A target stops at
    `cap` times its source's size and the excess goes to the others by weight. With sources ordered by cap / weight,
    the level that every source below its cap reaches is the largest of the levels left after each prefix is filled up.
    Only the table of sources, one row for each, passes through the global windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    everything = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / open_weight)
    target = F.least("cap", F.max("_level").over(everything) * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _pair_up(items: Column) -> Column:
    """Folds an array of (minus_size, doc_id, tie, nth, p) into (carry, done).

    Two documents with fractional copy counts exchange mass in words, in a random direction that keeps both
    expectations, until one of the counts is 0 or 1; that one is done, and the other meets the next document.
    The words that the two hold together never change.
    """
    item = "struct<minus_size:bigint,doc_id:bigint,tie:bigint,nth:bigint,p:double>"

    def meet(acc: Column, new: Column) -> Column:
        old = acc["carry"]
        a, b, x, y = -old["minus_size"], -new["minus_size"], old["p"], new["p"]
        out, back = F.least(a * x, b * (1 - y)), F.least(b * y, a * (1 - x))
        to_new = uniform(old["doc_id"], old["tie"], old["nth"], new["doc_id"], new["tie"], new["nth"]) * (out + back) < back
        x2 = F.when(to_new, F.when(a * x <= b * (1 - y), 0.0).otherwise(x - out / a)).otherwise(F.when(a * (1 - x) <= b * y, 1.0).otherwise(x + back / a))
        y2 = F.when(to_new, F.when(b * (1 - y) <= a * x, 1.0).otherwise(y + out / b)).otherwise(F.when(b * y <= a * (1 - x), 0.0).otherwise(y - back / b))

        def settle(old2: Column, new2: Column) -> Column:
            whole = lambda d: (d["p"] <= 0) | (d["p"] >= 1)
            return F.struct(
                F.when(~whole(old2), old2).when(~whole(new2), new2).alias("carry"),
                F.concat(acc["done"], F.filter(F.array(old2, new2), whole)).alias("done"),
            )

        held = lambda d, p: F.struct(d["minus_size"], d["doc_id"], d["tie"], d["nth"], p.alias("p")).cast(item)
        pair = F.array(F.struct(held(old, x2).alias("o"), held(new, y2).alias("n")))
        return F.when(old.isNull(), F.struct(new.alias("carry"), acc["done"].alias("done"))).otherwise(F.transform(pair, lambda z: settle(z["o"], z["n"]))[0])

    empty = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{item}>").alias("done"))
    return F.aggregate(items, empty, meet)


def _tie() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), "source")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, tie, source, size, source_size, target, copies: one row per row of docs.

    copies is the whole number of times that the mix takes the document. All documents of a source start at target /
    source_size copies; the whole part is taken, and the fractional parts are rounded by pivotal pairs within hashed
    blocks of about `block` documents. What a block leaves over (one document at most) meets the leftovers of `block`
    other blocks at the next level, and so on until one document of each source remains, which is rounded to the
    nearer count. So a source misses its target by half of one document at most. A hot source only has more blocks.

    Texts are read once, for their sizes. Null text counts as size 0. Documents of size 0 take no part in the rounding
    and get the whole part as copies. Null sources form a source of their own. Repeated rows and repeated ids are
    documents in their own right; tie is a digest of text and source that tells repeated ids apart, and rows that agree
    in all three are told apart by number, so that they spread over the blocks. Columns other than the three are not
    read. An empty table gives no rows.
    """
    sized = written(docs.select("doc_id", "source", word_count("text").alias("size"), _tie().alias("tie")), "sizes")
    targets = written(source_targets(sized, weights, share, cap), "targets")
    t = targets.withColumnRenamed("source", "_source")
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = numbered(sized).join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("base", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    keys = ["source", "source_size", "target", "base"]
    row = ["doc_id", "tie", *keys, "size", "copies"]
    n_blocks = F.ceil(F.col("n_docs") / block)
    whole = (F.col("size") == 0) | (F.col("p") == 0)
    dealt = joined.select(*keys, "doc_id", "tie", "nth", "size", "p", F.when(~whole, F.pmod(F.xxhash64("doc_id", "tie", "nth", F.lit(7)), n_blocks)).alias("blk"))
    dealt = written(dealt, "shares")
    parts = [dealt.filter("blk is null").withColumn("copies", F.col("base")).select(*row)]
    items = dealt.filter("blk is not null")
    blocks = -(-(targets.agg(F.max("n_docs")).first()[0] or 0) // block)
    while True:
        member = F.struct((-F.col("size")).alias("minus_size"), "doc_id", "tie", "nth", "p")
        last = blocks <= 1
        folded = items.groupBy(*keys, "blk").agg(F.sort_array(F.collect_list(member)).alias("items"))
        folded = written(folded.select(*keys, "blk", _pair_up(F.col("items")).alias("f")), "folded")
        ended = folded.select(*keys, F.inline("f.done"))
        if last:
            ended = ended.unionByName(folded.filter("f.carry is not null").select(*keys, "f.carry.*"))
        parts.append(ended.withColumn("size", -F.col("minus_size")).withColumn("copies", F.col("base") + F.when(F.col("p") >= 0.5, 1).otherwise(0)).select(*row))
        if last:
            break
        items = folded.filter("f.carry is not null").select(*keys, F.floor(F.col("blk") / block).alias("blk"), "f.carry.*").withColumn("size", -F.col("minus_size")).drop("minus_size")
        blocks = -(-blocks // block)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("base")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in the columns of docs.

    Rows that agree in doc_id, text and source are one document here, taken as often as all of them together.
    """
    taken = mix(docs, **options).groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("id"), F.col("tie").alias("taken_tie"), "copies")
    tied = packed_rows(docs, "doc_id", "text", "source").select("doc_id", _tie().alias("tie"), "doc").dropDuplicates(["doc_id", "tie"])
    both = tied.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("taken_tie")))
    return unpacked(both.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
