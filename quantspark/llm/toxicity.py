"""Toxicity scores from boosted trees over dense lexical features."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit as fit_trees
from .common import packed_rows, table, text_batches, unpacked, written

#: Common English insults; other words are learned from the labels.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting dumb fool imbecile vermin jerk".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes su sus".split())
#: Most labelled rows of each class that the lexicon is learned from, and most that the trees and the calibration are.
LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS = 4000, 8000, 4000
#: Most entries of the learned lexicon, and toxic rows that an entry is in at least.
LEXICON_WORDS, LEAST_ROWS = 20000, 4
NEAR = 5
_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_][\w@$*!+]*[0-9@$*!+][\w@$*!+]*[^\W\d_]")
_UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "+": None})


def stems(word: str) -> list[str]:
    """The word, and its first four to seven letters where it is longer."""
    return [word, *(word[:n] + "*" for n in range(4, 8) if len(word) > n)]


def features_of(text: str | None, weigh) -> list[float]:
    """weigh(word): how much more usual the word, or a stem of it, is in toxic documents (natural logarithm; 0: not)."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(len(words), 1)
    hits = [(i, w) for i, x in enumerate(words) if (w := weigh(x)) > 0]
    insults = [i for i, x in enumerate(words) if x in INSULTS]
    persons = np.array([i for i, x in enumerate(words) if x in SECOND_PERSON])
    marked = np.array(sorted({i for i, w in hits if w >= 3} | set(insults)))
    near = 0
    if len(marked) and len(persons):
        at = np.searchsorted(persons, marked)
        gap = np.minimum(np.abs(persons[np.clip(at, 0, len(persons) - 1)] - marked), np.abs(persons[np.clip(at - 1, 0, len(persons) - 1)] - marked))
        near = int((gap <= NEAR).sum())
    masked = _MASKED.findall(low)
    unmasked = sum(x.translate(_UNMASK) in INSULTS for x in masked)
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n_bytes = max(int(by_byte.sum()), 1)
    weights = sorted((w for _, w in hits), reverse=True)
    return [
        len(insults) / n, math.log1p(len(insults) + unmasked), weights[0] if weights else 0.0, sum(weights[:3]) / 3, sum(weights) / n,
        sum(w >= 3 for w in weights) / n, math.log1p(sum(w >= 3 for w in weights)), near / n, near / max(len(marked), 1),
        by_byte[65:91].sum() / n_bytes, (by_byte[33:48].sum() + by_byte[58:65].sum()) / n_bytes, by_byte[33] / n_bytes,
        len(masked) / n, float(unmasked), math.log1p(len(words)),
    ]


def features(text: Column | str, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}

        def weigh(word: str) -> float:
            w = known.get(word)
            if w is None:
                if len(known) > 500_000:
                    known.clear()
                w = known[word] = max(lexicon.get(s, 0.0) for s in stems(word))
            return w

        for texts in batches:
            yield pd.Series([features_of(t, weigh) for t in texts])

    return of(text)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """rows(text, toxic), a bounded sample -> weight by stem, for stems much more usual in toxic rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                own = {s for w in set(_WORD.findall((text or "").lower())) if len(w) > 2 for s in stems(w)}
                if own:  # pandas takes an empty list for numbers
                    yield pd.DataFrame({"stem": list(own), "toxic": toxic})

    n, ones = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not ones or ones == n:
        return {}
    per = rows.select("text", "toxic").mapInPandas(each, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    weight = F.log((F.col("bad") + 0.5) / (ones + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (n - ones + 1))
    best = per.filter(F.col("bad") >= LEAST_ROWS).withColumn("weight", weight).filter("weight >= 1.5").orderBy(F.desc("weight"), "stem").limit(LEXICON_WORDS)
    return {r[0]: r[1] for r in best.select("stem", "weight").collect()}


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    trees: Boosted

    def score(self, docs: DataFrame, score: str = "score") -> DataFrame:
        """docs with a column `score` more: 0 to 1, higher where toxic is likelier. Only the text, in full, decides."""
        rows = packed_rows(docs, "text").select("doc", features("text", self.lexicon).alias("features"))
        return self.trees.score(rows, "features", "toxic_score").select(*[F.col("doc")[c].alias(c) for c in docs.columns], F.col("toxic_score").alias(score))


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learns from labels(doc_id, toxic) but for the rows that held_out() keeps back.

    Three disjoint samples, chosen by a hash of doc_id and bounded by the constants above, give the lexicon, the trees
    and the isotonic calibration, so that no stage is judged on the rows that the one before has learned from. Labels
    with nulls do not count; of repeated labels the larger holds. Without labels of both classes every score is the
    rate of toxic labels. The samples, at most LEXICON_ROWS * 2 + TREE_ROWS + CALIBRATION_ROWS ids, are broadcast to
    the documents, whose text is not shuffled.
    """
    text_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~F.coalesce(held_out("doc_id"), F.lit(False)))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5))
    known = known.withColumn("part", part).withColumn("order", F.xxhash64("doc_id", F.lit(4)))
    pick = lambda where, n: known.filter(where).orderBy("order", "doc_id").limit(n)
    words = pick("part < 2 and toxic = 1", LEXICON_ROWS).unionByName(pick("part < 2 and toxic = 0", LEXICON_ROWS))
    sample = words.unionByName(pick("part in (2, 3)", TREE_ROWS)).unionByName(pick("part = 4", CALIBRATION_ROWS))
    sample = sample.select(F.col("doc_id").alias("_id"), "toxic", "part")
    rows = written(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "toxic", "part"), "toxicity-sample")
    lexicon = learn_lexicon(rows.filter("part < 2"))
    fitted = written(rows.filter("part >= 2").repartition(12).select(features("text", lexicon).alias("f"), "toxic", (F.col("part") == 4).alias("held")), "toxicity-features")
    return Toxicity(lexicon, fit_trees(fitted, "f", "toxic", "held"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, repeated rows and null ids included.

    Null and empty texts are scored as documents without words. A null id counts as not held out.
    """
    scored = fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, in its columns, whatever their names are."""
    scored = fit(docs, labels).score(packed_rows(docs, "text"), "score")
    return unpacked(scored.filter("score < 0.5"), docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
