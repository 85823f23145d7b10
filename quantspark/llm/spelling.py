"""Spelling variants: words that one edit parts, found by tiles of code-point matrices."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: A run of letters, and the letters that are lower-cased.
RUN, UPPER, LOWER = "[A-Za-z\\u00C0-\\u00FF]+", string.ascii_uppercase, string.ascii_lowercase
#: Every so many runs, by hash, one code point is taken out.
ONE_IN = 199
#: Code points and occurrences of a word.
LEAST_CHARS, LEAST_COUNT = 6, 5
#: How often a form must be there for one of its variant.
TIMES = 5
#: Words of one half that a block holds, words of a tile of rarer halves, and rows that are compared at a time.
BLOCK, TILE, ROWS = 2048, 4096, 256
#: Code points of pairs that are compared at a time.
CELLS = 1 << 22


def counted_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """docs(doc_id, text, ...) -> word, n: runs of letters with A-Z lower-cased, one code point of one in 199 taken out.

    Null and empty texts have none; a null id counts as empty in the hash. Counts are combined before the shuffle, so a
    very common word sends one row from each task.
    """
    found = F.filter(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= least_chars)
    runs = docs.select("doc_id", F.explode(found).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % ONE_IN == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """A row for each word and half that it may share with a near word: lengths of the pair, side, half.

    Of a near pair whose longer word has b code points, the common prefix and suffix have b - 1 or more together, so one
    of them has (b - 1) // 2. A word is the shorter or the longer one of a pair, or both are equally long.
    """
    size = F.length("word")
    kinds = F.array(*[F.struct((size + a).cast("int").alias("short"), (size + b).cast("int").alias("long")) for a, b in ((-1, 0), (0, 0), (0, 1))])
    rows = words.select("word", "n", F.explode(kinds).alias("pair")).select("word", "n", "pair.*").filter("short >= 0 and long > 0").withColumn("k", F.expr("(long - 1) div 2").cast("int"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), F.col("k")).alias("half")), F.struct(F.lit(1).alias("side"), F.when(F.col("k") > 0, F.expr("right(word, k)")).otherwise("").alias("half")))
    return rows.select("word", "n", "short", "long", F.explode(sides).alias("s")).select("word", "n", "short", "long", "s.*")


def _tiles(words: DataFrame) -> DataFrame:
    """Rows of _halves() dealt to tiles: short, long, side, tile, one, other.

    Halves that more than BLOCK words share are cut into blocks, and each pair of blocks is a tile; others are put
    together by hash. A row knows its own block (`one`) and the tile's other one.
    """
    rows = _halves(words)
    key = ["short", "long", "side", "half"]
    common = rows.groupBy(*key).agg(F.count("*").alias("shared")).filter(F.col("shared") > BLOCK)
    kinds = rows.groupBy("short", "long").agg(F.expr(f"(count(*) div {2 * TILE}) + 1").alias("tiles"))
    rows = rows.join(common, key, "left").join(kinds, ["short", "long"])
    blocks = F.expr(f"(shared div {BLOCK}) + 1")
    rows = rows.withColumn("one", F.when(F.col("shared").isNotNull(), F.pmod(F.xxhash64("word"), blocks)))
    rows = rows.withColumn("other", F.explode(F.when(F.col("shared").isNotNull(), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(None).cast("long")))))
    rare = F.pmod(F.xxhash64("half"), F.col("tiles")).cast("string")
    tile = F.concat_ws(" ", F.least("one", "other").cast("string"), F.greatest("one", "other").cast("string"), "half")
    return rows.select("word", "n", "short", "long", "side", "half", F.coalesce(F.when(F.col("shared").isNotNull(), tile), rare).alias("tile"), F.coalesce("one", F.lit(-1)).alias("one"), F.coalesce("other", F.lit(-1)).alias("other"))


def _matrix(words: list[str], width: int, turned: bool) -> np.ndarray:
    """Code points of words, a row each, padded with zeros at the end; turned round, words begin with their last one."""
    return np.array([w[::-1] for w in words] if turned else words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points each row of a has in common with that of b from the begin on."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


NEAR = "word string, n_near long, form_n long, form string"


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words in a tile: for each word how many, and the one that is there most often (ties: the smallest)."""
    short, long, side = (int(rows[c].iloc[0]) for c in ("short", "long", "side"))
    rows = rows.sort_values("half", kind="stable", ignore_index=True)
    words, n = rows["word"].tolist(), rows["n"].to_numpy()
    sizes = np.array([len(w) for w in words])
    begins, ends = _matrix(words, long, False), _matrix(words, long, True)
    half = pd.factorize(rows["half"])[0]
    last = np.searchsorted(half, half, side="right")
    part, split = rows["one"].to_numpy(), bool((rows["one"] != rows["other"]).any())
    k = (long - 1) // 2
    lefts, rights = [], []
    step = max(1, CELLS // max(long, 1))
    for s in range(0, len(rows), ROWS):
        e = min(s + ROWS, len(rows))
        for c in range(s, last[e - 1], ROWS * 4):
            d = min(c + ROWS * 4, last[e - 1])
            fits = half[s:e, None] == half[None, c:d]
            if short == long:
                fits &= np.arange(s, e)[:, None] < np.arange(c, d)[None, :]
            else:  # one of each length, in either order
                fits &= (sizes[s:e, None] != sizes[None, c:d]) & (np.arange(s, e)[:, None] < np.arange(c, d)[None, :])
            if split:
                fits &= part[s:e, None] != part[None, c:d]
            i, j = np.nonzero(fits)
            for t in range(0, len(i), step):
                a, b = i[t : t + step] + s, j[t : t + step] + c
                prefix = np.minimum(_common(begins[a], begins[b]), short)
                suffix = np.minimum(_common(ends[a], ends[b]), short)
                near = prefix + suffix >= long - 1
                if side == 1:  # pairs with a common first half are found there
                    near &= prefix < k
                lefts.append(a[near])
                rights.append(b[near])
    left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (lefts, rights))
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=lambda x: (-n[x], words[x]))] = np.arange(len(rows))
    best = np.full(len(rows), len(rows))
    np.minimum.at(best, left, rank[right])
    np.minimum.at(best, right, rank[left])
    found = np.bincount(left, minlength=len(rows)) + np.bincount(right, minlength=len(rows))
    at = np.empty(len(rows), np.int64)
    at[rank] = np.arange(len(rows))
    hit = np.flatnonzero(found)
    form = at[best[hit]]
    text = lambda at: pd.Series([words[x] for x in at], dtype=object)
    return pd.DataFrame({"word": text(hit), "n_near": found[hit], "form_n": n[form], "form": text(form)})


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words(word, n), each word once -> word, form, root, n, n_near, form_n.

    Two words are near if exactly one code point is inserted, deleted or replaced: their common prefix and suffix reach the
    longer length less one. form is the near word of largest n (ties: the smallest) if its n is `times` that of the word,
    root the end of the forms that follow each other. Null words are left out; words of any length and script will do.

    Near words share their first or last half, so words meet in tiles by halves; within a tile all rows with one half are
    compared densely. A half that very many words share is cut into blocks whose pairs are tiles of their own.
    """
    words = written(words.filter("word is not null").select("word", "n"), "words")
    near = _tiles(words).groupBy("short", "long", "side", "tile").applyInPandas(_compare, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    follows = (-F.col("best.less")) >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"))
    found = written(found, "forms")
    forms = found.filter("form is not null").select("word", "form")
    roots = written(forms.withColumnRenamed("form", "root"), "roots")
    # n grows with each step, so the chains end; each round doubles what is followed
    while True:
        hops = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root").select("word", "next")
        further = written(roots.join(hops, "word", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_forms(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with the usual spelling of each."""
    return spelling_variants(counted_words(table(spark, sf_dir, "documents")))
