"""Running aggregates by key over many tasks: two passes over buckets of the order, and over buckets of buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of an order that one task holds.
BUCKET = 1 << 16

#: How values run along, and how what an earlier bucket has, a, and what the own one has, b, become one.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def blocks(place: Column, size: int = BUCKET, levels: int = 2) -> list[list[Column]]:
    """Buckets for prefix_scan(): blocks of `size` places (0, 1, ...), blocks of blocks and so on.

    The last level is one block, which places below size ** levels share; a place beyond it fails the query.
    """
    up = [F.floor(place / F.lit(size**k)) for k in range(1, levels + 1)]
    beyond = F.raise_error(F.concat(F.lit(f"place beyond {size}^{levels}: "), place.cast("string"))).cast("long")
    return [*[[c] for c in up[:-1]], [F.when(F.coalesce(up[-1], F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(beyond)]]


#: Days that are told apart before and after 1970; later and earlier times count to the outermost ones.
DAYS = 1 << 22


def days(seconds: Column) -> list[list[Column]]:
    """Buckets for prefix_scan() of an order that begins with a time, in seconds since 1970: days, of which all are one. Null times come first."""
    inside = F.least(F.greatest(seconds, F.lit(-86400.0 * DAYS)), F.lit(86400.0 * (DAYS - 1)))
    day = F.floor(inside / 86400) + F.lit(DAYS)
    return [[day], *blocks(day, 2 * DAYS, 1)]


def prefix_scan(rows: DataFrame, keys: list[str], order: list[str], buckets: list[list[Column]], values: dict[str, tuple[str, Column]], exclusive: bool = False, local: dict[str, Callable[[WindowSpec], Column]] | None = None) -> DataFrame:
    """rows with running aggregates of each key along an order, though no task holds a key's whole history.

    values: name -> (kind of KINDS, value). buckets: from the finest to the coarsest, columns that grow with the order and
    by which a key's rows are parted; a finer bucket lies within one coarser bucket, and the coarsest holds the whole key.
    Each bucket is folded, combined before the shuffle; folds run along within the next coarser bucket by the same means;
    and each row combines what comes before its bucket with what precedes it there. A window thus holds the rows of one
    finest bucket, or one fold for each bucket within a coarser one. With exclusive, a row's own value is left out.
    local: name -> further window column within the finest bucket. Null keys are keys.
    """
    rows = rows.withColumns({f"_k{i}": F.struct(*keys, *b) for i, b in enumerate(buckets)})
    return _scan(rows, 0, len(buckets), order, values, exclusive, local or {}).drop(*[f"_k{i}" for i in range(len(buckets))])


def _scan(rows: DataFrame, level: int, levels: int, order: list[str], values: dict[str, tuple[str, Column]], exclusive: bool, local: dict) -> DataFrame:
    w = W.partitionBy(f"_k{level}").orderBy(*order)
    frame = w.rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    run = lambda name: KINDS[values[name][0]][0](values[name][1]).over(frame)
    out = rows.withColumns({**{f"_own_{n}": run(n) for n in values}, **{n: c(w) for n, c in local.items()}})
    if level + 1 == levels:
        return out.drop(*values).withColumnsRenamed({f"_own_{n}": n for n in values})
    folds = rows.groupBy(*[f"_k{i}" for i in range(level, levels)]).agg(*[_fold(kind, c, order).alias(n) for n, (kind, c) in values.items()])
    before = _scan(folds, level + 1, levels, [f"_k{level}"], {n: (kind, F.col(n)) for n, (kind, _) in values.items()}, True, {})
    before = before.select(F.col(f"_k{level}").alias("_k"), *[F.col(n).alias(f"_before_{n}") for n in values])
    out = out.join(before, F.expr(f"_k{level} = _k"), "left")
    out = out.withColumns({n: KINDS[kind][1](F.col(f"_before_{n}"), F.col(f"_own_{n}")) for n, (kind, _) in values.items()})
    return out.drop("_k", *[f"_before_{n}" for n in values], *[f"_own_{n}" for n in values])


def _fold(kind: str, c: Column, order: list[str]) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), F.struct(*order))) if kind == "last" else KINDS[kind][0](c)
