"""Manifests with clashing columns, rules of URLs against SQL, entropy of long URLs, and cells of a small vector join."""

from __future__ import annotations

import math
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quantspark.llm import vectors
from quantspark.llm.fixity import audit, record_digests, warc_records
from quantspark.llm.urls import RULES, _entropy, judge
from quantspark.llm.vectors import near_vectors

SF = "/root/testdata/sf0.001"


def test_manifests_keep_columns_of_any_name(spark):
    pages = spark.createDataFrame([(k % 50, f"http://h/{k}", "x" * (k % 30)) for k in range(120)] + [(3, "http://h/3", "xxx")] * 4, "page_id long, url string, html string")
    records = warc_records(pages, 16)
    plain = record_digests(records)
    names = ("bytes", "bucket", "within", "nth", "copies", "start", "_part", "more", "k", "s", "leaf", "node", "offset", "length", "digest")
    more = record_digests(records.withColumns({n: F.concat(F.lit(f"{n} "), F.col("page_id").cast("string")) for n in names}))
    kept = [n for n in names if n not in ("offset", "length", "digest")]
    assert more.columns == [*plain.columns, *kept]
    assert sorted(map(str, more.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert all(r[n] == f"{n} {r.page_id}" for r in more.collect() for n in kept)
    assert audit(more.select(*plain.columns), plain).count() == 0


def rule_sql():
    """The longest rule that fits, from the fixed list of rules."""
    fits = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}' END" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"coalesce({', '.join(fits)})"


def test_hosts_paths_and_rules_of_all_pages_equal_sql(spark, duck):
    got = judge(spark.read.parquet(f"{SF}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict").collect()
    # after ://, [^/?#]* is the host and [^?#]* what follows; only A to Z are lower-cased
    want = duck.execute(rf"""WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
      l AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u) SELECT page_id, host, path, {rule_sql()} AS rule FROM l""").fetchall()
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, want))
    says = {h + p: v for v, h, p in RULES}
    assert all(r.verdict == says[r.rule] for r in got if r.rule) and any(r.rule for r in got) and {r.verdict for r in got} <= {"allow", "block"}


def test_entropy_of_long_and_odd_texts(spark):
    texts = ["", "a", "aaaa", "abab", "a b.c/ü", "".join(chr(0x4E00 + k % 8000) for k in range(12000)), "z" * 50000]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(1).sortWithinPartitions("k").select(_entropy(F.col("t"))).collect()]
    assert time.time() - began < 60
    for text, bits in zip(texts, got, strict=True):
        n = Counter(text)
        assert abs(bits - -sum(c / len(text) * math.log2(c / len(text)) for c in n.values())) < 1e-9, text[:20]
    assert judge(spark.createDataFrame([(1, "http://" + "h" * 70000 + "/" + texts[5]), (2, "http://a.com/en/")], "page_id long, url string")).count() == 2


def test_small_tables_have_cells_too(spark, monkeypatch):
    """A few hundred clustered vectors: several cells, few of which a vector goes to, and the links of brute force."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(40, 16)) * 0.5 for c in centres])
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    placed = []
    cells = vectors._cells
    monkeypatch.setattr(vectors, "_cells", lambda *a: placed.append(cells(*a)) or placed[-1])
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert got == {k: int(n) - 1 for k, n in enumerate(near.sum(axis=1))} and near.sum() > 2 * len(x)
    homes = placed[0].groupBy("home").count().collect()
    sent = placed[0].agg(F.sum(F.size("cells"))).first()[0]
    assert len(homes) > 1 and sent < len(x) * 1.5
    monkeypatch.setattr(vectors, "CELL", 20)
    assert {r.vec_id: r.n_links for r in near_vectors(df).collect()} == got
    home = {r.home: r["count"] for r in placed[1].groupBy("home").count().collect()}
    came = {r.cell: r["count"] for r in placed[1].select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    compared = sum(n * (n + came.get(c, 0)) for c, n in home.items())
    assert len(home) > 8 and compared < 0.6 * len(x) ** 2
