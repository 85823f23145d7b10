"""Vectors, archives, URLs and toxicity against brute force or held-out labels."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quantspark.llm.components import connected_components
from quantspark.llm.fixity import audit, merkle_nodes, record_digests, warc_records
from quantspark.llm.toxicity import drop_toxic, toxicity
from quantspark.llm.urls import RULES, judge
from quantspark.llm.vectors import near_vectors

SF = "/root/testdata/sf0.001"


def components_by_hand(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (500, 501), (501, 500)]
    got = connected_components(spark.createDataFrame([*links, (None, 3)], "src long, dst long")).collect()
    want = components_by_hand({x for e in links for x in e}, links)
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    by_hand = {}
    for n, root in want.items():
        by_hand.setdefault(root, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in by_hand.values() if len(g) > 1)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(k, [float(x) for x in base[k % 12] * (1 + k) + rng.normal(size=8) * 0.2 * (k % 3) * (1 + k)]) for k in range(150)]
    rows += [(1000 + k, rows[0][1]) for k in range(40)]  # equal vectors
    odd = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [math.inf] + [0.0] * 7), (2005, [math.nan] + [1.0] * 7), (2006, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in [*rows, *odd]], "vec_id long, embedding array<float>, label int, cid long")
    x = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    roots = components_by_hand(ids, links)
    want = {i: (int(n), roots[i]) for i, n in zip(ids, near.sum(axis=1), strict=True)} | {i: (0, i) for i, _ in odd}
    got = near_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors(df.limit(0)).count() == 0


def test_fixity_finds_each_fault(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * (1 + k % 40)) for k in range(3000)] + [(None, None, None), (7, "http://h/7", "twice")], "page_id long, url string, html string")
    mine = record_digests(warc_records(pages, per_file=512))
    assert len(merkle_nodes(mine, 1024, 4)) > 2
    assert audit(mine, mine, 1024, 4).count() == 0
    theirs = mine.filter("page_id is null or page_id != 1234").withColumn("digest", F.when(F.col("page_id") == 2000, "bad").otherwise(F.col("digest")))
    theirs = theirs.unionByName(spark.createDataFrame([(99, 0, 10, 5555, "new")], "file long, offset long, length long, page_id long, digest string"))
    got = audit(mine, theirs, 1024, 4).collect()
    assert sorted((r.page_id, r.fault) for r in got) == [(1234, "missing"), (2000, "changed"), (5555, "extra")]
    none = mine.limit(0)
    assert audit(none, none).count() == 0 and audit(mine, none).count() == mine.count()


def test_urls(spark):
    rows = [
        (1, "http://a.com/en/1", "www"), (2, "HTTP://Sub.EXAMPLE.com/en/77?x=1", None), (3, "http://x.net/de/1", ""), (4, "http://example.net/de/8", ""), (5, "http://my.org/es/#t", ""),
        (6, None, ""), (7, "no scheme", ""), (8, "http://other.org/fr/", ""), (9, "http://a.com", ""), (9, "http://a.com", ""), (10, "x://y.org/es/a://b.com/en/", ""), (11, "http://acom/en/", ""), (12, "", ""),
    ]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(rows)
    assert by[1] == ("a.com", "/en/1", "com/en/", "block") and by[2] == ("sub.example.com", "/en/77", "example.com/en/7", "allow") and by[3][2:] == ("net/de/", "allow")
    assert by[4][2:] == ("example.net/de/8", "block") and by[5] == ("my.org", "/es/", "org/es/", "block") and by[6][:3] == ("", "", None) == by[7][:3] and by[9][:3] == ("a.com", "", None)
    assert by[10][:3] == ("y.org", "/es/a://b.com/en/", "org/es/") and by[11][2] is None
    assert {v[3] for v in by.values()} <= {"allow", "block"}
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_learn_the_labels(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['a', 'bb', 'ccc'])}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(10**6)}" for _ in range(1500)]
    got = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    ruled = got.filter("rule is not null").withColumn("model", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    assert ruled.filter("model = verdict").count() > 0.9 * ruled.count()
    assert RULES[0] == ("block", "com", "/en/")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in held) / len(held)
    assert right > 0.9


def test_toxicity_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 0, 0), (6, 1, 1), (6, 1, 0), (None, 1, 1), (7, None, None), (12, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity(edge, labels).count() == edge.count() and toxicity(nothing, labels).count() == 0
    assert {r.score for r in toxicity(edge, labels.limit(0)).collect()} == {0.0}
    kept = drop_toxic(edge, labels)
    assert kept.columns == edge.columns
