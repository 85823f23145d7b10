"""Classifiers on labels that they have not seen, retrieval against plain BM25, and the pipeline against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_hot_and_clashing import near_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from quantspark.llm import packing
from quantspark.llm.toxicity import features_of, toxicity
from quantspark.llm.urls import fit_urls, parse

TESTDATA = "/root/testdata"


def area_under_curve(scores, labels):
    """Chance that a row of label 1 scores above one of label 0; 0.5 for any constant score."""
    ones, zeros = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_finds_held_out_toxic_documents(spark):
    """A classifier that calls nothing toxic has a recall of 0 and an area of 0.5 here."""
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity(docs, labels).collect() if r.held_out and r.doc_id in known]
    truth = [known[r.doc_id] for r in held]
    assert 20 < sum(truth) < len(truth) / 4
    hits = sum(r.predicted and y for r, y in zip(held, truth, strict=True))
    assert hits >= 0.7 * sum(truth) and hits >= 0.8 * sum(r.predicted for r in held)
    assert area_under_curve([r.score for r in held], truth) > 0.9


def test_toxicity_features_by_hand():
    weigh = {"vile": 4.0, "odd": 2.0}.get
    got = features_of("YOU are a vile 1diot, idiot! So odd", lambda w: weigh(w, 0.0))
    n = 8  # you are a vile 1diot idiot so odd
    assert got[0] == 1 / n and got[1] == math.log1p(1) and got[2] == 4.0 and got[3] == 2.0 and got[4] == 6 / n
    assert got[5] == 1 / n and got[7] == 2 / n and got[8] == 1.0
    text = "YOU are a vile 1diot, idiot! So odd"
    assert got[9] == sum(c.isupper() for c in text) / len(text) and got[11] == 1 / len(text)
    assert features_of(None, lambda w: 0.0) == features_of("", lambda w: 0.0)


def test_url_trees_on_urls_they_have_not_seen(spark):
    """Spam has long numbered paths on some domains; a tenth of the labels are wrong."""
    rng = random.Random(12)
    rows = []
    for _ in range(4000):
        bad = rng.random() < 0.3
        host = rng.choice(["win.biz", "deal.top", "news.org"] if bad else ["news.org", "uni.edu", "town.gov"])
        path = "/".join(f"{rng.randrange(10**6)}" if bad else rng.choice(["about", "people", "2024", "index.html"]) for _ in range(rng.randrange(1, 4)))
        rows.append((f"http://w{rng.randrange(50)}.{host}/{path}?{'a=1&b=2' if bad else ''}", int(bad if rng.random() < 0.9 else not bad), int(bad)))
    df = spark.createDataFrame(rows, "url string, label int, truth int")
    labelled = parse(df, "label", "truth").withColumn("unseen", F.pmod(F.xxhash64("url", F.lit(77)), F.lit(3)) == 0)
    model = fit_urls(labelled.filter("not unseen"), 2000)
    got = model.score(labelled.filter("unseen")).collect()
    base = sum(r.truth for r in got) / len(got)
    assert 0.2 < base < 0.4 and len(got) > 1000
    assert area_under_curve([r.score for r in got][:800], [r.truth for r in got][:800]) > 0.95
    assert sum(r.score >= 0.5 and r.truth for r in got) > 0.85 * sum(r.truth for r in got)


def encoded():
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: [*encode.encode(t or "", add_special_tokens=False).ids, 1]


def plain_bm25(ids, seed):
    """Okapi BM25 of all documents for the distinct terms of one, term by term."""
    n, mean = len(ids), sum(map(len, ids)) / len(ids)
    tfs = [Counter(x) for x in ids]
    out = []
    for tf, x in zip(tfs, ids, strict=True):
        score = 0.0
        for t in set(ids[seed]):
            if t in tf:
                df = sum(t in other for other in tfs)
                score += math.log1p((n - df + 0.5) / (df + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        out.append(score)
    return out


def test_index_scores_are_those_of_plain_bm25(spark, prose):
    encode = encoded()
    texts = [prose(30 + k % 20, k % 25, 60) for k in range(40)]
    tokens = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    corpus = packing.corpus_of(packing.tokenized(tokens.repartition(3), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))
    ids = [np.array(encode(t), "<u4") for t in texts]
    assert corpus.n == 40 and corpus.mean == sum(map(len, ids)) / 40
    index = packing.Index(corpus, ids)
    for seed in (0, 7, 39):
        assert np.allclose(index.scores(seed), plain_bm25([x.tolist() for x in ids], seed), rtol=1e-4)


def test_windows_take_the_best_unused_neighbour(prose):
    """Documents of one topic follow their seed; a window is full before the next begins."""
    encode = encoded()
    texts = [prose(40, 500 + k, 50) if k % 3 else " ".join(random.Random(k).choices([f"topic{j}" for j in range(30)], k=40)) for k in range(30)]
    ids = [np.array(encode(t), "<u4") for t in texts]
    df = np.zeros(1 << 16, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    corpus = packing.Corpus(len(ids), sum(map(len, ids)), df)
    index = packing.Index(corpus, ids)
    pieces = list(packing.windows(ids, index, 1024))
    lengths = defaultdict(int)
    for doc, start, length, sequence, offset in pieces:
        assert offset == lengths[sequence] and length > 0
        lengths[sequence] += length
    sizes = [lengths[s] for s in sorted(lengths)]
    assert all(v == 1024 for v in sizes[:-1]) and sum(sizes) == sum(map(len, ids))
    first = [p[0] for p in pieces if p[3] == 0]
    unused = set(range(len(ids))) - {first[0]}
    score = index.scores(first[0])
    for doc in first[1:]:
        assert score[doc] >= max(score[list(unused)]) - 1e-4
        unused.discard(doc)


def test_an_index_takes_room_for_its_postings_only():
    """Very many short documents: common terms keep a row each, rare ones their postings, and no pair of documents a place."""
    rng = np.random.default_rng(3)
    ids = [np.append(rng.integers(100, 5000, rng.integers(0, 4)), [7] * (k % 3) + [1]).astype("<u4") for k in range(20000)]
    df = np.zeros(1 << 13, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    index = packing.Index(packing.Corpus(len(ids), sum(map(len, ids)), df), ids)
    postings = sum(len(np.unique(x)) for x in ids)
    assert index.dense.size <= packing.COMMON * postings and 0 < len(index.docs) < postings
    own = [set(x.tolist()) for x in ids]
    for seed in (0, 1, 19999):
        score = index.scores(seed)
        assert ((score > 0) == np.array([bool(own[seed] & x) for x in own])).all()


def test_ids_of_either_width_come_back():
    for ids in ([1], [0, 65535], [0, 65536], [1 << 31, 7], list(range(500)), list(range(65000, 66000))):
        blob = packing._blob(np.array(ids, np.uint32))
        assert packing._ids(blob).tolist() == ids and packing._ids(blob).dtype == np.uint32
        assert packing._size(blob) == 4 * len(ids) + packing.DOC_BYTES
        term, ends = packing._distinct(packing._ids(blob + b""))
        assert dict(zip(term.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)) == Counter(ids)


def test_best_neighbours_come_first_and_ties_in_order():
    rng = np.random.default_rng(4)
    for n in (0, 1, packing.FIRST, packing.FIRST + 1, 1000):
        score = rng.integers(0, 12, n).astype(float)
        assert list(packing._best_first(score)) == sorted(np.flatnonzero(score > 0), key=lambda k: (-score[k], k))


def test_neighbours_meet_in_a_shard(spark):
    """Against plain BM25 over the whole table: how good the best neighbour is that a document's own shard holds."""
    rows = [r.text for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("text").orderBy("doc_id").collect()]
    fast = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow = encoded()
    ids = [np.append(fast(t or ""), 1).astype("<u4") for t in rows]
    assert all(x.tolist() == slow(t) for x, t in zip(ids, rows, strict=True))
    df = np.zeros(1 << 16, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    corpus = packing.Corpus(len(ids), sum(map(len, ids)), df)
    order = sorted(range(len(ids)), key=lambda k: packing._keys(corpus, [ids[k].tobytes()]))
    ends = np.cumsum([4 * len(ids[k]) + packing.DOC_BYTES for k in order])
    index = packing.Index(corpus, ids)
    whole = np.stack([index.scores(k) for k in range(len(ids))])
    np.fill_diagonal(whole, 0)

    def reached(order):
        shard = np.zeros(len(ids), int)
        shard[order] = ends // (ends[-1] // 8 + 1)
        best = np.array([whole[k][shard == shard[k]].max() for k in range(len(ids))])
        return (best >= 0.9 * whole.max(axis=1)).mean()

    by_chance = reached(np.random.default_rng(0).permutation(len(ids)))
    assert reached(np.array(order)) > max(0.8, by_chance)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline_by_hand(spark):
    """run() against plain Python: which documents stay (given those that the classifier drops), what is left of their
    texts, how often each is taken, and the ids of every piece."""
    sf = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id not in toxic}
    label = near_by_hand([(i, r.text) for i, r in rows.items()], 5)
    rows = {i: r for i, r in rows.items() if label[i] == i}
    seen, text = set(), {}
    for i in sorted(rows):
        b = (rows[i].text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if (s := b[p : p + 100]) in seen:
                gone[p : p + 100] = True
            seen.add(s)
        text[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    encode = encoded()
    ids = {i: encode(t) for i, t in text.items()}
    size = {i: len(WORD.findall(t)) for i, t in text.items()}
    of_source = defaultdict(int)
    for i in rows:
        of_source[rows[i].source] += size[i]
    weights = dict(zip(sorted(of_source), [3, 1, 2] * len(of_source), strict=False))
    full: set[str] = set()
    while True:
        left = [s for s in of_source if s not in full]
        level = (1.5 * sum(of_source.values()) - sum(2 * of_source[s] for s in full)) / sum(weights[s] for s in left)
        over = {s for s in left if level * weights[s] > 2 * of_source[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * of_source[s] if s in full else level * weights[s] for s in of_source}

    pieces = corpus_pipeline.run(spark, sf).collect()
    by_doc = defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() <= rows.keys()
    taken = defaultdict(int)
    for i in rows:
        own = by_doc.get(i, [])
        copies = sum(r.start == 0 for r in own)
        rate = target[rows[i].source] / of_source[rows[i].source]
        assert math.floor(rate + 1e-9) <= copies <= math.ceil(rate - 1e-9) or size[i] == 0
        taken[rows[i].source] += copies * size[i]
        assert sum(r.length for r in own) == copies * len(ids[i])
        for r in own:
            assert r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    for s in of_source:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in rows if rows[i].source == s) / 2 + 1
    held = defaultdict(list)
    for r in pieces:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) <= 2048
    assert sum(r.length for r in pieces) > 0.9 * 2048 * len(held)
