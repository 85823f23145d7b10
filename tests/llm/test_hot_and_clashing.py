"""One key that holds a third of all rows, columns with the names that operators use themselves, and files of shards."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import common, fingerprints, packing, setsketch, suffixes, vectors
from quantspark.llm.extendible import shard, write_shards
from quantspark.llm.fixity import audit, record_digests, warc_records
from quantspark.llm.mixing import mix, mixed_documents
from quantspark.llm.packing import packed
from quantspark.llm.setsketch import deduplicated, near_duplicates
from quantspark.llm.suffixes import removal_report, without_repeats
from quantspark.llm.toxicity import drop_toxic, toxicity

#: Names of columns that the operators make on their way.
OWN_NAMES = (
    "_tie _tie_2 _id _copies _again _features _score _raw _vector _probability _class _margin _h _salt _salts _alone _nth _bytes _n _part _clash doc id tie "
    "taken_tie copies drop_id drop_tie features score toxic_score rest spans row range lead crc ids keys regs cid n key blk mb side h s c next page depth prefix entry cell"
).split()


@pytest.fixture(scope="module")
def clashing(spark, prose):
    one = prose(60, 21)
    texts = [(k, prose(50, k)) for k in range(8)] + [(20, one), (21, one + " end"), (22, None), (None, "x y"), (23, ""), (20, one)]
    df = spark.createDataFrame(texts, "doc_id long, text string").select("*", F.lit("s").alias("source"), F.lit("en").alias("lang"))
    return df.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in OWN_NAMES])


def test_columns_with_the_operators_own_names_are_kept(spark, clashing):
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(8)] + [(20, 1)], "doc_id long, toxic int")
    for run in (deduplicated, mixed_documents, without_repeats, lambda d: drop_toxic(d, labels), lambda d: drop_toxic(d, labels.limit(0))):
        out = run(clashing)
        assert out.columns == clashing.columns
        for r in out.collect():
            assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for c in OWN_NAMES)
    n = clashing.count()
    for run in (near_duplicates, mix, removal_report, fingerprints.fingerprints, lambda d: shard(d, 1000), lambda d: toxicity(d, labels)):
        assert run(clashing).count() == n
    assert packed(clashing).filter("start = 0").count() == n


def test_shards_are_written_row_by_row(spark, tmp_path, prose):
    texts = [(k, prose(6, k)) for k in range(60)] + [(7, prose(5, 100 + k)) for k in range(80)] + [(None, "no id " * 9)] * 30 + [(3, "same")] * 25
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("shard", F.lit("mine")).withColumn("page", F.lit(9))
    write_shards(docs, 500, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, texts))
    assert {r.shard_column for r in got.collect()} == {"mine"} and {r.page for r in got.collect()} == {9}
    sizes = got.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert len(sizes) > 10 and all(r.b <= 500 or r.n == 1 for r in sizes)


def third_of_rows(prose, n=240):
    """A third are copies of one row, a third have one id and texts of their own, the rest are as usual."""
    return [(5, prose(20, 1))] * (n // 3) + [(9, prose(12, 1000 + k)) for k in range(n // 3)] + [(100 + k, prose(15, k)) for k in range(n // 3)]


@pytest.mark.parametrize(("per_range", "stretches"), [(7, 4096), (64, 4096), (7, 6), (7, 1)])
def test_fingerprints_in_many_ranges(spark, prose, monkeypatch, per_range, stretches):
    """The ranges hold about as many rows each though one id, and one row, holds a third; an outlier id changes nothing. Where there are
    fewer stretches than ranges, these are cut again; and numbers of ranges are linked in blocks."""
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", per_range)
    monkeypatch.setattr(fingerprints, "STRETCHES", stretches)
    monkeypatch.setattr(fingerprints, "NEIGHBOURS", 5)
    rows = [*third_of_rows(prose), (10**15, "far off"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    tie = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None and -1 or 0, r[0] or 0, tie[r[1]]))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest(), float(t == after)))
    assert sorted(((r.doc_id, r.edited_sha256, r.near_next) for r in got), key=str) == sorted(want, key=str)
    placed = docs.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("row"))
    sizes = [r["count"] for r in placed.groupBy(fingerprints._range(placed, "doc_id").alias("r")).count().collect()]
    assert stretches == 1 or len(sizes) > len(rows) / per_range / 3
    assert stretches < 4096 or max(sizes) <= 4 * per_range + 8


@pytest.mark.parametrize("stretches", [1, 3])
def test_ranges_of_dense_ids_follow_the_table(spark, monkeypatch, stretches):
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", 50)
    monkeypatch.setattr(fingerprints, "STRETCHES", stretches)
    placed = spark.range(4000).select(F.lit(False).alias("no_id"), F.col("id").alias("doc_id"), F.xxhash64("id").alias("tie"), F.col("id").alias("row"))
    got = placed.select("doc_id", fingerprints._range(placed, "doc_id").alias("r")).orderBy("doc_id").collect()
    assert [r.r for r in got] == sorted(r.r for r in got)
    assert max(Counter(r.r for r in got).values()) <= 50 * 4


def test_parts_of_a_stretch_keep_the_order():
    lo, hi = (5, 10, 0), (9, 3, 7)
    places = [(a, b, c) for a in range(3, 12) for b in (0, 3, 10, 20) for c in (0, 7)]
    for low, high in ((lo, hi), ((5, 10, 0), (5, 20, 0)), ((5, 10, 0), (5, 10, 8)), (lo, lo)):
        parts = [packing._part(p, low, high, 4) for p in places]
        assert parts == sorted(parts) and set(parts) <= set(range(4))


def test_packing_in_more_ranges_than_stretches(spark, prose, monkeypatch):
    """A common leading term, one text that holds a third of all rows, and null texts: each id is in one piece, and no sequence is in two ranges."""
    rows = [*third_of_rows(prose, 600), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = packed(docs, window=64).collect()
    monkeypatch.setattr(packing, "RANGE_BYTES", 2000)
    monkeypatch.setattr(packing, "STRETCHES", 4)
    got = packed(docs, window=64, shard_bytes=1000).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 8
    tokens = lambda found: Counter({r: n for r, n in Counter((r.doc_id, r.start + k) for r in found for k in range(r.length)).items()})
    assert tokens(got) == tokens(whole)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]] and sum(n for _, n in own) <= 64


@pytest.mark.parametrize("shards", [1, 7, 100_000])
def test_a_batch_sends_its_runs_once_whatever_the_number_of_shards(shards):
    """Also where one passage fills the batch: what is settled is spread over shards, and a batch makes no more rows than it has runs."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 107, 3000, dtype=np.uint8))] * 40 + [bytes(rng.integers(97, 107, 500, dtype=np.uint8)) for _ in range(20)]
    runs = suffixes.sampled_suffixes(np.arange(len(texts)), texts)
    rows = suffixes._batch(runs, shards).to_pylist()
    assert len({r["shard"] for r in rows}) == len(rows) <= min(shards, len(runs)) and all(0 <= r["shard"] < shards for r in rows)
    sent = np.concatenate([suffixes._runs(r[c]) for r in rows for c in ("main", "repeated", "unclear")])
    assert sorted(sent[["doc", "start", "n"]].tolist()) == sorted(runs[["doc", "start", "n"]].tolist())
    assert shards < 100_000 or max(len(suffixes._runs(r["repeated"])) for r in rows) <= suffixes.PIECE


def test_forced_clashes_of_the_wide_hash(spark, prose, monkeypatch):
    """With a hash of two bits, fingerprints still are equal exactly where canonical texts are."""
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(4)).cast("string"))
    texts = [prose(10, k % 17) for k in range(40)]
    docs = spark.createDataFrame([(k, t.upper() if k % 2 else t + "  ") for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    by_text = defaultdict(set)
    for k, t in enumerate(texts):
        by_text[t.lower()].add(got[k].fingerprint)
        assert got[k].near_next == float(t.lower() == texts[(k + 1) % 40].lower())
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    assert all(r.near_edited == float(r.fingerprint == r.edited_fingerprint) for r in got.values())


def test_mixing_spreads_copies_and_does_not_depend_on_partitions(spark, prose):
    docs = spark.createDataFrame([(*r, "ab"[k % 2]) for k, r in enumerate(third_of_rows(prose))], "doc_id long, text string, source string")
    got = mix(docs, block=8).collect()
    assert len(got) == docs.count()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    assert sorted(map(str, mix(docs.repartition(5), block=8).collect())) == sorted(map(str, got))
    out = mixed_documents(docs, block=8)
    assert out.count() == sum(r.copies for r in got)


def test_manifest_offsets_of_repeated_pages(spark):
    rows = [(7, "http://h/7", "same")] * 400 + [(8, f"http://h/{k}", "x" * (k % 50)) for k in range(400)] + [(None, f"http://n/{k}", None) for k in range(300)] + [(k, f"http://h/{k}", f"p{k}") for k in range(100, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = record_digests(warc_records(pages, per_file=128))
    held = defaultdict(list)
    for r in manifest.collect():
        held[r.file].append((r.offset, r.length, r.page_id))
    assert sum(map(len, held.values())) == len(rows) and len([f for f in held if f < 0]) == 3
    for own in held.values():
        own.sort()
        assert [o for o, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]]
        ids = [p for _, _, p in own if p is not None]
        assert ids == sorted(ids)
    assert audit(manifest, manifest).count() == 0


@pytest.mark.parametrize("empty", [None, "", "a b c", "!?"])
def test_labelled_texts_without_words(spark, prose, empty):
    """Some of the rows that the lexicon is learned from have no word of three letters; they are scored like all others."""
    docs = spark.createDataFrame([(k, empty if k % 3 == 0 else prose(8, k)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    assert sorted(got) == list(range(60)) and len({got[k] for k in range(0, 60, 3)}) == 1 and all(0 <= x <= 1 for x in got.values())


def near_by_hand(texts, words=4):
    sets = {}
    for i, t in texts:
        own = (t or "").lower().split()
        sets[i] = {tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()
    label = {i: i for i in sets}
    order = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in order:
            for b in order:
                if a < b and label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_hot_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    """A bucket that holds a third of all rows goes in many blocks, with its centre's rows sent to them."""
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(16)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(90):
        own = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 2, 4, 6, 8, 10])):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append((k, " ".join(own)))
    texts += [(100 + k, " ".join(f"u{rng.randrange(10**5)}" for _ in range(60))) for k in range(60)]
    texts += [(200, texts[0][1].upper()), (201, "  " + texts[0][1]), (202, None), (203, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == near_by_hand(texts)


def test_hot_group_whose_rows_meet_their_roots_in_shuffles(spark, monkeypatch):
    """Tables over the limit for broadcasts, hot buckets below it: the union of hot and other buckets goes into joins by cid."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(setsketch, "connected_components", lambda edges, real=setsketch.connected_components: real(edges).hint("merge"))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    texts = [(k, " ".join(base[:at] + [f"v{k}"] + base[at + 1 :])) for k, at in enumerate(rng.choices(range(100), k=60))]
    for k in range(12):
        far = set(rng.sample(range(100), 12))
        texts.append((100 + k, " ".join(f"g{k}" if at in far else w for at, w in enumerate(base))))
    for k in range(300):
        own = " ".join(f"u{rng.randrange(10**6)}" for _ in range(12))
        texts += [(1000 + 2 * k, own), (1001 + 2 * k, own + " end")]
    most = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(most)
    spark.conf.set(most, "20k")
    try:
        got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    finally:
        spark.conf.set(most, was)
    hot = near_by_hand([x for x in texts if x[0] < 1000])
    assert got == hot | {k: k - k % 2 for k in range(1000, 1600)}


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_vectors_in_small_cells_and_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "CELL", 24)
    monkeypatch.setattr(vectors, "HOME_BYTES", 8 * 4 * 10)
    monkeypatch.setattr(vectors, "MEMBER_BYTES", 8 * 4 * 30)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 8))
    x = base[np.arange(180) % 9] + rng.normal(size=(180, 8)) * 0.28
    x[60:120] = x[60]
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), 1, 2, 3, 4) for k, v in enumerate(x)], f"vec_id long, embedding {kind}, dim int, cell int, side int, cid long")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(180)
    while True:
        least = np.where(near, label[None, :], 180).min(axis=1)
        new = np.minimum(label, least)
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {k: (int(near[k].sum()), int(label[k])) for k in range(180)}


def test_intermediate_tables_are_in_the_shared_folder(spark):
    path = common.shared_dir(spark)
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    common.written(spark.range(3), "made")
    assert any(n.startswith("made-") for n in set(os.listdir(path)) - before)
