"""Operators on whole texts against brute force, with nulls, empty and very long texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantspark.llm.extendible import shard
from quantspark.llm.fingerprints import fingerprints
from quantspark.llm.mixing import mix, mixed_documents
from quantspark.llm.packing import packed
from quantspark.llm.setsketch import deduplicated, near_duplicates
from quantspark.llm.suffixes import Levels, removal_report, sampled_suffixes, without_repeats

TABLES = ["edge", "documents"]
key = lambda r: (r.doc_id is None, r.doc_id or 0)


def test_empty_tables(nothing):
    for run in (mix, mixed_documents, fingerprints, packed, near_duplicates, deduplicated, removal_report, without_repeats, lambda d: shard(d, 100)):
        assert run(nothing).count() == 0


@pytest.mark.parametrize("name", TABLES)
def test_mixing(request, name):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text", "source").collect()
    got = mix(docs, block=4).collect()
    assert sorted(map(key, got)) == sorted(map(key, rows))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    weights = dict(zip(sorted(sizes), [3, 1, 2] * len(sizes), strict=False))
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in sizes if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / max(sum(weights[s] for s in left), 1)
        over = {s for s in left if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * sizes[s] if s in full else level * weights[s] for s in sizes}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = mix(docs.repartition(3), block=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_repeat_rows(documents):
    copies = {r.doc_id: r.copies for r in mix(documents).collect()}
    out = mixed_documents(documents)
    assert out.columns == documents.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


def canonical(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"[\s\x85]+", " ", nfkc(nfkc(t).casefold())).strip()


@pytest.mark.parametrize("name", TABLES)
def test_fingerprints(request, name):
    rows = request.getfixturevalue(name).select("doc_id", "text").collect()
    got = fingerprints(request.getfixturevalue(name)).collect()
    ordered = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == sorted(want, key=str)
    text_of = {r.doc_id: canonical(r.text or "") for r in rows}
    prints = {(text_of[r.doc_id], r.fingerprint) for r in got}
    assert len(prints) == len({t for t, _ in prints}) == len({f for _, f in prints})


def test_shards(documents, edge):
    for docs, limit in ((documents, 20000), (edge, 600)):
        got = shard(docs, limit).collect()
        assert len(got) == docs.count()
        held = defaultdict(list)
        for r in got:
            held[r.shard, r.page].append(r)
        for own in held.values():
            size = sum(r.n_bytes for r in own)
            assert all(r.shard_bytes == size for r in own) and (size <= limit or len({r.doc_id for r in own if r.n_bytes}) == 1)
        prefixes = {s for s, _ in held}
        assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)


def test_shard_pages_split_one_key(spark):
    docs = spark.createDataFrame([(1, "x" * 10)] * 50 + [(2, "y" * 10)], "doc_id long, text string")
    got = shard(docs, 100)
    assert got.count() == 51 and got.agg(F.max("shard_bytes")).first()[0] <= 100


@pytest.mark.parametrize("sizes", [[60] * 60, [60, 40, 51, 50, 49, 7, 0] * 20, [33] * 90, [250, 60, 99] * 10])
def test_shard_pages_stay_within_the_limit(spark, sizes):
    """Rows of one key that do not divide the limit; a row above it is alone."""
    got = shard(spark.createDataFrame([(1, "x" * n) for n in sizes], "doc_id long, text string"), 100, slack_bits=60).collect()
    assert sorted(r.n_bytes for r in got) == sorted(sizes)
    held = defaultdict(list)
    for r in got:
        held[r.shard, r.page].append(r)
    for own in held.values():
        size = sum(r.n_bytes for r in own)
        assert all(r.shard_bytes == size for r in own) and (size <= 100 or len(own) == 1)


def test_packing(documents, edge):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (documents, edge):
        rows = [(r.doc_id, [*encode.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.select("doc_id", "text").collect()]
        got = packed(docs, shard_bytes=100_000).collect()
        by_sequence = defaultdict(list)
        for r in got:
            by_sequence[r.sequence_id].append(r)
        fill = 0
        for own in by_sequence.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
            fill += (size := sum(r.length for r in own))
            assert size <= 2048
        assert fill / (2048 * len(by_sequence)) > 0.9
        pieces = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str)
        if docs is documents:
            ids = dict(rows)
            for i, start, length, crc, tokens in pieces:
                assert tokens == len(ids[i]) and zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes()) == crc
        assert sum(p[2] for p in pieces) == sum(len(x) for _, x in rows)


def test_special_token_text_is_tokenized_alike(spark):
    text = "a <|endoftext|> b" + "é" * 50 + "^" * 3000
    want = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids) + 1
    assert packed(spark.createDataFrame([(1, text)], "doc_id long, text string")).agg(F.sum("length")).first()[0] == want


def sets_of(t, words=4):
    own = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return frozenset(tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))) if own else frozenset()


@pytest.mark.parametrize("name", TABLES)
def test_near_duplicates(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, sets_of(r.text)) for r in docs.select("doc_id", "text").collect()]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    want = [(i, len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(rows)]
    got = near_duplicates(docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got.collect())
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)


def test_near_copies_in_a_large_group(spark):
    """A base with many edited copies, of which some reach it only through others."""
    import random

    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(300):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5, 9])):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append((k, " ".join(own)))
    rows = [(i, sets_of(t)) for i, t in texts]
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, x in rows:
            for j, y in rows:
                if i < j and label[i] != label[j] and 100 * len(x & y) >= 80 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == label


def removal_by_hand(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for p in range(len(b) - 99):
            if (s := b[p : p + 100]) in seen:
                gone[p : p + 100] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_levels(spark, documents, edge):
    periodic = [(1, "abcdefghij" * 40), (2, "a" * 5000), (3, "a" * 99), (4, "a" * 100), (5, "é" * 80), (6, "xé" * 90), (7, "b" + "a" * 150 + "c"), (8, "abcdefghij" * 9 + "abcdefghiX" * 30)]
    for rows in (periodic, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]):
        got = removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(map(tuple, got.collect())) == sorted(removal_by_hand(rows))
    # rows that agree in id and text are one document with one result
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    want = {r[0]: r for r in removal_by_hand(list(dict.fromkeys(rows)))}
    assert sorted(map(str, (tuple(r) for r in removal_report(edge).collect()))) == sorted(str(want[i]) for i, _ in rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_keep_a_text_of_their_own(spark, prose, parts):
    """In one batch and over several, with strings that are settled as whole runs, string by string, and in a hot prefix."""
    line = "This notice stands in every document and says the same thing each time it is read by anyone at all, always."
    rows = [(1, prose(80, 11)), (2, prose(90, 12)), (3, prose(40, 13) + prose(80, 11) + prose(40, 14)), *((k, f"{prose(12, k)} {line} {prose(12, k + 10**6)}") for k in range(10, 310))]
    want = {r[0]: r for r in removal_by_hand(rows)}
    assert want[2][2] == 0 and want[3][2] > 100
    again = rows + [rows[1], rows[2], rows[2], *rows[3:60]]
    docs = spark.createDataFrame(again, "doc_id long, text string").repartition(parts)
    assert sorted(map(tuple, removal_report(docs).collect())) == sorted(want[i] for i, _ in again)
    # characters are whole bytes here, so what is left is as long as the report says
    assert all(len(r.text) == want[r.doc_id][1] - want[r.doc_id][2] for r in without_repeats(docs).collect())


def test_hot_prefix_in_many_contexts(spark, prose):
    line = "This notice stands in every document and says the same thing each time it is read by anyone at all, always."
    rows = [(k, f"{prose(12, k)} {line} {prose(12, k + 10**6)}") for k in range(700)]
    got = removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(map(tuple, got.collect())) == sorted(removal_by_hand(rows))


def test_strings_that_defeat_one_polynomial_hash(spark):
    """Morse-Thue words and their complements agree in many low bits of a polynomial modulo 2 ** 64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 12))
    flipped = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, flipped), (3, word[:1000] + flipped[:1000]), (4, flipped[77:900] + "c" + word[13:500])]
    got = removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(map(tuple, got.collect())) == sorted(removal_by_hand(rows))


def test_runs_are_equal_only_if_all_hashes_agree():
    runs = sampled_suffixes(np.array([1, 2]), [b"x" * 90 + b"The same bytes stand in both of these texts." * 3] * 2)
    for field in ("key", "content", "wide"):
        a, b = runs[runs["doc"] == 1], runs[runs["doc"] == 2].copy()
        same, other = Levels(), Levels()
        same.add(a), same.add(b), same.scan()
        b[field] ^= np.uint64(1)
        other.add(a), other.add(b), other.scan()
        assert sum(map(len, same.repeated)) == len(b) and sum(map(len, other.repeated)) == 0


def test_without_repeats_keeps_characters_whole(spark):
    rows = [(1, "é" * 200), (2, "z" + "é" * 200 + "w"), (3, None)]
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == "" and got[2] == "zw" and set(got[1]) == {"é"}
