"""Window repeats, spelling variants and fill-in-the-middle against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import infill, spelling, windows
from quantspark.llm.infill import SkipList, fill_in_middle, restored
from quantspark.llm.spelling import counted_words, spelling_variants
from quantspark.llm.windows import repeated_windows, without_repeated_windows

TABLES = ["edge", "documents"]


def test_empty_tables(nothing):
    for run in (repeated_windows, without_repeated_windows, fill_in_middle, counted_words, lambda d: spelling_variants(counted_words(d))):
        assert run(nothing).count() == 0


def removed_by_hand(rows, window=20):
    """Positions of the words that go, for each row; rows with equal ids are not earlier than each other."""
    key = lambda i: (i is None, i or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(least.get(k, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        seen, gone = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if least[k] < key(i) or k in seen:
                gone |= set(range(s, s + window))
            seen.add(k)
        out.append((w, gone))
    return out


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("block", [32 << 10, 8 << 20])
def test_windows(request, name, block):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(i), len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _), (w, g) in zip(rows, removed_by_hand(rows), strict=True))
    got = repeated_windows(docs, block_bytes=block).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert any(r.n_removed for r in got)


def test_windows_of_few_words_and_in_one_text(spark):
    """Overlapping repeats within a text, and texts that are equal but for the case or the white space."""
    rows = [(1, "a b a b a b a b"), (2, "A b a b"), (3, "a  b\ta b a"), (4, "x y z"), (5, "q x y z"), (5, "x y z"), (None, "x y z"), (None, "x y z w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 2, 3):
        got = repeated_windows(docs, n, 8).collect()
        want = [(str(i), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _), (w, g) in zip(rows, removed_by_hand(rows, n), strict=True)]
        assert sorted((str(r.doc_id), r.n_removed, r.kept) for r in got) == sorted(want)


def test_windows_keep_columns(edge):
    got = without_repeated_windows(edge)
    assert got.schema.names == edge.schema.names and got.count() == edge.count()
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[6] == "" or texts[6].endswith("tail")
    assert texts[2] is None and texts[4] == " \t\n " and texts[9] == "Ünïcödé  ÄÖ ß ﬁ"
    assert {r.salt for r in got.collect()} == {"y"}


def test_hashes_that_collide_in_part(spark, monkeypatch):
    """Where the 64 bits are equal, the 16 of the other hash tell windows apart."""
    monkeypatch.setattr(windows, "_rolled", lambda words, base, n: np.full(len(words) - n + 1, 7 << 60, np.uint64) if base == windows.BASES[0] else (words[: len(words) - n + 1] << np.uint64(0)))
    ids, texts = np.array([2, 1, 1]), [b"a b c", b"b a", b"c c"]
    w = windows.Windows(ids, texts, 1)
    assert len(w.hashes) == 3 and sorted(w.starts[w.again]) == [0, 1, 2, 6]


def variants_by_hand(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near_by_hand(words):
    """Words by what is left of them without one code point, so that near ones meet."""
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :], k].add(w)
    near = defaultdict(set)
    for (rest, _), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    return near


def check_variants(words, got):
    near = near_by_hand(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    assert sorted(r.word for r in got) == sorted(words)
    for r in got:
        root = r.word
        while form[root]:
            root = form[root]
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (words[r.word], len(near[r.word]), form[r.word], form[r.word] and words[form[r.word]], root), r.word


@pytest.mark.parametrize("name", TABLES)
def test_spelling(request, name):
    docs = request.getfixturevalue(name)
    words = variants_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    counted = counted_words(docs)
    assert {r.word: r.n for r in counted.collect()} == words
    check_variants(words, spelling_variants(counted).collect())


@pytest.mark.parametrize(("block", "tile", "rows"), [(2048, 4096, 256), (3, 5, 4)])
def test_variants_of_any_words(spark, monkeypatch, block, tile, rows):
    """Words of all lengths and scripts, with forms that follow each other; common halves are cut into many blocks."""
    for name, value in (("BLOCK", block), ("TILE", tile), ("ROWS", rows), ("CELLS", 64)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(5)
    words = {}
    for letters in ("ab", "aé漢😀", "abcdefgh"):
        for _ in range(150):
            words["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))] = rng.choice([5, 5, 25, 30, 125, 700, 4000])
    words |= {"k" * 300: 5, "k" * 299 + "l": 30, "k" * 301: 200}
    df = spark.createDataFrame([*words.items(), (None, 9)], "word string, n long").repartition(3)
    check_variants(words, spelling_variants(df).collect())


def test_long_chains_of_forms(spark):
    words = {"chained" + "x" * k: 5 ** (12 - k) for k in range(12)}
    got = {r.word: (r.form, r.root) for r in spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["chained" + "x" * 11] == ("chained" + "x" * 10, "chained") and got["chained"] == (None, "chained")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 40, 3000])
def test_skip_list_finds_every_rank(n):
    rng = random.Random(n)
    text = "".join(rng.choice(["a", "Zz", "é", "😀", " ", "\n", "0", "[", "`", "abc"]) for _ in range(n))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    index = SkipList(text)
    assert index.n == len(units) and (n < 3000 or len(index.lanes) > 3)
    at = [0]
    for u in units:
        at.append(at[-1] + len(u))
    assert [index.seek(k) for k in range(len(units) + 1)] == at


@pytest.mark.parametrize("name", TABLES)
def test_fill_in_middle(request, name):
    docs = request.getfixturevalue(name)
    out = fill_in_middle(docs)
    got = out.withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    forms = Counter()
    for r in got:
        text, units = r.text or "", re.findall("[A-Za-z]+|[^A-Za-z]", r.text or "", re.S)
        d = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        want = ("plain", None, None, text) if plain else ("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == want and r.n == len(units) and r.back == text
        forms[r.form] += 1
    assert set(forms) == {"plain", "psm", "spm"} or name == "edge"
    assert set(docs.columns) <= set(out.columns)


def test_markers_in_texts(spark):
    rows = [(k, t) for k in range(30) for t in ("a <P> b", "x<M>", "<S>", "<<P", "<P<S<M>"[:6], "a<P<", "<M <S", "><P")]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    assert all(r.back == r.text and (r.form == "plain" or not any(m in r.text for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))) for r in got)
