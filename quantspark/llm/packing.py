"""Packing documents into training windows by lexical retrieval."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, table, text_batches, uniform, written

WINDOW = 2048
END_ID = 1
#: Bytes of ids in a shard of the index, about, and what a document counts besides its ids; so a shard has 32768 documents at most.
SHARD_BYTES, DOC_BYTES = 4 << 20, 128
#: Bytes of ids in a range of the lexical order, about; a task takes a range at a time and holds one of its shards.
RANGE_BYTES = 8 << 20
#: Stretches of the lexical order at most whose bounds are sampled, and sampled documents for each of them; their keys are all
#: that the driver gets besides term counts. A stretch is cut evenly into as many ranges as it needs.
STRETCHES, SAMPLED = 16384, 16
#: Terms of a document that decide its place in the lexical order.
LEAD_TERMS = 3
#: BM25's constants.
K1, B = 1.2, 0.75
#: One document in so many has a term whose weights an index keeps for all documents.
COMMON = 8
#: Neighbours of a seed that are put in order before the others.
FIRST = 64


@cache
def _encoder(json_path: str, ranks_path: str):
    """text -> ids. The ranks hold the vocabulary of the JSON file; their library encodes it several times as fast.

    Tests compare the two on whole tables and odd strings.
    """
    import tiktoken

    special = "<|endoftext|>"
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # a text that the fast library refuses
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(json_path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def tokenized(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: see _blob(); the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoder(tokenizer, ranks)
        for b in batches:
            out = [_blob(np.append(ids(t or ""), end_id)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def _blob(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned numbers of 32 bits, or of 16 bits and a zero byte where they fit; so an odd length tells."""
    return ids.astype("<u2").tobytes() + b"\0" if ids.max(initial=0) < 1 << 16 else ids.astype("<u4").tobytes()


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2", len(blob) // 2).astype("<u4") if len(blob) % 2 else np.frombuffer(blob, "<u4")


def _size(blob: bytes) -> int:
    """What a document counts in shards and ranges: bytes of its ids as 32-bit numbers, and DOC_BYTES."""
    return 4 * (len(blob) // (2 if len(blob) % 2 else 4)) + DOC_BYTES


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and how many ids there are up to each; numpy.unique without what it does for other types."""
    ids = np.sort(ids)
    last = np.flatnonzero(ids[1:] != ids[:-1])
    ends = np.append(last, len(ids) - 1)
    return ids[ends], ends + 1


class Corpus:
    """What BM25 knows of all documents: their number, their mean length and in how many of them each id is."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.mean, self.df = n, tokens / max(n, 1), df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.shared = np.where(df > 1, self.idf, np.float32(0))

    def terms(self, ids: np.ndarray, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ids of a document, and the weight of each in it."""
        term, ends = _distinct(ids)
        tf = ends.astype(np.float32)
        tf[1:] -= tf[:-1].copy()
        return term, (self.idf if idf is None else idf)[term] * (np.float32(K1 + 1) * tf / (tf + np.float32(K1 * (1 - B + B * len(ids) / self.mean))))

    def lead(self, ids: np.ndarray) -> list[int]:
        """The LEAD_TERMS terms that weigh most among those that other documents have too; -1 where there are fewer."""
        term, weight = self.terms(ids, self.shared)
        if len(term) > LEAD_TERMS:
            most = np.flatnonzero(weight >= np.partition(weight, -LEAD_TERMS)[-LEAD_TERMS])
            term, weight = term[most], weight[most]
        out = [int(term[k]) for k in np.argsort(-weight, kind="stable")[:LEAD_TERMS] if weight[k] > 0]
        return out + [-1] * (LEAD_TERMS - len(out))


def corpus_of(tokens: DataFrame) -> Corpus:
    """Counted over all rows of tokens(ids). A task sends one row for each id at most, so the driver gets the vocabulary's counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        df = np.zeros(1 << 16, np.int64)
        for b in batches:
            for blob in b.column("ids").to_pylist():
                ids = _ids(blob)
                own = _distinct(ids)[0]
                if own[-1] >= len(df):
                    df = np.append(df, np.zeros(int(own[-1]) + 1 - len(df), np.int64))
                df[own] += 1
                n, total = n + 1, total + len(ids)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], there]), pa.int64()), pa.array(np.concatenate([[n, total], df[there]]), pa.int64())], ["id", "n"])

    counts = {r[0]: r[1] for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()}
    df = np.zeros(max([0, *counts]) + 1, np.int64)
    for k, v in counts.items():
        if k >= 0:
            df[k] = v
    return Corpus(counts.get(-2, 0), counts.get(-1, 0), df)


def _keys(corpus: Corpus, blobs: list[bytes]) -> list[tuple[int, int]]:
    """The place of each document in the lexical order: its leading terms, and what tells apart those that agree in them."""
    out = []
    for blob in blobs:
        a, b, c = corpus.lead(_ids(blob))
        out.append((((a + 1) << 40) + ((b + 1) << 20) + c + 1, zlib.crc32(blob)))
    return out


Place = tuple[int, int, int]


def _part(place: Place, lo: Place, hi: Place, parts: int) -> int:
    """Which of the `parts` ranges of the stretch from lo to hi a place is in: by the first number in which the two differ, evenly."""
    if not lo <= place < hi:
        return 0 if place < lo else parts - 1
    own, low, high = next((own, low, high) for own, low, high in zip(place, lo, hi, strict=True) if low != high)
    return min(parts - 1, (own - low) * parts // (high - low))


def _ranged(tokens: DataFrame, corpus: Corpus, edges: list[Place], parts: int) -> DataFrame:
    """tokens(doc_id, ids, row) with the place in the lexical order and the range that this falls in: one of `parts` between two edges."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        bounds = edges[1:-1]
        for b in batches:
            keys = _keys(corpus, b.column("ids").to_pylist())
            at = []
            for (k, crc), row in zip(keys, b.column("row").to_pylist(), strict=True):
                stretch = bisect_right(bounds, (k, crc, row))
                at.append(stretch * parts + (_part((k, crc, row), edges[stretch], edges[stretch + 1], parts) if parts > 1 and edges else 0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([crc for _, crc in keys], pa.int64()), b.column("doc_id"), b.column("ids")], ["range", "lead", "crc", "doc_id", "ids"])

    return tokens.mapInArrow(place, "range long, lead long, crc long, doc_id long, ids binary")


def _edges(tokens: DataFrame, corpus: Corpus, stretches: int, ranges: int) -> list[Place]:
    """Where stretches of about equal sizes start, and the end, from a sample by hash of the contents and the row's number."""
    if ranges < 2:
        return []

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _keys(corpus, b.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([c for _, c in own], pa.int64()), b.column("row"), pa.array([_size(x) for x in b.column("ids").to_pylist()], pa.int64())], ["lead", "crc", "row", "weight"])

    share = min(1.0, stretches * SAMPLED / corpus.n)
    some = tokens.filter(uniform(F.xxhash64("ids"), "doc_id", "row") < share).select("ids", "row")
    found = sorted((tuple(r) for r in some.mapInArrow(keys, "lead long, crc long, row long, weight long").collect()))
    if not found:
        return []
    ends = np.cumsum([x[3] for x in found])
    cut = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, stretches) / stretches))
    return [found[k][:3] for k in (0, *cut, -1)]


class Index:
    """The inverted index of a shard: by term the documents that have it, and its weight in each.

    A term that at least one document in COMMON has keeps a weight for every document (so COMMON times the room of its
    postings at most), any other term its postings. A question reads the terms of its seed only.
    """

    def __init__(self, corpus: Corpus, ids: list[np.ndarray]):
        own = [corpus.terms(x) for x in ids]
        self.n, sizes = len(ids), [len(t) for t, _ in own]
        term = np.concatenate([t for t, _ in own])
        count = np.bincount(term, minlength=len(corpus.df))
        posting, count = (np.cumsum(count > 0) - 1)[term], count[count > 0]
        doc, weight = np.repeat(np.arange(self.n), sizes), np.concatenate([w for _, w in own])
        common = count * COMMON >= self.n
        row = np.cumsum(common) - 1
        dense = common[posting]
        self.dense = np.zeros((int(common.sum()), self.n), np.float32)
        self.dense[row[posting[dense]], doc[dense]] = weight[dense]
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(posting[rare], kind="stable")]
        self.docs, self.weights = doc[rare], weight[rare].astype(np.float64)
        self.begins = np.concatenate([[0], np.cumsum(np.where(common, 0, count))])
        ends = np.cumsum(sizes)
        self.rows = [row[x[common[x]]] for x in np.split(posting, ends[:-1])]
        self.postings = [x[~common[x]] for x in np.split(posting, ends[:-1])]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document for a query of all distinct terms of one."""
        at, ends = self.begins[self.postings[seed]], self.begins[self.postings[seed] + 1]
        sizes = ends - at
        read = np.arange(sizes.sum()) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)
        return self.dense[self.rows[seed]].sum(axis=0) + np.bincount(self.docs[read], weights=self.weights[read], minlength=self.n)


def _best_first(score: np.ndarray) -> Iterator[int]:
    """Documents of any score, the best first; most windows are full after a few, so only those are sorted at once."""
    found = np.flatnonzero(score > 0)
    edge = np.partition(score[found], -FIRST)[-FIRST] if len(found) > FIRST else 0
    for part in (found[score[found] >= edge], found[score[found] < edge]):
        yield from part[np.argsort(-score[part], kind="stable")].tolist()


def windows(ids: list[np.ndarray], index: Index, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    A seed document, and then its unused neighbours by score, fill the window; a document that does not fit is cut and
    its rest is the next window's seed. Without neighbours the next unused document goes on, so only the last window
    of a shard can be short.
    """
    n = len(ids)
    used, at = np.zeros(n, bool), 0
    left = sum(map(len, ids))
    sequence = offset = 0
    seed, rest, queue, fresh = -1, 0, iter(()), True
    while left:
        if rest == 0:
            doc = next((d for d in queue if not used[d]), -1)
            if doc < 0 and fresh and seed >= 0:
                queue, fresh = _best_first(np.where(used, 0, index.scores(seed))), False
                continue
            if doc < 0:
                while used[at]:
                    at += 1
                doc, seed, fresh = at, at, True
            used[doc], rest, current = True, len(ids[doc]), doc
        length = min(rest, window - offset)
        yield current, len(ids[current]) - rest, length, sequence, offset
        rest, offset, left = rest - length, offset + length, left - length
        if offset == window:
            sequence, offset = sequence + 1, 0
            seed, queue, fresh = (current, iter(()), True) if rest else (-1, iter(()), True)


_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(corpus: Corpus, window: int, shard_bytes: int):
    """Rows in the lexical order -> pieces. A run of about shard_bytes in one range is a shard of the index."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight, number, of_range = [], 0, 0, None

        def pieces() -> pa.RecordBatch:
            nonlocal number
            ids = [_ids(x) for _, x in rows]
            out, most = [], 0
            for d, start, length, sequence, offset in windows(ids, Index(corpus, ids), window):
                out.append((rows[d][0], start, length, zlib.crc32(ids[d][start : start + length]), len(ids[d]), (of_range << 32) + number + sequence, offset))
                most = sequence
            number += most + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PIECES)

        for b in batches:
            for r, doc_id, blob in zip(b.column("range").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if rows and (r != of_range or weight + _size(blob) > shard_bytes):
                    yield pieces()
                    rows, weight = [], 0
                if r != of_range:
                    of_range, number = r, 0
                rows.append((doc_id, blob))
                weight += _size(blob)
        if rows:
            yield pieces()

    return pack


def packed(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, ranks: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Documents are tokenized where they are read. Document frequencies, lengths and their number are counted over the
    whole corpus. Documents are then put in a lexical order: by the terms that weigh most in them, so that those with the
    same leading terms, and near copies, stand together. A shard of the BM25 index is a run of that order of about
    shard_bytes; a task holds one at a time, asks it for each seed's neighbours by all terms of the seed, and fills
    windows. The order is cut into ranges, as many as the size of the corpus asks for, by a sample of its keys and evenly
    between them, so a term that leads in a third of all documents, or a group of copies, takes many ranges. A task may
    take several ranges in turn.

    Null and empty texts have the end id alone. Repeated rows and ids are packed each. A document that is longer than a
    window is cut. A shard leaves one window short at most. Rows that agree in all read
    columns are told apart by their number in the written table. An empty table gives no rows. Columns other than the
    two are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = written(tokenized(docs, tokenizer, ranks).withColumn("row", F.monotonically_increasing_id()), "tokens")
    corpus = corpus_of(tokens)
    ranges = max(1, math.ceil((4 * round(corpus.n * corpus.mean) + DOC_BYTES * corpus.n) / max(RANGE_BYTES, shard_bytes)))
    stretches = min(STRETCHES, ranges)
    tasks = min(ranges, max(STRETCHES, partitions(spark)))
    placed = _ranged(tokens, corpus, _edges(tokens, corpus, stretches, ranges), math.ceil(ranges / stretches)).repartition(tasks, "range").sortWithinPartitions("range", "lead", "crc", F.col("doc_id").asc_nulls_last())
    return placed.select("range", "doc_id", "ids").mapInArrow(_pack(corpus, window, shard_bytes), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
