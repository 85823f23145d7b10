"""Substring dedup: Rabin-Karp hashes of every window of words, counted over the corpus; repeated windows go."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed_rows, partitions, table

#: Words of a window.
WINDOW = 20
#: Bytes of text in a block of documents, which one call of Python holds with all its words.
BLOCK_BYTES = 4 << 20
#: Bytes of text for one range of hashes; a call holds some twenty bytes for each of its windows.
RANGE_BYTES = 16 << 20
#: Odd bases of the two rolling hashes, and the id that rows without one are ordered by.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LAST = np.iinfo(np.int64).max


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _rolled(words: np.ndarray, base: int, window: int) -> np.ndarray:
    """The Rabin-Karp hash of each window of words, from sums of words times powers of the base; then mixed one to one."""
    n = len(words)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * _powers(base, n), dtype=np.uint64)])
    h = (sums[window:] - sums[:-window]) * _powers(pow(base, -1, 1 << 64), n - window + 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Windows:
    """The windows of a block of documents, in order of their hashes. It depends on the rows alone, not on their order.

    The hash of a window has 80 bits: 64 and 16 of two rolling hashes under different bases, over the halves of the words'
    128-bit xxhash. Equal windows are a group; `ids` holds the smallest doc_id of each.
    """

    def __init__(self, doc_ids: np.ndarray, texts: list[bytes | None], window: int):
        self.window = window
        self.words = [(t or b"").split() for t in texts]  # bytes.split() parts at the six ASCII white-space characters
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        known: dict[bytes, int] = defaultdict(count().__next__)
        nth = np.fromiter((known[w] for ws in self.words for w in ws), dtype=np.int64, count=int(self.begins[-1]))
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), dtype="<u8").reshape(-1, 2)
        row = np.repeat(np.arange(len(texts)), self.lengths)
        starts = np.flatnonzero(np.arange(len(nth)) + window <= self.begins[row + 1])
        if not len(starts):
            self.starts, self.first, self.hashes, self.checks, self.ids = starts, starts, np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64)
            self.group, self.again = starts, np.zeros(0, bool)
            return
        h = _rolled(digests[nth, 0], BASES[0], window)[starts]
        check = (_rolled(digests[nth, 1], BASES[1], window)[starts] >> np.uint64(48)).astype(np.uint16)
        owner = row[starts]
        rank = np.argsort(np.argsort(doc_ids, kind="stable"), kind="stable")  # rows in order of doc_id, ties in any
        by_id = np.argsort(rank[owner], kind="stable")
        order = by_id[np.argsort(h[by_id], kind="stable")]
        same = h[order][1:] == h[order][:-1]
        if (same & (check[order][1:] != check[order][:-1])).any():
            order = np.lexsort((starts, rank[owner], check, h))
        self.starts, h, check, owner = starts[order], h[order], check[order], owner[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.hashes, self.checks, self.ids = h[self.first], check[self.first], doc_ids[owner[self.first]]
        later = np.concatenate([[False], owner[1:] == owner[:-1]]) & ~new
        self.again = later | (doc_ids[owner] > self.ids[self.group])

    def covered(self, elsewhere: np.ndarray) -> np.ndarray:
        """Whether a window that goes covers each word of the block; elsewhere says for each group whether a document with a smaller id has it too."""
        gone = self.starts[self.again | elsewhere[self.group]]
        n = int(self.begins[-1]) + 1
        return np.cumsum(np.bincount(gone, minlength=n) - np.bincount(gone + self.window, minlength=n))[:-1] > 0


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte by byte of all their values, so that bytes that hardly change take no room."""
    return pa.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unplaned(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(blob, n * sum(sizes), codec="zstd", asbytes=True), dtype=np.uint8)
    out, at = [], 0
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).reshape(n))
        at += n * s
    return out


def _windows(block: pa.Table, window: int) -> Windows:
    ids, texts = (pc.struct_field(block["doc"], c) for c in ("doc_id", "text"))
    return Windows(ids.cast(pa.int64()).fill_null(LAST).to_numpy(), texts.cast(pa.binary()).to_pylist(), window)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, from 0; hashes are in order, so a range is a slice."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


SENT = "bucket long, block long, n long, entries binary"
FOUND = "block long, bucket long, n long, bits binary"
SPANS = "array<struct<start:long,end:long>>"


def _send(buckets: int, window: int):
    """For each block and range of hashes: hash, check and smallest doc_id of its groups."""

    def send(block: pa.Table) -> pa.Table:
        w = _windows(block, window)
        own = _bucket(w.hashes, buckets)
        present, begins = np.unique(own, return_index=True)
        parts = list(zip(begins, [*begins[1:], len(own)][: len(begins)], strict=True))
        low = [w.ids[a:b].min() for a, b in parts]
        blobs = [_planes(np.diff(w.hashes[a:b], prepend=np.uint64(0)), w.checks[a:b], w.ids[a:b] - m) + int(m).to_bytes(8, "little", signed=True) for (a, b), m in zip(parts, low, strict=True)]
        at = block["block"][0].as_py()
        return pa.table({"bucket": pa.array(present, pa.int64()), "block": pa.array([at] * len(parts), pa.int64()), "n": pa.array([b - a for a, b in parts], pa.int64()), "entries": pa.array(blobs, pa.binary())})

    return send


def _decide(sent: pa.Table) -> pa.Table:
    """For each entry of a range of hashes: whether another block has the window in a document with a smaller id."""
    sizes = sent["n"].to_pylist()
    hashes, checks, ids = [], [], []
    for n, blob in zip(sizes, sent["entries"].to_pylist(), strict=True):
        h, c, i = _unplaned(blob[:-8], n, "<u8", "<u2", "<i8")
        hashes.append(np.cumsum(h, dtype=np.uint64))
        checks.append(c)
        ids.append(i + int.from_bytes(blob[-8:], "little", signed=True))
    h, c, i = np.concatenate(hashes), np.concatenate(checks), np.concatenate(ids)
    order = np.argsort(h, kind="stable")
    if ((h[order][1:] == h[order][:-1]) & (c[order][1:] != c[order][:-1])).any():
        order = np.lexsort((c, h))
    h, c = h[order], c[order]
    begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
    least = np.minimum.reduceat(i[order], begins)
    smaller = np.empty(len(h), dtype=bool)
    smaller[order] = i[order] > np.repeat(least, np.diff(begins, append=len(h)))
    parts = np.split(smaller, np.cumsum(sizes)[:-1])
    bits = [pa.compress(np.packbits(p).tobytes(), codec="zstd", asbytes=True) for p in parts]
    return pa.table({"block": sent["block"], "bucket": sent["bucket"], "n": sent["n"], "bits": pa.array(bits, pa.binary())})


def _apply(window: int):
    """The rows of a block with their repeated words found and taken out."""

    def apply(block: pa.Table, found: pa.Table) -> pa.Table:
        w = _windows(block, window)
        answers = sorted(zip(found["bucket"].to_pylist(), found["n"].to_pylist(), found["bits"].to_pylist(), strict=True))
        elsewhere = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(pa.decompress(b, (n + 7) // 8, codec="zstd", asbytes=True), np.uint8), count=n).astype(bool) for _, n, b in answers]])
        gone = w.covered(elsewhere)
        removed, spans, kept = [], [], []
        for words, a, b in zip(w.words, w.begins[:-1], w.begins[1:], strict=True):
            own = gone[a:b]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
            removed.append(sum(e - s for s, e in edges))
            spans.append([{"start": s, "end": e} for s, e in edges])
            kept.append(b" ".join([x for x, g in zip(words, own.tolist(), strict=True) if not g] if edges else words).decode())
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc": block["doc"], "n_words": pa.array(w.lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, spans_type), "kept": pa.array(kept, pa.string())})

    return apply


def _removed(docs: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """doc (all columns of docs), n_words, n_removed, spans, kept.

    Documents are dealt into blocks by a hash of id and text. A block sends each range of hashes its distinct windows
    with their smallest doc_id, once, however often it has them; the range answers with one bit for each. The exchange
    of texts serves both passes over them.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, ranges = (max(partitions(docs.sparkSession), -(-total // size)) for size in (block_bytes, RANGE_BYTES))
    rows = packed_rows(docs, "doc_id", "text").select("doc", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"))
    sent = rows.groupBy("block").applyInArrow(_send(ranges, window), SENT)
    found = sent.groupBy("bucket").applyInArrow(_decide, FOUND)
    out = StructType([rows.schema["doc"], *StructType.fromDDL(f"n_words long, n_removed long, spans {SPANS}, kept string")])
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_apply(window), out)


def repeated_windows(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_removed, spans, kept.

    A word goes if a window of so many words covers it whose words also start earlier: in a row with a smaller doc_id, or
    earlier in the same row. Windows are judged on the input. spans holds the maximal removed runs as word positions,
    kept the other words joined by one space.

    Rows without an id stand last; rows with equal ids, or none, are not earlier than each other, so repeated rows are
    treated alike. Null texts have no words. A very long text makes a block of its own size. Windows are equal if 80 bits
    of two rolling hashes over 128-bit word hashes are.
    """
    return _removed(docs.select("doc_id", "text"), window, block_bytes).select("doc.doc_id", "n_words", "n_removed", "spans", "kept")


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with their repeated windows taken out of the text; texts that lose nothing stay as they are, other columns too."""
    made = _removed(docs, window, block_bytes)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text")).alias("text")
    return made.select(*[text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def op11_window_repeats(spark, sf_dir: str) -> DataFrame:
    """All documents, with the digest of what is left of their words."""
    made = repeated_windows(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest([array_to_string(w[i:i + 19], ' ') FOR i IN range(1, len(w) - 18)]) AS words, unnest(range(1, len(w) - 18)) AS i FROM d),
g AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY words) < (doc_id, i) AS again FROM s),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM g WHERE again),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
a AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) FILTER (x.p IS NULL) AS kept, count(x.p) AS n_removed FROM k LEFT JOIN x ON x.doc_id = k.doc_id AND x.p = k.p GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""
