"""Removal of repeated passages by winnowing: sampled suffixes in the order of their hashes, in a logarithmic family of levels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_batches, written

#: Bytes of a repeated string, and bytes of the prefix by which a suffix is sampled.
LENGTH, PREFIX = 100, 32
#: Bytes of text that are hashed at a time; a longer text goes in overlapping segments.
SEGMENT = 1 << 18
#: Bytes of text whose suffixes are sorted at a time; a worker holds the runs of so much.
BATCH_BYTES = 8 << 20
#: Bytes of text for each shard of the hash order.
SHARD_BYTES = 8 << 20
#: Different contexts of one prefix in one batch above which all of them go straight to the comparison window by window.
MANY = 256
#: Runs that are settled within a batch which go to one shard together.
PIECE = 1024

#: Bases of the two polynomial hashes of a string.
_MUL, _MUL_2 = 6364136223846793005, 2862933555777941757
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _POWER_2 = _powers(_MUL, SEGMENT + 1), _powers(_MUL_2, SEGMENT + 1)
_INVERSE, _INVERSE_2 = _powers(pow(_MUL, -1, 1 << 64), SEGMENT + 1), _powers(pow(_MUL_2, -1, 1 << 64), SEGMENT + 1)
_POS = _U((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _prefix_sums(text: np.ndarray, power: np.ndarray = _POWER) -> np.ndarray:
    out = np.empty(len(text) + 1, np.uint64)
    out[0] = 0
    np.cumsum((text.astype(np.uint64) + _U(1)) * power[: len(text)], out=out[1:])
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts (or a part of one), and for each text in it: which, where it starts here, and where this part starts in the text."""
    own, base, which, at = [], [], [], 0
    starts = []
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for a in range(0, max(1, len(t) - LENGTH + 1), SEGMENT - LENGTH + 1):
            part = t[a : a + SEGMENT]
            if at + len(part) > SEGMENT and own:
                yield np.frombuffer(b"".join(own), np.uint8), np.array(which), np.array(starts), np.array(base)
                own, base, which, starts, at = [], [], [], [], 0
            own.append(part)
            which.append(i)
            starts.append(at)
            base.append(a)
            at += len(part)
    if own:
        yield np.frombuffer(b"".join(own), np.uint8), np.array(which), np.array(starts), np.array(base)


_RUN = np.dtype([("key", "<u8"), ("content", "<u8"), ("wide", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])


def sampled_suffixes(docs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The sampled suffixes of some texts, as runs of strings of LENGTH bytes.

    Each string is filed under the prefix in it whose hash is least (the leftmost of equals), so equal strings are filed
    alike wherever they are. Neighbouring strings filed under one place are a run: key is the hash of the prefix, content
    and wide are two hashes of all bytes of the run, start and n the first string's place in its text and the number of strings.
    """
    out = []
    w = LENGTH - PREFIX + 1
    for text, which, starts, base in _segments(texts):
        sums, sums_2 = _prefix_sums(text), _prefix_sums(text, _POWER_2)
        n = len(text)
        keys = _mix((sums[PREFIX:] - sums[:-PREFIX]) * _INVERSE[: n - PREFIX + 1])
        place = np.arange(len(keys), dtype=np.uint64)
        least = (_sliding_min((keys & ~_POS) | place, w) & _POS).astype(np.int64)
        ends = np.append(starts[1:], n)
        counts = ends - starts - LENGTH + 1
        first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        at = least[first]
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        p, q = first[new], first[np.append(new[1:], len(first)) - 1]
        of = np.searchsorted(starts, p, side="right") - 1
        run = np.empty(len(p), _RUN)
        run["key"] = _mix(keys[at[new]])  # least hashes are small; mixed again, they spread over the shards
        run["content"] = _mix(((sums[q + LENGTH] - sums[p]) * _INVERSE[p]) ^ (q - p).astype(np.uint64))
        run["wide"] = (sums_2[q + LENGTH] - sums_2[p]) * _INVERSE_2[p]
        run["doc"], run["start"], run["n"] = docs[which[of]], p - starts[of] + base[of], q - p + 1
        out.append(run)
    return np.concatenate(out) if out else np.empty(0, _RUN)


def _sorted(runs: np.ndarray) -> np.ndarray:
    """Sorted runs, each once: rows that repeat exactly are one document, so a run that they bring again is not an earlier one."""
    runs = runs[np.lexsort((runs["start"], runs["doc"], runs["wide"], runs["content"], runs["key"]))]
    new = np.ones(len(runs), bool)
    new[1:] = np.logical_or.reduce([runs[f][1:] != runs[f][:-1] for f in ("key", "content", "wide", "doc", "start")])
    return runs[new]


def _first_of_class(runs: np.ndarray) -> np.ndarray:
    """Of sorted runs: whether it is the first with its prefix and bytes."""
    new = np.ones(len(runs), bool)
    new[1:] = np.logical_or.reduce([runs[f][1:] != runs[f][:-1] for f in ("key", "content", "wide")])
    return new


class Levels:
    """Sorted levels of geometric sizes. A new batch is merged with a level of its size, as digits are carried, and every
    merge is a scan that finds which runs of the two also start earlier."""

    def __init__(self) -> None:
        self.levels: dict[int, np.ndarray] = {}
        self.repeated: list[np.ndarray] = []

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = _sorted(np.concatenate([a, b]))
        first = _first_of_class(both)
        self.repeated.append(both[~first])
        return both[first]

    def add(self, batch: np.ndarray) -> None:
        while len(batch) and (size := len(batch).bit_length()) in self.levels:
            batch = self._merge(self.levels.pop(size), batch)
        if len(batch):
            self.levels[len(batch).bit_length()] = batch

    def scan(self) -> np.ndarray:
        """All runs that are the first of their kind, sorted."""
        out = np.empty(0, _RUN)
        for size in sorted(self.levels):
            out = self._merge(out, self.levels[size])
        self.levels = {len(out).bit_length(): out}
        return out


#: What is known of a run: it starts earlier as a whole; its prefix has other contexts; so many that they may not meet in one task.
REPEATED, UNCLEAR, HOT = 0, 1, 2
#: Marks a run, in n, whose prefix has more contexts in its batch than were sent on.
_MARK = 1 << 31


def _rows(runs: np.ndarray, kind: int | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(runs["doc"]), pa.array(runs["start"].astype(np.int64)), pa.array((runs["n"] & ~np.uint32(_MARK)).astype(np.int64)), pa.array(np.broadcast_to(np.int32(kind), len(runs)))], ["doc", "start", "n", "kind"])


_FOUND = "doc long, start long, n long, kind int"


def _dealt(shards: int, main: np.ndarray, repeated: np.ndarray, unclear: np.ndarray) -> pa.RecordBatch:
    """A row for each shard that gets any of the batch's runs. Those of main go by the hash order; what is settled already goes in pieces
    to shards that are spread evenly, from one on that differs by batch. So a batch makes as many rows as it has runs at most, whatever the
    number of shards, and a passage that fills all batches loads no shard more than others."""
    shard = (main["key"] >> _U(32)) * _U(shards) >> _U(32)
    there, cut = np.unique(shard, return_index=True)
    cut = np.append(cut, len(main))
    own = {int(s): main[cut[k] : cut[k + 1]] for k, s in enumerate(there)}
    pieces = min(shards, -(-max(len(repeated), len(unclear)) // PIECE))
    from_shard = int(_mix((repeated if len(repeated) else unclear)["doc"][:1].astype(np.uint64))[0] % _U(shards)) if pieces else 0
    piece = {(from_shard + k * shards // pieces) % shards: k for k in range(pieces)}
    share = lambda x, s: x[piece[s] * len(x) // pieces : (piece[s] + 1) * len(x) // pieces] if s in piece else x[:0]
    rows = []
    for s in sorted({*own, *piece}):
        parts = own.get(s, main[:0]), share(repeated, s), share(unclear, s)
        rows.append((s, *(b"".join(x[f].tobytes() for f in _RUN.names) for x in parts)))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "main", "repeated", "unclear"])


_DEALT = "shard int, main binary, repeated binary, unclear binary"


def _runs(blob: bytes) -> np.ndarray:
    n = len(blob) // _RUN.itemsize
    out, at = np.empty(n, _RUN), 0
    for f in _RUN.names:
        out[f] = np.frombuffer(blob, _RUN[f], n, at)
        at += n * _RUN[f].itemsize
    return out


def _batch(runs: np.ndarray, shards: int) -> pa.RecordBatch:
    """The sampled suffixes of a batch in the order of their hashes, dealt to shards; what repeats within the batch is settled here, so a hot passage
    sends one run from each batch, and a prefix in many contexts sends two that mark it and leaves the rest for later."""
    runs = _sorted(runs)
    first = _first_of_class(runs)
    repeated, runs = runs[~first], runs[first]
    new = np.flatnonzero(np.concatenate([[True], runs["key"][1:] != runs["key"][:-1]])) if len(runs) else np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(runs)))
    hot = np.repeat(counts > MANY, counts)
    stays = ~hot
    for k in (0, 1):
        stays[new[counts > MANY] + k] = True
        runs["n"][new[counts > MANY] + k] |= np.uint32(_MARK)
    return _dealt(shards, runs[stays], repeated, runs[~stays])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches put together to about BATCH_BYTES, so that more repeats meet before the shuffle."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _find(shards: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            if b.num_rows:
                yield _batch(sampled_suffixes(np.asarray(b.column("doc")), b.column("text").cast(pa.binary()).to_pylist()), shards)

    return find


def _match(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one shard: runs that also start earlier as a whole, and first runs whose prefix has other contexts as well."""
    levels = Levels()
    marked = []
    for blob in rows.column("main").to_pylist():
        runs = _runs(blob)
        marked.append(runs["key"][runs["n"] >= _MARK])
        levels.add(runs)
    firsts = levels.scan()
    new = np.flatnonzero(np.concatenate([[True], firsts["key"][1:] != firsts["key"][:-1]])) if len(firsts) else np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(firsts)))
    contexts = np.repeat(counts, counts)
    hot = (contexts > MANY * MANY) | np.isin(firsts["key"], np.concatenate(marked)) if len(firsts) else np.empty(0, bool)
    unclear = contexts > 1
    out = [_rows(x, REPEATED) for x in levels.repeated] + [_rows(_runs(x), REPEATED) for x in rows.column("repeated").to_pylist()]
    out += [_rows(firsts[unclear], np.where(hot[unclear], HOT, UNCLEAR))] + [_rows(_runs(x), HOT) for x in rows.column("unclear").to_pylist()]
    return pa.Table.from_batches(out)


def _single_strings(docs: np.ndarray, texts: list[bytes], bases: np.ndarray) -> np.ndarray:
    """Every string of LENGTH bytes of the given parts of texts as a run of its own, under two independent hashes of its bytes."""
    out = []
    for text, which, starts, base in _segments(texts):
        sums, sums_2 = _prefix_sums(text), _prefix_sums(text, _POWER_2)
        counts = np.append(starts[1:], len(text)) - starts - LENGTH + 1
        p = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        of = np.repeat(np.arange(len(starts)), counts)
        run = np.empty(len(p), _RUN)
        run["key"], run["content"] = _mix((sums[p + LENGTH] - sums[p]) * _INVERSE[p]), (sums_2[p + LENGTH] - sums_2[p]) * _INVERSE_2[p]
        run["wide"] = 0
        run["doc"], run["start"], run["n"] = docs[which[of]], p - starts[of] + base[of] + bases[which[of]], 1
        out.append(run)
    return np.concatenate(out) if out else np.empty(0, _RUN)


def _neighbours_joined(runs: np.ndarray) -> np.ndarray:
    """Single strings that start side by side as runs."""
    runs = runs[np.lexsort((runs["start"], runs["doc"]))]
    new = np.flatnonzero(np.concatenate([[True], (runs["doc"][1:] != runs["doc"][:-1]) | (runs["start"][1:] != runs["start"][:-1] + 1)])) if len(runs) else np.empty(0, np.int64)
    out = runs[new]
    out["n"] = np.diff(np.append(new, len(runs)))
    return out


_PARTS = "shard int, hot boolean, docs binary, starts binary, lengths binary, bytes binary, main binary, repeated binary, unclear binary"


def _unclear_parts(shards: int):
    """The unclear runs of documents with their bytes, dealt by prefix as before; hot ones as single strings, dealt by their own hash."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            docs, starts, own, hot = [], [], [], []
            for doc, text, spans in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                for span in spans:
                    start, n = span >> 32, span & (_MARK - 1)
                    docs.append(doc)
                    starts.append(start)
                    own.append(text[start : start + n - 1 + LENGTH])
                    hot.append(bool(span & _MARK))
            if not own:
                continue
            docs, starts, hot = np.array(docs, np.int64), np.array(starts, np.int64), np.array(hot)
            cool, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
            found = sampled_suffixes(cool, [own[k] for k in cool])
            key = np.zeros(len(own), np.uint64)
            key[found["doc"]] = found["key"]
            shard = (key >> _U(32)) * _U(shards) >> _U(32)
            empty, rows = b"", []
            cool = cool[np.argsort(shard[cool], kind="stable")]
            there, cut = np.unique(shard[cool], return_index=True)
            for s, at in zip(there, (cool[a:z] for a, z in zip(cut, [*cut[1:], len(cool)])), strict=True):
                texts = [own[k] for k in at]
                rows.append((int(s), False, docs[at].tobytes(), starts[at].astype("<u4").tobytes(), np.array([len(t) for t in texts], "<u4").tobytes(), b"".join(texts), empty, empty, empty))
            if len(warm):
                dealt = _batch(_single_strings(docs[warm], [own[k] for k in warm], starts[warm]), shards)
                rows += [(r["shard"], True, empty, empty, empty, empty, r["main"], r["repeated"], r["unclear"]) for r in dealt.to_pylist()]
            types = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _PARTS.split(", ")])

    return parts


def _match_strings(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one shard: strings that also start earlier, neighbours joined."""
    levels, settled = Levels(), []
    for r in rows.to_pylist():
        if r["hot"]:
            levels.add(_runs(r["main"]))
            settled.append(_runs(r["repeated"]))
            continue
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(r["lengths"], "<u4"), dtype=np.int64)])
        texts = [r["bytes"][a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        levels.add(_deduplicated(_single_strings(np.frombuffer(r["docs"], "<i8"), texts, np.frombuffer(r["starts"], "<u4").astype(np.int64)), settled))
    levels.scan()
    found = [*levels.repeated, *settled]
    return pa.Table.from_batches([_rows(_neighbours_joined(np.concatenate(found) if found else np.empty(0, _RUN)), REPEATED)])


def _deduplicated(runs: np.ndarray, settled: list[np.ndarray]) -> np.ndarray:
    runs = _sorted(runs)
    first = _first_of_class(runs)
    settled.append(runs[~first])
    return runs[first]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, rest) with doc, a long that orders documents: the id, or where ids repeat or are null the rank by id and text hash."""
    own = ["doc_id", F.coalesce("text", F.lit("")).alias("text"), "rest"]
    ids = docs.groupBy("doc_id").count()
    if ids.filter("count > 1 or doc_id is null").isEmpty():
        return docs.select(*own, F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"))
    tied = docs.select(*own).withColumn("tie", F.xxhash64("text"))
    ranks = tied.select("doc_id", "tie").distinct().repartitionByRange(F.col("doc_id").asc_nulls_last(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tie")
    ranks = written(ranks.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.monotonically_increasing_id().alias("doc")), "ranks")
    out = tied.join(ranks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    return out.select("doc_id", "text", "rest", F.coalesce("doc", F.lit(0)).cast("long").alias("doc"))


def repeated_strings(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> text, rest, spans (rest: all columns but text; null text is empty): for each row the strings of LENGTH bytes that also start earlier.

    spans is an array of start * 2 ** 32 + number of neighbouring starts, or null. Texts are UTF-8 bytes, null is empty,
    and strings lie in one text. Earlier means a smaller doc_id, or the same document and an earlier start.

    A suffix is sampled where the hash of its first PREFIX bytes is least among those of some string of LENGTH bytes,
    which every such string has, about one byte in 35. A batch of documents gets its sampled suffixes sorted by hash; shards of
    that order merge the batches in a logarithmic family of levels, and each merge scan finds runs of strings that
    also start earlier as a whole. Runs whose prefix is elsewhere in other contexts (at the ends of repeated passages)
    are compared string by string in the same way, after their bytes have been dealt by prefix; prefixes in very many
    contexts are dealt by the strings' own hashes instead. Strings are equal if two 64-bit hashes of all their bytes
    agree, under different bases. Rows that agree in
    doc_id and text are one document and get one result; other rows with one id follow each other by a hash of the
    text, and null ids come last. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest")
    docs = _numbered(docs.select("doc_id", "text", rest)).select("doc", "text", "rest")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    found = written(docs.select("doc", "text").mapInArrow(_find(shards), _DEALT).groupBy("shard").applyInArrow(_match, _FOUND), "runs")
    span = lambda n: F.collect_list(F.shiftleft("start", 32) + n).alias("spans")
    unclear = found.filter(F.col("kind") != REPEATED).groupBy("doc").agg(span(F.col("n") + F.when(F.col("kind") == HOT, F.lit(_MARK)).otherwise(0)))
    # both joins take the same columns of docs, so that its texts are shuffled once
    parts = docs.join(unclear, "doc").select("doc", "text", "rest", "spans").mapInArrow(_unclear_parts(shards), _PARTS)
    strings = parts.groupBy("shard").applyInArrow(_match_strings, _FOUND)
    spans = found.filter(F.col("kind") == REPEATED).unionByName(strings).groupBy("doc").agg(span(F.col("n")))
    return docs.join(spans, "doc", "left").select("text", "rest", "spans")


def kept_parts(text: bytes, spans: list[int] | None) -> tuple[bytes, int, int]:
    """What is left of the text, bytes removed, and maximal removed runs."""
    if not spans:
        return text, 0, 0
    own = np.array(spans, np.int64)
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, own >> 32, 1)
    np.add.at(edge, (own >> 32) + (own & 0xFFFFFFFF) - 1 + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs; see repeated_strings()."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                kept, removed, runs = kept_parts(text, spans)
                out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
            c = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("rest").field("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_strings(docs.select("doc_id", "text")).mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text; characters that lose some of their bytes go. Null texts become empty."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kept_parts(t, s)[0].decode("utf-8", "ignore") for t, s in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column("rest")], ["text", "rest"])

    found = repeated_strings(docs)
    rest = found.schema["rest"].dataType.simpleString()
    out = found.mapInArrow(clean, f"text string, rest {rest}")
    return out.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def op5_suffix_levels(spark, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
