"""Removal of token windows that also stand in an earlier document, by Rabin-Karp hashes.

Every window of `size` words of every text is hashed by a rolling polynomial. Within a task, repeats are settled
at once and one entry for each window and its least doc_id remains; those entries are dealt out by hash, packed
in columns, and counted across tasks. The windows found merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import cut, partitions_for
from tidemark.llm._words import BASES, span_hashes, text_parts, window_hashes, window_starts, word_spans

WINDOW = 13
SEGMENT_WINDOWS = 600_000
BUCKET_BYTES = 8 << 20
MAX_BROADCAST = 100_000  # rows of a doc_id each
PIECE_SCHEMA = "bucket int, hashes binary, places binary, found binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers of one length each, compressed; small differences cost about a byte."""
    raw = b"".join(np.int64(len(c)).tobytes() + np.ascontiguousarray(c.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<i4").reshape(-1))
        at += 8 + 4 * n
    return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high 32 bits of 64-bit integers."""
    return (x & 0xFFFFFFFF).astype(np.uint32).view(np.int32), (x >> 32).astype(np.int32)


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low.view(np.uint32).astype(np.int64)


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """For each entry of sorted keys, the index of the first entry of its group."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.flatnonzero(new)
    return np.repeat(first, np.diff(np.append(first, len(sorted_keys))))


class Segment:
    """Windows of some rows, gathered until there are enough of them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, ids: np.ndarray, marks: np.ndarray, buf: np.ndarray, offs: np.ndarray, size: int) -> None:
        starts, ends, first = word_spans(buf, offs)
        rows, at = window_starts(first, size)
        if len(at):
            words = span_hashes(buf, starts, ends)
            hashes, other = window_hashes(words, size)[at], window_hashes(words, size, BASES[3])[at]  # 61 bits each: 64 are compared, others of the second choose the bucket
            hashes |= other << np.uint64(61)
            self.parts.append((hashes, (other >> np.uint64(29)).astype(np.uint32), ids[rows], marks[rows], (at - first[:-1][rows]).astype(np.int32)))
            self.count += len(at)

    def flush(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Entries for other tasks, by bucket, and windows already known to repeat a smaller doc_id of this segment."""
        if not self.parts:
            return
        hashes, other, ids, marks, places = (np.concatenate(c) for c in zip(*self.parts))
        self.__init__()
        order = np.lexsort((ids, hashes))
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order][groups(hashes[order])]
        later = ids > least
        none = lambda n: pa.nulls(n, pa.binary())
        if packed := found_packs(ids[later], marks[later], places[later], buckets):
            to, blobs = zip(*packed)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), none(len(to)), none(len(to)), pa.array(blobs, pa.binary())], names=["bucket", "hashes", "places", "found"])
        keep = ~later
        hashes, ids, marks, places = hashes[keep], ids[keep], marks[keep], places[keep]
        bucket = (other[keep] % np.uint32(buckets)).astype(np.int32)  # by a hash of its own, so windows of one bucket agree in that too
        order = np.argsort(bucket, kind="stable")  # documents and places stay in order within a bucket
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(ends)):
            at = order[ends[b] : ends[b + 1]]
            d, m, p = ids[at], marks[at], places[at]
            new = np.ones(len(at), bool)
            new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (p[1:] < p[:-1])
            head = np.flatnonzero(new)
            runs = np.diff(np.append(head, len(at)))
            doc = d[head]
            low, high = halves(doc)
            out.append((int(b), hashes[at].tobytes(), pack(deltas(p), runs, deltas(low), deltas(high), *halves(m[head]))))
        for i in range(0, len(out), 64):
            b, h, pl = zip(*out[i : i + 64])
            n = len(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.array(h, pa.binary()), pa.array(pl, pa.binary()), pa.nulls(n, pa.binary())],
                names=["bucket", "hashes", "places", "found"],
            )


def found_packs(ids: np.ndarray, marks: np.ndarray, places: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Starts of windows that go, packed as runs of consecutive ones, one pack for each bucket of documents."""
    to = ids % buckets
    order = np.lexsort((places, marks, ids, to))
    to, ids, marks, places = to[order], ids[order], marks[order], places[order]
    ends = np.searchsorted(to, np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(ends)):
        d, m, p = (x[ends[b] : ends[b + 1]] for x in (ids, marks, places))
        doc = np.ones(len(d), bool)
        doc[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1])
        new = doc.copy()
        new[1:] |= p[1:] > p[:-1] + 1
        heads, docs = np.flatnonzero(new), np.flatnonzero(doc)
        per = np.diff(np.append(np.searchsorted(heads, docs), len(heads)))
        lengths = p[np.append(heads[1:], len(p)) - 1] - p[heads] + 1
        low, high = halves(d[docs])
        out.append((int(b), pack(deltas(low), deltas(high), *halves(m[docs]), per, deltas(p[heads]), lengths)))
    return out


def found_rows(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each document (doc_id and mark) of the packs, with the starts of its windows that go."""
    parts = []
    for blob in blobs:
        low, high, m_low, m_high, per, heads, lengths = unpack(blob)
        ids, marks = whole(np.cumsum(low, dtype=np.int32), np.cumsum(high, dtype=np.int32)), whole(m_low, m_high)
        parts.append((np.repeat(ids, per), np.repeat(marks, per), np.cumsum(heads, dtype=np.int32), lengths))
    if not parts:
        return
    ids, marks, heads, lengths = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    order = np.lexsort((heads, marks, ids))
    ids, marks, heads, lengths = ids[order], marks[order], heads[order], lengths[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    ends = np.append(np.flatnonzero(new), len(ids))
    for i in range(0, len(ends) - 1, 4096):
        at = ends[i : i + 4097]
        found = [as_intervals(heads[a:b], lengths[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[:-1]]), pa.array(marks[at[:-1]]), pa.array(found, pa.binary())], names=["doc_id", "mark", "found"])


def as_intervals(heads: np.ndarray, lengths: np.ndarray) -> bytes:
    """Ascending runs of starts, joined where they touch: alternating gaps and lengths in the shortest integer type."""
    ends = heads + lengths
    new = np.ones(len(heads), bool)
    new[1:] = heads[1:] > np.maximum.accumulate(ends)[:-1]
    first = np.flatnonzero(new)
    last = np.maximum.reduceat(ends, first)
    flat = np.empty(2 * len(first), np.int64)
    flat[0::2], flat[1::2] = deltas(heads[first].astype(np.int64)), last - heads[first]
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if flat.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + flat.astype(kind).tobytes()


def of_intervals(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)
    return np.cumsum(flat[0::2]), flat[1::2]


def _hash_windows(size: int, buckets: int, segment_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment()
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for i, j, buf, offs in text_parts(batch.column("text")):
                segment.add(ids[i:j], marks[i:j], buf, offs, size)
                if segment.count >= segment_windows:
                    yield from segment.flush(buckets)
        yield from segment.flush(buckets)

    return run


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a few buckets' entries: windows whose least doc_id over all tasks is smaller than the entry's. What was found before passes."""
        hashes: list[np.ndarray] = []
        blobs: list[bytes] = []
        for batch in batches:
            known = batch.column("found").is_valid()
            yield batch.select(["bucket", "found"]).filter(known)
            batch = batch.filter(pc.invert(known))
            hashes += [np.frombuffer(h.as_py(), np.uint64) for h in batch.column("hashes")]
            blobs += [p.as_py() for p in batch.column("places")]
        if packed := found_packs(*repeated(hashes, blobs), buckets):
            to, found = zip(*packed)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(found, pa.binary())], names=["bucket", "found"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from found_rows([f.as_py() for batch in batches for f in batch.column("found")])


def repeated(hashes: list[np.ndarray], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, marks and places of entries whose hash has a smaller doc_id."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    if not blobs:
        return none
    ends = np.cumsum([0, *map(len, hashes)])
    keys = np.concatenate(hashes)
    hashes.clear()
    order = np.argsort(keys)
    keys = keys[order]
    twice = np.zeros(len(keys), bool)
    twice[1:] = keys[1:] == keys[:-1]
    twice[:-1] |= twice[1:]
    order, keys = order[twice], keys[twice]
    # only places of repeated windows are unpacked and kept, a blob at a time
    back = np.argsort(order)
    order, keys = order[back], keys[back]
    kept = []
    for k, blob in enumerate(blobs):
        at = order[np.searchsorted(order, ends[k]) : np.searchsorted(order, ends[k + 1])] - ends[k]
        if len(at):
            places, runs, low, high, m_low, m_high = unpack(blob)
            doc, marks = whole(np.cumsum(low, dtype=np.int32), np.cumsum(high, dtype=np.int32)), whole(m_low, m_high)
            of = np.repeat(np.arange(len(runs)), runs)[at]
            kept.append((doc[of], marks[of], np.cumsum(places, dtype=np.int32)[at]))
    if not kept:
        return none
    ids, marks, places = (np.concatenate(c) for c in zip(*kept))
    order = np.lexsort((ids, keys))
    own = ids[order]
    order = order[own > own[groups(keys[order])]]
    return ids[order], marks[order], places[order]


def _rebuild(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, removed, kept_text, row = [], [], [], 0
            found = batch.column("found")
            for i, j, buf, offs in text_parts(batch.column("text")):
                starts, ends, first = word_spans(buf, offs)
                raw = buf.tobytes()
                for row in range(i, j):
                    a, b = first[row - i], first[row - i + 1]
                    gone = np.zeros(b - a + 1, np.int32)
                    if (here := found[row].as_py()) is not None:
                        s, n = of_intervals(here)
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + n + size - 1, -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    words_n.append(int(b - a))
                    removed.append(int(len(stay) - stay.sum()))
                    at = np.flatnonzero(stay) + a
                    kept_text.append(b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): mark is 0, or a 64-bit hash of the text where a doc_id has several different texts, by which its rows are told apart."""
    h = F.xxhash64("text")
    several = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo != hi").select("doc_id", F.lit(True).alias("_s")))
    n = several.count()
    if not n:
        return docs.withColumn("mark", F.lit(0).cast("long"))
    several = F.broadcast(several) if n <= MAX_BROADCAST else several
    return docs.join(several, "doc_id", "left").select("doc_id", "text", F.when(F.col("_s"), h).otherwise(F.lit(0).cast("long")).alias("mark"))


def remove_repeated_windows(docs: DataFrame, size: int = WINDOW, segment_windows: int = SEGMENT_WINDOWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of `size` consecutive words that covers it also starts in a document with a smaller
    doc_id. Windows are judged on the input, by two polynomials over the hashes of their words, modulo the prime 2**61 - 1 at independent bases. 61 bits of one and 3 of
    the other are compared among windows that further bits of the second deal to the same of b buckets. Two windows that differ agree in one polynomial at 12 of 2**61 bases at most, and at one on
    average: of n windows about n**2 / (b * 2**65) go by chance. b grows with the input; for 100 TB (1e13 windows, 12 million buckets) that is less than one.
    A task settles repeats among segment_windows at a time before it sends the rest on.

    A null text has no words. Rows with a null doc_id lose nothing and make no other row lose anything. Rows that
    share a doc_id are each judged against smaller doc_ids only, so a repeated row changes nothing. Extra columns are
    ignored; no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    buckets = partitions_for(docs, BUCKET_BYTES)  # of the input: a join's size would be the product of its sides'
    docs = marked(docs)
    pieces = docs.mapInArrow(_hash_windows(size, buckets, segment_windows), PIECE_SCHEMA)
    across = pieces.repartition(buckets, "bucket").mapInArrow(_count(buckets), "bucket int, found binary")
    found = across.repartition(buckets, "bucket").mapInArrow(_merge, "doc_id bigint, mark bigint, found binary")
    return docs.join(found, ["doc_id", "mark"], "left").mapInArrow(_rebuild(size), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
