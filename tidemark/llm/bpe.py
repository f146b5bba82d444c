"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece exactly one token can stand last in its encoding: that which follows the encoding of the rest
of the prefix such that no merge would cross between the two. Storing it for every prefix encodes in one pass; appended
bytes only add entries, and after an edit the entries before it stay.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._shared import tidy

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_CACHE = 400_000
PAIR_CACHE = 500_000
RUN_CHARS = 1 << 20
NONE = 1 << 60


class Fits(dict):
    """Answers of Vocabulary.compatible by pair, kept up to PAIR_CACHE of them; few pairs make up most questions."""

    def __init__(self, ask: Callable[[int, int], bool]) -> None:
        super().__init__()
        self.ask = ask

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= PAIR_CACHE:
            self.clear()
        self[pair] = out = self.ask(*pair)
        return out


class Vocabulary:
    """Ranks of tokens, and the two tokens that each is merged from; tokens that merging can't reach have none."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.fits = Fits(self.compatible)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.reached: dict[bytes, int] = {t: i for t, i in ranks.items() if len(t) == 1}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (two := self._last_merge(token, rank)):
                self.parts[rank] = two
                self.pairs[two] = rank
                self.reached[token] = rank

    @classmethod
    @functools.lru_cache(maxsize=4)
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """Merges token by all lower ranks, least first; None if more or fewer than two parts stay."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], NONE)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether left, right stays so: undoes the merges of both, latest first, and asks at each state whether the pair at the border would have merged earlier."""
        pairs, parts, limit = self.pairs, self.parts, NONE
        while pairs.get((left, right), NONE) >= limit:
            if left > right and left in parts or right not in parts:
                if left not in parts:
                    return True
                limit, left = left, parts[left][1]
            else:  # of equal ranks the left one merges first
                limit, right = right + 1, parts[right][0]
        return False


class Prefixes:
    """The last token of each prefix of a growing run of bytes. `encode` reads the tokens of the whole run."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data = vocabulary, bytearray()
        self.last: list[int] = []
        self.width: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: entries of the old prefixes stay valid."""
        n = len(self.data)
        self.data += more
        get, last, width, fits, longest = self.v.reached.get, self.last, self.width, self.v.fits, self.v.longest
        data = bytes(self.data)
        for end in range(n + 1, len(data) + 1):
            for size in range(1, (longest if end > longest else end) + 1):  # one token fits, and most are short
                token = get(data[end - size : end])
                if token is not None and (size == end or fits[last[end - size - 1], token]):
                    last.append(token)
                    width.append(size)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}; the ranks lack a byte")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Edits data[start:end]; prefixes up to start are kept, the rest is encoded again."""
        tail = bytes(self.data[end:])
        del self.data[start:], self.last[start:], self.width[start:]
        self.append(new + tail)

    def encode(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= self.width[end - 1]
        return out[::-1]


class Encoder:
    """Whole texts: the pattern's matches are encoded each on its own; results of short pieces are kept, up to PIECE_CACHE of them.

    New pieces of a run of texts are taken in order, so each continues from the prefix that it shares with the one before.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.v = Vocabulary.load(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of pieces."""
        out, walk, before = {}, Prefixes(self.v), b""
        for raw, text in sorted((p.encode(), p) for p in pieces):
            whole = self.v.ranks.get(raw)
            if whole is not None:
                out[text] = (whole,)
                continue
            same, most = 0, min(len(before), len(raw))
            while same < most and before[same] == raw[same]:
                same += 1
            walk.replace(same, len(before), raw[same:])
            out[text], before = tuple(walk.encode()), raw
        return out

    def encode_run(self, texts: list[str]) -> Iterator[list[int]]:
        found = [self.find(t) for t in texts]
        new = set().union(*found).difference(self.known)
        now = self.learn(new)
        kept = self.known
        if len(kept) + len(now) > PIECE_CACHE:
            self.known = {}
        self.known.update((p, ids) for p, ids in now.items() if len(p) <= 64)
        for pieces in found:
            out: list[int] = []
            for p in pieces:
                out += now[p] if p in now else kept[p]
            yield out

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text, in runs of about RUN_CHARS."""
        run, size = [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= RUN_CHARS:
                yield from self.encode_run(run)
                run, size = [], 0
        yield from self.encode_run(run)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_run([text]))

    def decode(self, ids: list[int]) -> bytes:
        table = self.v.bytes
        return b"".join([table[i] for i in ids])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [np.array(x, np.int32) for x in own.encode_all(t.as_py() or "" for t in batch.column("text"))]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends.astype(np.int32), flat)], names=["doc_id", "ids"])

    return run


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for ids in own.encode_all(t.as_py() or "" for t in batch.column("text")):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids of every row's whole text, as a library for the same ranks gives them without special tokens.

    A null or empty text has no ids. Rows are independent: null and repeated doc_ids pass; extra columns are ignored.
    path: a file of ranks that every executor can read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(_encode(path or public_tokenizers.path(RANKS))), f"doc_id {kind}, ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every row: doc_id, n_tokens, ids_sha256, decoded_sha256. Cases as in `encoded`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(_digest(path or public_tokenizers.path(RANKS))), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every row."""
    return encoded(docs)
