"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 drawn from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its place. A text's vector bundles (adds) those of all its n-grams; a
language's prototype bundles those of all its training texts. Texts take the language of the largest cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class Profile:
    """Vectors of dims signs over n-grams of letters, where all else is one border; at most rows n-gram vectors are kept by a worker.

    Prototypes go to every task, so `languages` bounds their number (and their size, 2 kB each): more are an error, as no list of languages has that many."""

    dims: int = 512
    n: int = 3
    rows: int = 1 << 16
    seed: int = 5
    languages: int = 20_000


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 of all else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


class Space:
    """Vectors of n-grams, made when first met."""

    def __init__(self, p: Profile) -> None:
        self.p = p
        self.of_letter: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.used = 0
        if not hasattr(self, "vectors"):
            self.vectors = np.zeros((1024, self.p.dims), np.float32)  # grows by doubling

    def letter(self, code: int) -> np.ndarray:
        if code not in self.of_letter:
            self.of_letter[code] = np.random.default_rng([self.p.seed, code]).integers(0, 2, self.p.dims).astype(np.int8) * 2 - 1
        return self.of_letter[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """A row for each n-gram: the product of its letters' vectors, each rolled by its place."""
        out = np.ones((len(grams), self.p.dims), np.int8)
        for k in range(self.p.n):
            codes, at = np.unique((grams >> np.uint64(21 * k)) & np.uint64(0x1FFFFF), return_inverse=True)
            out *= np.roll(np.stack([self.letter(int(c)) for c in codes]), k, axis=1)[at]
        return out

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of self.vectors for distinct ascending grams."""
        if len(self.codes) + len(grams) > self.p.rows:
            self.clear()  # made again when met again: a cache, so results don't change
        found = np.searchsorted(self.codes, grams)
        new = grams[(found == len(self.codes)) | (self.codes[np.minimum(found, len(self.codes) - 1)] != grams)] if len(self.codes) else grams
        if len(new):
            to = self.used + len(new)
            if to > len(self.vectors):
                wider = np.zeros((max(to, 2 * len(self.vectors)), self.p.dims), np.float32)
                wider[: self.used] = self.vectors[: self.used]
                self.vectors = wider
            self.vectors[self.used : to] = self.bind(new)
            codes = np.concatenate([self.codes, new])
            at = np.concatenate([self.at, np.arange(self.used, to)])
            order = np.argsort(codes)
            self.codes, self.at, self.used = codes[order], at[order], to
            found = np.searchsorted(self.codes, grams)
        return self.at[found]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.p.dims, np.float64)
        for i in range(0, len(grams), 4096):
            rows = self.rows(grams[i : i + 4096])
            out += counts[i : i + 4096].astype(np.float32) @ self.vectors[rows]
        return out


@functools.lru_cache(maxsize=2)
def space(p: Profile) -> Space:
    return Space(p)


def grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, with counts: words of letters between borders (0), runs of borders as one."""
    code = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate([[0], code, [0]]).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code = code[keep]
    if not code.any() or len(code) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        whole |= code[k : k + len(whole)] << np.uint64(21 * k)
    return np.unique(whole, return_counts=True)


def _train(p: Profile):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a language and task: the sum of its texts' vectors."""
        sums: dict[str, np.ndarray] = {}
        own = space(p)
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                g, c = grams(text.as_py() or "", p.n)
                if len(g):
                    held.setdefault(lang, []).append((g, c))
            for lang, pairs in held.items():  # n-grams of all texts of the batch are bound once
                g, at = np.unique(np.concatenate([x[0] for x in pairs]), return_inverse=True)
                c = np.bincount(at, np.concatenate([x[1] for x in pairs]))
                sums[lang] = sums.get(lang, 0) + own.bundle(g, c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"]
        )

    return run


def train(docs: DataFrame, p: Profile = Profile()) -> DataFrame:
    """One row a language of docs (text, lang): lang, v. Null lang and texts without letters teach nothing."""
    sums = docs.where("lang is not null").select("text", "lang").mapInArrow(_train(p), "lang string, v array<double>")
    return (
        sums.select("lang", F.posexplode("v").alias("k", "x"))
        .groupBy("lang", "k")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    )


def _predict(p: Profile, langs: list[str], prototypes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space(p)
        for batch in batches:
            best, scores = [], []
            for text in batch.column("text"):
                g, c = grams(text.as_py() or "", p.n)
                if not len(g) or not langs:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = own.bundle(g, c)
                cosine = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                k = int(np.argmax(cosine))
                best.append(langs[k])
                scores.append(float(min(1.0, max(0.0, cosine[k]))))
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, prototypes: DataFrame, p: Profile = Profile()) -> DataFrame:
    """doc_id (and held_out, if docs has it), lang_pred and score, the cosine from 0 to 1, of each row's whole text.

    A text that is null or has no letter is `und` with score 0, as is any where no language was learned. Of equal cosines the
    language of least name wins. Rows are independent: null and repeated doc_ids pass; extra columns are ignored.
    Prototypes are dims numbers a language and go to all tasks.
    """
    rows = sorted(prototypes.collect(), key=lambda r: r.lang)  # one row a language, never of documents
    if len(rows) > p.languages:
        raise ValueError(f"{len(rows)} languages, more than {p.languages}")
    matrix = np.array([r.v for r in rows], np.float64).reshape(len(rows), p.dims)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    keep = [c for c in ("doc_id", "held_out") if c in docs.columns]
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(_predict(p, [r.lang for r in rows], matrix), ", ".join([*fields, "lang_pred string", "score double"]))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    prototypes = train(docs.where("not held_out"))
    return identify(docs, prototypes)
