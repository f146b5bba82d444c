"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length one and rotated by a fixed orthogonal matrix. Cosine >= t means a squared distance of
2 - 2t at most, so of blocks of equal width one has at most its proportional share. Each block is range-joined
under that budget: vectors are dealt to cells of a grid over the block's first coordinates, and sent as probes to
the cells their radius touches. A pair that passes in a block is checked against all 64 quantised coordinates
with the quantisation's error bound, goes out once, and is confirmed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import cut
from tidemark.llm.components import connected_components

STEPS = 127  # quantised coordinates of unit vectors are -127 .. 127
GRID = 2  # coordinates of a block that make its grid


@dataclass(frozen=True)
class Pigeonhole:
    """blocks of the rotated vector; cell is the grid's step; a cell of more than chunk vectors is split into parts of about that many."""

    cosine: float = 0.95
    blocks: int = 8
    cell: float = 0.09
    chunk: int = 4096


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def cuts(dims: int, blocks: int) -> list[tuple[int, int]]:
    at = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


class Budget:
    """Integer limits on squared distances of quantised vectors that no pair within the exact limits exceeds."""

    def __init__(self, dims: int, p: Pigeonhole) -> None:
        self.cuts = cuts(dims, p.blocks)
        d2 = max(0.0, 2 - 2 * p.cosine) + 1e-9
        limit = lambda share, width: int(np.ceil((np.sqrt(d2 * share) * STEPS + np.sqrt(width)) ** 2)) + 1  # noqa: E731  each coordinate's difference is off by 1 at most
        self.block = [limit((b - a) / dims, b - a) for a, b in self.cuts]
        self.whole = limit(1.0, dims)


def units(flat: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def unit_int8(flat: np.ndarray) -> np.ndarray:
    """Rows rotated and quantised."""
    unit = units(flat)
    return np.rint(unit @ rotation(flat.shape[1]) * STEPS).astype(np.int8)


def dense(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def touched(q: np.ndarray, a: int, b: int, limit: int, p: Pigeonhole) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cell numbers) of cells after the own one that a vector's range in block a..b touches; the own one first, for all rows."""
    g, step = min(GRID, b - a), p.cell * STEPS
    x = q[:, a : a + g].astype(np.float64)
    own = np.floor(x / step).astype(np.int64)
    reach = int(np.ceil(np.sqrt(limit) / step))
    number = lambda c: ((c + 4096) * 8192 ** np.arange(g)).sum(axis=1)
    home = number(own)
    yield np.arange(len(q)), home
    for off in np.ndindex(*[2 * reach + 1] * g):
        o = np.array(off) - reach
        to = own + o
        other = number(to)
        low, high = to * step, (to + 1) * step
        gap = np.maximum(np.maximum(low - x, x - high), 0)
        near = np.flatnonzero(((gap**2).sum(axis=1) <= limit) & (other > home))
        if len(near):
            yield near, other[near]


def _counts(dims: int, p: Pigeonhole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = Budget(dims, p)
        for batch in batches:
            q = unit_int8(dense(batch.column("v"), dims))
            for k, (a, b) in enumerate(budget.cuts):
                _, home = next(touched(q, a, b, budget.block[k], p))
                cell, n = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(n)], names=["block", "cell", "n"])

    return run


def _deal(dims: int, p: Pigeonhole, parts: dict[tuple[int, int], int]):
    """Rows of (block, cell, part, kind, ids, vectors): kind 0 are the cell's own vectors, 1 the probes for that part of it.

    Each vector is in one part of its own cell, and a probe for the earlier parts of its cell and all parts of touched later ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = Budget(dims, p)
        for batch in batches:
            q = unit_int8(dense(batch.column("v"), dims))
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for k, (a, b) in enumerate(budget.cuts):
                out = []

                def send(kind: int, rows: np.ndarray, cell: int, part: int) -> None:
                    if len(rows):
                        out.append((k, cell, part, kind, ids[rows].tobytes(), q[rows].tobytes()))

                for turn, (rows, cells) in enumerate(touched(q, a, b, budget.block[k], p)):
                    order = np.argsort(cells, kind="stable")
                    rows, cells = rows[order], cells[order]
                    heads = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                    for s, e in zip(heads, np.append(heads[1:], len(cells))):
                        cell, here = int(cells[s]), rows[s:e]
                        count = parts.get((k, cell), 0)
                        if turn == 0:
                            mine = (salt[here] % np.uint64(count)).astype(np.int64)
                            for part in range(count):
                                send(0, here[mine == part], cell, part)
                                send(1, here[mine > part], cell, part)
                        else:
                            for part in range(count):
                                send(1, here, cell, part)
                for i in range(0, len(out), 512):
                    c = list(zip(*out[i : i + 512]))
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=["block", "cell", "part", "kind", "ids", "vectors"])

    return run


def _join(dims: int, p: Pigeonhole):
    """Pairs of one part of a cell: its own vectors are held, at most about chunk of them; probes stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = Budget(dims, p)
        at, ids, own = None, np.zeros(0, np.int64), np.zeros((0, dims), np.int8)

        def pairs(k: int, i1: np.ndarray, v1: np.ndarray, i2: np.ndarray, v2: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(i2), 1024):
                yield from tile(k, i1, v1, i2[s : s + 1024], v2[s : s + 1024], s if same else None)

        def tile(k: int, i1: np.ndarray, v1: np.ndarray, i2: np.ndarray, v2: np.ndarray, after: int | None) -> Iterator[pa.RecordBatch]:
            a, b = budget.cuts[k]
            x, y = v1[:, a:b].astype(np.float32), v2[:, a:b].astype(np.float32)
            d = (x @ y.T) * np.float32(-2)  # whole numbers below 2**24: exact
            d += (x * x).sum(axis=1)[:, None]
            d += (y * y).sum(axis=1)[None, :]
            r, c = np.nonzero(d <= budget.block[k])
            if after is not None:
                keep = r < c + after
                r, c = r[keep], c[keep]
            for s in range(0, len(r), 1 << 16):
                rr, cc = r[s : s + (1 << 16)], c[s : s + (1 << 16)]
                sq = (v1[rr].astype(np.int32) - v2[cc].astype(np.int32)) ** 2
                good = sq.sum(axis=1) <= budget.whole
                for e in range(k):  # an earlier block that passes has sent this pair
                    ea, eb = budget.cuts[e]
                    good &= sq[:, ea:eb].sum(axis=1) > budget.block[e]
                u, w = i1[rr[good]], i2[cc[good]]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, w)), pa.array(np.maximum(u, w))], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["block"], row["cell"], row["part"])
                i, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int8).reshape(-1, dims)
                if key != at:
                    at, ids, own = key, np.zeros(0, np.int64), np.zeros((0, dims), np.int8)
                if len(ids):
                    yield from pairs(key[0], ids, own, i, v, False)
                if row["kind"] == 0:
                    yield from pairs(key[0], i, v, i, v, True)
                    ids, own = np.concatenate([ids, i]), np.concatenate([own, v])

    return run


def _confirm(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) for c in ("va", "vb"))
                x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
                dot = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                yield batch.select(["a", "b"]).filter(pa.array(dot >= cosine))

    return run


def candidate_pairs(vectors: DataFrame, dims: int, p: Pigeonhole) -> DataFrame:
    """Pairs (a < b) of vec_ids, each once, among which are all with that cosine. vectors: vec_id not null, v of dims finite values, not all 0."""
    spark = vectors.sparkSession
    counts = vectors.mapInArrow(_counts(dims, p), "block int, cell bigint, n bigint").groupBy("block", "cell").agg(F.sum("n").alias("n"))
    # at most blocks * (2 / cell + 3)**GRID rows, however many vectors: 5,000 here
    parts = {(r.block, r.cell): -(-r.n // p.chunk) for r in counts.collect()}
    dealt = vectors.mapInArrow(_deal(dims, p, parts), "block int, cell bigint, part int, kind int, ids binary, vectors binary")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, sum(parts.values())) // 16, 1)
    tasks = dealt.repartition(n, "block", "cell", "part").sortWithinPartitions("block", "cell", "part", "kind")
    return tasks.mapInArrow(_join(dims, p), "a bigint, b bigint")


def near_duplicate_vectors(rows: DataFrame, p: Pigeonhole = Pigeonhole()) -> DataFrame:
    """One row per row of rows (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of one length link if their cosine in double precision is p.cosine or more; those of other lengths are compared among themselves. Equal
    vectors are one class, joined once by its least vec_id and counted, so copies aren't paired. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing. A row with a null vec_id links with nothing and is kept, with a null component_id. Rows that share a vec_id
    are one vector: the least by value; exact repeats change nothing. Extra columns are ignored; no rows give no rows.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = rows.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    each = whole.groupBy("vec_id").agg(F.min("v").alias("v"))
    # equal vectors are known by 128 bits of hashes; 0.0 for -0.0
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    each = cut(each.withColumns({"k1": F.xxhash64(plain), "k2": F.xxhash64(F.lit(1), plain)}))
    classes = each.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = cut(each.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"]).select("vec_id", "rep", "copies"))
    reps = cut(each.join(members.where("vec_id = rep").select("vec_id", "copies"), "vec_id").select("vec_id", "v", "copies"))
    links = None
    for r in reps.groupBy(F.size("v").alias("dims")).count().where("count > 1").collect():  # a row a length that occurs
        vectors = reps.where(F.size("v") == r.dims)
        side = lambda x: vectors.select(F.col("vec_id").alias(x), F.col("v").alias(f"v{x}"))  # noqa: E731, B023
        both = candidate_pairs(vectors.select("vec_id", "v"), r.dims, p).join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb")
        found = both.mapInArrow(_confirm(p.cosine), "a bigint, b bigint")
        links = found if links is None else links.unionByName(found)
    ids = rows.select("vec_id")
    if links is None:
        links = rows.sparkSession.createDataFrame([], "a bigint, b bigint")
    links = cut(links)
    copies = reps.select("vec_id", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(copies.withColumnRenamed("vec_id", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    component = connected_components(links).withColumnRenamed("id", "rep")
    known = members.join(degree, "rep", "left").join(component, "rep", "left")
    known = known.select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return (
        ids.join(known, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op10_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
