"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature coordinate: sigma scatters the shingles, and coordinate k is the least
value of pi over the shingles shifted circularly by k. Both are bijections of 32-bit or 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, partitions_for, tidy
from tidemark.llm._words import mix, shingles, text_parts
from tidemark.llm.components import connected_components

U32 = np.uint32


@dataclass(frozen=True)
class NearDup:
    """size words a shingle; pairs link from a similarity of percent / 100. Of pairs just that similar, bands of
    rows coordinates miss (1 - 0.75**rows)**bands, which is 2e-5 here, and fewer of more similar ones. A pair whose
    sketches, two bits of each coordinate, agree in fewer than least_bits isn't read in full: that is 4.5 deviations below
    the mean of 350 bits at the threshold, and leaves pairs of a similarity of about 0.57 and more; in buckets of several
    components, longer sketches of `wide` further coordinates that must agree in least_wide bits, again 4.5 deviations below the mean, leave those of about 0.69 and more.
    part_rows documents at most are compared with one copy of a leader's text; part_members of a bucket meet in one task."""

    size: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    least_bits: int = 314
    wide: int = 2048
    least_wide: int = 3470
    part_rows: int = 256
    part_members: int = 4096

    @property
    def sketch(self) -> list[str]:
        return [f"w{i}" for i in range(-(-2 * self.bands * self.rows // 64))]


def pi(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers."""
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def signatures(sets: np.ndarray, offs: np.ndarray, count: int, first: int = 0) -> np.ndarray:
    """(rows, count) circulant MinHash coordinates of sets of 64-bit hashes; rows without members hold the largest value."""
    out = np.full((len(offs) - 1, count), 0xFFFFFFFF, U32)
    full = np.flatnonzero(np.diff(offs))
    sigma = (mix(sets ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(U32)
    step, at = 1 << 15, 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(offs[full], offs[full[at]] + step)))
        rows = full[at:to]
        lo, hi = offs[rows[0]], offs[rows[-1] + 1]
        part, starts = sigma[lo:hi], offs[rows] - lo
        for k in range(count):
            out[rows, k] = np.minimum.reduceat(pi(part - U32(first + k)), starts)
        at = to
    return out


def set_keys(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each set, by which equal sets are known."""
    sums = np.zeros((2, len(sets) + 1), np.uint64)
    np.cumsum(mix(sets.copy()), out=sums[0, 1:])
    np.cumsum(mix(sets ^ np.uint64(0xBB67AE8584CAA73B)), out=sums[1, 1:])
    return sums[:, offs[1:]] - sums[:, offs[:-1]]


def sketches(sig: np.ndarray, words: int) -> np.ndarray:
    """(rows, words) of 64 bits: two bits of each coordinate, padded with zeros."""
    bits = np.zeros((len(sig), words * 64), bool)
    bits[:, : sig.shape[1]], bits[:, sig.shape[1] : 2 * sig.shape[1]] = sig & U32(1), sig & U32(2)
    return np.packbits(bits, axis=1).view(np.int64)


def _sign(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_parts(batch.column("text")):
                sets, ends = shingles(buf, offs, p.size)
                sizes = np.diff(ends)
                sig = signatures(sets, ends, p.bands * p.rows)
                empty = sizes == 0
                keys = set_keys(sets, ends)
                short = sketches(sig, len(p.sketch))
                bands = np.empty((len(sizes), p.bands), np.uint64)
                for b in range(p.bands):
                    h = np.full(len(sizes), b + 1, np.uint64)
                    for k in range(b * p.rows, (b + 1) * p.rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                    bands[:, b] = h
                each = pa.ListArray.from_arrays(np.arange(0, len(sizes) * p.bands + 1, p.bands, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(keys[0].view(np.int64), mask=empty),
                        pa.array(keys[1].view(np.int64), mask=empty),
                        *[pa.array(short[:, k].copy()) for k in range(short.shape[1])],
                        each,
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", *p.sketch, "bands"],
                )

    return run


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id), sorted by both, to (key, id, leader, edge) of runs of one key with several rows; leader is the run's first id.

    The first id of a task's first and of its last run is given once more, marked as edge, for tasks that hold other
    parts of that run. Only the last run's leader is carried from batch to batch.
    """

    def rows(keys, ids, leaders, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, ids, leaders, pa.array(np.full(len(keys), edge))], names=["key", "id", "leader", "edge"])

    key, leader, length = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key"), batch.column("id")
        k = keys.to_numpy()
        carried = key is not None and k[0] == key
        start = np.concatenate([[not carried], k[1:] != k[:-1]])
        at = np.flatnonzero(start)
        heads = ids.take(pa.array(at))
        if carried:
            heads = pa.concat_arrays([leader, heads])
        run = np.cumsum(start) - (not carried)
        sizes = np.bincount(run, minlength=len(heads))
        some = np.sort(np.concatenate([np.flatnonzero(~start), at[sizes[int(carried) :] > 1]]))
        yield rows(keys.take(pa.array(some)), ids.take(pa.array(some)), heads.take(pa.array(run[some])), False)
        if carried and length == 1:
            yield rows(keys.slice(0, 1), leader, leader, False)
        if key is None:
            yield rows(keys.slice(0, 1), ids.slice(0, 1), ids.slice(0, 1), True)
        length = int(sizes[-1]) + (length if carried and len(heads) == 1 else 0)
        key, leader = k[-1], heads.slice(len(heads) - 1)
    if key is not None:
        yield rows(pa.array([key]), leader, leader, True)


def buckets(reps: DataFrame, kind: str) -> DataFrame:
    """(key, id, leader, edge) of bands that several documents share. Only (key, id) is shuffled, once, by ranges of both, so a
    band of very many documents lies in several tasks, each with a leader of its own."""
    banded = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    n = partitions_for(reps, 64 << 20)
    return banded.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(tidy(_lead), f"key bigint, id {kind}, leader {kind}, edge boolean")


def alike(p: NearDup, x: str, y: str) -> Column:
    """Whether sizes and sketches of two rows leave a similarity of the threshold possible."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in p.sketch), F.lit(0))
    return (100 * small >= p.percent * large) & (apart <= 2 * p.bands * p.rows - p.least_bits)


def leader_pairs(shared: DataFrame, traits: DataFrame, p: NearDup) -> DataFrame:
    """Distinct pairs (a, b) of each document and the leaders of its buckets, and of the leaders of one bucket's parts."""
    chunks = shared.where("edge").select("key", F.col("leader").alias("id")).distinct()
    heads = chunks.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("parts")).where("parts > 1")
    met = shared.select("id", "leader").unionByName(chunks.join(heads, "key").select("id", "leader"))
    pairs = met.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    x, y = traits.select(F.col("id").alias("a"), F.struct("n", *p.sketch).alias("x")), traits.select(F.col("id").alias("b"), F.struct("n", *p.sketch).alias("y"))
    return pairs.join(x, "a").join(y, "b").where(alike(p, "x", "y")).select("a", "b").distinct()


def _details(p: NearDup, wide: bool):
    """(id, k1, x): x is the document's shingles or, with wide, its longer sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_parts(batch.column("text")):
                sets, ends = shingles(buf, offs, p.size)
                if wide:
                    bits = sketches(signatures(sets, ends, p.wide, p.bands * p.rows), p.wide // 32)
                    x = pa.ListArray.from_arrays(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32), pa.array(bits.reshape(-1)))
                else:
                    x = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(set_keys(sets, ends)[0].view(np.int64)), x], names=["id", "k1", "x"])

    return run


def common_bound(texts: DataFrame, ids: DataFrame, traits: DataFrame, p: NearDup, scratch: Scratch) -> DataFrame:
    """traits of the documents ids with most, how many of a document's shingles any other of these documents has, which bounds what two can share, and a longer sketch.

    Spark counts the shingles; one that a single document has is kept with that document by the same aggregation. Documents that share too
    little with all the others together are left out.
    """
    kind = traits.schema["id"].dataType.simpleString()
    some = texts.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    get = lambda wide: some.mapInArrow(tidy(_details(p, wide)), f"id {kind}, k1 bigint, x array<bigint>")
    rows = get(False).select("id", "k1", F.explode("x").alias("s"))
    # equal texts under one id are one document: the least and the largest are then the same
    ones = rows.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("k1").alias("k1"), F.max("k1").alias("last_k")).where("id = last and k1 = last_k")
    lone = ones.groupBy("id", "k1").agg(F.count("*").alias("lone"))
    known = traits.join(ids.select("id").distinct(), "id", "left_semi").join(lone, ["id", "k1"], "left")
    known = known.withColumn("most", F.col("n") - F.coalesce("lone", F.lit(0))).where(100 * F.col("most") >= p.percent * F.col("n"))
    wide = get(True).dropDuplicates(["id", "k1"]).withColumnRenamed("x", "wide")
    return scratch.stage(known.join(wide, ["id", "k1"]).drop("lone", "k1"), "bounds")


def cross_pairs(shared: DataFrame, group: DataFrame, traits: DataFrame, texts: DataFrame, p: NearDup, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket, aren't yet in one component, and may be similar enough.

    In each bucket that holds several components, the documents outside its largest meet all others. A bucket's members are
    dealt to parts of about part_members, and the documents outside the largest component are sent to each part.
    """
    now = scratch.stage(shared.select("key", "id").distinct().join(group, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g")), "members")

    def several(members: DataFrame) -> DataFrame:
        each = members.groupBy("key", "g").agg(F.count("*").alias("c"))
        return each.groupBy("key").agg(F.max(F.struct("c", "g")).alias("m"), F.count("*").alias("groups"), F.sum("c").alias("c")).where("groups > 1")

    first = now.join(several(now).select("key"), "key", "left_semi")
    bounds = common_bound(texts, first, traits, p, scratch)
    live = first.join(bounds.select("id").distinct(), "id", "left_semi")  # the others can't be similar enough to any of these
    keys = several(live).select("key", F.col("m.g").alias("main"), F.ceil(F.col("c") / p.part_members).cast("int").alias("parts"))
    open_ = scratch.stage(live.join(keys, "key").join(bounds, "id").select("key", "g", "main", "parts", F.struct("id", "n", "most", "wide", "bands", *p.sketch).alias("d")), "open")
    y = open_.select("key", F.col("g").alias("gy"), F.col("d").alias("y"), (F.col("g") == F.col("main")).alias("in_main"), F.pmod(F.xxhash64("d.id"), "parts").cast("int").alias("part"))
    x = open_.where("g != main").select("key", F.col("g").alias("gx"), F.col("d").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    common = F.least("x.most", "y.most")
    enough = 100 * common >= p.percent * (F.col("x.n") + F.col("y.n") - common)
    apart = F.aggregate(F.zip_with("x.wide", "y.wide", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, v: t + v)
    near = enough & alike(p, "x", "y") & (apart <= 2 * p.wide - p.least_wide)
    first_band = F.array_position(F.zip_with("x.bands", "y.bands", lambda u, v: u == v), True).cast("int") - 1
    near = near & (F.get(F.col("x.bands"), first_band) == x["key"])  # once a pair: in the first bucket that both share
    met = x.join(y, ["key", "part"]).where((F.col("gx") != F.col("gy")) & (F.col("in_main") | (F.col("x.id") > F.col("y.id"))) & near)
    return met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def _verify(p: NearDup):
    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b) or 100 * min(len(a), len(b)) < p.percent * max(len(a), len(b)):
            return False
        small, large = (a, b) if len(a) < len(b) else (b, a)
        at = np.searchsorted(large, small)
        both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        return both > 0 and 100 * both >= p.percent * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leads = None, {}
        for batch in batches:
            groups = list(zip(batch.column("b").to_pylist(), batch.column("part").to_pylist()))
            member = batch.column("member").to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            for i, _, buf, offs in text_parts(batch.column("text")):
                sets, ends = shingles(buf, offs, p.size)
                keys = set_keys(sets, ends)[0]
                for r in range(len(ends) - 1):
                    if groups[i + r] != now:
                        now, leads = groups[i + r], {}
                    own = sets[ends[r] : ends[r + 1]]
                    if member[i + r]:
                        keep[i + r] = any(similar(own, x) for x in leads.values())
                    else:
                        leads[int(keys[r])] = own.copy()
            yield batch.select(["id", "b"]).filter(pa.array(keep)).rename_columns(["a", "b"])

    return run


def verified(texts: DataFrame, pairs: DataFrame, p: NearDup) -> DataFrame:
    """Those of the distinct pairs (a, b) of doc_ids whose whole shingle sets are similar enough.

    The pairs of one b are dealt to parts of about part_rows, and b's text is sent once to each part. Documents that
    share a doc_id are taken as one document whose links are those of any of its texts.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / p.part_rows).alias("parts"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"))
    needs = dealt.select(F.col("a").alias("id"), "b", "part", F.lit(True).alias("member")).unionByName(
        dealt.select(F.col("b").alias("id"), "b", "part", F.lit(False).alias("member")).distinct()
    )
    kind = pairs.schema["a"].dataType.simpleString()
    met = texts.join(needs, texts["doc_id"] == needs["id"]).select("id", "b", "part", "member", "text")
    met = met.repartition(partitions_for(texts, 64 << 20), "b", "part").sortWithinPartitions("b", "part", "member")
    return met.mapInArrow(tidy(_verify(p)), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents of one shingle set form a class whose least doc_id stands for it. Classes that share a band are
    candidates: first each with a leader of its bucket, which joins most of a large group in as many pairs as
    it has members; then, in buckets that still hold several components, pairs across components that sizes, sketches and counts of
    shared shingles leave possible. Every pair is confirmed on full sets, so the components are those of all found pairs, without emitting
    all pairs of a group.

    A null or wordless text has no shingles, no links and is kept. A null doc_id has a null component_id and is
    kept. Rows that share a doc_id are one document and share its component. Extra columns are ignored; no rows give no rows.
    Intermediate tables are deleted once the result, a small table in the shared folder, is written.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = ", ".join(f"{w} bigint" for w in p.sketch)
    signed = scratch.stage(docs.mapInArrow(tidy(_sign(p)), f"doc_id {kind}, n_shingles bigint, k1 bigint, k2 bigint, {words}, bands array<bigint>"), "signatures")
    some = signed.where("doc_id is not null and k1 is not null")
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    copies = some.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = scratch.stage(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", *p.sketch, "bands")).alias("m")).select("k1", "m.*"), "classes")
    traits = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "k1", *p.sketch)
    bands = reps.select(F.col("doc_id").alias("id"), "k1", "bands")
    shared = scratch.stage(buckets(reps, kind), "buckets")
    texts = scratch.stage(docs.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    first = scratch.stage(leader_pairs(shared, traits, p), "first")
    links = scratch.stage(verified(texts, first, p), "links")
    second = cross_pairs(shared, connected_components(links), traits.join(bands, ["id", "k1"]), texts, p, scratch).join(first, ["a", "b"], "left_anti")
    more = verified(texts, scratch.stage(second, "second"), p)
    component = connected_components(links.unionByName(more).unionByName(copies))
    result = (
        signed.select("doc_id", "n_shingles")
        .join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    return scratch.result(result, "components")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id, with all its columns.

    Rows that share a doc_id are one document and go or stay together. Rows with a null doc_id, and rows with a null or wordless
    text, are in no group and stay. An empty table gives an empty one.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
