"""Mixing sources to target weights by pivotal dependent rounding of copy counts.

DataFrame functions only. Each document of a source is wanted target / source_size times; the whole part is taken, and
of the fractions two at a time trade mass (in words) at random until one is 0 or 1, which keeps every expectation and
the source's words. Chunks of a source are folded so at once; what is left of each, at most one fraction, goes to the
next level of a reduction tree, until each source has one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import cut, stage

SMALL_GROUPS = 10_000  # sources whose counts are broadcast: at most 160 kB
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights by the sources' order, repeating; most copies of any document; about chunk fractions are folded in one row.

    Documents are rounded in strata, those of more than an eighth of their source's words first; the words by which a
    stratum misses its expectation shift the probabilities of the next, so that no large document is left to the end.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: float = 3.0
    chunk: int = 48
    seed: int = 11
    strata: tuple[int, ...] = (8, 40, 200, 1000)


def targets(sizes: DataFrame, m: Mix = Mix()) -> DataFrame:
    """sizes (source, source_size) with target: shares of the whole by weight, of at most `most` times a source's size.

    Sources stand by code point, null last. Capped sources are those of least size for their weight, and the level of
    the rest is what is left over their weight: running sums in that order find it without repeated sharing. A row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(m.weights))).cast("int")
    df = sizes.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in m.weights]), turn))
    df = df.withColumns({"cap": F.col("source_size") * F.lit(m.most), "ratio": F.col("source_size") * F.lit(m.most) / F.col("w")})
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    df = df.withColumn("level", F.try_divide(left, heavy))
    # if all before are capped, this one isn't where the level is at most its ratio; the first such level holds for the rest
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return df.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * level), F.col("cap")).alias("target"))


def fold(units: Column, seed: int, level: int) -> Column:
    """Pivotal rounding of an array of (u, size, p), 0 < p < 1: struct(carry, done), done the array of (u, take)."""
    empty = F.struct(
        F.lit(None).cast("struct<u:bigint,size:bigint,p:double>").alias("carry"), F.array().cast("array<struct<u:bigint,take:int>>").alias("done")
    )

    def step(state: Column, x: Column) -> Column:
        c = state["carry"]
        a, b = c["p"] * c["size"], x["p"] * x["size"]
        up = F.least(c["size"] - a, b)  # words the carried one can take from x
        down = F.least(a, x["size"] - b)
        draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), c["u"], x["u"]), 11)).cast("double") / F.lit(float(1 << 53))
        rise = draw * (up + down) < down
        # exactly 0 or 1 where a transfer fills or empties a document
        cp = F.when(rise, F.when(c["size"] - a <= b, 1.0).otherwise((a + up) / c["size"])).otherwise(F.when(a <= x["size"] - b, 0.0).otherwise((a - down) / c["size"]))
        xp = F.when(rise, F.when(b <= c["size"] - a, 0.0).otherwise((b - up) / x["size"])).otherwise(F.when(x["size"] - b <= a, 1.0).otherwise((b + down) / x["size"]))

        def settle(u: Column, p: Column) -> Column:
            none = F.array().cast("array<struct<u:bigint,take:int>>")
            return F.when(p <= 0, F.array(F.struct(u.alias("u"), F.lit(0).alias("take")))).when(p >= 1, F.array(F.struct(u.alias("u"), F.lit(1).alias("take")))).otherwise(none)

        unit = lambda v, p: F.struct(v["u"].alias("u"), v["size"].alias("size"), p.alias("p"))
        traded = F.transform(F.array(F.struct(cp.alias("cp"), xp.alias("xp"))), lambda t: F.struct(
            F.when((t["cp"] > 0) & (t["cp"] < 1), unit(c, t["cp"])).when((t["xp"] > 0) & (t["xp"] < 1), unit(x, t["xp"])).alias("carry"),
            F.concat(state["done"], settle(c["u"], t["cp"]), settle(x["u"], t["xp"])).alias("done"),
        ))[0]
        return F.when(c.isNull(), F.struct(unit(x, x["p"]).alias("carry"), state["done"].alias("done"))).otherwise(traded)

    return F.aggregate(units, empty, step)


def rounded(units: DataFrame, m: Mix) -> DataFrame:
    """(u, take) for units (g, u, size, p): take is 0 or 1, 1 with probability p, and each g's words stay near their expectation."""
    done, level, left = None, 0, units
    while True:
        counts = left.groupBy("g").agg(F.count("*").alias("n"))
        most, groups = counts.agg(F.max("n"), F.count("*")).first()
        if (most or 0) <= 1:
            break
        if groups <= SMALL_GROUPS:  # a source of many rows then isn't dealt to one task
            counts = F.broadcast(counts)
        chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / m.chunk))
        part = F.pmod(F.xxhash64(F.lit(m.seed), F.lit(level), "u"), chunks)
        rows = left.join(counts, "g").select("g", part.alias("part"), F.struct(F.xxhash64("u", F.lit(m.seed)).alias("o"), "u", "size", "p").alias("unit"))
        folded = rows.groupBy("g", "part").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = folded.select("g", fold(F.transform("units", lambda x: F.struct(x["u"].alias("u"), x["size"].alias("size"), x["p"].alias("p"))), m.seed, level).alias("f"))
        folded = stage(folded, f"fold{level}")
        now = folded.select(F.inline("f.done"))
        done = now if done is None else done.unionByName(now)
        left = folded.where("f.carry is not null").select("g", "f.carry.*")
        level += 1
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(m.seed), F.lit(-1), "u"), 11).cast("double") / F.lit(float(1 << 53))
    last = left.select("u", F.when(draw < F.col("p"), 1).otherwise(0).alias("take"))
    return last if done is None else done.unionByName(last)


def mix(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size (words), source_size, target, taken (words, repeats counted), copies.

    Copies are the whole part of target / source_size, or one more: so taken is at most `most` times size. The draws are
    hashes of what they decide on, so reruns agree. Rows of one doc_id, source and size are one unit, and get the same copies.
    A null or wordless text has size 0 and, having no words to weigh, as many copies as the whole part says; a source of no words
    has target 0. A null doc_id and a null source are values like any other. Extra columns are ignored; no rows give no rows.
    """
    sized = stage(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")), "sizes")
    return copies(sized, m)


def copies(sized: DataFrame, m: Mix) -> DataFrame:
    wanted = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), m))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    few = wanted.count() <= SMALL_GROUPS
    small = F.broadcast if few else (lambda df: df)  # a row a source: then a source of many rows isn't dealt to one task
    plan = wanted.select(F.col("source").alias("_s"), "source_size", "target", F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("p"))
    unit = F.xxhash64("doc_id", F.coalesce("source", F.lit("")), F.col("source").isNull(), "size")
    keyed = sized.withColumn("u", unit).join(small(plan), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    units = cut(
        keyed.where("size > 0 and p > 0")
        .groupBy("u")
        .agg(
            F.sum("size").alias("size"),
            F.first("p").alias("p"),
            F.first(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).alias("g"),
            F.first("source_size").alias("source_size"),
        )
        .select("g", "u", "size", "p", sum((F.when(F.col("size") * k <= F.col("source_size"), 1).otherwise(0) for k in m.strata), F.lit(0)).alias("stratum"))
    )
    strata = sorted(r.stratum for r in units.select("stratum").distinct().collect())  # five at most
    takes = keyed.sparkSession.createDataFrame([], "u bigint, take int")
    missed = keyed.sparkSession.createDataFrame([], "g bigint, off double")  # words above expectation, by source
    for k in strata:
        part = units.where(F.col("stratum") == k).select("g", "u", "size", "p")
        shift = part.groupBy("g").agg(F.sum("size").alias("room")).join(missed, "g").select("g", (F.col("off") / F.col("room")).alias("shift"))
        moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") - F.coalesce("shift", F.lit(0.0))))
        part = cut(part.join(small(shift), "g", "left").select("g", "u", "size", "p", moved.alias("q")))
        free = part.where("q > 0 and q < 1").select("g", "u", "size", F.col("q").alias("p"))
        now = cut(rounded(free, m).unionByName(part.where("q >= 1").select("u", F.lit(1).alias("take"))))
        off = part.join(now, "u", "left").select("g", ((F.coalesce("take", F.lit(0)) - F.col("p")) * F.col("size")).alias("off"))
        missed = cut(missed.unionByName(off).groupBy("g").agg(F.sum("off").alias("off")))
        takes = takes.unionByName(now)
    return (
        keyed.join(takes, "u", "left")
        .withColumn("copies", F.col("whole") + F.coalesce("take", F.lit(0)))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
    )


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str, m: Mix = Mix()) -> DataFrame:
    """Each row as often as the mix takes it; rows that it doesn't take go. Rows of one doc_id, source and number of words are taken alike; a null doc_id and a
    null source are values like any other, a null or wordless text has no words, and no rows give no rows."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = stage(docs.select("doc_id", "source", size.alias("size")), "sizes")
    times = copies(sized, m).select("doc_id", "source", "size", "copies").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.col("source").alias("s"), size.alias("n"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    return rows.join(times.where("copies > 0"), same).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
