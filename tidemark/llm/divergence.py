"""Audit of how far the sources of a language differ in their words, in whole numbers throughout.

A source's share of a term is smoothed, so every pair of sources differs in every kept term. Only terms that a source has are ever
listed: for two sources, the difference over terms that neither has is one product, and each list of terms corrects it. The largest terms of a source are
found by radix selection: histograms over the bits of values, then over the bytes of tied terms, narrow each source's list before it is ranked.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch

#: Bytes outside terms become spaces, A-Z become a-z; bytes of characters beyond ASCII stay.
TO_TERMS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class Audit:
    """Terms of at least `least` documents of a language are kept; shares are of `unit`; the first `ranks` terms of a source are given.

    A source's list is narrowed until at most `slack` terms more than needed are left, `bits` bits or `width` bytes at a time. Constants of up to `few` sources are broadcast
    (three numbers each); more are joined in `salts` parts, so that a large source isn't one task's. Tasks hold counts of about `held` terms.
    """

    least: int = 3
    unit: int = 1_000_000_000
    ranks: int = 200
    slack: int = 1000
    bits: int = 12
    width: int = 2
    few: int = 10_000
    salts: int = 32
    held: int = 200_000


def _count(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs), and a row without a term for each group, summed over as many documents as fit."""
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms = list(n)
                for i in range(0, len(terms) + 1, 20_000):
                    part = terms[i : i + 20_000]
                    names = pa.array([*part, *([None] if i == 0 else [])], pa.binary()).cast(pa.string())
                    zero = [0] if i == 0 else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(names)), pa.array([source] * len(names)), names, pa.array([n[t] for t in part] + zero, pa.int64()), pa.array([docs[t] for t in part] + zero, pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            counts.clear()

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for k, text in enumerate(batch.column("text")):
                n, docs = counts.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                raw = text.as_buffer()
                own = Counter(raw.to_pybytes().translate(TO_TERMS).split()) if raw is not None else {}
                before = len(n)
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before
                if size >= held:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def share(n: str, total: str, terms: str, a: Audit) -> Column:
    """1 + floor(unit * (n + 1) / (total + terms)), exact for counts of any size; null where both are 0."""
    return F.expr(f"1 + cast({n} + 1 as decimal(27,0)) * cast({a.unit} as decimal(11,0)) div nullif(cast({total} + {terms} as decimal(38,0)), 0)")


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)"""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def meet(rows: DataFrame, groups: DataFrame, few: bool, a: Audit, by: str, spread: str) -> DataFrame:
    """rows with their group's constants: broadcast if groups are few, else joined in parts that a hash of `spread` deals, so that a large group isn't one task's."""
    if few:
        return rows.join(F.broadcast(groups), by)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(a.salts)))
    return dealt.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(a.salts - 1)).cast("array<bigint>"))), [by, "_salt"]).drop("_salt")


def term_counts(docs: DataFrame, a: Audit, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """(kept, groups, few): kept is (g, lang, term, n, p, p0, q), a row for each kept term that group g has; groups is (g, lang, source, p0, terms), a row a group.

    n counts the term, p is its share in the group, p0 that of terms the group doesn't have, q that of the term in the language, and `terms` the language's kept terms.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    pieces = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_count(a.held), "lang string, source string, term string, n bigint, docs bigint")
    counts = scratch.stage(pieces.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    names = scratch.stage(counts.where("term is null").select("lang", "source", F.monotonically_increasing_id().alias("g")), "groups")
    few = names.count() <= a.few
    # a term of a language has one row a source
    term = Window.partitionBy("lang", "term")
    each = counts.where("term is not null").withColumns({"all_n": F.sum("n").over(term), "all_docs": F.sum("docs").over(term), "first": F.min("source").over(term)})
    each = each.where(F.col("all_docs") >= a.least).select("lang", "source", "term", "n", "all_n", (F.col("source") == F.col("first")).alias("first"))
    each = scratch.stage(each, "terms")
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("terms"))
    lang = Window.partitionBy("lang")  # a row a group
    zero = F.lit(0).cast("bigint")
    groups = names.join(totals, ["lang", "source"], "left").withColumns({"total": F.coalesce("total", zero), "terms": F.coalesce("terms", zero)})
    groups = groups.withColumns({"terms": F.sum("terms").over(lang), "lang_total": F.sum("total").over(lang), "none": zero})
    groups = scratch.stage(groups.withColumn("p0", share("none", "total", "terms", a)), "shares")
    keyed = F.struct("lang", "source")
    known = meet(each.withColumn("_g", keyed), groups.select(keyed.alias("_g"), "g", "p0", "total", "lang_total", "terms"), few, a, "_g", "term")
    kept = known.select("g", "lang", "term", "n", share("n", "total", "terms", a).alias("p"), "p0", share("all_n", "lang_total", "terms", a).alias("q"))
    return scratch.stage(kept, "kept"), groups.select("g", "lang", "source", "p0", "terms"), few


def pairs(kept: DataFrame, groups: DataFrame, few: bool, a: Audit) -> DataFrame:
    """(g, h, value) for every two groups g and h of a language: the summed difference of g from h over all kept terms, 0 where there are none.

    With p0 and q0 the shares of terms they don't have, all terms count as apart(p0, q0) at first. What one has alone corrects that by a term for each share
    that occurs in it, with the number of terms of that share; terms that both have add what the two corrections leave out.
    """
    one, two = groups.select("lang", F.col("g").alias("g"), F.col("p0").alias("p0"), "terms"), groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    both = one.join(two, "lang").where("g != h")  # the result's own rows
    base = both.select("g", "h", F.coalesce(F.col("terms") * apart("p0", "q0"), F.lit(0)).alias("value"))
    shares = kept.groupBy("g", "p").agg(F.count("*").alias("k"))
    alone = meet(shares, one.drop("terms"), few, a, "g", "p").join(F.broadcast(two) if few else two, "lang").where("g != h")
    there = alone.select("g", "h", (F.col("k") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"), (F.col("k") * (apart("q0", "p") - apart("q0", "p0"))).alias("back"))
    there = there.groupBy("g", "h").agg(F.sum("value").alias("value"), F.sum("back").alias("back"))
    holders = kept.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "p0"))).alias("own")).where(F.size("own") > 1)  # an entry a source
    x = holders.select("own", F.posexplode("own").alias("i", "x")).select("x", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("y"))
    extra = lambda u, v: apart(f"{u}.p", f"{v}.p") - apart(f"{u}.p", f"{v}.p0") - apart(f"{u}.p0", f"{v}.p") + apart(f"{u}.p0", f"{v}.p0")
    shared = x.groupBy(F.col("x.g").alias("g"), F.col("y.g").alias("h")).agg(F.sum(extra("x", "y")).alias("value"), F.sum(extra("y", "x")).alias("back"))
    parts = base
    for df in (there, shared):
        parts = parts.unionByName(df.select("g", "h", "value")).unionByName(df.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))
    return parts.groupBy("g", "h").agg(F.sum("value").alias("value"))


def _skip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many bytes the least and the largest of a group's tied terms share."""
    for pdf in batches:
        shared = [len(os.path.commonprefix([bytes(x), bytes(y)])) for x, y in zip(pdf["low"], pdf["high"])]
        yield pdf[["g", "v", "need", "found"]].assign(at=pd.Series(shared, dtype="int32"))


def last_bins(rows: DataFrame, digit: Column, bins: Window) -> DataFrame:
    """Of rows (g, need) counted by digit in the order of bins, each group's digit in which its last wanted row lies: g, digit, need (in that digit), size."""
    hist = rows.groupBy("g", digit.alias("digit")).agg(F.count("*").alias("size"), F.first("need").alias("need"))
    hist = hist.withColumn("before", F.sum("size").over(bins) - F.col("size"))  # a row a digit
    return hist.where("before < need and before + size >= need").select("g", "digit", (F.col("need") - F.col("before")).alias("need"), "size")


def largest(rows: DataFrame, few: bool, a: Audit, scratch: Scratch) -> DataFrame:
    """The first a.ranks rows of each g of rows (g, term, v), 0 <= v < 2**60, by v descending, then by the bytes of term, with rank. Terms of a g differ.

    A round counts each group's rows by the next bits of v below the prefix found so far, and takes the digit in which the last wanted row lies; a group is done once few more rows
    than wanted are above its threshold. Where too many rows tie in v, rounds over bytes of their terms follow, beyond those that all of them share. A histogram has at most 2**bits
    or 256**width rows a group.
    """
    wide, by = F.col("size") > F.col("need") + a.slack, Window.partitionBy("g")
    whole = rows.groupBy("g").agg(F.count("*").alias("size"))
    state = scratch.stage(whole.select("g", F.lit(0).cast("bigint").alias("digit"), F.lit(a.ranks).cast("bigint").alias("need"), "size"), "state")
    shift, limits = 60, []
    while True:
        limits.append(state.where(~wide).select("g", F.shiftleft("digit", shift).alias("least"), F.lit(None).cast("binary").alias("upto")))
        state = state.where(wide)
        if shift == 0 or state.isEmpty():
            break
        last, shift = shift, max(0, shift - a.bits)
        near = meet(rows, state, few, a, "g", "term").where(F.shiftright("v", last) == F.col("digit"))
        state = scratch.stage(last_bins(near.drop("digit"), F.shiftright("v", shift), by.orderBy(F.desc("digit"))), "state")
    raw, kind = F.encode("term", "UTF-8"), rows.schema["g"].dataType.simpleString()
    ties = state.select("g", F.col("digit").alias("tied"), "need", F.lit(b"").alias("found"))
    while not ties.isEmpty():
        near = meet(rows, ties, few, a, "g", "term").where((F.col("v") == F.col("tied")) & raw.startswith(F.col("found")))
        ends = near.groupBy("g", "v", "need", "found").agg(F.min(raw).alias("low"), F.max(raw).alias("high"))
        places = scratch.stage(ends.mapInPandas(_skip, f"g {kind}, v bigint, need bigint, found binary, at int").withColumnRenamed("v", "tied"), "places")
        near = meet(rows, places, few, a, "g", "term").where((F.col("v") == F.col("tied")) & raw.startswith(F.col("found")))
        state = last_bins(near, F.substring(raw, F.lit(1), F.col("at") + a.width), by.orderBy("digit"))
        state = scratch.stage(state.join(ties.select("g", "tied"), "g"), "state")
        limits.append(state.where(~wide).select("g", F.col("tied").alias("least"), F.col("digit").alias("upto")))
        ties = state.where(wide).select("g", "tied", "need", F.col("digit").alias("found"))
    found = limits[0]
    for more in limits[1:]:
        found = found.unionByName(more)
    taken = meet(rows, scratch.stage(found, "limits"), few, a, "g", "term")
    above = (F.col("v") > F.col("least")) | (F.col("v") == F.col("least")) & (F.col("upto").isNull() | (F.substring(raw, F.lit(1), F.length("upto")) <= F.col("upto")))
    ranked = taken.where(above).select("g", "term", "v", F.row_number().over(by.orderBy(F.desc("v"), "term")).alias("rank"))  # ranks + slack rows a group
    return ranked.where(F.col("rank") <= a.ranks)


def audit(docs: DataFrame, a: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source): how far each source of a language is from each other one (part `pair`), and the terms that it
    has more of than its language (part `term`, the first a.ranks).

    Null text, lang and source are ''. Every row is a document, also repeated ones. A group without kept terms has pairs, of value 0 if its language keeps none, and no
    terms; a language of one source has no pairs. Ties stand by the bytes of their items. Very long terms are terms like any other. Extra columns are ignored; no rows give no rows.
    Lists of a language's sources are kept with each term, as the result has a row for every two of them anyway. Intermediate tables are deleted when the result is written.
    """
    with Scratch(docs.sparkSession) as scratch:
        kept, groups, few = term_counts(docs, a, scratch)
        names = groups.select("g", "lang", "source")
        order = Window.partitionBy("g").orderBy(F.desc("value"), "item")  # a row for each other source
        met = pairs(kept, groups, few, a).join(names.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
        first = met.select("g", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        more = kept.where("p > q").select("g", "term", apart("p", "q").alias("v"))
        second = largest(more, few, a, scratch).select("g", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("v").alias("value"), "rank")
        out = first.unionByName(second).join(F.broadcast(names) if few else names, "g")
        return scratch.result(out.select("lang", "source", "part", "item", "value", "rank"), "audit")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
