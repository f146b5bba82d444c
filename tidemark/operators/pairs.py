"""Pairs of vessels that share a time bin and grid cell: edges, lift, accumulation over periods, scores and evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PERSISTENCE_K, REPORT_K, TOP_K, PairConfig
from tidemark.functions.core import above, below, cell, has_prefix, pair_of, share, time_bin
from tidemark.functions.quantiles import grouped_quantiles, medians
from tidemark.functions.ranking import cut, ranked
from tidemark.operators.blocks import Dealt, block_pairs
from tidemark.operators.counted import Counted, by_kind, pairs_alone, true_places


def vessel_cells(points: DataFrame, c: PairConfig = PairConfig()) -> DataFrame:
    """Distinct (tbin, ci, cj, mmsi) with whether the vessel was ever stopped and ever moving there; both may hold."""
    return (
        points.where(~has_prefix("mmsi", c.exclude_prefixes))
        .groupBy(time_bin("ts", c.bin_hours).alias("tbin"), cell("lat", c.cell).alias("ci"), cell("lon", c.cell).alias("cj"), "mmsi")
        .agg(F.max(below("sog", c.stopped_sog)).alias("stopped"), F.max(above("sog", c.moving_sog)).alias("moving"))
    )


HOT_CELL = 1_024  # vessels that a cell may hold before it is split
HOT_CELLS = 100_000  # split cells that are broadcast, at most


def meetings(cells: DataFrame, by: tuple[str, ...] = ("tbin", "ci", "cj"), block: int = HOT_CELL) -> DataFrame:
    """by, mmsi_a < mmsi_b, and stopped and moving (both vessels are), once for each cell that two vessels share; vessels without a number meet nobody.

    The self-join is an equi-join on the cell. A cell of more than `block` vessels is dealt to n blocks of about that many and its pairs to the n(n + 1) / 2 pairs of blocks, each a key of its own:
    a vessel's row goes n + 1 times, and no key holds more than about two blocks, however busy the cell. cells is read three times: cut it before.
    """
    cells = cells.where(F.col("mmsi").isNotNull())
    hot = cut(cells.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > block))
    many = hot.count()
    keys, apart = list(by), F.lit(False)
    if many:
        n = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("long")
        dealt = cells.join(F.broadcast(hot) if many <= HOT_CELLS else hot, keys, "left").withColumn("_n", n).withColumn("_k", F.pmod(F.xxhash64("mmsi"), F.col("_n")))
        left = dealt.withColumns({"_x": F.col("_k"), "_y": F.explode(F.sequence(F.col("_k"), F.col("_n") - 1))})
        right = dealt.withColumns({"_x": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k"))), "_y": F.col("_k")})
        keys, apart = [*by, "_x", "_y"], F.col("a._x") < F.col("a._y")
    else:
        left = right = cells
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], apart | (F.col("a.mmsi") < F.col("b.mmsi"))])
    low, high = pair_of("a.mmsi", "b.mmsi")
    return met.select(*[F.col(f"a.{k}") for k in by], low.alias("mmsi_a"), high.alias("mmsi_b"), (F.col("a.stopped") & F.col("b.stopped")).alias("stopped"), (F.col("a.moving") & F.col("b.moving")).alias("moving"))


def cooccurrence(cells: DataFrame, min_windows: int, blocks: int | None = None) -> DataFrame:
    """mmsi_a < mmsi_b with n_windows (shared bins and cells), n_both_stopped, n_both_moving and their shares. blocks of vessels, by default as many as the rows ask for."""
    return with_ratios(block_pairs(cells, ("tbin", "ci", "cj"), least=min_windows, blocks=blocks))


def with_ratios(edges: DataFrame) -> DataFrame:
    n = F.col("n_windows")
    return edges.withColumns({"mooring_ratio": share(F.col("n_both_stopped"), n), "moving_ratio": share(F.col("n_both_moving"), n)})


def vessel_attributes(points: DataFrame) -> DataFrame:
    """mmsi, name, class: the earliest not null of each."""
    at = F.struct("ts", "lat", "lon")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    return points.groupBy("mmsi").agg(first("vessel_name").alias("name"), first("vessel_class").alias("class"))


def with_names(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        named = attributes.select(F.col("mmsi").alias(f"mmsi_{side}"), F.col("name").alias(f"name_{side}"), F.col("class").alias(f"class_{side}"))
        edges = edges.join(named, f"mmsi_{side}", "left")
    return edges


def build_edges(points: DataFrame, c: PairConfig = PairConfig()) -> DataFrame:
    """Edges with names, classes and lift = n_windows * cells / (cells of a * cells of b), over all non-empty cells; null where it isn't finite."""
    cells = cut(vessel_cells(points, c))
    total = cells.select("tbin", "ci", "cj").distinct().agg(F.count("*").cast("double").alias("total"))
    vessels = vessel_attributes(points).join(cells.groupBy("mmsi").agg(F.count("*").cast("double").alias("n")), "mmsi", "left")
    df = with_ratios(block_pairs(cells, ("tbin", "ci", "cj"), least=c.min_windows, vessels=vessels)).crossJoin(F.broadcast(total))  # one row
    return df.withColumn("lift", F.try_divide(F.col("n_windows").cast("double") * F.col("total"), F.col("n_a") * F.col("n_b"))).drop("n_a", "n_b", "total")


def cells_by_period(points: DataFrame, period: Column, c: PairConfig) -> DataFrame:
    return (
        points.where(~has_prefix("mmsi", c.exclude_prefixes))
        .groupBy(period.alias("period"), time_bin("ts", c.bin_hours).alias("tbin"), cell("lat", c.cell).alias("ci"), cell("lon", c.cell).alias("cj"), "mmsi")
        .agg(F.max(below("sog", c.stopped_sog)).alias("stopped"), F.max(above("sog", c.moving_sog)).alias("moving"))
    )


BY_PERIOD = ("period", "tbin", "ci", "cj")


def edges_by_period(points: DataFrame, period: Column, c: PairConfig = PairConfig(), filter_after: bool = False) -> DataFrame:
    """Edges of each period on its own: period, mmsi_a, mmsi_b, n_windows, n_both_stopped, n_both_moving; of min_windows or more, unless filter_after leaves that to the sums. A cell's bin belongs to one period."""
    return block_pairs(cells_by_period(points, period, c), BY_PERIOD, least_each=1 if filter_after else c.min_windows, apart=True)


def merge_periods(edges: DataFrame, points: DataFrame, least: int | None = None) -> DataFrame:
    """Edges (period, mmsi_a, mmsi_b, counts) summed, n_months the number of periods, with shares, names and classes; sums of fewer than `least` windows go."""
    total = edges.groupBy("mmsi_a", "mmsi_b").agg(*[F.sum(x).alias(x) for x in ("n_windows", "n_both_stopped", "n_both_moving")], F.count_distinct("period").alias("n_months"))
    if least is not None:
        total = total.where(F.col("n_windows") >= least)
    return with_names(with_ratios(total), vessel_attributes(points))


def accumulate(points: DataFrame, period: Column, c: PairConfig = PairConfig(), filter_after: bool = False, incidents: DataFrame | None = None, score: Callable | None = None) -> DataFrame:
    """Edges of each period summed: n_windows, n_both_stopped, n_both_moving, n_months (periods with an edge), names, classes, shares; with incidents, incident_num, the last that both vessels are in, and is_truth;
    with a score (of arrays of n_both_moving and n_months), score and rank.

    The threshold applies to each period's edges first; with filter_after, to the sums only. `sources.store` keeps the periods' edges, so that a new period is added alone.
    Edges are as many as the graph is dense, so they aren't kept: who reads them twice counts them twice.
    """
    least = (c.min_windows, 1) if filter_after else (1, c.min_windows)
    df = with_ratios(block_pairs(cells_by_period(points, period, c), BY_PERIOD, *least, periods=True, vessels=vessel_attributes(points), incidents=incidents, score=score))
    return df if incidents is None else df.withColumn("is_truth", F.col("incident_num").isNotNull())


def counted(points: DataFrame, period: Column, c: PairConfig, incidents: DataFrame, classes: bool = True) -> Counted:
    """The edges of `accumulate` for `report`, `persistence`, `persistence_curve`, `class_baseline`, which need a row for each kind of edge and the few edges that come first."""
    vessels = vessel_attributes(points).select("mmsi", F.col("class").cast("string").alias("class")) if classes else None
    return Counted(Dealt(cells_by_period(points, period, c), BY_PERIOD, vessels, incidents), 1, c.min_windows)


def class_pair() -> Column:
    a, b = (F.coalesce(F.col(x).cast("string"), F.lit("nan")) for x in ("class_a", "class_b"))
    return F.concat_ws("/", *pair_of(a, b))


def by_months(moving: np.ndarray, months: np.ndarray) -> np.ndarray:
    return moving * np.log1p(months.astype(np.float64))


def per_month(moving: np.ndarray, months: np.ndarray) -> np.ndarray:
    return moving / (1.0 + months)


def score_edges(edges: DataFrame) -> DataFrame:
    """score = n_both_moving * ln(1 + n_months), and rank by it, ties by ids."""
    df = edges.withColumn("score", F.col("n_both_moving") * F.log1p(F.col("n_months").cast("double")))
    return ranked(df, [F.desc("score"), "mmsi_a", "mmsi_b"])


SCORES = ("s_raw", "s_pers_sqrt", "s_per_month", "s_class_z", "s_class_pct_w")


def few(df: DataFrame, most: int = HOT_CELLS) -> DataFrame:
    """df, to be broadcast if it has no more than that many rows; it is counted, so cut it before."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def build_scores(edges: DataFrame, n: Column | None = None) -> DataFrame:
    """Five scores, m being 1 + n_months: raw movement, times the root of m, by m, z-score of that within the pair of classes, and its percentile rank there times ln(1 + movement).

    Deviations are sample deviations; a class pair of one edge or of equal scores has z-score 0. Percentile ranks run from 1/n to 1 and tied rows share
    the mean of their ranks; as equal scores are counted first, a pair of classes is ranked by its distinct scores only. n: how many edges a row stands for, by default one.
    """
    months = F.lit(1.0) + F.col("n_months")
    df = edges.withColumn("class_pair", class_pair()).withColumns({
        "s_raw": F.col("n_both_moving").cast("double"),
        "s_pers_sqrt": F.col("n_both_moving") * F.sqrt(months),
        "s_per_month": F.col("n_both_moving") / months,
    })
    values = cut(df.groupBy("class_pair", "s_per_month").agg((F.count("*") if n is None else F.sum(n)).alias("_k")))
    stats = values.groupBy("class_pair").agg(F.sum("_k").alias("_n"), (F.sum(F.col("s_per_month") * F.col("_k")) / F.sum("_k")).alias("_mean"), (F.min("s_per_month") < F.max("s_per_month")).alias("_differ"))
    values = values.join(stats, "class_pair")
    squares = values.groupBy("class_pair").agg(F.sum(F.col("_k") * (F.col("s_per_month") - F.col("_mean")) ** 2).alias("_squares"))
    smaller = F.coalesce(F.sum("_k").over(Window.partitionBy("class_pair").orderBy("s_per_month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("_rank", smaller + (F.col("_k") + 1) / F.lit(2.0)).join(squares, "class_pair").drop("_k")
    values = cut(values.withColumn("_sd", F.when(F.col("_differ"), F.sqrt(F.try_divide(F.col("_squares"), F.col("_n") - 1)))).drop("_differ", "_squares"))
    df = df.join(few(values), ["class_pair", "s_per_month"])
    z = F.coalesce(F.try_divide(F.col("s_per_month") - F.col("_mean"), F.when(F.col("_sd") > 0, F.col("_sd"))), F.lit(0.0))
    df = df.withColumns({"s_class_z": z, "s_class_pct": F.col("_rank") / F.col("_n")})
    return df.withColumn("s_class_pct_w", F.col("s_class_pct") * F.log1p(F.col("n_both_moving").cast("double"))).drop("_n", "_mean", "_sd", "_rank")


def incident_pairs(incidents: DataFrame) -> DataFrame:
    """(incident_num, mmsi_a < mmsi_b) for all pairs of vessels in an incident."""
    none = incidents.where(F.lit(False)).select("incident_num", "mmsi", F.lit(False).alias("stopped"), F.lit(False).alias("moving"))
    return block_pairs(none, ("incident_num",), incidents=incidents, listed=True).drop("n_windows")


def in_month(incidents: DataFrame, start: str) -> DataFrame:
    """Incidents that start in the month of `start`, half open."""
    t0 = F.date_trunc("MONTH", F.lit(start).cast("timestamp"))
    return incidents.where((F.col("t_start") >= t0) & (F.col("t_start") < F.add_months(t0, 1)))


def validate(incidents: DataFrame, cells: DataFrame, min_windows: int = 1) -> DataFrame:
    """Each incident's pairs with whether they share min_windows cells or more, and how many."""
    kinds = cut(incidents.groupBy("incident_num").agg(F.min("incident_type").alias("incident_type"), F.min("evidence").alias("evidence")))
    found = block_pairs(cells, ("tbin", "ci", "cj"), least=min_windows, incidents=incidents, listed=True)
    return found.join(few(kinds), "incident_num", "left").select(
        "incident_num", "mmsi_a", "mmsi_b", "incident_type", "evidence", F.col("n_windows").isNotNull().alias("detected"), F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows")
    )


def truth_pairs(incidents: DataFrame) -> DataFrame:
    """(mmsi_a, mmsi_b, incident_num), once a pair: the last incident."""
    who = incidents.select("incident_num", "mmsi").distinct().withColumns({"stopped": F.lit(False), "moving": F.lit(False)})
    return block_pairs(who, ("incident_num",), incidents=incidents).select("mmsi_a", "mmsi_b", "incident_num")


def count_truth_pairs(incidents: DataFrame) -> DataFrame:
    """(t): how many rows `truth_pairs` has, none of which is made."""
    who = incidents.select("incident_num", "mmsi").distinct().withColumns({"stopped": F.lit(False), "moving": F.lit(False)})
    return Dealt(who, ("incident_num",), twice=False).pairs(fold=(pairs_alone, "n long")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))


def with_truth(edges: DataFrame, truth: DataFrame, by_name: bool = False) -> DataFrame:
    """edges with is_truth: its vessels are in one incident; by_name compares pairs of names instead, missing names as 'nan'."""
    if not by_name:
        known = truth.select("mmsi_a", "mmsi_b", F.lit(True).alias("is_truth"))
        return edges.join(known, ["mmsi_a", "mmsi_b"], "left").withColumn("is_truth", F.coalesce("is_truth", F.lit(False)))
    lo, hi = names_of_pair()
    names = edges.join(truth, ["mmsi_a", "mmsi_b"], "left_semi").select(lo.alias("_lo"), hi.alias("_hi"), F.lit(True).alias("is_truth")).distinct()
    return edges.withColumns({"_lo": lo, "_hi": hi}).join(names, ["_lo", "_hi"], "left").drop("_lo", "_hi").withColumn("is_truth", F.coalesce("is_truth", F.lit(False)))


def names_of_pair() -> tuple[Column, Column]:
    return pair_of(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("name_a", "name_b")])


def truth_by_name(edges: DataFrame, vessels: DataFrame) -> DataFrame:
    """As `with_truth` by names, of edges that bring is_truth by numbers. vessels: (mmsi, name) of all.

    A pair whose names are no other vessel's has no other edge of the same names, so it isn't joined: only edges of shared (or missing) names are.
    """
    text = F.coalesce(F.col("name").cast("string"), F.lit("nan"))
    shared = cut(vessels.select(text.alias("_name")).groupBy("_name").agg(F.count("*").alias("_n")).where("_n > 1").select("_name"))
    if shared.isEmpty():
        return edges
    shared, held = few(shared), edges
    for c in ("a", "b"):
        held = held.join(shared.select(F.col("_name").alias(f"_{c}"), F.lit(True).alias(f"_shared_{c}")), F.coalesce(F.col(f"name_{c}").cast("string"), F.lit("nan")) == F.col(f"_{c}"), "left")
    lo, hi = names_of_pair()
    common = F.coalesce("_shared_a", "_shared_b", F.lit(False))
    known = held.where(common & F.col("is_truth")).select(lo.alias("_lo"), hi.alias("_hi"), F.lit(True).alias("_known")).distinct()
    joined = held.where(common).withColumns({"_lo": lo, "_hi": hi}).join(known, ["_lo", "_hi"], "left").withColumn("is_truth", F.coalesce("_known", F.lit(False)))
    return held.where(~common).select(*edges.columns).unionByName(joined.select(*edges.columns))


def top_hits(scored: DataFrame | Counted, scores: tuple[str, ...], ks: tuple[int, ...]) -> DataFrame:
    """(score, K, hits, n, t): truth edges among the first K by each score (ties by ids), all edges, all truth edges.

    All scores are ranked in one pass; tasks keep their first rows up to the largest K, so no more are shuffled. Of counted edges only those are made that can be among the first.
    """
    whole = None
    if isinstance(scored, Counted):
        kinds = cut(build_scores(scored.kinds, F.col("n")))
        whole = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("n"))), F.lit(0)).alias("t"))
        first = scored.first(kinds, scores, max(ks))
        scored = scored.edges(kinds, scores) if first is None else first
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("s")) for s in scores])).alias("x")
    first = Window.partitionBy("score").orderBy(F.desc("s"), "mmsi_a", "mmsi_b")
    top = scored.select("mmsi_a", "mmsi_b", "is_truth", each).select("mmsi_a", "mmsi_b", "is_truth", "x.*").withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(ks))
    hits = top.groupBy("score").agg(*[F.count_if((F.col("r") <= k) & F.col("is_truth")).alias(f"h{k}") for k in ks])
    whole = scored.agg(F.count("*").alias("n"), F.count_if("is_truth").alias("t")) if whole is None else whole
    kk = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("K"), F.col(f"h{k}").alias("hits")) for k in ks]))
    return hits.crossJoin(whole).select("score", kk.alias("x"), "n", "t").select("score", "x.*", "n", "t")  # whole is one row


def report(scored: DataFrame | Counted, scores: tuple[str, ...] = SCORES, ks: tuple[int, ...] = REPORT_K) -> DataFrame:
    """score, K, hits, recall, precision and lift; precision is over K also where there are fewer edges."""
    precision = share(F.col("hits"), F.col("K"))
    return top_hits(scored, scores, ks).select(
        "score", "K", "hits", share(F.col("hits"), F.col("t")).alias("recall"), precision.alias("precision"), F.try_divide(precision, share(F.col("t"), F.col("n"))).alias("lift")
    )


def best_score(table: DataFrame, ks: tuple[int, ...] = (20, 50, 100, 200)) -> DataFrame:
    """The score of largest mean lift over ks; of equal ones the first by name."""
    means = table.where(F.col("K").isin(*ks)).groupBy("score").agg(F.round(F.avg("lift"), 6).alias("mean_lift"))
    return means.orderBy(F.desc("mean_lift"), "score").limit(1)


def class_baseline(scored: DataFrame | Counted, first: int = 12) -> DataFrame:
    """The commonest pairs of classes: edges, median and largest joint movement, truth edges."""
    if isinstance(scored, Counted):
        kinds = cut(scored.kinds.groupBy(class_pair().alias("class_pair"), "n_both_moving").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("n"))), F.lit(0)).alias("t")))
        top = kinds.groupBy("class_pair").agg(F.sum("n").alias("n_edges"), F.max("n_both_moving").alias("max_moving"), F.sum("t").alias("n_truth"))
        each = F.col("n")
    else:
        kinds, each = scored, None
        top = scored.groupBy("class_pair").agg(F.count("*").alias("n_edges"), F.max("n_both_moving").alias("max_moving"), F.count_if("is_truth").alias("n_truth"))
    top = cut(top.orderBy(F.desc("n_edges"), "class_pair").limit(first))
    middle = medians(kinds.join(F.broadcast(top.select("class_pair")), "class_pair", "left_semi"), ["n_both_moving"], ("class_pair",), each).withColumnRenamed("n_both_moving", "median_moving")
    return top.join(middle, "class_pair", "left").select("class_pair", "n_edges", "median_moving", "max_moving", "n_truth").orderBy(F.desc("n_edges"), "class_pair")


def truth_hits(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Ranked edges that are truth pairs. Edges that bring their incident_num aren't joined."""
    hits = scored.where("incident_num is not null") if "incident_num" in scored.columns else scored.join(truth, ["mmsi_a", "mmsi_b"])
    return hits.select("incident_num", "rank", "score", "n_both_moving", "mmsi_a", "mmsi_b", "name_a", "name_b", "class_a", "class_b")


def evaluate_counted(edges: Counted, score: Callable, n_truth: DataFrame, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """As `evaluate`, of edges ranked by a score of arrays of n_both_moving and n_months. n_truth: the row of `count_truth_pairs`."""
    scored = cut(by_kind(edges.kinds, score))
    whole = scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("n"))), F.lit(0)).alias("h")).crossJoin(n_truth)  # one row each
    first = edges.first(scored, ("score",), max(ks))
    first = edges.edges(scored, ("score",)) if first is None else first
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "mmsi_a", "mmsi_b"))  # tasks keep their first rows
    top = first.select("is_truth", rank.alias("r")).where(F.col("r") <= max(ks))
    found = top.agg(*[F.count_if((F.col("r") <= k) & F.col("is_truth")).alias(f"h{k}") for k in ks])
    rows = [(F.least(F.lit(k).cast("long"), F.col("n")), F.col(f"h{k}")) for k in ks] + [(F.col("n"), F.col("h"))]
    x = F.explode(F.array(*[F.struct(k.alias("K"), h.alias("hits")) for k, h in rows]))
    return whole.crossJoin(found).select(x.alias("x"), "t").select("x.*", share(F.col("x.hits"), F.col("t")).alias("recall"), share(F.col("x.hits"), F.col("x.K")).alias("precision"))


def truth_summary_counted(edges: Counted, score: Callable, n_truth: DataFrame) -> DataFrame:
    """As `truth_summary`, of edges ranked by a score of arrays of n_both_moving and n_months. n_truth: the row of `count_truth_pairs`."""
    n = edges.kinds.where("is_truth").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    last = n - 1
    rank = true_places(edges, score, sorted({0, last // 2, -(-last // 2), last})) if n else {}
    middle = F.lit((rank[last // 2] + rank[-(-last // 2)]) / 2 if n else None).cast("double")
    best, worst = (F.lit(rank[k] if n else None).cast("long") for k in (0, last))
    row = n_truth.withColumnRenamed("t", "n_truth").withColumns({"n_found": F.lit(n).cast("long"), "best_rank": best, "worst_rank": worst, "median_rank": middle})
    return row.withColumn("recall", share(F.col("n_found"), F.col("n_truth")))


def evaluate(ranked_edges: DataFrame, truth: DataFrame, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """(K, hits, recall, precision) of the first K edges by rank, for each of ks and for all edges; a K above their number is that number.

    Recall is over all truth pairs, also those that are no edges. Without edges precision is null, without truth pairs recall.
    """
    n = ranked_edges.agg(F.count("*").alias("n")).crossJoin(truth.agg(F.count("*").alias("t")))  # one row each
    found = truth_hits(ranked_edges, truth).agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.count("*").alias("h"))
    rows = [(F.least(F.lit(k).cast("long"), F.col("n")), F.col(f"h{k}")) for k in ks] + [(F.col("n"), F.col("h"))]
    x = F.explode(F.array(*[F.struct(k.alias("K"), h.alias("hits")) for k, h in rows]))
    return n.crossJoin(found).select(x.alias("x"), "t").select("x.*", share(F.col("x.hits"), F.col("t")).alias("recall"), share(F.col("x.hits"), F.col("x.K")).alias("precision"))


def truth_summary(ranked_edges: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: truth pairs, those found as edges, their share, and the median, best and worst of their ranks."""
    hits = cut(truth_hits(ranked_edges, truth).select("rank"))
    found = hits.agg(F.count("*").alias("n_found"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank")).crossJoin(medians(hits, ["rank"]).withColumnRenamed("rank", "median_rank"))  # one row each
    return truth.agg(F.count("*").alias("n_truth")).crossJoin(found).withColumn("recall", share(F.col("n_found"), F.col("n_truth")))  # one row each


def persistence(edges: DataFrame | Counted, periods: int) -> DataFrame:
    """One row: edges, those of every period, their share and truth edges among them, and medians of n_months and n_both_moving of all and of truth edges (is_truth)."""
    full, each, n = F.col("n_months") == periods, None, F.lit(1).cast("long")
    if isinstance(edges, Counted):
        edges, each, n = edges.kinds, F.col("n"), F.col("n")
    total = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0).cast("long"))
    whole = edges.agg(total(F.lit(True)).alias("n_edges"), total(full).alias("n_full"), share(total(full), total(F.lit(True))).alias("full_share"), total(full & F.col("is_truth")).alias("n_full_truth"))
    middles = ["n_months", "n_both_moving", "n_months_truth", "n_both_moving_truth"]
    found = grouped_quantiles(edges.withColumns({f"{c}_truth": F.when(F.col("is_truth"), F.col(c)) for c in ("n_months", "n_both_moving")}), middles, n=each)
    of = lambda c: F.max(F.when(F.col("column") == c, F.col("value")))
    middle = found.agg(of("n_months").alias("median_months"), of("n_months_truth").alias("median_months_truth"), of("n_both_moving").alias("median_moving"), of("n_both_moving_truth").alias("median_moving_truth"))
    return whole.crossJoin(middle)  # one row each


def persistence_curve(scored: DataFrame | Counted, ks: tuple[int, ...] = PERSISTENCE_K) -> DataFrame:
    """(K, base_hits, pers_hits): truth edges among the first K by movement times the root of persistence, and by movement a month."""
    hits = top_hits(scored, ("s_pers_sqrt", "s_per_month"), ks)
    of = lambda s: F.max(F.when(F.col("score") == s, F.col("hits")))
    return hits.groupBy("K").agg(of("s_pers_sqrt").alias("base_hits"), of("s_per_month").alias("pers_hits"))


def persistence_ranks(scored: DataFrame) -> DataFrame:
    """Truth edges with their rank by movement a month, ties by ids."""
    df = ranked(scored.select("mmsi_a", "mmsi_b", "n_both_moving", "n_months", "s_per_month", "is_truth"), [F.desc("s_per_month"), "mmsi_a", "mmsi_b"], "rank_pers")
    return df.where("is_truth").drop("is_truth")


def moored_pairs(edges: DataFrame, c: PairConfig = PairConfig()) -> DataFrame:
    """Edges whose vessels are mostly both stopped."""
    return edges.where(F.col("mooring_ratio") >= c.mooring_ratio)


def moving_pairs(edges: DataFrame, c: PairConfig = PairConfig()) -> DataFrame:
    """Edges whose vessels are often both under way."""
    return edges.where(F.col("n_both_moving") >= c.min_moving_windows)
