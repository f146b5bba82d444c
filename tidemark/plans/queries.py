"""Queries of the track engine over the test tables; `plans.sql` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import AnomalyConfig, FederatedConfig, PairConfig, RuleConfig
from tidemark.functions.core import micros
from tidemark.functions.ranking import cut, remove, shared_path
from tidemark.operators import eda, graph, ml, pairs, rules, tracks
from tidemark.operators.louvain import louvain
from tidemark.plans.sql import ORACLE  # noqa: F401  the entry reads both here
from tidemark.sources import readers, store, zipped
from tidemark.sources.adapters import incidents, points, supplier_cells

ANY = PairConfig(min_windows=1)
SHORT = RuleConfig(min_points=5)
FOREST = AnomalyConfig()
PERIOD_US = 5 * 86_400_000_000
MONTH = "2024-02-01"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places; sums of doubles depend on the order of rows beyond that."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def period():
    return F.floor(micros("ts") / F.lit(float(PERIOD_US))).cast("long")


def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.cooccurrence(pairs.vessel_cells(points(spark, sf)), 1))


def edge_lift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.build_edges(points(spark, sf), PairConfig(min_windows=2)))


def voyages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.split_voyages(points(spark, sf)).select("mmsi", "ts", "voyage_seq", "voyage_id", "gap_hours"))


def voyage_kinematics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.kinematics(tracks.split_voyages(points(spark, sf))))


def course_std(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.course_spread(tracks.split_voyages(points(spark, sf))))


def coverage_grid(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.coverage_grid(points(spark, sf))


def gaps_of(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return tracks.signal_gaps(tracks.split_voyages(p), tracks.coverage_grid(p))


def signal_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gaps_of(spark, sf))


def gap_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.gap_rollup(gaps_of(spark, sf)))


def draft_usability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.draft_features(tracks.split_voyages(points(spark, sf))))


def voyage_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.build_features(points(spark, sf)))


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.accumulate(points(spark, sf), period(), ANY)


def with_truth(spark: SparkSession, sf: str, score: Callable | None = None) -> DataFrame:
    p = points(spark, sf)
    return pairs.accumulate(p, period(), ANY, incidents=incidents(p), score=score)


def counted_truth(spark: SparkSession, sf: str, classes: bool = True) -> pairs.Counted:
    p = points(spark, sf)
    return pairs.counted(p, period(), ANY, incidents(p), classes)


def edge_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(yearly(spark, sf))


def edge_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.accumulate(points(spark, sf), period(), ANY, score=pairs.by_months).select("mmsi_a", "mmsi_b", "n_both_moving", "n_months", "score", "rank"))


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.build_scores(yearly(spark, sf)).select("mmsi_a", "mmsi_b", "class_pair", *pairs.SCORES, "s_class_pct"))


def class_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.class_baseline(counted_truth(spark, sf)))


def incident_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.incident_pairs(incidents(points(spark, sf)))


def validate_incidents(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return pairs.validate(incidents(p), pairs.vessel_cells(p))


def topk_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.report(counted_truth(spark, sf)))


def best_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.best_score(pairs.report(counted_truth(spark, sf))))


def persistence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.persistence(counted_truth(spark, sf, False), 2))


def truth_hits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.truth_hits(*evaluated(spark, sf)))


def evaluated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return with_truth(spark, sf, pairs.by_months), pairs.truth_pairs(incidents(points(spark, sf)))


def evaluated_counted(spark: SparkSession, sf: str) -> tuple:
    return counted_truth(spark, sf, False), pairs.by_months, pairs.count_truth_pairs(incidents(points(spark, sf)))


def edge_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.evaluate_counted(*evaluated_counted(spark, sf)))


def truth_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.truth_summary_counted(*evaluated_counted(spark, sf)))


def persistence_curve(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.persistence_curve(counted_truth(spark, sf))


def persistence_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Truth edges with their rank by movement a month."""
    df = with_truth(spark, sf, pairs.per_month).where("is_truth")
    return rounded(df.select("mmsi_a", "mmsi_b", "n_both_moving", "n_months", F.col("score").alias("s_per_month"), F.col("rank").alias("rank_pers")))


def truth_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.truth_by_name(with_truth(spark, sf), pairs.vessel_attributes(points(spark, sf))).select("mmsi_a", "mmsi_b", "name_a", "name_b", "is_truth")


def validate_month(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    later = incidents(p).withColumn("t_start", F.col("t_start") + F.expr("interval 20 days"))
    return pairs.validate(pairs.in_month(later, MONTH), pairs.vessel_cells(p))


def moored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.moored_pairs(pairs.cooccurrence(pairs.vessel_cells(points(spark, sf)), 1)))


def moving_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.moving_pairs(pairs.cooccurrence(pairs.vessel_cells(points(spark, sf)), 1), PairConfig(min_moving_windows=2)))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return ml.label_voyages(tracks.build_features(p), incidents(p), AnomalyConfig(pad_hours=0.5))


def voyage_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("voyage_id", "mmsi", "is_incident")


def incident_tracks(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return rounded(ml.incident_tracks(p, incidents(p), 0.5))


def incident_months(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return ml.incident_months(incidents(p), 60 * 24.0)


def pruned_points(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return ml.prune_months(p, incidents(p), 0.5).groupBy("mmsi").agg(F.count("*").alias("n"))


def stored_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points kept by day, of which only files of days near an incident are read: how many of each vessel."""
    p, path = points(spark, sf), shared_path(spark, "points")
    store.write_points(p, path, store.DAYS)
    near = store.in_periods(store.read(spark, path), store.incident_periods(incidents(p).where("evidence = 'High'"), 0.5, store.DAYS))
    out = cut(near.groupBy("mmsi").agg(F.count("*").alias("n")))
    remove(spark, path)
    return out


def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of each day kept as a store: those of odd days first, then the others are added alone, then all are summed."""
    p, path, kept = points(spark, sf), shared_path(spark, "points"), shared_path(spark, "edges")
    for rest in (1, 0):
        store.write_points(p.where(F.dayofyear("ts") % 2 == rest), path, store.DAYS, mode="append")
        store.update_edges(spark, path, kept, ANY)
    out = rounded(store.merged_edges(spark, path, kept))
    for x in (path, kept):
        remove(spark, x)
    return out


def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ml.auc(labelled(spark, sf), "max_sog", "is_incident"))


def feature_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ml.feature_contribution(labelled(spark, sf), ("n_points", "duration_hours", "avg_sog", "max_sog", "stopped_ratio")))


def ports(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rules.detect_ports(points(spark, sf)))


def nearest_port(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    places = p.groupBy("mmsi").agg(F.max_by("lat", F.struct("ts", "lat", "lon")).alias("lat"), F.max_by("lon", F.struct("ts", "lat", "lon")).alias("lon"))
    return rounded(rules.nearest_port(places, rules.detect_ports(p)))


def checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = points(spark, sf)
    v, harbours = cut(tracks.split_voyages(p)), cut(rules.detect_ports(p))
    return p, v, rules.apply_rules(cut(rules.declarations(v, harbours, SHORT)), v, harbours, SHORT)


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return rules.declarations(tracks.split_voyages(p), rules.detect_ports(p), SHORT)


def rule_checks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checked(spark, sf)[2])


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return rules.confusion(checked(spark, sf)[2])


def fusion(spark: SparkSession, sf: str) -> DataFrame:
    p, _, results = checked(spark, sf)
    return rounded(rules.fuse(cut(results), tracks.build_features(p), yearly(spark, sf)))


def strong(spark: SparkSession, sf: str, nodes: DataFrame | None = None) -> DataFrame:
    """Pairs that share two windows or more; with nodes (node), only between these, whose cells alone are paired."""
    cells = pairs.vessel_cells(points(spark, sf))
    if nodes is not None:
        cells = cells.join(nodes.select(F.col("node").alias("mmsi")), "mmsi", "left_semi")
    return pairs.cooccurrence(cells, 2).select("mmsi_a", "mmsi_b", "n_windows")


def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(strong(spark, sf))


def degree_core(spark: SparkSession, sf: str) -> DataFrame:
    """As `graph.degree_core`, edges counted anew between the nodes that are left instead of joined with them."""
    core = cut(graph.degrees(strong(spark, sf)).where("degree >= 3").select("node"))
    big = cut(graph.largest_nodes(strong(spark, sf, core)))
    return graph.degrees(strong(spark, sf, core.join(big, "node", "left_semi"))).orderBy(F.desc("degree"), "node").limit(34)


def ego_network(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ego_network(strong(spark, sf), 5, "n_windows")


def traded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.trade_layer(pairs.cooccurrence(pairs.vessel_cells(points(spark, sf)), 1))


def trade_layer(spark: SparkSession, sf: str) -> DataFrame:
    return traded(spark, sf)[1]


def ring_communities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.communities(*traded(spark, sf)))


def ring_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycles(traded(spark, sf)[1].where("type = 'trades_with'"))


def edge_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of greatest modularity of vessels that share two windows or more."""
    return louvain(strong(spark, sf))[0]


def edge_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of up to six vessels of a minimum cycle basis of all co-occurrence edges."""
    return graph.cycles(pairs.cooccurrence(pairs.vessel_cells(points(spark, sf)), 1), "mmsi_a", "mmsi_b")


def top_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_edges(strong(spark, sf), "n_windows", 100)


def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    """As `graph.largest_component`, edges counted anew between its nodes instead of joined with them."""
    return strong(spark, sf, cut(graph.largest_nodes(strong(spark, sf))))


def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(strong(spark, sf), "n_windows")


def snapshot_union(spark: SparkSession, sf: str) -> DataFrame:
    edges = strong(spark, sf)
    return graph.snapshot(edges, points(spark, sf).where("mmsi < 4").select("mmsi"), top=20)


def snapshot_declared(spark: SparkSession, sf: str) -> DataFrame:
    """The 500 largest edges and all of vessels that a declaration names."""
    return graph.snapshot(strong(spark, sf), declarations(spark, sf).select("mmsi"))


def snapshot_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of all vessels that a declaration names."""
    v = tracks.split_voyages(points(spark, sf)).join(declarations(spark, sf).select("mmsi").distinct(), "mmsi", "left_semi")
    return rounded(v.select("mmsi", "ts", "lat", "lon", "sog", "cog", "voyage_id"))


def snapshot_features(spark: SparkSession, sf: str) -> DataFrame:
    """Voyage features of all vessels that a declaration names."""
    return voyage_features(spark, sf).join(declarations(spark, sf).select("mmsi").distinct(), "mmsi", "left_semi")


def reported(p: DataFrame) -> tuple[DataFrame, list[str]]:
    """Points by the names that files have, with headings, of which a third is unavailable; and our names of these columns."""
    p = p.withColumn("heading", F.when(F.col("mmsi") % 3 == 0, 511.0).otherwise(90.0))
    names = {short: long for long, (short, _) in readers.POINT_COLUMNS.items()}
    kept = [c for c in ("mmsi", "ts", "lat", "lon", "sog", "cog", "heading", "vessel_name") if c in p.columns]
    return p.select(*[F.col(c).alias(names[c]) for c in kept]), kept


def csv_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as CSV by their file names, in two folders, and read back by the profile that drops unreal places and unavailable headings."""
    rows, kept = reported(points(spark, sf))
    base, paths = shared_path(spark, "points"), []
    for part in (0, 1):
        paths.append(f"{base}/{part}")
        readers.write_csv(rows.where(F.col("MMSI") % 2 == part), paths[-1])
    out = readers.read_points(spark, paths, "features").select(*kept)
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def zipped_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as CSV in archives, one for each of eight groups of vessels, and read back by ranges, with the profile that keeps all places and headings."""
    rows, kept = reported(points(spark, sf))
    path = shared_path(spark, "archives")
    zipped.write_zipped(rows.repartition(8, "MMSI"), path)
    out = readers.clean_points(readers.typed(zipped.read_zipped(spark, path), readers.POINT_COLUMNS)).select(*kept)
    out = cut(rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
    remove(spark, path)
    return out


def track_of(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.track_of(points(spark, sf), 5).select("mmsi", "ts", "lat", "lon", "sog", "cog"))


def eda_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return (
        eda.value_counts(p, "vessel_class").withColumn("what", F.lit("class"))
        .unionByName(eda.counts_in_order(incidents(p), "evidence").drop("pos").withColumn("what", F.lit("evidence")))
    )


def showcase(spark: SparkSession, sf: str) -> DataFrame:
    return eda.showcase(incidents(points(spark, sf)))


def null_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.fill_rates(points(spark, sf), "draft", "vessel_class"))


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.quantiles(points(spark, sf), "sog"))


def overview(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return eda.overview(p, incidents(p))


def supplier_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.cooccurrence(supplier_cells(spark, sf), 3))


def iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ml.isolation_scores(cut(labelled(spark, sf)), FOREST.features, FOREST).select("voyage_id", "score", "is_anomaly")


def anomaly_ablation(spark: SparkSession, sf: str) -> DataFrame:
    return ml.ablation(cut(labelled(spark, sf)), c=FOREST)


def federated(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and half the 95 % interval of the held-out AUC of each model over all repeats."""
    c = FederatedConfig()
    task = cut(ml.federated_task(cut(tracks.build_features(points(spark, sf))), c, c.repeats))
    return rounded(ml.mean_and_interval(ml.federated_results(task, c, c.repeats), "auc", "model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vessel_cells": lambda spark, sf: pairs.vessel_cells(points(spark, sf)),
    **{
        f.__name__: f
        for f in (
            cooccurrence_edges, edge_lift, voyages, voyage_kinematics, course_std, coverage_grid, signal_gaps, gap_rollup, draft_usability, voyage_features,
            edge_accumulate, edge_scores, class_scores, class_baseline, incident_pairs, validate_incidents, topk_curve, best_score, persistence, truth_hits,
            voyage_labels, incident_tracks, auc_exact, feature_contribution, ports, nearest_port, declarations, rule_checks, confusion, fusion, components,
            degree_core, ego_network, ring_communities, ring_cycles, edge_communities, edge_cycles, snapshot_union, snapshot_declared, eda_value_counts, null_rates, quantiles, overview, supplier_cooccurrence,
            iforest_scores, anomaly_ablation, federated, edge_evaluation, truth_summary, persistence_curve, persistence_ranks, truth_by_name, validate_month,
            moored_pairs, moving_pairs, trade_layer, top_edges, largest_component, showcase, incident_months, pruned_points, stored_points, stored_edges, degrees, snapshot_tracks, snapshot_features, csv_points, zipped_points, track_of,
        )
    },
}
