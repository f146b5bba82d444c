"""The whole analysis as named steps, each written as Parquet and kept while its options and what it was made from stay the same."""

from __future__ import annotations

import argparse
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import AnomalyConfig, FederatedConfig, PairConfig
from tidemark.functions.ranking import cut
from tidemark.operators import eda, graph, ml, pairs, rules, tracks
from tidemark.operators.louvain import louvain
from tidemark.sources import readers


@dataclass(frozen=True)
class Options:
    normal: int = 10
    seed: int = 42
    repeats: int = 8
    epochs: int = 200
    year: str | None = None
    months: tuple[str, ...] = ()


@dataclass(frozen=True)
class Step:
    """make takes the options and, by name, the tables it needs; uses names the options on which it depends, besides those that chose the points."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    uses: tuple[str, ...] = ()


def apart(points: DataFrame) -> DataFrame:
    """points whose vessels are told apart by period (yyyy_MM), so that voyages end with it and their ids name it."""
    return points.withColumn("mmsi", F.concat_ws(":", F.date_format("ts", "yyyy_MM"), F.col("mmsi").cast("string")))


def together(df: DataFrame) -> DataFrame:
    return df.withColumns({"period": F.split_part("mmsi", F.lit(":"), F.lit(1)), "mmsi": F.split_part("mmsi", F.lit(":"), F.lit(2)).cast("long")})


def voyages_by_period(points: DataFrame) -> DataFrame:
    return together(tracks.split_voyages(apart(points)))


def features_by_period(points: DataFrame) -> DataFrame:
    """Voyage features of each period on its own, with the voyage ids of voyages_by_period."""
    return together(tracks.build_features(apart(points)))


def federated(o: Options, features: DataFrame) -> DataFrame:
    c = replace(FederatedConfig(), seed=o.seed, repeats=o.repeats, epochs=o.epochs)
    task = cut(ml.federated_task(features, c, c.repeats))
    return ml.mean_and_interval(ml.federated_results(task, c, c.repeats), "auc", "model")


def of_declared(df: DataFrame, declarations: DataFrame) -> DataFrame:
    return df.join(declarations.select("mmsi").distinct(), "mmsi", "left_semi")


FOREST = AnomalyConfig()
STEPS = (
    Step("voyage_points", ("points",), lambda o, points: voyages_by_period(points)),
    Step("coverage", ("points",), lambda o, points: tracks.coverage_grid(points)),
    Step("features", ("points",), lambda o, points: features_by_period(points)),
    Step("edges", ("points",), lambda o, points: pairs.accumulate(points, F.date_format("ts", "yyyy_MM"), PairConfig())),
    Step("edges_scored", ("edges", "incidents"), lambda o, edges, incidents: pairs.with_truth(pairs.build_scores(edges), pairs.truth_pairs(incidents))),
    Step("score_comparison", ("edges_scored",), lambda o, edges_scored: pairs.report(edges_scored)),
    Step("evaluation", ("edges", "incidents"), lambda o, edges, incidents: pairs.evaluate(pairs.score_edges(edges), pairs.truth_pairs(incidents))),
    Step("truth_hits", ("edges", "incidents"), lambda o, edges, incidents: pairs.truth_hits(pairs.score_edges(edges), pairs.truth_pairs(incidents))),
    Step("persistence", ("edges_scored",), lambda o, edges_scored: pairs.persistence(edges_scored, 12)),
    Step("persistence_curve", ("edges_scored",), lambda o, edges_scored: pairs.persistence_curve(edges_scored)),
    Step("persistence_ranks", ("edges_scored",), lambda o, edges_scored: pairs.persistence_ranks(edges_scored)),
    Step("best_score", ("score_comparison",), lambda o, score_comparison: pairs.best_score(score_comparison)),
    Step("edge_communities", ("edges",), lambda o, edges: louvain(edges)[0]),
    Step("trade_edges", ("edges",), lambda o, edges: graph.trade_layer(edges)[1]),
    Step("communities", ("edges",), lambda o, edges: graph.communities(*graph.trade_layer(edges))),
    Step("cycles", ("trade_edges",), lambda o, trade_edges: graph.cycles(trade_edges.where("type = 'trades_with'"))),
    Step("ports", ("points",), lambda o, points: rules.detect_ports(points)),
    Step("declarations", ("voyage_points", "ports"), lambda o, voyage_points, ports: rules.declarations(voyage_points, ports, normal=o.normal), ("normal",)),
    Step("rule_results", ("declarations", "voyage_points", "ports"), lambda o, declarations, voyage_points, ports: rules.apply_rules(declarations, voyage_points, ports)),
    Step("fusion", ("rule_results", "features", "edges"), lambda o, rule_results, features, edges: rules.fuse(rule_results, features, edges)),
    Step("voyage_labels", ("features", "incidents"), lambda o, features, incidents: ml.label_voyages(features, incidents)),
    Step("anomaly_scores", ("voyage_labels",), lambda o, voyage_labels: ml.isolation_scores(voyage_labels, FOREST.features, replace(FOREST, seed=o.seed)), ("seed",)),
    Step("ablation", ("voyage_labels",), lambda o, voyage_labels: ml.ablation(voyage_labels, c=replace(FOREST, seed=o.seed)), ("seed",)),
    Step("federated", ("features",), lambda o, features: federated(o, features), ("seed", "repeats", "epochs")),
    Step("snapshot_edges", ("edges", "declarations"), lambda o, edges, declarations: graph.snapshot(edges, declarations)),
    Step("snapshot_tracks", ("voyage_points", "declarations"), lambda o, voyage_points, declarations: of_declared(voyage_points, declarations)),
    Step("snapshot_features", ("features", "declarations"), lambda o, features, declarations: of_declared(features, declarations)),
    Step("overview", ("points", "incidents"), lambda o, points, incidents: eda.overview(points, incidents)),
)


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """What a step was made from; empty where it wasn't finished."""
    p, fs = file_system(spark, f"{path}/_manifest.json")
    return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8")) if exists(spark, path) and fs.exists(p) else {}


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    p, fs = file_system(spark, f"{path}/_manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()


def files_of(df: DataFrame) -> list:
    """(path, length, time of change) of a table's input files."""
    out = []
    for name in sorted(df.inputFiles()):
        p, fs = file_system(df.sparkSession, name)
        status = fs.getFileStatus(p)
        out.append([name, status.getLen(), status.getModificationTime()])
    return out


def run(
    spark: SparkSession, inputs: dict[str, DataFrame], out: str, force: bool = False, only: set[str] | None = None, dry: bool = False, skip: set[str] = frozenset(), o: Options = Options()
) -> list[tuple[str, str]]:
    """Runs the steps in order; (step, made | kept | would run). An error ends the run.

    Each finished step holds a manifest: the options it uses, the files of inputs it read, and the stamps of the steps it read. A step is kept while they are what they would be now, so a changed option,
    a changed input and a remade step remake all that depends on them, and nothing else.
    """
    tables, log = dict(inputs), []
    stamps: dict[str, object] = {name: {"files": files_of(df), "year": o.year, "months": sorted(o.months)} for name, df in inputs.items()}
    for step in STEPS:
        path = f"{out}/{step.name}"
        if only and step.name not in only or step.name in skip:
            if exists(spark, path):
                tables[step.name], stamps[step.name] = spark.read.parquet(path), read_manifest(spark, path).get("stamp")
            continue
        have = read_manifest(spark, path)
        want = {"options": {k: getattr(o, k) for k in step.uses}, "needs": {n: stamps.get(n) for n in step.needs}}
        if not force and have.get("made_from") == json.loads(json.dumps(want)):
            log.append((step.name, "kept"))
            stamps[step.name] = have["stamp"]
        elif dry:
            log.append((step.name, "would run"))
            stamps[step.name] = uuid.uuid4().hex  # what reads it would run as well
            continue
        else:
            step.make(o, **{n: tables[n] for n in step.needs}).write.mode("overwrite").parquet(path)
            stamps[step.name] = uuid.uuid4().hex
            write_manifest(spark, path, {"made_from": want, "stamp": stamps[step.name]})
            log.append((step.name, "made"))
        tables[step.name] = spark.read.parquet(path)
    return log


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--points", nargs="+", required=True, help="CSV files of position reports")
    a.add_argument("--incidents", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--incident-zone")
    a.add_argument("--force", action="store_true")
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--only", nargs="*")
    a.add_argument("--skip", nargs="*", help="steps to leave out")
    a.add_argument("--year", help="only points of this year (yyyy)")
    a.add_argument("--months", nargs="*", help="only points of these months (yyyy_MM)")
    a.add_argument("--n-normal", type=int, default=Options.normal)
    a.add_argument("--seed", type=int, default=Options.seed)
    a.add_argument("--repeats", type=int, default=Options.repeats)
    o = a.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    inputs = {"points": readers.read_points(spark, o.points, "features"), "incidents": readers.read_incidents(spark, o.incidents, o.incident_zone)}
    if o.year:
        inputs["points"] = inputs["points"].where(F.date_format("ts", "yyyy") == o.year)
    if o.months:
        inputs["points"] = inputs["points"].where(F.date_format("ts", "yyyy_MM").isin(o.months))
    options = Options(normal=o.n_normal, seed=o.seed, repeats=o.repeats, year=o.year, months=tuple(o.months or ()))
    for name, what in run(spark, inputs, o.out, o.force, set(o.only or ()) or None, o.dry_run, set(o.skip or ()), options):
        print(name, what)


if __name__ == "__main__":
    main()
