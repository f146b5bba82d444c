import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import AnomalyConfig, FederatedConfig, PairConfig
from tidemark.functions.ranking import cut, ranked
from tidemark.operators import eda, graph, ml, pairs, rules, tracks
from tidemark.plans import pipeline, queries
from tidemark.sources import readers

T0 = dt.datetime(2024, 1, 1)
POINT = "mmsi long, ts timestamp, lat double, lon double, sog double, cog double, vessel_name string, vessel_class string, draft double"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def points(spark, rows):
    """rows: (mmsi, hours, lat, lon, sog, cog, draft), the last ones optional."""
    full = []
    for r in rows:
        m, h, lat, lon, sog, cog, draft = (*r, *[None] * (7 - len(r)))
        full.append((m, at(h), float(lat), float(lon), sog, cog, f"N{m}", f"C{m % 2}", draft))
    return spark.createDataFrame(full, POINT)


def test_voyages_split_after_more_than_the_gap(spark):
    p = points(spark, [(1, 0, 0, 0), (1, 6, 0, 0), (1, 12 + 1 / 3600, 0, 0), (2, 0, 0, 0)])
    got = sorted((r.mmsi, r.ts, r.voyage_id) for r in tracks.split_voyages(p).collect())
    assert [x[2] for x in got] == ["1_1", "1_1", "1_2", "2_1"]


def test_kinematics_and_course(spark):
    p = points(spark, [(1, 0, 0, 0, 0.4, 359.0), (1, 1, 0, 1, None, 1.0), (1, 2, 0, 2, 4.0, 181.0), (1, 3, 0, 3, 0.5, None), (1, 4, 0, 4, 1.0, 10.0), (2, 0, 5, 5, 1.0, 3.0)])
    v = tracks.split_voyages(p)
    k = {r.voyage_id: r for r in tracks.kinematics(v).collect()}
    assert k["1_1"].n_points == 5 and k["1_1"].stopped_ratio == pytest.approx(0.2) and k["1_1"].lon_end == 4.0 and k["2_1"].std_sog is None
    c = {r.voyage_id: r.course_std for r in tracks.course_spread(v).collect()}
    assert c["1_1"] == pytest.approx(182 / 2**0.5)  # +2 and -180
    assert c["2_1"] is None


def test_missing_speed_is_neither_stopped_nor_moving(spark):
    p = points(spark, [(1, 0, 0, 0, None), (1, 0.1, 0, 0, float("nan"))])
    got = pairs.vessel_cells(p).collect()
    assert len(got) == 1 and not got[0].stopped and not got[0].moving


def test_coverage_needs_vessels_and_days(spark):
    rows = [(m, 24 * d, 0.01, 0.01) for m in range(5) for d in range(3)] + [(m, 24 * d, 1.01, 0.01) for m in range(4) for d in range(3)] + [(m, 24 * d, 2.01, 0.01) for m in range(5) for d in range(2)]
    got = {r.ci: r.coverage_ok for r in tracks.coverage_grid(points(spark, rows)).collect()}
    assert got == {0: True, 20: False, 40: False}


def test_signal_gap_classes(spark):
    cover = [(m, 24 * d, 0.01, 0.01, 1.0) for m in range(10, 15) for d in range(3)]
    p = points(spark, cover + [(1, 0, 0.01, 0.01, 2.0), (1, 0.5, 0.01, 0.01, 2.1), (1, 0.9, 0.01, 0.01, 2.1), (1, 2, 0.01, 0.01, 0.4), (1, 3, 9.0, 9.0, 5.0)])
    v = tracks.split_voyages(p)
    got = [(r.gap_hours, r.signal_class) for r in tracks.signal_gaps(v, tracks.coverage_grid(p)).where("mmsi = 1").orderBy("gap_end").collect()]
    assert [c for _, c in got] == ["MISSING_MOORED", "CONFLICT", "MISSING"] and got[0][0] == 0.5


def test_drafts(spark):
    rows = [(1, 0, 0, 0, 1.0, 0.0, None), (2, 0, 0, 0, 1.0, 0.0, 5.0), (2, 1, 0, 0, 1.0, 0.0, 5.0), (3, 0, 0, 0, 1.0, 0.0, 5.0), (3, 1, 0, 0, 1.0, 0.0, 5.5), (3, 9, 0, 0, 1.0, 0.0, 5.0), (3, 10, 0, 0, 1.0, 0.0, 5.125)]
    got = {r.voyage_id: r.draft_class for r in tracks.draft_features(tracks.split_voyages(points(spark, rows))).collect()}
    assert got == {"1_1": "NO_DRAFT", "2_1": "STATIC_DRAFT", "3_1": "CHANGED", "3_2": "UNCHANGED"}


def test_cooccurrence(spark):
    rows = [(1, 0.1, 0.01, 0.01, 0.1), (1, 0.2, 0.01, 0.01, 5.0), (2, 0.3, 0.01, 0.01, 0.1), (3, 0.4, 0.01, 0.01, 9.0), (1, 0.5, 1.01, 0.01, 1.0), (2, 0.6, 1.01, 0.01, 1.0), (98123, 0.1, 0.01, 0.01, 1.0), (2, 0.3, 0.01, 0.01, 0.1)]
    edges = {(r.mmsi_a, r.mmsi_b): (r.n_windows, r.n_both_stopped, r.n_both_moving) for r in pairs.cooccurrence(pairs.vessel_cells(points(spark, rows)), 1).collect()}
    assert edges == {(1, 2): (2, 1, 0), (1, 3): (1, 0, 1), (2, 3): (1, 0, 0)}
    lift = pairs.build_edges(points(spark, rows), PairConfig(min_windows=2)).collect()
    assert len(lift) == 1 and lift[0].lift == pytest.approx(2 * 2 / (2 * 2)) and lift[0].name_a == "N1" and lift[0].class_b == "C0"


def test_thresholds_of_periods_and_sums(spark):
    rows = [(m, h, 0.01, 0.01, 1.0) for m in (1, 2) for h in (0, 1, 50, 51)]
    period = F.when(F.col("ts") < F.lit(at(24)), 1).otherwise(2)
    p = points(spark, rows)
    assert pairs.accumulate(p, period, PairConfig(min_windows=3)).count() == 0
    got = pairs.accumulate(p, period, PairConfig(min_windows=3), filter_after=True).collect()
    assert len(got) == 1 and (got[0].n_windows, got[0].n_months) == (4, 2)


def test_scores_ranks_and_curve(spark):
    rows = [(1, 2, 3, 1, "A", "B"), (1, 3, 3, 1, "B", "A"), (1, 4, 1, 1, "A", "B"), (1, 5, 5, 1, "B", "A"), (1, 6, 7, 2, None, "Z")]
    e = spark.createDataFrame(rows, "mmsi_a long, mmsi_b long, n_both_moving long, n_months long, class_a string, class_b string")
    got = {r.mmsi_b: r for r in pairs.build_scores(e).collect()}
    assert [got[k].s_class_pct for k in (2, 3, 4, 5)] == [0.625, 0.625, 0.25, 1.0]
    assert got[6].s_class_z == 0.0 and got[6].class_pair == "Z/nan"
    t = spark.createDataFrame([(1, 5, 9)], "mmsi_a long, mmsi_b long, incident_num long")
    c = {r.K: (r.hits, r.recall, r.precision, r.lift) for r in pairs.report(pairs.with_truth(pairs.build_scores(e), t), ("s_raw",), (1, 2, 10)).collect()}
    assert c == {1: (0, 0.0, 0.0, 0.0), 2: (1, 1.0, 0.5, 2.5), 10: (1, 1.0, 0.1, 0.5)}
    # by hand: movement 3 in one period is 3 * sqrt(1 + 1) and 3 / (1 + 1); 7 in two is 7 / 3
    assert got[2].s_pers_sqrt == pytest.approx(3 * 2**0.5) and got[2].s_per_month == 1.5 and got[6].s_per_month == pytest.approx(7 / 3)
    mean, sd = 1.5, (((0.0 + 0.0 + 1.0 + 1.0) / 3) ** 0.5)  # 1.5, 1.5, 0.5, 2.5
    assert got[5].s_class_z == pytest.approx((2.5 - mean) / sd) and got[5].s_class_pct_w == pytest.approx(1.0 * 1.791759469228055)  # ln 6
    base = {r.class_pair: (r.n_edges, r.median_moving, r.max_moving, r.n_truth) for r in pairs.class_baseline(pairs.with_truth(pairs.build_scores(e), t)).collect()}
    assert base == {"A/B": (4, 3.0, 5, 1), "Z/nan": (1, 7.0, 7, 0)}
    two = {r.K: (r.base_hits, r.pers_hits) for r in pairs.persistence_curve(pairs.with_truth(pairs.build_scores(e), t), (1, 2)).collect()}
    assert two == {1: (0, 1), 2: (1, 1)}
    assert [(r.mmsi_b, r.rank_pers) for r in pairs.persistence_ranks(pairs.with_truth(pairs.build_scores(e), t)).collect()] == [(5, 1)]


def test_evaluation_over_all_truth_pairs(spark):
    rows = [(1, b, 10 - b, 1, "n", "n", "A", "B") for b in range(2, 8)]
    e = pairs.score_edges(spark.createDataFrame(rows, "mmsi_a long, mmsi_b long, n_both_moving long, n_months long, name_a string, name_b string, class_a string, class_b string"))
    truth = spark.createDataFrame([(1, 3, 9), (1, 7, 9), (50, 60, 9), (50, 61, 8)], "mmsi_a long, mmsi_b long, incident_num long")
    assert sorted(tuple(r) for r in pairs.evaluate(e, truth, (1, 2, 1000)).collect()) == [(1, 0, 0.0, 0.0), (2, 1, 0.25, 0.5), (6, 2, 0.5, 2 / 6), (6, 2, 0.5, 2 / 6)]
    s = pairs.truth_summary(e, truth).first()
    assert (s.n_truth, s.n_found, s.median_rank, s.best_rank, s.worst_rank, s.recall) == (4, 2, 4.0, 2, 6, 0.5)


def test_ranks_over_many_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") % 37).alias("x")).repartition(7)
    want = {r: i + 1 for i, r in enumerate(sorted(range(1000), key=lambda i: (-(i % 37), i)))}
    assert {r.id: r["rank"] for r in ranked(df, [F.desc("x"), "id"]).collect()} == want
    assert ranked(df.where("false"), ["id"]).count() == 0
    q = ml.upper_shares(df.select((F.col("id") / 10).alias("a"), F.lit(3.0).alias("b")), ["a", "b"], 0.2).first()
    assert q.limit_a == pytest.approx(79.92) and q.limit_b == 3.0


def test_truth_pairs(spark):
    i = spark.createDataFrame([(1, 7), (1, 5), (1, 6), (2, 6), (2, 5), (3, 9)], "incident_num long, mmsi long")
    assert sorted(tuple(r) for r in pairs.truth_pairs(i).collect()) == [(5, 6, 2), (5, 7, 1), (6, 7, 1)]


def test_labels_at_the_pad(spark):
    f = spark.createDataFrame([(1, "a", at(0), at(1)), (1, "b", at(20), at(21)), (2, "c", at(0), at(1))], "mmsi long, voyage_id string, t_start timestamp, t_end timestamp")
    i = spark.createDataFrame([(1, at(7), None), (1, at(7), None)], "mmsi long, t_start timestamp, t_end timestamp")
    assert {r.voyage_id: r.is_incident for r in ml.label_voyages(f, i).collect()} == {"a": True, "b": False, "c": False}


def test_ports_and_nearest(spark):
    rows = [(m, 0, 0.01, 0.01, 0.1) for m in range(3)] + [(m, 1, 0.01, 0.05, 0.1) for m in range(3)] + [(9, 0, 5, 5, 0.1)]
    ports = rules.detect_ports(points(spark, rows))
    assert [(r.port_id, r.cj) for r in ports.orderBy("port_id").collect()] == [("P00", 0), ("P01", 1)]
    place = spark.createDataFrame([(0.01, 0.03)], "lat double, lon double")
    assert rules.nearest_port(place, ports).first().port_id == "P00"
    none = rules.nearest_port(place, ports.where("false")).first()
    assert none.port_id is None and none.port_distance == float("inf")


def test_rules(spark):
    ports = spark.createDataFrame([("P00", 0.0, 0.0), ("P01", 1.0, 1.0), ("P02", 5.0, 5.0)], "port_id string, lat double, lon double")
    track = [(1, 0, 0, 0, 5.0), (1, 1, 0.5, 0.5, 5.0), (1, 3.5, 1, 1, 0.0)]
    v = tracks.split_voyages(points(spark, track))
    d = [
        ("ok", "1_1", "P00", "P01", at(0), at(3.5)), ("route", "1_1", "P02", "P02", at(0), at(3.5)), ("late", "1_1", "P00", "P01", at(90), at(91)),
        ("none", "9_9", "P00", "P01", at(0), at(1)), ("short", "1_1", "P00", "P01", at(0), at(1)),
    ]
    decl = spark.createDataFrame([(a, b, 1, "N", c, e, s, t, False, None) for a, b, c, e, s, t in d], "decl_id string, voyage_id string, mmsi long, vessel_name string, declared_departure string, declared_arrival string, declared_start timestamp, declared_end timestamp, is_fraud boolean, fraud_type string")
    got = {r.decl_id: (r.triggered, r.risk) for r in rules.apply_rules(decl, v, ports).collect()}
    assert got == {
        "ok": ("R3_SIGNAL", "MEDIUM"), "route": ("R1_ROUTE;R1_ROUTE;R2_CALL;R2_CALL;R3_SIGNAL", "HIGH"), "late": ("R2_NO_RECORD", "MEDIUM"),
        "none": ("R0_NO_TRACK", "MEDIUM"), "short": ("R2_CALL", "MEDIUM"),
    }


def test_fusion(spark):
    r = spark.createDataFrame([("a", 1, "v1", "n", True, 2, "x;y"), ("b", 2, "v2", "n", False, 0, ""), ("c", 3, "v3", "n", False, 0, ""), ("d", 4, "none", "n", False, 1, "x")], "decl_id string, mmsi long, voyage_id string, vessel_name string, truth_fraud boolean, n_rules long, triggered string")
    f = spark.createDataFrame([("v1", 0, 1, 1.0), ("v2", 1, 1, 2.8), ("v3", 0, 0, None)], "voyage_id string, n_signal_conflict long, n_gaps long, max_gap_hours double")
    got = {x.decl_id: x for x in rules.fuse(r, f).collect()}
    assert got["a"].fusion_score == 0.4545 and got["a"].intercept_level == "YELLOW" and got["b"].fusion_score == 0.3709
    assert got["c"].intercept_level == "GREEN" and got["d"].space_direction == "MISSING" and got["d"].intercept_level == "RED"
    assert got["b"].space_text == "1 signal gaps under way in good coverage (longest 2.8 hours)" and got["a"].text_text == "2 rules triggered: x;y"
    e = spark.createDataFrame([(1, 3, 11, 1001, "A", "C"), (2, 4, 11, 1000, "B", "D"), (5, 6, 1, 1, "E", "F")], "mmsi_a long, mmsi_b long, n_months long, n_both_moving long, name_a string, name_b string")
    got = {x.decl_id: x for x in rules.fuse(r, f, e).collect()}
    assert {k: x.graph_direction for k, x in got.items()} == {"a": "MISSING", "b": "CONFLICT", "c": "MISSING", "d": "CONFLICT"}
    assert got["b"].graph_text == "unusual co-occurrence with D: 1000 windows under way in 11 months"
    # a vessel without an edge, in a graph that has some: its weight counts, 0.25 * 1 / (0.3 + 0.25 + 0.45)
    one = rules.fuse(r.where("decl_id = 'a'"), f, e.where("mmsi_a = 5")).first()
    assert one.graph_direction == "SUPPORT" and one.fusion_score == 0.25 and one.intercept_level == "YELLOW"
    assert rules.fuse(r.where("decl_id = 'a'"), f, e.where("false")).first().fusion_score == 0.4545


# What fusion without a graph gives for these cases: gap hours and whether one gap is in conflict (None: no gap), rules triggered, score, level.
FUSED = [
    (None, False, 0, 0.0, "GREEN"), (None, False, 2, 0.4545, "YELLOW"), (None, False, 1, 0.3409, "YELLOW"),
    (43.6, False, 0, 0.0, "GREEN"), (43.6, False, 2, 0.4545, "YELLOW"), (43.6, False, 1, 0.3409, "YELLOW"),
    (68.2, False, 0, 0.0, "GREEN"), (21.8, True, 0, 0.5455, "RED"), (96.2, True, 0, 0.5455, "RED"),
    (2.8, True, 0, 0.37, "YELLOW"), (16.4, True, 0, 0.5455, "RED"), (86.0, False, 0, 0.0, "GREEN"),
]


def test_fusion_of_known_cases(spark):
    r = spark.createDataFrame([(f"{i:02d}", i, f"v{i}", "n", False, n, "") for i, (_, _, n, _, _) in enumerate(FUSED)], "decl_id string, mmsi long, voyage_id string, vessel_name string, truth_fraud boolean, n_rules long, triggered string")
    f = spark.createDataFrame([(f"v{i}", int(c), int(g is not None), g) for i, (g, c, _, _, _) in enumerate(FUSED)], "voyage_id string, n_signal_conflict long, n_gaps long, max_gap_hours double")
    got = [(x.fusion_score, x.intercept_level) for x in rules.fuse(r, f).orderBy("decl_id").collect()]
    assert [x[1] for x in got] == [x[4] for x in FUSED] and [x[0] for x in got] == pytest.approx([x[3] for x in FUSED], abs=0.001)


def test_declarations(spark):
    ports = spark.createDataFrame([(f"P{i:02d}", float(i), float(i)) for i in range(4)], "port_id string, lat double, lon double")
    rows = [(1, h / 10, 0.01 + h / 10 * 0.2, 0.01 + h / 10 * 0.2, 5.0) for h in range(50)] + [(2, h / 10, 0.2 + h / 50, 0.2, 5.0) for h in range(51)]  # 2 begins far from any port
    p = points(spark, rows + [(1, 5.0, 1.0, 1.0, 0.0)])
    got = {r.decl_id: r for r in rules.declarations(tracks.split_voyages(p), ports).collect()}
    assert set(got) == {"D000", "D000F0", "D000F1", "D000F2", "D000F3"}
    assert {(r.declared_departure, r.declared_arrival) for k, r in got.items() if k in ("D000", "D000F2", "D000F3")} == {("P00", "P01")}
    assert got["D000F0"].declared_departure == "P00" and got["D000F0"].declared_arrival in ("P02", "P03") and got["D000F0"].fraud_type == "FAKE_ROUTE"
    assert got["D000F1"].declared_arrival == "P01" and got["D000F1"].declared_departure in ("P02", "P03") and got["D000F1"].fraud_type == "FAKE_CALL"
    assert (got["D000F2"].declared_start, got["D000F2"].declared_end) == (at(-72), at(-24)) and (got["D000F3"].declared_start, got["D000F3"].declared_end) == (at(1), at(4))


def test_first_known_name_of_a_voyage(spark):
    p = points(spark, [(1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 0, 0)]).withColumn("vessel_name", F.when(F.hour("ts") > 0, F.concat(F.lit("N"), F.hour("ts"))))
    assert tracks.kinematics(tracks.split_voyages(p)).first().vessel_name == "N1"


def test_missing_values_before_scaling(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (None, 8.0), (float("inf"), 6.0), (3.0, float("nan"))], "a double, max_gap_hours double")
    got = ml.filled(df, ("a", "max_gap_hours"), {"max_gap_hours": 0.0}).select("x_a", "x_max_gap_hours").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (2.0, 4.0), (2.5, 8.0), (0.0, 6.0), (3.0, 0.0)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (10, 11), (11, 12), (10, 12)] + [(20 + i, 20 + (i + 1) % 7) for i in range(7)], "mmsi_a long, mmsi_b long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((10, 11, 12), 10), **dict.fromkeys(range(20, 27), 20)}
    assert graph.largest_component(e).count() == 7
    assert sorted((r.length, r.members) for r in graph.cycles(e, "mmsi_a", "mmsi_b").collect()) == [(3, "10→11→12→10"), (4, "1→2→3→4→1")]
    line = spark.createDataFrame([(i, i + 1) for i in range(60)], "mmsi_a long, mmsi_b long")
    assert {r.component for r in graph.components(line).collect()} == {0}
    with pytest.raises(ValueError):
        graph.trade_layer(line.where("mmsi_a < 6"))
    nodes, edges = graph.trade_layer(line)
    assert nodes.where("is_fraud").count() == 20 and nodes.groupBy("id").count().where("count > 1").isEmpty()
    got = graph.communities(nodes, edges).collect()
    assert len(got) == 5 and {(r["size"], r.internal_density, r.n_shared_vessels, r.n_shared_ports, r.precision) for r in got} == {(4, 0.667, 2, 2, 1.0)}
    assert {v for r in got for v in r.vessels.split(",")} <= {str(i) for i in range(61)}
    # all that any member uses counts, not only what two share
    more = edges.unionByName(edges.where("src = 'ENT_0300'").limit(1).select("src", F.lit("60").alias("dst"), F.lit("declares").alias("type")))
    assert max(r.n_shared_vessels for r in graph.communities(nodes, more.distinct()).collect()) in (2, 3)


def test_declared_snapshot(spark, monkeypatch):
    edges = [(i, i + 1, 5000 - i) for i in range(0, 1400, 2)]
    monkeypatch.setattr(queries, "strong", lambda spark, sf: spark.createDataFrame(edges, "mmsi_a long, mmsi_b long, n_windows long"))
    monkeypatch.setattr(queries, "declarations", lambda spark, sf: spark.createDataFrame([("D0", 1201), ("D0F0", 1201), ("D1", 1300), ("D2", 4)], "decl_id string, mmsi long"))
    got = sorted(tuple(r) for r in queries.QUERIES["snapshot_declared"](spark, "").collect())
    assert got == edges[:500] + [edges[600], edges[650]]


@pytest.mark.parametrize("scores,labels,want", [([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([4, 3, 2, 1], [0, 0, 1, 1], 0.0), ([1, 1, 1, 1], [0, 1, 0, 1], 0.5), ([1, 2], [1, 1], None)])
def test_auc(spark, scores, labels, want):
    df = spark.createDataFrame([(float(s), bool(x)) for s, x in zip(scores, labels)], "s double, y boolean")
    assert ml.auc(df, "s", "y").first().auc == want


def test_isolation_forest_finds_outliers(spark):
    rows = [(f"v{i}", float(i % 10), float(i % 7)) for i in range(300)] + [("far", 500.0, -90.0)]
    got = ml.isolation_scores(spark.createDataFrame(rows, "voyage_id string, a double, b double"), ("a", "b"), AnomalyConfig(trees=30)).orderBy(F.desc("score")).first()
    assert got.voyage_id == "far" and got.is_anomaly and 0 < got.score <= 1


def test_scores_are_those_of_single_walks(spark):
    """Each row's score by a walk down each tree; `ablation` prepares its features once and gives the areas of single forests."""
    c = AnomalyConfig(trees=9, sample=64, ablations={"all": ("a", "b"), "one": ("b",)})
    rows = [(f"v{i:03}", float(i * i % 31), float(i % 7) if i % 5 else None, i % 11 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "voyage_id string, a double, b double, is_incident boolean")
    x = ml.prepared(df, ("a", "b")).select("voyage_id", "x_a", "x_b", F.xxhash64("voyage_id", F.lit(c.seed)).alias("h")).toPandas().sort_values("h")
    trees, want = ml.grow_trees(x[["x_a", "x_b"]].to_numpy(float), c), {}
    for r in x.itertuples():
        total = 0.0
        for t in trees:
            at = depth = 0
            while t[at][0] >= 0:
                at, depth = int(t[at][2] if (r.x_a, r.x_b)[int(t[at][0])] < t[at][1] else t[at][3]), depth + 1
            total += depth + ml._path_length(t[at][4])
        want[r.voyage_id] = 2.0 ** (-total / len(trees) / ml._path_length(64))
    assert {r.voyage_id: r.score for r in ml.isolation_scores(df, ("a", "b"), c).collect()} == pytest.approx(want)
    got = {r.feature_set: r.auc for r in ml.ablation(df, c=c).collect()}
    assert got == {name: pytest.approx(ml.auc(ml.isolation_scores(df, k, c), "score", "is_incident").first().auc) for name, k in c.ablations.items()}


def test_federated_equals_centralized(spark):
    """Weights and areas equal those of gradient descent over whole NumPy arrays."""
    c = FederatedConfig(epochs=6)
    names = [f for _, fs in c.parties for f in fs]
    rows = [(f"v{i}", *[None if (i + k) % 29 == 0 else float((i * k) % 11) for k in range(1, 11)]) for i in range(150)]
    task = cut(ml.federated_task(spark.createDataFrame(rows, "voyage_id string, " + ", ".join(f"{n} double" for n in names)), c, 2))
    t = task.toPandas()
    assert abs(t.label_0.mean() - 0.2) < 0.01 and (t.label_0 != t.label_1).any()
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(t.set_index("voyage_id").loc[[r[0] for r in rows], [f"z_{n}" for n in names]].to_numpy(), z)
    got = {(r.model, r.repeat): r.auc for r in ml.federated_results(task, c, 2).collect()}
    assert len(got) == 10
    models = {"centralized": names, "vertical_federated": names} | {f"single_{p}": list(fs) for p, fs in c.parties}
    for (model, r), area in got.items():
        a, y, train = t[[f"z_{n}" for n in models[model]]].to_numpy(), t[f"label_{r}"].to_numpy(float), t[f"train_{r}"].to_numpy(bool)
        w = np.zeros(a.shape[1])
        for _ in range(c.epochs):
            w -= c.rate * (a[train].T @ (1 / (1 + np.exp(-a[train] @ w)) - y[train]) / train.sum() + c.l2 * w)
        s, held = a[~train] @ w, y[~train]
        pos, neg = s[held == 1], s[held == 0]
        assert area == pytest.approx(((pos[:, None] > neg).sum() + ((pos[:, None] == neg).sum()) / 2) / (len(pos) * len(neg)), abs=1e-6)
    both = ml.mean_and_interval(spark.createDataFrame([("m", 1.0), ("m", 3.0)], "model string, auc double"), "auc", "model").first()
    assert both["mean"] == 2.0 and both.ci95 == pytest.approx(1.96)


def test_queries_take_the_whole_number_of_epochs_and_trees(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "cut", lambda df: df)
    monkeypatch.setattr(ml, "mean_and_interval", lambda df, x, by: spark.range(1))
    monkeypatch.setattr(queries, "labelled", lambda spark, sf: None)
    monkeypatch.setattr(queries.tracks, "build_features", lambda p: None)
    monkeypatch.setattr(queries, "points", lambda spark, sf: None)
    monkeypatch.setattr(ml, "federated_task", lambda f, c, repeats: None)
    monkeypatch.setattr(ml, "federated_results", lambda task, c, repeats: seen.append((c.epochs, repeats)))
    monkeypatch.setattr(ml, "ablation", lambda f, c=AnomalyConfig(): seen.append(c.trees))
    monkeypatch.setattr(ml, "isolation_scores", lambda f, columns, c=AnomalyConfig(): seen.append(c.trees) or spark.createDataFrame([], "voyage_id string, score double, is_anomaly boolean"))
    for name in ("federated", "anomaly_ablation", "iforest_scores"):
        queries.QUERIES[name](spark, "")
    assert seen == [(200, 8), 300, 300]


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿MMSI,datetime_utc,lat,lon,speed_over_ground_knots,heading_deg,vessel_name\n1,2024-01-01 00:00:00,10,20,1.5,511,"PI""IL"\n1,broken,1,1,1,1,x\n2,2024-01-01 00:00:00,95,20,1,90,y\n')
    got = readers.read_points(spark, str(tmp_path / "p.csv"), "features").collect()
    assert len(got) == 1 and got[0].vessel_name == 'PI"IL' and got[0].heading is None
    assert readers.read_points(spark, str(tmp_path / "p.csv")).count() == 2
    g = spark.createDataFrame([("1", " 2024-01-01 00:00:00", 1.0, 2.0), ("1", " 2024-01-01 00:00:00", 1.0, 2.0), ("1", "x", 0.0, 0.0)], "MMSI string, `Timestamp ` string, LAT double, LON double")
    assert readers.load_generic(g.withColumn("Timestamp ", F.trim("Timestamp "))).count() == 1
    r = readers.schema_report(g).first()
    assert not r.has_draft and "draft" in r.missing_expected and json.loads(r.json)["columns"] == g.columns


def test_showcase(spark):
    rows = [(1, "x", "High"), (2, "x", "High"), (3, "y", "High"), (4, "z", "Some")] + [(n, "t", "High") for n in (10, 11, 12) for _ in (0, 1)] + [(20, "t", "High")] * 3
    i = spark.createDataFrame([(n, m, at(0), at(1), t, e) for m, (n, t, e) in enumerate(rows)], "incident_num long, mmsi long, t_start timestamp, t_end timestamp, incident_type string, evidence string")
    assert [r.incident_num for r in eda.showcase(i).orderBy("incident_num").collect()] == [1, 3, 10, 10, 11, 11]
    assert {r.incident_num for r in eda.showcase(i.where("incident_num >= 10")).collect()} == {10, 11, 12}


def test_tables_behind_charts(spark):
    df = spark.createDataFrame([("High",), ("High",), ("Some",), (None,)], "e string")
    assert [(r.value, r.n) for r in eda.counts_in_order(df, "e").orderBy("pos").collect()] == [("High", 2), ("Good", 0), ("Some", 1), ("No obvious evidence", 0)]
    assert [r.value for r in eda.quantiles(spark.range(5), "id", (0.5, 0.9)).collect()] == [2.0, 3.6]


def test_pipeline_keeps_what_is_made(spark, tmp_path):
    p = points(spark, [(m, h / 4, 0.01 + m / 1000, 0.01, 0.2 + m) for m in range(4) for h in range(8)])
    i = spark.createDataFrame([(1, 1, at(0), at(1), "t", "High"), (1, 2, at(0), at(1), "t", "High")], "incident_num long, mmsi long, t_start timestamp, t_end timestamp, incident_type string, evidence string")
    only = {"voyage_points", "edges", "edges_scored", "features", "evaluation", "snapshot_tracks", "ports", "declarations"}
    first = pipeline.run(spark, {"points": p, "incidents": i}, str(tmp_path), only=only)
    assert {x for _, x in first} == {"made"} and {x for _, x in pipeline.run(spark, {"points": p, "incidents": i}, str(tmp_path), only=only)} == {"kept"}
    made = spark.read.parquet(f"{tmp_path}/features")
    assert made.select("period").distinct().first().period == "2024_01"
    assert made.join(spark.read.parquet(f"{tmp_path}/voyage_points"), "voyage_id", "left_anti").count() == 0  # one id for a voyage everywhere
    for step in pipeline.STEPS:
        assert set(step.needs) <= {"points", "incidents"} | {s.name for s in pipeline.STEPS[: pipeline.STEPS.index(step)]}


def test_streams(spark, tmp_path):
    from tidemark.streaming import live

    points(spark, [(1, 0, 0.01, 0.01, 0.1), (1, 1, 0.01, 0.01, 3.0), (1, 9, 0.01, 0.01, 3.0)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POINT).parquet(f"{tmp_path}/in")
    for name, df in (("cells", live.live_cells(stream)), ("trips", live.live_voyages(stream))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("cells").count() == 3 and spark.table("trips").count() == 2
