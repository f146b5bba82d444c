"""Reports on edges that are counted by kind: same rows as from the edges themselves, of which almost none are made."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import PairConfig
from tidemark.operators import blocks, counted, pairs

ANY = PairConfig(min_windows=1)
POINTS = "mmsi long, ts timestamp_ntz, lat double, lon double, sog double, vessel_name string, vessel_class string"


def some_points(spark, seed=3, vessels=60):
    """Points of few cells, so that pairs meet often; vessels without a class, twice the same row, null numbers, times and places."""
    rng = random.Random(seed)
    kind = {m: rng.choice(["x", "y", None]) for m in range(vessels)}
    rows = [(m, f"2024-01-{1 + rng.randrange(20):02d} {rng.randrange(3):02d}:00:00", 20.01 + 0.02 * rng.randrange(2), -158.01, rng.choice([0.0, 1.0, 9.0, None]), f"V{m}", kind[m]) for m in range(vessels) for _ in range(rng.randrange(3, 40))]
    rows += rows[:50] + [(None, rows[0][1], 20.01, -158.01, 9.0, "N", "x"), (1, None, 20.01, -158.01, 9.0, "V1", "x"), (1, rows[0][1], None, -158.01, 9.0, "V1", "x")]
    return spark.createDataFrame(rows, POINTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def marks(spark, seed=4, vessels=60):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.randrange(vessels)) for i in range(6) for _ in range(9)] + [(None, 1), (2, None)], "incident_num long, mmsi long")


@pytest.fixture(scope="module")
def both(spark):
    p, i = some_points(spark), marks(spark)
    period = F.floor(F.dayofmonth("ts") / 5).cast("long")
    edges = pairs.build_scores(pairs.accumulate(p, period, ANY, incidents=i)).localCheckpoint()
    return edges, (p, period, ANY, i)


def same(got, want):
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(want.columns)).collect())
    assert got.dtypes == want.dtypes and key(got) == key(want) and key(want)


def test_reports_are_those_of_all_edges(spark, monkeypatch, both):
    """Several blocks, tasks that pass kinds on again and again, few first edges among many equal ones."""
    edges, args = both
    monkeypatch.setattr(blocks, "SMALL", 200)
    c = pairs.counted(*args)
    assert c.dealt.n > 3 and c.kinds.agg(F.sum("n")).first()[0] == edges.count() > 1000
    for ks in ((1, 7, 50), (10, 100_000)):
        same(pairs.report(c, ks=ks), pairs.report(edges, ks=ks))
        same(pairs.persistence_curve(c, ks), pairs.persistence_curve(edges, ks))
    monkeypatch.setattr(counted, "FEW", 3)
    same(pairs.report(c, ks=(7, 50)), pairs.report(edges, ks=(7, 50)))


def test_middles_and_shares(both):
    edges, args = both
    c = pairs.counted(*args)
    same(pairs.class_baseline(c, 2), pairs.class_baseline(edges, 2))
    for x in (c, pairs.counted(*args, classes=False)):
        same(pairs.persistence(x, 4), pairs.persistence(edges, 4))


def test_ranks_of_true_edges(spark, both):
    """Among many edges of the same score; an odd and an even number of true ones, one and none."""
    p, period, c, i = both[1]
    for of in (i, i.where("incident_num < 3"), i.where("incident_num = 0"), i.where("mmsi < 2"), i.where("false")):
        truth = pairs.truth_pairs(of).localCheckpoint()
        edges = pairs.accumulate(p, period, c, incidents=of, score=pairs.by_months).localCheckpoint()
        x, n = pairs.counted(p, period, c, of, False), pairs.count_truth_pairs(of)
        assert n.first().t == truth.count()
        same(pairs.truth_summary_counted(x, pairs.by_months, n), pairs.truth_summary(edges, truth))
        same(pairs.evaluate_counted(x, pairs.by_months, n, (1, 7, 60, 10_000)), pairs.evaluate(edges, truth, (1, 7, 60, 10_000)))


def test_few_edges_are_made(both):
    edges, args = both
    c = pairs.counted(*args)
    scored = pairs.build_scores(c.kinds, F.col("n"))
    made = c.first(scored, ("s_raw", "s_per_month"), 10)
    assert 10 <= made.count() <= 10 * 2 * (1 + c.dealt.n * (c.dealt.n + 1) // 2) < edges.count()


def test_no_edges(spark, both):
    p, period, c, i = both[1]
    none = pairs.counted(p.where("false"), period, c, i)
    assert pairs.report(none).collect() == [] and pairs.persistence_curve(none).collect() == [] and pairs.class_baseline(none).collect() == []
    assert tuple(pairs.persistence(none, 4).first()) == (0, 0, None, 0, None, None, None, None)


def test_kinds_are_passed_on(both, monkeypatch):
    """A task that holds few kinds at once gives the same counts."""
    _, (p, period, c, i) = both
    want = pairs.counted(p, period, c, i).kinds.collect()
    tallied = counted.tallied

    def few(classes):
        fold = tallied(classes)

        def limited(x, y, pieces):
            kept, counted.KEPT = counted.KEPT, 4
            yield from fold(x, y, pieces)
            counted.KEPT = kept

        return limited

    monkeypatch.setattr(counted, "tallied", few)
    assert sorted(map(str, pairs.counted(p, period, c, i).kinds.collect())) == sorted(map(str, want))
