"""Busy cells and vessels with many voyages and incidents: split by design, same rows as brute force."""

import datetime as dt
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.config import AnomalyConfig
from tidemark.functions.intervals import PIECES, deal_moments, deal_spans
from tidemark.operators import ml, pairs

T0 = dt.datetime(2024, 1, 1)
CELLS = "tbin long, ci long, cj long, mmsi long, stopped boolean, moving boolean"


@pytest.mark.parametrize("block", [1, 3, 10, 1_000])
def test_busy_cells_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(t, c, 0, m, rng.random() < 0.5, rng.random() < 0.5) for t in range(2) for c, n in ((0, 40), (1, 7), (2, 1)) for m in rng.sample(range(60), n)]
    want, still, moving = Counter(), Counter(), Counter()
    for t in range(2):
        for c in range(3):
            for a, b in combinations(sorted(r[3:] for r in rows if r[:2] == (t, c)), 2):
                want[a[0], b[0]] += 1
                still[a[0], b[0]] += a[1] and b[1]
                moving[a[0], b[0]] += a[2] and b[2]
    rows += [(0, 0, 0, None, True, True), (0, 0, 0, None, True, True), (None, 0, 0, 1, True, True), (None, 0, 0, 2, True, True)]
    got = pairs.cooccurrence(spark.createDataFrame(rows, CELLS), 1, block).collect()
    assert {(r.mmsi_a, r.mmsi_b): (r.n_windows, r.n_both_stopped, r.n_both_moving) for r in got} == {k: (n, still[k], moving[k]) for k, n in want.items()}
    assert pairs.cooccurrence(spark.createDataFrame([], CELLS), 1, block).count() == 0


def test_one_cell_of_many_vessels_is_many_keys(spark):
    """No key of the join holds more than about two blocks, and every pair comes once."""
    cells = spark.range(1_500).select(F.lit(0).cast("long").alias("tbin"), F.lit(0).cast("long").alias("ci"), F.lit(0).cast("long").alias("cj"), F.col("id").alias("mmsi"), F.lit(True).alias("stopped"), F.lit(False).alias("moving"))
    r = pairs.meetings(cells, block=100).agg(F.count("*").alias("n"), F.count_distinct("mmsi_a", "mmsi_b").alias("d"), F.count_if(F.col("mmsi_a") >= F.col("mmsi_b")).alias("bad")).first()
    assert (r.n, r.d, r.bad) == (1_500 * 1_499 // 2,) * 2 + (0,)


def spans(rng, n, longest):
    out = []
    for k in range(n):
        start = T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 60))
        end = rng.choice([None, start, start + dt.timedelta(minutes=rng.randrange(longest))])
        out.append((k, rng.randrange(3), start, end))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_points_and_voyages_near_incidents(spark, seed):
    """Lengths from nothing to weeks, no end, an end long before the start, no start, shared borders: as plain comparisons say."""
    rng, pad = random.Random(seed), dt.timedelta(hours=6)
    i = spans(rng, 25, 60 * 24 * 30) + [(90, 0, T0 + dt.timedelta(days=20), T0), (91, 1, None, T0), (92, None, T0, T0), (93, 2, None, None)]
    v = [(f"v{k}", m, a, b) for k, m, a, b in spans(rng, 60, 60 * 24 * 20)] + [("all", 0, T0 - dt.timedelta(days=400), T0 + dt.timedelta(days=900))]
    v += [(f"edge{k}", m, b + pad, b + pad) for k, m, _, b in i[:25] if b] + [("none", None, T0, T0)]
    p = [(rng.randrange(3), T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 60)), 1.0, 2.0, 3.0) for _ in range(300)] + [(0, T0 - dt.timedelta(days=9_000), 1.0, 2.0, 3.0), (0, None, 1.0, 2.0, 3.0)]
    incidents = spark.createDataFrame(i, "incident_num long, mmsi long, t_start timestamp_ntz, t_end timestamp_ntz")
    wide = [(k, m, a and a - pad, (b or a) and (b or a) + pad) for k, m, a, b in i]
    wide = [w for w in wide if None not in w]
    got = Counter((r.incident_num, r.mmsi, r.ts) for r in ml.incident_tracks(spark.createDataFrame(p, "mmsi long, ts timestamp_ntz, lat double, lon double, sog double"), incidents).collect())
    assert got == Counter((k, m, t) for k, m, a, b in wide for x, t, *_ in p if x == m and t and a <= t <= b)
    features = spark.createDataFrame(v, "voyage_id string, mmsi long, t_start timestamp_ntz, t_end timestamp_ntz")
    got = {r.voyage_id: r.is_incident for r in ml.label_voyages(features, incidents, AnomalyConfig()).collect()}
    assert got == {n: any(x == m and s and e and s <= b and e >= a for _, m, a, b in wide) for n, x, s, e in v}
    assert not any(r.is_incident for r in ml.label_voyages(features, incidents.limit(0)).collect())


def test_long_spans_take_few_buckets_and_meet_a_moment_once(spark):
    rows = [(k, T0, T0 + dt.timedelta(hours=1.7**k)) for k in range(22)]
    s = spark.createDataFrame(rows, "k long, lo timestamp_ntz, hi timestamp_ntz")
    d = deal_spans(s, "lo", "hi")
    assert d.groupBy("k").count().agg(F.max("count")).first()[0] <= PIECES + 1
    m = deal_moments(spark.createDataFrame([(T0 + dt.timedelta(minutes=20),), (T0,)], "at timestamp_ntz"), "at", d)
    met = m.join(d, ["_level", "_bucket"]).where("at between lo and hi").groupBy("k", "at").count()
    assert met.count() == 44 and met.agg(F.max("count")).first()[0] == 1
