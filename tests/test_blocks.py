"""Pairs counted by blocks of vessels: same rows as brute force for any number of blocks, and no pair is ever shuffled."""

import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, graph, pairs
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
CELLS = "period {0}, tbin long, ci long, cj long, mmsi long, stopped boolean, moving boolean"


@pytest.mark.parametrize("n,places,wide,text", [(1, 1 << 20, 1, False), (4, 64, 1, True), (7, 5, 1 << 40, False)])
def test_pairs_by_blocks_are_those_of_brute_force(spark, monkeypatch, n, places, wide, text):
    """Counted in lists and in places, at once and in pieces; a cell's numbers too wide for one long; periods as numbers and as texts."""
    counter = blocks._counter

    def small(*args):
        run = counter(*args)

        def limited(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, (blocks.PLACES, blocks.CHUNK) = (blocks.PLACES, blocks.CHUNK), (places, 10)
            yield from run(key, batches)
            blocks.PLACES, blocks.CHUNK = kept

        return limited

    rng = random.Random(n)
    name = (lambda t: f"p{t // 2}") if text else (lambda t: t // 2 - 3)
    rows = [(name(t), t * wide, c * wide, -c, m, rng.random() < 0.5, rng.random() < 0.5) for t in range(6) for c in range(3) for m in rng.sample(range(40), rng.choice([1, 5, 25]))]
    marks = [(i, rng.randrange(40)) for i in range(-2, 5) for _ in range(6)]
    each = defaultdict(Counter)
    for key in {r[:4] for r in rows}:
        for a, b in combinations(sorted(r[4:] for r in rows if r[:4] == key), 2):
            each[a[0], b[0]].update({("n", key[0]): 1, ("s", key[0]): a[1] and b[1], ("m", key[0]): a[2] and b[2]})
    both = {(a, b): sorted(i for i in {i for i, _ in marks} if {(i, a), (i, b)} <= set(marks)) for a, b in combinations(range(40), 2)}
    cells = spark.createDataFrame(rows + [(None, 0, 0, 0, 1, True, True), (rows[0][0], 0, 0, 0, None, True, True)], CELLS.format("string" if text else "long"))
    incidents = spark.createDataFrame([*marks, (None, 1), (1, None)], "incident_num long, mmsi long")
    vessels = spark.createDataFrame([(m, f"V{m}") for m in range(0, 40, 3)], "mmsi long, name string")
    monkeypatch.setattr(blocks, "_counter", small if n > 1 else counter)
    got = blocks.block_pairs(cells, pairs.BY_PERIOD, 3, 2, periods=True, vessels=vessels, incidents=incidents, blocks=n).collect()
    want = {}
    for p, c in each.items():
        kept = [k for x, k in c if x == "n" and c[x, k] >= 2]
        if sum(c["n", k] for k in kept) >= 3:
            named = tuple(f"V{v}" if v % 3 == 0 else None for v in p)
            want[p] = (*(sum(c[x, k] for k in kept) for x in "nsm"), len(kept), *named, max(both[p], default=None))
    assert {(r.mmsi_a, r.mmsi_b): tuple(r[2:]) for r in got} == want and len(got) == len(want) > 20
    got = blocks.block_pairs(cells, pairs.BY_PERIOD, least_each=2, apart=True, blocks=n).collect()
    assert Counter(map(tuple, got)) == Counter((k, *p, c["n", k], c["s", k], c["m", k]) for p, c in each.items() for x, k in list(c) if x == "n" and c[x, k] >= 2)
    got = blocks.block_pairs(cells, pairs.BY_PERIOD, 2, incidents=incidents, listed=True, blocks=n).collect()
    shared = {p: sum(v for (x, _), v in c.items() if x == "n") for p, c in each.items()}
    assert Counter(map(tuple, got)) == Counter((i, *p, shared[p] if shared.get(p, 0) >= 2 else None) for p, found in both.items() for i in found)


@pytest.mark.parametrize("name", ["cooccurrence_edges", "edge_lift", "edge_accumulate", "moving_pairs", "moored_pairs", "class_scores", "incident_pairs", "validate_incidents", "supplier_cooccurrence"])
def test_no_pair_is_shuffled(spark, name):
    """Exchanges lie below the step that makes pairs: above it the plan has none."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("== Initial Plan ==")[-1].split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan and " hashpartitioning" not in above.replace("BroadcastExchange", "") and "SortMergeJoin" not in above


def test_edges_beyond_held_rows_get_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 10)
    monkeypatch.setattr(blocks, "BLOCKS", 2)
    cells = spark.range(90).select(F.lit(0).cast("long").alias("tbin"), F.lit(0).cast("long").alias("ci"), F.lit(0).cast("long").alias("cj"), F.col("id").alias("mmsi"), F.lit(True).alias("stopped"), F.lit(False).alias("moving"))
    df = blocks.block_pairs(cells, ("tbin", "ci", "cj"))
    assert df.count() == 90 * 89 // 2 and df.rdd.getNumPartitions() >= 9 * 10 // 2 - 1


@pytest.mark.parametrize("n", [1, 5])
def test_ranks_by_blocks(spark, n):
    """Many equal scores: places are those of a sort by score and numbers."""
    rng = random.Random(n)
    rows = [(0, t, c, 0, m, False, rng.random() < 0.7) for t in range(4) for c in range(3) for m in rng.sample(range(60), 25)]
    df = blocks.block_pairs(spark.createDataFrame(rows, CELLS.format("long")), pairs.BY_PERIOD, periods=True, blocks=n, score=pairs.by_months)
    got = sorted(df.collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and len(got) > 300
    assert [(r.mmsi_a, r.mmsi_b) for r in got] == [(r.mmsi_a, r.mmsi_b) for r in sorted(got, key=lambda r: (-r.score, r.mmsi_a, r.mmsi_b))]


def test_tasks_leave_forests(spark):
    """Of a dense graph's edges, at most two a node and task reach the rounds of labels."""
    edges = spark.range(200).select(F.col("id").alias("mmsi_a")).crossJoin(spark.range(200).select(F.col("id").alias("mmsi_b"))).where("mmsi_a < mmsi_b and mmsi_a % 2 = mmsi_b % 2")
    assert graph.thinned(edges, "mmsi_a", "mmsi_b").count() <= 2 * 8 * 200 < edges.count()
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(k, k % 2) for k in range(200)}


def test_truth_by_name(spark):
    """Edges of unshared names aren't shuffled; shared and missing names are as by the join of all."""
    edges = spark.createDataFrame([(1, 2, "A", "B", True), (3, 4, "B", "A", False), (1, 5, "A", None, True), (3, 6, "B", None, False), (4, 6, "A", "nan", False), (7, 8, "C", "D", True), (7, 9, "C", "E", False)], "mmsi_a long, mmsi_b long, name_a string, name_b string, is_truth boolean")
    vessels = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "A"), (5, None), (6, "nan"), (7, "C"), (8, "D"), (9, "E")], "mmsi long, name string")
    want = pairs.with_truth(edges.drop("is_truth"), edges.where("is_truth").select("mmsi_a", "mmsi_b"), by_name=True)
    got = pairs.truth_by_name(edges, vessels)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.where("is_truth").count() == 5
    plan = QUERIES["truth_by_name"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert " hashpartitioning" not in plan.split("== Initial Plan ==")[-1].split("FlatMapGroupsInArrow")[0] and "SortMergeJoin" not in plan.split("FlatMapGroupsInArrow")[0]
