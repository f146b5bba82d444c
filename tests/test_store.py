import re

from pyspark.sql import functions as F

from tidemark.config import PairConfig
from tidemark.operators import pairs
from tidemark.sources import store


def reports(spark):
    """Three vessels that meet in each of four months, and a report without a time."""
    rows = [(m, f"2023-{k:02d}-0{d} 0{h}:10:00", 21.0, -158.0, 1.0, f"V{m}", "cargo", None) for k in (1, 2, 3, 12) for d in (1, 2) for h in (1, 2) for m in (1, 2, 3)]
    rows.append((4, None, 21.0, -158.0, 1.0, "V4", "cargo", None))
    df = spark.createDataFrame(rows, "mmsi long, t string, lat double, lon double, sog double, vessel_name string, vessel_class string, draft double")
    return df.withColumn("ts", F.to_timestamp("t").cast("timestamp_ntz")).drop("t")


def files_read(df):
    """(files read, whether they were chosen at run time) by the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    scans, stack = [], [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif name == "FileSourceScanExec":
            scans.append(node.metrics().apply("numFiles").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return sum(scans), bool(re.search("dynamicpruning", text))


def test_only_files_of_an_incidents_months_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    store.write_points(reports(spark), path, spread=2)
    all_files, _ = files_read(store.read(spark, path))
    near = spark.createDataFrame([("2023-01-31 20:00:00", "2023-02-01 01:00:00"), (None, "2023-03-01 00:00:00"), ("2023-12-05 00:00:00", "2023-12-01 00:00:00")], "a string, b string")
    near = near.select(F.to_timestamp("a").alias("t_start"), F.to_timestamp("b").alias("t_end"))
    assert sorted(r.period for r in store.incident_periods(near).collect()) == ["2023_01", "2023_02"]
    some = store.in_periods(store.read(spark, path), store.incident_periods(near))
    read, chosen = files_read(some)
    assert chosen and 0 < read < all_files
    assert {(r.period, r["count"]) for r in some.groupBy("period").count().collect()} == {("2023_01", 12), ("2023_02", 12)}


def test_a_new_period_is_added_alone(spark, tmp_path):
    points, edges, c = f"file://{tmp_path}/p", f"file://{tmp_path}/e", PairConfig(min_windows=2)
    all_points = reports(spark)
    early = F.month("ts") < 3
    store.write_points(all_points.where(early), points)
    assert store.update_edges(spark, points, edges, c) == ["2023_01", "2023_02"]
    store.write_points(all_points.where(~early | F.col("ts").isNull()), points, mode="append")
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "e").glob("period=2023_0[12]/*.parquet")}
    assert store.update_edges(spark, points, edges, c) == ["2023_03", "2023_12"] and store.update_edges(spark, points, edges, c) == []
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "e").glob("period=2023_0[12]/*.parquet")}
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = rows(pairs.accumulate(all_points.where("ts is not null"), F.date_format("ts", "yyyy_MM"), c))
    assert rows(store.merged_edges(spark, points, edges)) == want
    assert store.update_edges(spark, points, edges, c, ["2023_01", "1999_01"]) == ["2023_01"]
    assert rows(store.merged_edges(spark, points, edges)) == want


def test_kept_edges_are_rows_of_vessels(spark, tmp_path):
    """40 vessels that meet each day are 40 rows a day, not 780 pairs; periods may have thresholds of their own."""
    points, edges = f"file://{tmp_path}/p", f"file://{tmp_path}/e"
    rows = [(m, f"2023-0{k}-01 0{h}:10:00", 21.0, -158.0, 1.0, f"V{m}", "cargo", None) for k in (1, 2) for h in range(k) for m in range(40)]
    df = spark.createDataFrame(rows, "mmsi long, t string, lat double, lon double, sog double, vessel_name string, vessel_class string, draft double")
    store.write_points(df.withColumn("ts", F.to_timestamp("t").cast("timestamp_ntz")).drop("t"), points)
    store.update_edges(spark, points, edges, PairConfig(min_windows=1), ["2023_01"])
    store.update_edges(spark, points, edges, PairConfig(min_windows=2))
    assert store.read(spark, edges).count() == 3 * 40
    assert {(r.n_windows, r.n_months) for r in store.merged_edges(spark, points, edges).collect()} == {(3, 2)}
    store.update_edges(spark, points, edges, PairConfig(min_windows=2), ["2023_01"])
    got = store.merged_edges(spark, points, edges).collect()
    assert {(r.n_windows, r.n_months) for r in got} == {(2, 1)} and len(got) == 780


def test_steps_follow_their_options_and_inputs(spark, tmp_path):
    from tidemark.plans import pipeline

    where = f"file://{tmp_path}/in"
    reports(spark).where("ts is not null").withColumns({"cog": F.lit(0.0), "heading": F.lit(0.0)}).write.parquet(where)
    only, out = {"voyage_points", "ports", "declarations", "overview"}, f"file://{tmp_path}/out"
    i = spark.createDataFrame([], "incident_num long, mmsi long, t_start timestamp_ntz, t_end timestamp_ntz, incident_type string, evidence string")

    def made(o=pipeline.Options(), **kw):
        log = pipeline.run(spark, {"points": spark.read.parquet(where), "incidents": i}, out, only=only & kw.pop("some", only), o=o, **kw)
        return {name for name, what in log if what == "made"}

    assert made() == only and made() == set()
    assert made(pipeline.Options(normal=2)) == {"declarations"} and made(pipeline.Options(normal=2, seed=7)) == set()
    assert made(pipeline.Options(normal=2), force=True, some={"ports"}) == {"ports"}
    assert made(pipeline.Options(normal=2)) == {"declarations"}  # its ports were remade
    reports(spark).where("mmsi = 1").withColumns({"cog": F.lit(0.0), "heading": F.lit(0.0)}).write.mode("append").parquet(where)
    assert {name for name, _ in pipeline.run(spark, {"points": spark.read.parquet(where), "incidents": i}, out, only=only, dry=True) if _ == "would run"} == only
