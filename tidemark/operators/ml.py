"""Voyage labels, anomaly scores and their evaluation, and vertically federated logistic regression."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import AnomalyConfig, FederatedConfig
from tidemark.functions.core import share
from tidemark.functions.intervals import deal_moments, deal_spans, in_bucket
from tidemark.functions.quantiles import grouped_quantiles, medians
from tidemark.functions.ranking import cut, ranked, sums_before

SAMPLE_ROWS = 100_000  # rows an isolation forest draws its trees' samples from, at most


def label_voyages(features: DataFrame, incidents: DataFrame, c: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """features with is_incident: the voyage overlaps an incident of its vessel, widened by pad_hours on both sides; without an end, an incident ends at its start.

    Two spans overlap where one starts within the other. Both cases are joins of moments with spans by vessel and bucket of time, so a vessel of many voyages and incidents isn't one key.
    """
    pad = F.expr(f"interval {int(c.pad_hours * 3600)} seconds")
    spans = incidents.select(F.col("mmsi").alias("_m"), (F.col("t_start") - pad).alias("_lo"), (F.coalesce("t_end", "t_start") + pad).alias("_hi"))
    voyages = features.select("mmsi", "voyage_id", "t_start", "t_end")
    overlap = (F.col("mmsi") == F.col("_m")) & (F.col("t_start") <= F.col("_hi")) & (F.col("t_end") >= F.col("_lo"))
    wide, long = deal_spans(spans, "_lo", "_hi"), deal_spans(voyages, "t_start", "t_end")
    hits = [
        in_bucket(deal_moments(voyages, "t_start", wide), wide, overlap & (F.col("t_start") >= F.col("_lo")), "left_semi"),
        in_bucket(long, deal_moments(spans, "_lo", long), overlap & (F.col("t_start") <= F.col("_lo")), "left_semi"),
    ]
    hit = hits[0].select("voyage_id").unionByName(hits[1].select("voyage_id")).distinct()
    return features.join(hit.withColumn("is_incident", F.lit(True)), "voyage_id", "left").withColumn("is_incident", F.coalesce("is_incident", F.lit(False)))


def incident_tracks(points: DataFrame, incidents: DataFrame, pad_hours: float = 6.0) -> DataFrame:
    """Points of each incident's vessels from pad_hours before it to pad_hours after: an equi-join on the vessel and a bucket of time."""
    pad = F.expr(f"interval {int(pad_hours * 3600)} seconds")
    i = incidents.select("incident_num", F.col("mmsi").alias("_m"), (F.col("t_start") - pad).alias("_lo"), (F.coalesce("t_end", "t_start") + pad).alias("_hi"))
    spans = deal_spans(i, "_lo", "_hi")
    near = deal_moments(points.select("mmsi", "ts", "lat", "lon", "sog"), "ts", spans)
    return in_bucket(near, spans, (F.col("mmsi") == F.col("_m")) & F.col("ts").between(F.col("_lo"), F.col("_hi"))).select("incident_num", "mmsi", "ts", "lat", "lon", "sog")


def incident_months(incidents: DataFrame, pad_hours: float = 6.0) -> DataFrame:
    """(month) that an incident, widened by pad_hours on both sides, touches; one without a start or an end touches none."""
    pad = F.expr(f"interval {int(pad_hours * 3600)} seconds")
    month = lambda t: F.date_trunc("MONTH", t)
    span = F.sequence(month(F.col("t_start") - pad), month(F.col("t_end") + pad), F.expr("interval 1 month"))
    return incidents.where("t_start is not null and t_end is not null").select(F.explode(span).alias("month")).select(F.col("month").cast("timestamp_ntz")).distinct()


def prune_months(points: DataFrame, incidents: DataFrame, pad_hours: float = 6.0) -> DataFrame:
    """Points of months that an incident touches: a semi-join that prunes files where points are partitioned by month."""
    months = incident_months(incidents, pad_hours)
    return points.join(months, F.date_trunc("MONTH", F.col("ts")).cast("timestamp_ntz") == F.col("month"), "left_semi")


def filled(features: DataFrame, columns: list[str] | tuple[str, ...], constants: dict[str, float]) -> DataFrame:
    """features with x_<column>: NaN and null filled with the column's constant, else with its median (in which infinite values count); then infinite ones are 0."""
    df = features.withColumns({f"x_{c}": F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})
    free = [c for c in columns if c not in constants]
    found = medians(df, [f"x_{c}" for c in free]).first() if free else None
    middle = lambda c: 0.0 if found is None or found[f"x_{c}"] is None else float(found[f"x_{c}"])
    fill = {c: constants.get(c, middle(c) if c in free else 0.0) for c in columns}
    whole = {c: F.coalesce(f"x_{c}", F.lit(fill[c])) for c in columns}
    return df.withColumns({f"x_{c}": F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(0.0)) for c, x in whole.items()})


def prepared(features: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """features with x_<column>: missing values filled with the median (0 for the longest gap), then infinite ones with 0, scaled by mean and population deviation."""
    df = filled(features, columns, {"max_gap_hours": 0.0})
    stats = df.agg(*[F.avg(f"x_{c}").alias(f"m_{c}") for c in columns], *[F.stddev_pop(f"x_{c}").alias(f"s_{c}") for c in columns]).first()
    mean, sd = (lambda c: float(stats[f"m_{c}"] or 0.0)), (lambda c: float(stats[f"s_{c}"] or 0.0) or 1.0)
    return df.withColumns({f"x_{c}": (F.col(f"x_{c}") - mean(c)) / sd(c) for c in columns})


def _path_length(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_trees(sample: np.ndarray, c: AnomalyConfig) -> list[list[list[float]]]:
    """Isolation trees: rows of (column or -1, cut, left, right, size)."""
    rng, trees = np.random.default_rng(c.seed), []
    size = min(c.sample, len(sample))
    depth = int(np.ceil(np.log2(max(size, 2))))
    for _ in range(c.trees):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, len(rows)])
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if level < depth and len(spread):
                k = int(rng.choice(spread))
                cut = float(rng.uniform(rows[:, k].min(), rows[:, k].max()))
                left = rows[:, k] < cut
                if left.any() and not left.all():
                    nodes[at] = [k, cut, grow(rows[left], level + 1), grow(rows[~left], level + 1), len(rows)]
            return at

        grow(sample[rng.choice(len(sample), size, replace=False)], 0)
        trees.append(nodes)
    return trees


def scoring_trees(trees: list[list[list[float]]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Each tree as (column, cut, right child, path length at a leaf, depth), a left child beside its right one; a leaf is its own right child and nothing is below its cut."""
    out = []
    for nodes in trees:
        order, depths, right = [0], [0], []
        for at, depth in zip(order, depths):  # both grow
            k, _, left, other, _ = nodes[at]
            right.append(len(order) if k >= 0 else len(right))
            if k >= 0:
                order += [int(other), int(left)]
                depths += [depth + 1] * 2
        rows = [nodes[at] for at in order]
        ends = np.array([d + _path_length(r[4]) for r, d in zip(rows, depths)])
        out.append((np.array([max(int(r[0]), 0) for r in rows]), np.array([r[1] if r[0] >= 0 else -np.inf for r in rows]), np.array(right), ends, max(depths)))
    return out


def forest_scores(df: DataFrame, sets: dict[str, list[str]], c: AnomalyConfig) -> DataFrame | None:
    """voyage_id and, under each set's name, the score of a forest on its columns: one pass over df for the samples of all sets, one for the scores. None without rows."""
    every = sorted({k for x in sets.values() for k in x})
    drawn = df.select(*every, F.xxhash64("voyage_id", F.lit(c.seed)).alias("_h")).orderBy("_h").limit(SAMPLE_ROWS).select(*every).toPandas()
    if not len(drawn):
        return None
    forests = {name: json.dumps(grow_trees(drawn[x].to_numpy(float), c)) for name, x in sets.items()}
    norm = _path_length(min(c.sample, len(drawn))) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = {name: scoring_trees(json.loads(f)) for name, f in forests.items()}
        for pdf in batches:
            out = {"voyage_id": pdf["voyage_id"]}
            for name, x in sets.items():
                m = np.ascontiguousarray(pdf[x].to_numpy(float))
                flat, first = m.ravel(), np.arange(len(m)) * len(x)
                total = np.zeros(len(m))
                for column, limit, right, ends, depth in grown[name]:
                    at = np.zeros(len(m), int)
                    for _ in range(depth):
                        at = right.take(at) + (flat.take(first + column.take(at)) < limit.take(at))
                    total += ends.take(at)
                out[name] = 2.0 ** (-total / len(grown[name]) / norm)
            yield pd.DataFrame(out)

    return cut(df.select("voyage_id", *every).mapInPandas(score, ", ".join(["voyage_id string", *[f"{name} double" for name in sets]])))


def isolation_scores(features: DataFrame, columns: list[str] | tuple[str, ...], c: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """features with score, larger for what random cuts isolate sooner (from 0 to 1), and is_anomaly for the contamination share.

    Trees are grown on samples of at most SAMPLE_ROWS rows, drawn by a hash of the voyage, as the method samples anyway; every row is scored.
    """
    scores = forest_scores(prepared(features, columns), {"score": [f"x_{k}" for k in columns]}, c)
    if scores is None:
        return features.withColumns({"score": F.lit(None).cast("double"), "is_anomaly": F.lit(False)})
    return features.join(scores, "voyage_id").crossJoin(F.broadcast(upper_share(scores, "score", c.contamination))).withColumn("is_anomaly", F.col("score") > F.col("limit")).drop("limit")  # one row


def upper_share(df: DataFrame, x: str, part: float) -> DataFrame:
    return upper_shares(df, [x], part).withColumnRenamed(f"limit_{x}", "limit")


def upper_shares(df: DataFrame, columns: list[str], part: float) -> DataFrame:
    """One row, limit_<column>: the exact (1 - part) quantile of each column, linear between values; null and empty columns have none.

    All columns are ranked at once by ranges of (column, value), so no task holds all values."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in columns])).alias("v")).select("v.*").where("x is not null")
    placed = ranked(each, ["c", "x"], "_r")
    spans = placed.groupBy("c").agg((F.min("_r") + (F.count("*") - 1) * (1 - part)).alias("at"))  # a place with a fraction
    two = placed.join(F.broadcast(spans), "c").where((F.col("_r") == F.floor("at")) | (F.col("_r") == F.ceil("at")))  # a row a column
    of = lambda f, v, c: f(F.when(F.col("c") == c, v))
    return two.agg(*[
        (of(F.min, F.col("x"), c) + (of(F.max, F.col("x"), c) - of(F.min, F.col("x"), c)) * of(F.max, F.col("at") - F.floor("at"), c)).alias(f"limit_{c}") for c in columns
    ])


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row, n_pos, n_neg, auc: the exact area under the ROC curve, as of `aucs`; null without both classes."""
    return aucs(scored.select(F.lit(0).alias("_g"), F.col(score).alias("_s"), F.col(label).alias("_l")), ["_g"], "_s", "_l").agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.max("auc").alias("auc")
    )


def aucs(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by, n_pos, n_neg, auc: exact areas under the ROC curves of groups, with mean ranks of ties.

    Scores are counted by value first, and the distinct values of all groups are ranked at once by ranges.
    """
    values = scored.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    placed = sums_before(values, [*by, "s"], {"below": F.col("n")})
    first = placed.groupBy(*by).agg(F.min("below").alias("_b"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("u"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return first.select(*by, "n_pos", "n_neg", F.try_divide(F.col("u") - F.col("_b") * F.col("n_pos"), pairs).alias("auc"))


def ablation(features: DataFrame, label: str = "is_incident", c: AnomalyConfig = AnomalyConfig(), k: int = 100) -> DataFrame:
    """For each feature set: n_features, auc, hits among the k of largest score, lift. Features are prepared once, and all forests score them in one pass."""
    out = None
    whole = prepared(features, sorted({k for columns in c.ablations.values() for k in columns}))
    scores = forest_scores(cut(whole), {f"s_{name}": [f"x_{k}" for k in columns] for name, columns in c.ablations.items()}, c)
    sets = [f"s_{name}" for name in c.ablations]
    scores = features.select("voyage_id", label, *[F.lit(None).cast("double").alias(x) for x in sets]) if scores is None else cut(features.select("voyage_id", label).join(scores, "voyage_id"))
    for name, columns in c.ablations.items():
        scored = scores.select("voyage_id", F.col(f"s_{name}").alias("score"), label)
        hits = scored.orderBy(F.desc("score"), "voyage_id").limit(k).agg(F.count_if(label).alias("hits"), F.count("*").alias("k"))
        whole = scored.agg(F.count_if(label).alias("t"), F.count("*").alias("n"))
        row = auc(scored, "score", label).crossJoin(hits).crossJoin(whole).select(  # one row each
            F.lit(name).alias("feature_set"), F.lit(len(columns)).alias("n_features"), "auc", F.col("hits").alias("top_hits"),
            F.try_divide(share(F.col("hits"), F.col("k")), share(F.col("t"), F.col("n"))).alias("lift"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def feature_contribution(features: DataFrame, columns: list[str] | tuple[str, ...], label: str = "is_incident") -> DataFrame:
    """feature, medians of incident and other voyages, and their ratio."""
    found = grouped_quantiles(features, list(columns), (0.5,), (label,))
    median = lambda of: F.max(F.when(of, F.col("value")))
    out = found.groupBy(F.col("column").alias("feature")).agg(median(F.col(label)).alias("median_event"), median(~F.col(label)).alias("median_normal"))
    names = features.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = names.join(F.broadcast(out), "feature", "left")  # a row a column, also if it has no values
    return out.withColumn("ratio", F.try_divide("median_event", F.when(F.col("median_normal") != 0, F.col("median_normal"))))


def unit(key: str, seed: int, salt: int) -> Column:
    """A number in (0, 1) by a hash: the same at any partitioning."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key), F.lit(seed), F.lit(salt))), 1, 12), 16, 10).cast("double")
    return (bits + 1.0) / float((1 << 48) + 2)


def federated_task(features: DataFrame, c: FederatedConfig = FederatedConfig(), repeats: int = 1) -> DataFrame:
    """voyage_id, z_<feature>, and for each repeat r from 0: label_r, train_r.

    Missing values are filled with the median, infinite ones with 0, and scaled with sample deviations. A party's signal is the mean of its features, scaled
    again (population deviation) so that parties weigh alike; the label is the top fifth of the three signals' sum with normal noise of deviation 1.2.
    Noise and split come from hashes of the voyage and the repeat.
    """
    columns = [f for _, fs in c.parties for f in fs]
    df = filled(features.select("voyage_id", *columns), columns, {})
    stats = df.agg(*[F.avg(f"x_{k}").alias(f"m_{k}") for k in columns], *[F.stddev_samp(f"x_{k}").alias(f"s_{k}") for k in columns])
    df = df.crossJoin(F.broadcast(stats))  # one row
    scaled = lambda x, m, s: (F.col(x) - F.col(m)) / F.coalesce(F.when(F.col(s) > 0, F.col(s)), F.lit(1.0))
    df = df.select("voyage_id", *[scaled(f"x_{k}", f"m_{k}", f"s_{k}").alias(f"z_{k}") for k in columns])
    names = [name for name, _ in c.parties]
    df = df.withColumns({f"p_{name}": sum((F.col(f"z_{k}") for k in fs), F.lit(0.0)) / len(fs) for name, fs in c.parties})
    whole = df.agg(*[F.avg(f"p_{n}").alias(f"pm_{n}") for n in names], *[F.stddev_pop(f"p_{n}").alias(f"ps_{n}") for n in names])
    seeds = [c.seed + 17 * r for r in range(repeats)]
    noise = [F.sqrt(-2 * F.log(unit("voyage_id", s, 1))) * F.cos(2 * np.pi * unit("voyage_id", s, 2)) for s in seeds]
    signal = sum((scaled(f"p_{n}", f"pm_{n}", f"ps_{n}") for n in names), F.lit(0.0))
    df = cut(df.crossJoin(F.broadcast(whole)).withColumns({f"y_{r}": signal + c.noise * x for r, x in enumerate(noise)}))  # one row
    limits = upper_shares(df, [f"y_{r}" for r in range(repeats)], c.positives)
    return df.crossJoin(F.broadcast(limits)).select(  # one row
        "voyage_id", *[f"z_{k}" for k in columns], *[(F.col(f"y_{r}") > F.col(f"limit_y_{r}")).alias(f"label_{r}") for r in range(repeats)],
        *[(unit("voyage_id", s, 3) < c.train_share).alias(f"train_{r}") for r, s in enumerate(seeds)],
    )


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit_logistic(task: DataFrame, models: dict[str, list[list[str]]], c: FederatedConfig, repeats: int = 1) -> dict[tuple[str, int], dict[str, float]]:
    """Full-batch gradient descent without intercept: weights by column of each model and repeat; a model is given as the columns of its parties.

    A party sends its columns' partial score of each row up and gets the residual back, no columns: its gradient is that of all columns at one
    place. An epoch is one aggregation of the gradients of all models and repeats.
    """
    keys = [(m, r) for m in models for r in range(repeats)]
    w = {key: {k: 0.0 for g in models[key[0]] for k in g} for key in keys}
    names = [(key, k) for key in keys for k in w[key]]
    groups = {tuple(g) for m in models.values() for g in m}
    every = sorted({k for g in groups for k in g})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # once: epochs read numbers as they lie in memory, a row a batch
        for pdf in batches:
            flags = pdf[[f"{k}_{r}" for k in ("label", "train") for r in range(repeats)]].to_numpy(bool)
            yield pd.DataFrame({"n": [len(pdf)], "z": [pdf[every].to_numpy(float).tobytes()], "flags": [np.packbits(flags.T, axis=1).tobytes()]})

    def gradient(w: dict[tuple[str, int], dict[str, float]]):  # weights go along as data: as literals they would make Spark compile each epoch anew
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for pdf in batches:
                for n, z, flags in zip(pdf["n"], pdf["z"], pdf["flags"]):
                    z = np.frombuffer(z).reshape(n, -1)
                    flags = np.unpackbits(np.frombuffer(flags, np.uint8).reshape(2 * repeats, -1), axis=1, count=n).T.astype(float)
                    label, train = flags[:, :repeats], flags[:, repeats:]
                    party = {g: np.ascontiguousarray(z[:, [every.index(k) for k in g]]) for g in groups}  # what each party has
                    out = [train.sum(axis=0)]
                    for m in models:  # all repeats of a model at once
                        score = sum(party[g] @ np.array([[w[m, r][k] for r in range(repeats)] for k in g]) for g in map(tuple, models[m]))
                        residual = (sigmoid(score) - label) * train
                        out.append(np.concatenate([party[g].T @ residual for g in map(tuple, models[m])]).T.ravel())
                    total = total + np.concatenate(out)
            if np.ndim(total):
                yield pd.DataFrame({"i": range(len(total)), "v": total})

        return run

    packed = task.select(*every, *[f"{k}_{r}" for k in ("label", "train") for r in range(repeats)]).mapInPandas(pack, "n long, z binary, flags binary").persist()
    for _ in range(c.epochs):
        g = {r.i: r.v for r in packed.mapInPandas(gradient(w), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}  # a row a weight
        mean = {(key, k): g.get(repeats + i, 0.0) / (g.get(key[1]) or 1.0) for i, (key, k) in enumerate(names)}
        w = {key: {k: x[k] - c.rate * (mean[key, k] + c.l2 * x[k]) for k in x} for key, x in w.items()}
    packed.unpersist()
    return w


def federated_results(task: DataFrame, c: FederatedConfig = FederatedConfig(), repeats: int = 1) -> DataFrame:
    """(model, repeat, auc) on the held-out rows: all columns at one place, the same split by party, and each party alone. task is read once an epoch: give it written or cut."""
    parties = [[f"z_{k}" for k in fs] for _, fs in c.parties]
    models = {"centralized": [[k for g in parties for k in g]], "vertical_federated": parties} | {f"single_{name}": [g] for (name, _), g in zip(c.parties, parties)}
    fitted = fit_logistic(task, models, c, repeats)
    rows = [F.struct(F.lit(m).alias("model"), F.lit(r).alias("repeat"), (~F.col(f"train_{r}")).alias("held"), F.col(f"label_{r}").alias("label"), sum((F.col(k) * x for k, x in w.items()), F.lit(0.0)).alias("s")) for (m, r), w in fitted.items()]
    return aucs(task.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("held"), ["model", "repeat"], "s", "label").select("model", "repeat", "auc")


def mean_and_interval(values: DataFrame, x: str, by: str) -> DataFrame:
    """Mean and half the 95 % interval by group; null of a single value."""
    return values.groupBy(by).agg(F.avg(x).alias("mean"), (1.96 * F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))).alias("ci95"))
