"""Edges that are counted by kind instead of being listed: reports on all edges read a row for each kind, and only the few edges that they name are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import cut, sums_before
from tidemark.operators.blocks import Dealt, Side

KEPT = 1 << 20  # kinds that a task holds before it passes them on
FEW = 100_000  # kinds that are sent to all tasks, at most
KIND = ("class_a", "class_b", "n_both_moving", "n_months")


def _classes(x: Side, y: Side, used: bool) -> tuple[list, np.ndarray, np.ndarray]:
    """Classes of two blocks, and each vessel's place among them; one place for all where classes aren't used."""
    if not used:
        return [None], np.zeros(len(x.mmsi), np.int64), np.zeros(len(y.mmsi), np.int64)
    names = [s.table["class"].to_pylist() for s in (x, y)]
    every = sorted({c for s in names for c in s}, key=lambda c: (c is not None, c))
    at = {c: k for k, c in enumerate(every)}
    return every, *[np.array([at[c] for c in s], np.int64) for s in names]


class Coder:
    """Kinds of edges as one long each, in their order."""

    def __init__(self, x: Side, y: Side, classes: bool):
        self.names, self.x, self.y = _classes(x, y, classes)
        self.wide = len(self.names)
        most = int(max([1, *np.diff(x.ends)]))  # cells of a vessel: no pair shares more
        self.bits = most.bit_length() + 1
        if 2 * self.wide.bit_length() + 2 * self.bits > 61:
            raise ValueError(f"{self.wide} classes and {most} cells of a vessel are too many for a long")

    def codes(self, a: np.ndarray, b: np.ndarray, moving: np.ndarray, months: np.ndarray) -> np.ndarray:
        return ((self.x[a] * self.wide + self.y[b]) << 2 * self.bits) | (moving << self.bits) | months

    def tally(self, a: np.ndarray, b: np.ndarray, moving: np.ndarray, months: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kinds, in twice their codes, one more for true ones, and how many there are of each."""
        top, most = int(moving.max()) + 1, int(months.max()) + 1
        if self.wide**2 * top * most > FEW:
            found, n = np.unique(self.codes(a, b, moving, months) << 1 | truth, return_counts=True)
            return found, n
        place = self.x[a] * self.wide + self.y[b]
        for v, k in ((moving, top), (months, most), (truth, 2)):
            place *= k
            place += v
        n = np.bincount(place)
        place = np.flatnonzero(n)
        pair, rest = np.divmod(place, top * most * 2)
        moving, rest = np.divmod(rest, most * 2)
        return (pair << 2 * self.bits + 1) | (moving << self.bits + 1) | rest, n[place]

    def kinds(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = (1 << self.bits) - 1
        pair = code >> 2 * self.bits
        return pair // self.wide, pair % self.wide, code >> self.bits & low, code & low


def tallied(classes: bool) -> Callable:
    """Kinds of edges and whether they are true, with how many there are."""

    def fold(x: Side, y: Side, pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        coder = Coder(x, y, classes)

        def summed(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate(codes), return_inverse=True)
            return found, np.bincount(at, np.concatenate(n), len(found)).astype(np.int64)

        def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            a, b, moving, months = coder.kinds(code >> 1)
            names = pa.array(coder.names, pa.string())
            columns = [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(moving), pa.array(months), pa.array(code & 1 == 1), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, names=[*KIND, "is_truth", "n"])

        codes, sizes, held = [], [], 0
        for a, b, counts, months, truth in pieces:
            found, n = coder.tally(a, b, counts[2], months, truth)
            codes.append(found)
            sizes.append(n)
            held += len(found)
            if held > KEPT:
                codes, sizes = ([v] for v in summed(codes, sizes))
                held = len(codes[0])
                if held > KEPT // 2:
                    yield rows(codes[0], sizes[0])
                    codes, sizes, held = [], [], 0
        if codes:
            yield rows(*summed(codes, sizes))

    return fold


def chosen(kinds: list[tuple], classes: bool, most: int) -> Callable:
    """Edges of kinds (class_a, class_b, n_both_moving, n_months, above, equal). above: all of them; equal: a bit for each score, of which a task's first `most` edges are enough, in the order of a and b."""

    def fold(x: Side, y: Side, pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        coder = Coder(x, y, classes)
        at = {c: k for k, c in enumerate(coder.names)}
        low = 1 << coder.bits
        known = sorted((((at[p] * coder.wide + at[q]) << 2 * coder.bits) | (m << coder.bits) | k, above, equal) for p, q, m, k, above, equal in kinds if p in at and q in at and m < low and k < low)
        if not known:
            return
        code, above, equal = np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known], bool), np.array([k[2] for k in known], np.int64)
        names = pa.array(coder.names, pa.string())
        taken = dict.fromkeys([k for k in range(62) if int(np.bitwise_or.reduce(equal)) >> k & 1], 0)
        least = int((code >> coder.bits & low - 1).min())
        for a, b, counts, months, truth in pieces:
            hit = np.flatnonzero(counts[2] >= least)
            own = coder.codes(a[hit], b[hit], counts[2][hit], months[hit])
            place = np.minimum(np.searchsorted(code, own), len(code) - 1)
            some = code[place] == own
            hit, place = hit[some], place[some]
            if not len(hit):
                continue
            keep = above[place].copy()
            for k in taken:
                some = np.flatnonzero(equal[place] >> k & 1)[: most - taken[k]]
                taken[k] += len(some)
                keep[some] = True
            hit = hit[keep]
            if len(hit):
                a, b = a[hit], b[hit]
                columns = [pa.array(x.mmsi[a]), pa.array(y.mmsi[b]), names.take(pa.array(coder.x[a])), names.take(pa.array(coder.y[b])), pa.array(counts[2][hit]), pa.array(months[hit]), pa.array(truth[hit])]
                yield pa.RecordBatch.from_arrays(columns, names=["mmsi_a", "mmsi_b", *KIND, "is_truth"])

    return fold


class Counted:
    """Edges of periods, summed as by `pairs.accumulate`, that are counted by kind (classes, n_both_moving, n_months, is_truth). classes: vessels bring a class; it is null otherwise."""

    def __init__(self, dealt: Dealt, least: int = 1, least_each: int = 1):
        self.dealt, self.least, self.classes = dealt, {"least": least, "least_each": least_each, "periods": True}, "class" in dealt.extra
        kinds = "class_a string, class_b string, n_both_moving long, n_months long, is_truth boolean"
        self.kinds = cut(dealt.pairs(**self.least, fold=(tallied(self.classes), f"{kinds}, n long")).groupBy(*KIND, "is_truth").agg(F.sum("n").alias("n")))
        self.schema = f"mmsi_a long, mmsi_b long, {kinds}"

    def edges(self, scored: DataFrame, scores: tuple[str, ...]) -> DataFrame:
        """All edges, with the scores of their kinds: for kinds that are too many to be sent."""
        vessels = F.col("class_a") if self.classes else F.lit(None).cast("string")
        other = F.col("class_b") if self.classes else F.lit(None).cast("string")
        edges = self.dealt.pairs(**self.least).withColumns({"class_a": vessels, "class_b": other, "is_truth": F.col("incident_num").isNotNull()}).alias("e")
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in KIND]
        return edges.join(scored.dropDuplicates(list(KIND)).select(*KIND, *scores).alias("w"), same).select("e.mmsi_a", "e.mmsi_b", "e.is_truth", *[f"w.{s}" for s in scores])

    def first(self, scored: DataFrame, scores: tuple[str, ...], most: int) -> DataFrame | None:
        """The edges that can be among the first `most` by a score (ties by ids), with the scores that scored, kinds with n, has; None where those kinds are too many to be sent.

        Of each score, the value that the most-th edge has is known from the kinds. Edges above it are all made; of those of that value, each task makes its first ones only."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).cast("double").alias("s")) for k, s in enumerate(scores)])).alias("x")
        levels = scored.select(each, "n").select("x.*", "n").groupBy("k", "s").agg(F.sum("n").alias("n"))
        parts = [levels.where(F.col("k") == k).orderBy(F.desc("s")).limit(most).collect() for k in range(len(scores))]  # a level has an edge at least
        above, equal = F.lit(False), F.lit(0).cast("long")
        for k, (s, rows) in enumerate(zip(scores, parts)):
            total = 0
            for r in rows:
                total, least = total + r.n, r.s
                if total >= most:
                    break
            if rows:
                above, equal = above | (F.col(s) > F.lit(least)), equal + F.when(F.col(s) == F.lit(least), F.lit(1 << k)).otherwise(F.lit(0))
        wanted = scored.select(*KIND, *scores, above.alias("above"), equal.alias("equal")).where("above or equal > 0").dropDuplicates(list(KIND))
        wanted = cut(wanted)
        kinds = [tuple(r) for r in wanted.select(*KIND, "above", "equal").limit(FEW + 1).collect()]
        if len(kinds) > FEW:
            return None
        edges = self.dealt.pairs(**self.least, fold=(chosen(kinds, self.classes, most), self.schema)).alias("e")
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in KIND]
        return edges.join(F.broadcast(wanted.select(*KIND, *scores).alias("w")), same).select("e.*", *[f"w.{s}" for s in scores])  # FEW rows at most


def by_kind(kinds: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """kinds with score, of arrays of n_both_moving and n_months."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("score", pa.array(np.asarray(score(b["n_both_moving"].to_numpy(), b["n_months"].to_numpy()), np.float64)))

    return kinds.mapInArrow(run, ", ".join(f"{c} {'long' if t == 'bigint' else t}" for c, t in [*kinds.dtypes, ("score", "double")]))


def pairs_alone(x: Side, y: Side, pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The number of a task's pairs."""
    n = sum(len(p[0]) for p in pieces)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def placed(levels: dict[tuple[int, int], int], only: dict[int, set[int]] | None) -> Callable:
    """(level, mmsi_a, n, t): of edges whose (n_both_moving, n_months) has a level, how many there are of each level and vessel, and how many are true. With only, the vessels of each level that count, edges are rows, with mmsi_b."""

    def fold(x: Side, y: Side, pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        known = sorted(levels)
        shift = max(k[1] for k in known).bit_length()
        code, level = np.array([m << shift | k for m, k in known], np.int64), np.array([levels[k] for k in known], np.int64)
        wanted = None if only is None else {k: np.flatnonzero(np.isin(x.mmsi, np.array(sorted(v), np.int64))) for k, v in only.items()}
        for a, b, counts, months, truth in pieces:
            own = np.where(months < 1 << shift, counts[2] << shift | months, -1)
            place = np.minimum(np.searchsorted(code, own), len(code) - 1)
            hit = np.flatnonzero(code[place] == own)
            at, a, b, truth = level[place[hit]], a[hit], b[hit], truth[hit]
            if wanted is not None:
                keep = np.zeros(len(at), bool)
                for k, who in wanted.items():
                    keep |= (at == k) & np.isin(a, who)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(x.mmsi[a[keep]]), pa.array(y.mmsi[b[keep]]), pa.array(truth[keep].astype(np.int64))], names=["level", "mmsi_a", "mmsi_b", "t"])
            elif len(at):
                found, back = np.unique(at * len(x.mmsi) + a, return_inverse=True)
                n, t = np.bincount(back), np.bincount(back, truth).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found // len(x.mmsi)), pa.array(x.mmsi[found % len(x.mmsi)]), pa.array(n), pa.array(t)], names=["level", "mmsi_a", "n", "t"])

    return fold


def true_places(edges: Counted, score: Callable[[np.ndarray, np.ndarray], np.ndarray], wanted: list[int]) -> dict[int, int]:
    """For each of wanted, the rank (from 1, by score downwards and ids) of the true edge that has so many true ones before it.

    The value that such an edge has is known from the kinds; edges of these values are counted by their first vessel, and of the vessels that are met there, by their second one."""
    kinds = by_kind(edges.kinds.groupBy("n_both_moving", "n_months").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_truth"), F.col("n")).otherwise(0)).alias("t")), score)
    kinds = cut(kinds)

    def found(df: DataFrame, order: list, keys: list[str], within: dict[int, tuple[int, int, int]]) -> dict[int, tuple]:
        """Of each number w, the row of df (keys, n, t) that holds the true edge of w, with the edges and true edges that lie before it. within: (level, edges, true edges) before level's first row."""
        sums = sums_before(df, order, {"before": F.col("n"), "t_before": F.col("t")})
        if "level" in df.columns:
            least = sums.groupBy("level").agg(F.min("before").alias("_b"), F.min("t_before").alias("_t"))
            sums = sums.join(F.broadcast(least), "level").withColumns({"before": F.col("before") - F.col("_b"), "t_before": F.col("t_before") - F.col("_t")})  # a row a level, few
        sums, out = cut(sums), {}
        for w, (level, n, t) in within.items():
            here = (F.col("t_before") <= w - t) & (F.col("t_before") + F.col("t") > w - t)
            row = sums.where(here if level is None else here & (F.col("level") == level)).first()
            out[w] = (*[row[k] for k in keys], n + row.before, t + row.t_before)
        return out

    by_value = found(kinds.groupBy("score").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), [F.desc("score")], ["score"], {w: (None, 0, 0) for w in wanted})
    scores = sorted({v[0] for v in by_value.values()})
    levels = {(r.n_both_moving, r.n_months): scores.index(r.score) for r in kinds.where(F.col("score").isin(scores)).collect()}  # kinds of four values at most
    rows = edges.dealt.pairs(**edges.least, fold=(placed(levels, None), "level long, mmsi_a long, n long, t long")).groupBy("level", "mmsi_a").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    by_vessel = found(rows, ["level", "mmsi_a"], ["level", "mmsi_a"], {w: (scores.index(v[0]), *v[1:]) for w, v in by_value.items()})
    only: dict[int, set[int]] = {}
    for level, a, *_ in by_vessel.values():
        only.setdefault(level, set()).add(a)
    rows = edges.dealt.pairs(**edges.least, fold=(placed(levels, only), "level long, mmsi_a long, mmsi_b long, t long"), only={a for v in only.values() for a in v})
    rows, out = cut(rows.withColumn("n", F.lit(1).cast("long"))), {}
    for w, (level, a, n, t) in by_vessel.items():
        last = found(rows.where((F.col("level") == level) & (F.col("mmsi_a") == a)).drop("level"), ["mmsi_b"], ["mmsi_b"], {w: (None, n, t)})
        out[w] = last[w][1] + 1
    return out
