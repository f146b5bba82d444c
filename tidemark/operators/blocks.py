"""Pairs counted by blocks of vessels: what vessels were part of is sent to tasks, pairs never are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import cut, ranked, sums_before

BLOCKS = 32  # blocks of vessels, unless one would hold more than HELD rows
SMALL = 2_000  # rows that are worth a block
HELD = 2_000_000  # rows of a block, about
PLACES = 1 << 17  # pairs that are counted at once; a task's arrays of so many stay in its processor's cache
CHUNK = 1 << 22  # meetings that are listed at once
LIST = 1 << 16  # meetings that are sorted rather than counted in places, however few places there are
COUNTS = ("n_windows", "n_both_stopped", "n_both_moving")


def packed(df: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, int, list]:
    """df with _cell, one long for each value of by, the first of by being its highest digit; the number of cells a value of the first has; and the first's values where they are texts, else its least value.

    Columns are digits in a mixed radix, or where these are too wide for a long, all but the first are numbered together. Rows with a null among by belong to no cell and go.
    A text must be of a bounded set, such as periods of the calendar.
    """
    df = cut(df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by])))  # read three times
    names, first = None, F.col(by[0])
    if dict(df.dtypes)[by[0]] == "string":
        names = [r[0] for r in df.select(by[0]).distinct().orderBy(by[0]).collect()]
        first = (F.array_position(F.array(*[F.lit(p) for p in names]), F.col(by[0])) - 1) if names else F.lit(0)
    df = df.withColumn("_first", first.cast("long"))
    rest = list(by[1:])
    spans = df.agg(*[f(c) for c in ["_first", *rest] for f in (F.min, F.max)]).first()
    least = [spans[2 * k] or 0 for k in range(len(rest) + 1)]
    wide = [(spans[2 * k + 1] or 0) - least[k] + 1 for k in range(len(rest) + 1)]
    if reduce(lambda x, y: x * y, wide) >= 1 << 60:
        ids = cut(ranked(df.select(*rest).distinct(), rest, "_id"))
        df, rest, least, wide = df.join(ids, rest), ["_id"], [least[0], 1], [wide[0], ids.count()]
    cell = F.col("_first") - F.lit(least[0])
    for c, lo, n in zip(rest, least[1:], wide[1:]):
        cell = cell * F.lit(n) + (F.col(c) - F.lit(lo))
    return df.withColumn("_cell", cell.cast("long")), reduce(lambda x, y: x * y, wide[1:], 1), names if names is not None else [least[0]]


def gathered(df: DataFrame, name: str) -> DataFrame:
    """(mmsi, name): a vessel's cells, in each the flags stopped and moving as the lowest bits."""
    flags = F.col("stopped").cast("long") + 2 * F.col("moving").cast("long")
    return df.groupBy("mmsi").agg(F.collect_list(F.col("_cell") * 4 + flags).alias(name))


def block_pairs(
    cells: DataFrame, by: tuple[str, ...], least: int = 1, least_each: int | dict[str, int] = 1, periods: bool = False, apart: bool = False, vessels: DataFrame | None = None, incidents: DataFrame | None = None, blocks: int | None = None,
    listed: bool = False, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """mmsi_a < mmsi_b with n_windows, n_both_stopped, n_both_moving, over distinct (by, mmsi, stopped, moving): pairs that share `least` cells or more.

    Vessels are dealt to n blocks, ranges of their numbers of about equal numbers of rows, and the pairs of vessels to the n(n + 1) / 2 pairs of blocks, a group each. A vessel's row, its cells packed into an array, goes to
    n + 1 of them, and there its pairs are counted to the end, so nothing is shuffled or spilled for each pair. n is BLOCKS however many rows there are, up to BLOCKS * HELD; beyond that it grows so that a task holds two blocks of HELD rows.

    periods: by starts with a period; its pairs of fewer than least_each cells go, and n_months is the number of periods left; least_each may be given for each period, where these are texts. apart: a row for each period, under `period`.
    vessels: (mmsi, ...) columns that both vessels of a pair give it, as <column>_a and <column>_b. incidents: (incident_num, mmsi); a pair gets incident_num, the last that both are in, or null. With listed, rows
    are (incident_num, mmsi_a, mmsi_b, n_windows) instead, of all pairs of an incident, n_windows null for those below `least`.
    score: of n_both_moving and n_months; pairs get score and rank, from the largest score on, ties by numbers. Pairs are counted twice: first each vessel's pairs with each block by score, whose running sums, a row for
    each vessel, block and score, then go to the tasks that rank.
    """
    return Dealt(cells, by, vessels, incidents, blocks, listed, twice=score is not None).pairs(least, least_each, periods, apart, listed, score)


class Dealt:
    """Vessels dealt to blocks, whose pairs can be counted several times: see `block_pairs`. twice: the packed rows are kept, as they will be read more than once."""

    def __init__(self, cells: DataFrame, by: tuple[str, ...], vessels: DataFrame | None = None, incidents: DataFrame | None = None, blocks: int | None = None, listed: bool = False, twice: bool = True):
        rows, self.span, self.names = packed(cells.where(F.col("mmsi").isNotNull()), by)
        rows = cut(rows.select("_cell", F.col("mmsi").cast("long").alias("mmsi"), F.coalesce("stopped", F.lit(False)).alias("stopped"), F.coalesce("moving", F.lit(False)).alias("moving")))
        held, count = gathered(rows, "cells"), rows
        self.marked = incidents is not None
        if incidents is not None:
            marks = incidents.select("incident_num", F.col("mmsi").cast("long").alias("mmsi")).na.drop().distinct()
            held = held.join(marks.groupBy("mmsi").agg(F.sort_array(F.collect_list("incident_num")).alias("marks")), "mmsi", "full" if listed else "left")
            count = rows.select("mmsi").unionByName(marks.select("mmsi")) if listed else rows
        size = count.count()
        n = blocks or max(1, min(BLOCKS, -(-size // SMALL)), -(-size // HELD))
        borders = sorted(set(count.approxQuantile("mmsi", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
        borders, self.extra = [int(b) for b in borders], []
        if vessels is not None:
            self.extra = [c for c in vessels.columns if c != "mmsi"]
            held = held.join(vessels, "mmsi", "left")
        self.n = n = len(borders) + 1
        own = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b < F.col("mmsi"))) if borders else F.lit(0)
        held = held.withColumn("_block", own.cast("int"))
        low, high = (f(F.col("_block"), F.col("_other")) for f in (F.least, F.greatest))
        held = cut(held) if twice else held
        self.kinds = {c: t for c, t in held.dtypes}
        self.dealt = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_pair", (low * n + high).cast("int"))

    def pairs(
        self, least: int = 1, least_each: int | dict[str, int] = 1, periods: bool = False, apart: bool = False, listed: bool = False, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
        fold: tuple[Callable, str] | None = None, only: set[int] | None = None,
    ) -> DataFrame:
        """As `block_pairs`. fold: (function, schema); a task's rows are what the function makes of its two blocks and of its pieces (a, b, counts, n_months, is_truth), arrays in the order of a and b, places in the blocks.
        only: vessels; pairs whose first one isn't among them may be left out."""
        n, names, extra, dealt = self.n, self.names, self.extra, self.dealt
        text = names if names and isinstance(names[0], str) else None
        least_each = [least_each[p] for p in names] if isinstance(least_each, dict) else least_each
        out = ["mmsi_a long", "mmsi_b long", *[f"{c} long" for c in COUNTS]]
        if apart:
            out = [f"period {'string' if text else 'long'}", *out]
        elif periods:
            out += ["n_months long"]
        out += [f"{c}_{s} {self.kinds[c]}" for c in extra for s in "ab"] + (["incident_num long"] if self.marked else [])
        if listed:
            out = ["incident_num long", "mmsi_a long", "mmsi_b long", "n_windows long"]

        def met(rows: DataFrame, out: list[str], ranks: bool) -> DataFrame:
            run = _counter(n, self.span if periods or apart else None, least, least_each, apart, extra, names, self.marked, listed, [c.split()[0] for c in out], score, ranks, fold and fold[0], only)
            return rows.drop("_other").repartition(n * (n + 1) // 2, "_pair").groupBy("_pair").applyInArrow(run, ", ".join(out))

        if fold is not None:
            return met(dealt, [fold[1]], False)
        if score is None:
            return met(dealt, out, False)
        tallies = met(dealt, ["score double", "mmsi_a long", "other int", "n long"], False).groupBy("score", "mmsi_a", "other").agg(F.sum("n").alias("n"))
        before = sums_before(tallies, [F.desc("score"), "mmsi_a", "other"], {"before": F.col("n")})
        before = before.groupBy(F.col("mmsi_a").alias("mmsi"), F.col("other").alias("_other")).agg(F.collect_list(F.struct("score", "before")).alias("_before"))
        return met(dealt.join(before, ["mmsi", "_other"], "left"), [*out, "score double", "rank long"], True)


class Side:
    """A block's vessels by their numbers, each one's cells in a row."""

    def __init__(self, t: pa.Table, marked: bool):
        t = t.sort_by("mmsi")
        self.table, self.mmsi = t, t["mmsi"].to_numpy()
        self.who, self.cells, flags = self._flat(t["cells"])
        self.flags, self.cells = self.cells & 3, self.cells >> 2
        self.ends = np.searchsorted(self.who, np.arange(len(self.mmsi) + 1))
        if marked:
            self.mark_who, self.marks, _ = self._flat(t["marks"])
            self.mark_ends = np.searchsorted(self.mark_who, np.arange(len(self.mmsi) + 1))

    @staticmethod
    def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, None]:
        lists = column.combine_chunks()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), None


def _meet(cx: np.ndarray, wx: np.ndarray, fx: np.ndarray | None, cy: np.ndarray, wy: np.ndarray, fy: np.ndarray | None, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, 4 * place + flags) of rows of x and y in the same cell, CHUNK at once; y is in the order of its cells."""
    lo, hi = np.searchsorted(cy, cx, "left"), np.searchsorted(cy, cx, "right")
    some = np.flatnonzero(hi > lo)
    n = (hi - lo)[some]
    done = np.cumsum(n)
    start = 0
    while start < len(some):
        base = done[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(done, base + CHUNK, "right")))
        k, m = some[start:end], n[start:end]
        at = np.repeat(lo[k] - (done[start:end] - m - base), m) + np.arange(int(m.sum()))
        code = (np.repeat(wx[k] * width, m) + wy[at]) * 4
        yield np.repeat(k, m), code if fx is None else code + (np.repeat(fx[k], m) & fy[at])
        start = end


def _tally(codes: Iterator[np.ndarray], places: int) -> tuple[np.ndarray, np.ndarray]:
    """(places met, and of each how often, both stopped and both moving)."""
    sums = None
    kept, held = [], 0
    for code in codes:
        if held + len(code) <= places and sums is None:
            kept.append(code)
            held += len(code)
            continue
        sums = np.zeros(4 * places, np.int64) if sums is None else sums
        for c in [*kept, code]:
            sums += np.bincount(c, minlength=4 * places)
        kept = []
    if sums is not None:
        f = sums.reshape(-1, 4)
        at = np.flatnonzero(f.any(axis=1))
        f = f[at]
        return at, np.stack([f.sum(axis=1), f[:, 1] + f[:, 3], f[:, 2] + f[:, 3]])
    code = np.sort(np.concatenate(kept)) if kept else np.empty(0, np.int64)
    at = code >> 2
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    if not len(starts):
        return starts, np.zeros((3, 0), np.int64)
    ends = np.r_[starts[1:], len(at)]
    return at[starts], np.stack([ends - starts, np.add.reduceat(code & 1, starts), np.add.reduceat(code >> 1 & 1, starts)])


def _starts(key: np.ndarray) -> np.ndarray:
    """Where equal ones begin, in an order; and the length."""
    new = np.empty(len(key) + 1, bool)
    new[:1] = new[-1:] = True
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    return np.flatnonzero(new) if len(key) else np.zeros(1, np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, dtype=values.dtype, out=total[1:])
    return np.diff(total[starts]).astype(np.int64)


def _listed(
    lo: np.ndarray, hi: np.ndarray, place: np.ndarray, period: np.ndarray, mask: np.ndarray, yk: np.ndarray, low: int, span: int | None, least: int, least_each: int | list[int], apart: bool, above: int | None, width: int, stopped: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in order, periods if apart, counts, periods of each place) of meetings that are listed and sorted at once, by place, period and flags. Without stopped, those counts are 0."""
    n = hi - lo
    some = np.flatnonzero(n)
    m = n[some]
    done = np.cumsum(m)
    at = np.repeat(lo[some] - (done - m), m)
    at += np.arange(len(at))
    code = yk[at]
    code &= np.repeat(mask[some].astype(yk.dtype), m)
    code += np.repeat(((place[some] << low) + period[some]).astype(yk.dtype), m)
    if above is not None:
        p = (code >> low).astype(np.int64) + above
        code = code[p // width < p % width]
    code.sort()
    if span is not None and not apart and least_each == 1:
        starts = _starts(code >> low)
        where = code[starts[:-1]].astype(np.int64) >> low
        months = np.ones(len(code), np.int32)
        months[1:] = code[1:] >> 2 != code[:-1] >> 2
        sizes, when = np.diff(starts), None
        counts, months = np.stack([sizes, _sums(code & 1, starts) if stopped else np.zeros_like(sizes), _sums(code >> 1 & 1, starts)]), _sums(months, starts)
    else:
        starts = _starts(code >> 2)
        g = code[starts[:-1]].astype(np.int64) >> 2
        counts = np.stack([np.diff(starts), *[_sums(code >> k & 1, starts) for k in (0, 1)]])
        where, when = g >> (low - 2), g & ((1 << (low - 2)) - 1)
        if span is not None:
            keep = counts[0] >= (np.array(least_each)[when] if isinstance(least_each, list) else least_each)
            where, when, counts = where[keep], when[keep], counts[:, keep]
        if apart:
            return where, when, counts, np.ones(len(where), np.int64)
        starts = _starts(where)
        where, months, counts = where[starts[:-1]], np.diff(starts), np.stack([_sums(c, starts) for c in counts])
    if least > 1:
        keep = counts[0] >= least
        where, counts, months = where[keep], counts[:, keep], months[keep]
    return where, when, counts, months


def _counter(n: int, span: int | None, least: int, least_each: int | list[int], apart: bool, extra: list[str], names: list, marked: bool, listed: bool, out: list[str], score: Callable | None, ranks: bool, fold: Callable | None = None, only: set[int] | None = None):
    def made(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | tuple]:
        table = pa.Table.from_batches(list(batches))
        one, two = divmod(key[0].as_py(), n)
        block = table["_block"].to_numpy()
        x = Side(table.filter(pa.array(block == one)), marked)
        y = x if one == two else Side(table.filter(pa.array(block == two)), marked)
        del table
        if not len(x.mmsi) or not len(y.mmsi):
            return
        if fold is not None:
            yield x, y
        order = np.argsort(y.cells, kind="stable")
        cy, wy, fy = y.cells[order], y.who[order], y.flags[order]
        order = np.argsort(x.cells)
        lo, hi = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        lo[order], hi[order] = np.searchsorted(cy, x.cells[order], "left"), np.searchsorted(cy, x.cells[order], "right")
        reach = np.concatenate([[0], np.cumsum(hi - lo)])
        spans = len(names) if span is not None and isinstance(names[0], str) else int(cy[-1] // span) + 1 if span is not None and len(cy) else 1
        low = 2 + (spans - 1).bit_length()  # bits of a period and of the flags
        small = (PLACES + len(y.mmsi) << low) < 1 << 31
        yk = ((wy << low) | fy).astype(np.int32 if small else np.int64)
        xk = ((x.cells // span << 2) if span is not None else np.zeros(len(x.cells), np.int64), ~np.int64(3) | x.flags)
        if marked:
            order = np.argsort(y.marks, kind="stable")
            my, mw = y.marks[order], y.mark_who[order]
        if ranks:
            lists = x.table["_before"].combine_chunks()
            who, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten()
            before = dict(zip(zip(who.tolist(), flat.field("score").to_pylist()), flat.field("before").to_pylist()))
        width = len(y.mmsi)
        step = max(1, PLACES // width)

        def upper(code: np.ndarray, i: int) -> np.ndarray:
            return code if x is not y else code[(code >> 2) // width + i < (code >> 2) % width]

        def batch(at: np.ndarray, i: int, columns: dict) -> pa.RecordBatch:
            a, b = at // width + i, at % width
            columns = {"mmsi_a": x.mmsi[a], "mmsi_b": y.mmsi[b], **columns}
            for c in extra:
                columns[f"{c}_a"], columns[f"{c}_b"] = x.table[c].combine_chunks().take(pa.array(a)), y.table[c].combine_chunks().take(pa.array(b))
            return pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in out], names=out)

        def finished(i: int, j: int, at: np.ndarray, counts: np.ndarray, columns: dict) -> Iterator[pa.RecordBatch]:
            """The rows of pairs counted to the end, at their places."""
            if marked:
                s = slice(x.mark_ends[i], x.mark_ends[j])
                order = np.argsort(x.marks[s], kind="stable")
                cm, wm = x.marks[s][order], x.mark_who[s][order] - i
                if fold is not None:
                    true = np.zeros((j - i) * width, bool)
                    for _, code in _meet(cm, wm, None, my, mw, None, width):
                        true[code >> 2] = True  # places of a above b, where x is y, are no pairs
                    if len(at):
                        yield at // width + i, at % width, counts, columns.get("n_months", np.ones(len(at), np.int64)), true[at]
                    return
                newest = np.full(len(at), np.iinfo(np.int64).min)
                for k, code in _meet(cm, wm, None, my, mw, None, width):
                    if x is y:
                        right = (code >> 2) // width + i < (code >> 2) % width
                        k, code = k[right], code[right]
                    code = code >> 2
                    place = np.minimum(np.searchsorted(at, code), max(len(at) - 1, 0))
                    found = at[place] == code if len(at) else np.zeros(len(code), bool)
                    if listed:
                        windows = pa.array(counts[0][place] if len(at) else np.zeros(len(code), np.int64), mask=~found)
                        if len(code):
                            yield batch(code, i, {"incident_num": cm[k], "n_windows": windows})
                    else:
                        newest[place[found]] = np.maximum(newest[place[found]], cm[k[found]])  # incidents ascend, so of a place that comes twice the last one is the largest
                columns["incident_num"] = pa.array(newest, mask=newest == np.iinfo(np.int64).min)
            if fold is not None:
                if len(at):
                    yield at // width + i, at % width, counts, columns.get("n_months", np.ones(len(at), np.int64)), np.zeros(len(at), bool)
                return
            if score is not None and len(at):
                a, scores = at // width + i, np.asarray(score(counts[2], columns.get("n_months", np.ones(len(at), np.int64))), np.float64)
                order = np.lexsort((at, scores, a))
                a, values = a[order], scores[order]
                starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (values[1:] != values[:-1])])
                sizes = np.diff(np.r_[starts, len(a)])
                if not ranks:
                    yield pa.RecordBatch.from_arrays([pa.array(values[starts]), pa.array(x.mmsi[a[starts]]), pa.array(np.full(len(starts), two, np.int32)), pa.array(sizes)], names=out)
                    return
                first = np.array([before[k] for k in zip(a[starts].tolist(), values[starts].tolist())], np.int64)
                rank = np.empty(len(at), np.int64)
                rank[order] = np.repeat(first - starts + 1, sizes) + np.arange(len(at))
                columns |= {"score": scores, "rank": rank}
            if len(at) and not listed:
                yield batch(at, i, {**dict(zip(COUNTS, counts)), **columns})

        for i in range(0, len(x.mmsi), step):
            j = min(i + step, len(x.mmsi))
            if only is not None and only.isdisjoint(x.mmsi[i:j].tolist()):
                continue
            places = (j - i) * width
            s = slice(x.ends[i], x.ends[j])
            met = int(reach[s.stop] - reach[s.start])
            if met <= CHUNK and met <= max(2 * places, LIST):
                at, period, counts, months = _listed(lo[s], hi[s], (x.who[s] - i) * width, xk[0][s], xk[1][s], yk, low, span, least, least_each, apart, i * width if x is y else None, width, fold is None)
                if apart:
                    if len(at):
                        value = pa.array(names if isinstance(names[0], str) else [names[0] + k for k in range(spans)])
                        yield batch(at, i, {"period": value.take(pa.array(period)), **dict(zip(COUNTS, counts))})
                    continue
                columns = {} if span is None else {"n_months": months}
                yield from finished(i, j, at, counts, columns)
                continue
            order = np.argsort(x.cells[s], kind="stable")
            cx, wx, fx = x.cells[s][order], x.who[s][order] - i, x.flags[s][order]
            cuts = [0, len(cx)] if span is None else [0, *(np.flatnonzero(np.diff(cx // span)) + 1).tolist(), len(cx)]
            total = []
            for p, q in zip(cuts, cuts[1:]):
                if p == q:
                    continue
                part = _meet(cx[p:q], wx[p:q], fx[p:q], cy, wy, fy, width)
                at, counts = _tally((upper(code, i) for _, code in part), places)
                period = int(cx[p] // span) if span is not None else 0
                each = least_each[period] if isinstance(least_each, list) else least_each
                keep = counts[0] >= (each if span is not None else least)
                at, counts = at[keep], counts[:, keep]
                if apart and len(at):
                    value = names[period] if isinstance(names[0], str) else names[0] + period
                    yield batch(at, i, {"period": pa.array([value]).take(pa.array(np.zeros(len(at), np.int64))), **dict(zip(COUNTS, counts))})
                elif len(at):
                    total.append((at, counts))
            if apart:
                continue
            at = np.concatenate([t[0] for t in total]) if total else np.empty(0, np.int64)
            counts = np.concatenate([t[1] for t in total], axis=1) if total else np.zeros((3, 0), np.int64)
            columns = {}
            if span is not None:
                order = np.argsort(at, kind="stable")
                at, counts = at[order], counts[:, order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
                if len(starts):
                    at, counts, columns = at[starts], np.add.reduceat(counts, starts, axis=1), {"n_months": np.diff(np.r_[starts, len(at)])}
                    keep = counts[0] >= least
                    at, counts, columns = at[keep], counts[:, keep], {c: v[keep] for c, v in columns.items()}
            yield from finished(i, j, at, counts, columns)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = made(key, batches)
        if fold is None:
            yield from pieces
        elif (sides := next(pieces, None)) is not None:
            yield from fold(*sides, pieces)

    return run
