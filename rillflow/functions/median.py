"""Medians of the ordered values of a segment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose estimates are made in step.
SLICE_ROWS = 500


def p2_medians(rows: list[np.ndarray]) -> np.ndarray:
    """The five-marker P-square estimate of the median of each row of values in order, all rows in step.

    After Jain and Chlamtac (1985), with desired positions 1 + i * c / 4 at the c-th value. Up to five values
    the upper median is exact; no value gives 0.
    """
    sizes = np.array([len(r) for r in rows])
    out = np.zeros(len(rows))
    for k in np.flatnonzero((sizes > 0) & (sizes <= 5)):
        out[k] = np.sort(rows[k])[sizes[k] // 2]
    own = np.flatnonzero(sizes > 5)
    if not len(own):
        return out
    own = own[np.argsort(-sizes[own], kind="stable")]  # the rows that go on are a prefix
    length = sizes[own]
    x = np.zeros((len(own), length[0]))
    for i, k in enumerate(own):
        x[i, : length[i]] = rows[k]
    q = np.sort(x[:, :5], axis=1)
    n = np.tile(np.arange(1.0, 6.0), (len(own), 1))
    for c in range(6, length[0] + 1):
        m = int(np.searchsorted(-length, -c, "right"))
        v, h, pos = x[:m, c - 1], q[:m], n[:m]
        h[:, 0] = np.minimum(h[:, 0], v)
        h[:, 4] = np.maximum(h[:, 4], v)
        cell = (v >= h[:, 1]).astype(int) + (v >= h[:, 2]) + (v >= h[:, 3])
        pos += np.arange(5) > cell[:, None]
        for i in (1, 2, 3):
            d = 1 + i * c / 4 - pos[:, i]
            up, down = pos[:, i + 1] - pos[:, i], pos[:, i - 1] - pos[:, i]
            s = np.where((d >= 1) & (up > 1), 1.0, np.where((d <= -1) & (down < -1), -1.0, 0.0))
            at = np.flatnonzero(s)
            if not len(at):
                continue
            sa, a, b, e = s[at], h[at, i - 1], h[at, i], h[at, i + 1]
            pa, pb, pe = pos[at, i - 1], pos[at, i], pos[at, i + 1]
            curve = b + sa / (pe - pa) * ((pb - pa + sa) * (e - b) / (pe - pb) + (pe - pb - sa) * (b - a) / (pb - pa))
            near, near_pos = np.where(sa > 0, e, a), np.where(sa > 0, pe, pa)
            line = b + sa * (near - b) / (near_pos - pb)
            h[at, i] = np.where((a < curve) & (curve < e), curve, line)
            pos[at, i] += sa
    out[own] = q[:, 2]
    return out


class P2:
    """The estimate of p2_medians, value by value."""

    def __init__(self) -> None:
        self.first: list[float] = []
        self.heights: list[float] = []
        self.places: list[float] = []
        self.count = 0

    def add(self, values: Iterable[float]) -> None:
        q, n, c = self.heights, self.places, self.count
        for v in values:
            c += 1
            if c <= 5:
                self.first.append(v)
                if c == 5:
                    q, n = sorted(self.first), [1.0, 2.0, 3.0, 4.0, 5.0]
                continue
            if v < q[0]:
                q[0] = v
            elif v > q[4]:
                q[4] = v
            for k in range((v >= q[1]) + (v >= q[2]) + (v >= q[3]) + 1, 5):
                n[k] += 1.0
            for i in (1, 2, 3):
                at, below, above = n[i], n[i - 1], n[i + 1]
                away = 1 + i * c / 4 - at
                if away >= 1 and above - at > 1:
                    step = 1.0
                elif away <= -1 and below - at < -1:
                    step = -1.0
                else:
                    continue
                a, b, e = q[i - 1], q[i], q[i + 1]
                curve = b + step / (above - below) * ((at - below + step) * (e - b) / (above - at) + (above - at - step) * (b - a) / (at - below))
                near, near_at = (e, above) if step > 0 else (a, below)
                q[i] = curve if a < curve < e else b + step * (near - b) / (near_at - at)
                n[i] += step
        self.heights, self.places, self.count = q, n, c

    def median(self) -> float:
        if self.count <= 5:
            return sorted(self.first)[self.count // 2] if self.first else 0.0
        return self.heights[2]


def p2_of_sorted(keys: list[str], value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of values sorted by keys and in order to a row a key with its median estimate, for mapInArrow.

    Keys whose values lie within a batch are estimated in step; the state of one that goes on is five markers, so a key of any
    number of values needs no more memory than a batch. A key's rows must come to one task.
    """

    def row(firsts: pa.RecordBatch, medians: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[firsts.column(k) for k in keys], pa.array(medians, pa.float64())], [*keys, "Median"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, P2()  # a row with the key that can go on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                c = batch.column(k)
                new[1:] |= ~pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            values = batch.column(value).to_numpy(zero_copy_only=False)
            runs = np.split(values, starts)
            head = batch.slice(0, 1).select(keys)
            if open_ is not None and not open_.equals(head):
                yield row(open_, [state.median()])
                state = P2()
            state.add(runs[0].tolist())
            open_ = head
            if len(starts):
                firsts = batch.take(pa.array(starts)).select(keys)
                yield row(open_, [state.median()])
                if len(starts) > 1:
                    yield row(firsts.slice(0, len(starts) - 1), p2_medians(runs[1:-1]).tolist())
                open_, state = firsts.slice(len(starts) - 1), P2()
                state.add(runs[-1].tolist())
        if open_ is not None:
            yield row(open_, [state.median()])

    return run


@F.pandas_udf(T.DoubleType())
def p2_median(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series(p2_medians([np.asarray(v, float) if v is not None else np.zeros(0) for v in s]), index=s.index)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def p2_medians_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The estimates of several arrays of values a row; SLICE_ROWS rows at a time, however many a batch has."""
    for s in batches:
        told = []
        for k in range(0, len(s), SLICE_ROWS):
            own = s.iloc[k : k + SLICE_ROWS]
            medians = p2_medians([np.asarray(v, float) for r in own for v in r])
            told += np.split(medians, np.cumsum([len(r) for r in own])[:-1])
        yield pd.Series(told, index=s.index, dtype=object)


def small_median(values: Column) -> Column:
    """The upper median of an array: sorted[n div 2], 0 for none."""
    ordered = F.array_sort(values)
    return F.coalesce(F.get(ordered, F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def histogram_median(hist: Column, step: int) -> Column:
    """Interpolated median of an array of bin counts: in the first bin that reaches half, as in integer (n + 1) / 2."""
    n = F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, h: a + h)
    half = F.floor((n + 1) / 2)
    zero = F.struct(F.lit(0).cast("bigint").alias("acc"), F.lit(0).alias("bin"), F.lit(None).cast("double").alias("median"))

    def step_of(a: Column, h: Column) -> Column:
        hit = a["median"].isNull() & (h > 0) & (a["acc"] + h >= half)
        median = F.when(hit, a["bin"] * step + F.lit(float(step)) * (half - a["acc"]) / h).otherwise(a["median"])
        return F.struct((a["acc"] + h).alias("acc"), (a["bin"] + 1).alias("bin"), median.alias("median"))

    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(hist, zero, step_of, lambda a: a["median"]))
