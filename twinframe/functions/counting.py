"""Counting of pairs of rows that agree, or lie within distances, over the rows that one task holds; all in numpy.

A distance on one axis needs running sums only. For two, a wavelet matrix keeps the ranks on the second axis bit by bit along
the first one, with running sums of the weights at each bit, so a box is summed up in as many steps as ranks have bits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The functions below travel to the executors with their code, so this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Array = np.ndarray
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _running(values: Array) -> Array:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))


class Points:
    """Weighted points in numbered groups, on one axis or two, ready for the weight in many boxes."""

    def __init__(self, group: Array, axes: list[Array], weight: Array) -> None:
        self.places = [np.unique(axis) for axis in axes]
        ranks = [np.searchsorted(places, axis) for places, axis in zip(self.places, axes, strict=True)]
        self.width = len(self.places[0]) + 1
        at = group * self.width + ranks[0]
        order = np.argsort(at, kind="stable")
        self.at, weight = at[order], weight[order]
        self.sums = _running(weight)
        self.levels = []
        if len(axes) == 2:
            rank = ranks[1][order]
            for bit in reversed(range(len(self.places[1]).bit_length())):
                one = (rank >> bit) & 1
                turned = np.concatenate((np.flatnonzero(one == 0), np.flatnonzero(one)))
                rank, weight = rank[turned], weight[turned]
                self.levels.append((bit, _running(1 - one), _running(weight)))

    def within(self, group: Array, boxes: list[tuple[Array, Array]]) -> Array:
        """The weight of the points of each group (-1: of none) in its box; bounds are included."""
        (low, high), *second = boxes
        first, last = (
            np.searchsorted(self.at, group * self.width + np.searchsorted(self.places[0], place, side))
            for place, side in ((low, "left"), (high, "right"))
        )
        if not second:
            return self.sums[last] - self.sums[first]
        low, high = second[0]
        return self._below(first, last, np.searchsorted(self.places[1], high, "right")) - self._below(
            first, last, np.searchsorted(self.places[1], low, "left")
        )

    def _below(self, first: Array, last: Array, rank: Array) -> Array:
        """The weight from ``first`` to before ``last`` of points ranked below ``rank`` on the second axis."""
        total = np.zeros(len(rank), np.int64)
        for bit, zeros, sums in self.levels:
            one = (rank >> bit) & 1 == 1
            from_, to = zeros[first], zeros[last]
            total += np.where(one, sums[to] - sums[from_], 0)
            first = np.where(one, zeros[-1] + first - from_, from_)
            last = np.where(one, zeros[-1] + last - to, to)
        return total


def product_sum(x: Array, y: Array) -> int:
    """The sum of products of two arrays of numbers that are not negative, without overflow."""
    if not len(x):
        return 0
    if int(x.max()) * int(y.max()) * len(x) < MOST:
        return int(np.dot(x, y))
    return int(np.dot(x.astype(object), y.astype(object)))


# Strips: rows dealt out along each axis


def strip_of(bounds: list[Array], point: list[Array]) -> Array:
    """How many of the sorted ``bounds`` are not above each point, both compared column by column."""
    low, high = np.zeros(len(point[0]), np.int64), np.full(len(point[0]), len(bounds[0]), np.int64)
    for _ in range(len(bounds[0]).bit_length()):
        open_ = low < high
        middle = np.minimum((low + high) >> 1, len(bounds[0]) - 1)
        reached = bounds[-1][middle] <= point[-1]
        for column, value in zip(bounds[-2::-1], point[-2::-1], strict=True):
            cut = column[middle]
            reached = (cut < value) | ((cut == value) & reached)
        low, high = np.where(open_ & reached, middle + 1, low), np.where(open_ & ~reached, middle, high)
    return low


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[Array]:
    return [batch.column(name).to_numpy(zero_copy_only=False) for name in names]


def dealt(batches: Iterator[pa.RecordBatch], bounds: list[list[Array]], reaches: list[int], whole: bool) -> Iterator[pa.RecordBatch]:
    """Points and boxes for the strips that answer for them: ``part, asks`` or ``w``, and per axis the start and the length.

    A box asks the strips of the first axis that hold its ends for the points in it, and for the strips between them the
    strips of the second axis that hold its ends there. ``whole`` gives what is left: strips between on every axis.
    """
    n = len(reaches)
    for batch in batches:
        h0, h1, w, asks, *axes = _columns(batch, ["h0", "h1", "w", "asks", *[f"p{i}" for i in range(n)]])
        least, most = np.full(len(h0), LEAST), np.full(len(h0), MOST)
        own, first, last, inner = [], [], [], []
        for i, (bound, reach) in enumerate(zip(bounds, reaches, strict=True)):
            others = [axes[j] for j in range(n) if j != i]
            own.append(strip_of(bound, [h0, axes[i], *others]))
            first.append(strip_of(bound, [h0, axes[i] - reach, *[least for _ in others]]))
            last.append(strip_of(bound, [h0, axes[i] + reach, *[most for _ in others]]))
            # Only a strip between two others of the same group can lie between the ends of a box.
            inner.append((np.searchsorted(bound[0], h0, "left") < own[i]) & (own[i] < np.searchsorted(bound[0], h0, "right")))
        given, asked, zero = w > 0, asks > 0, np.zeros(len(h0), np.int64)
        between = [last[i] - first[i] >= 2 for i in range(n)]
        span = [(first[i] + 1, last[i] - first[i] - 2) for i in range(n)]
        box = [(axes[i] - reach, np.full(len(h0), 2 * reach)) for i, reach in enumerate(reaches)]
        out = []

        def add(mask: Array, part: Array, places: list[tuple[Array, Array]], weights: tuple[Array, Array]) -> None:
            columns = [part, h0, h1, *weights, *[column for place in places for column in place]]
            out.append([np.broadcast_to(column, len(h0))[mask] for column in columns])  # noqa: B023

        if whole:
            group = -1 - (h0 & 0xFFFF)
            add(given & np.logical_and.reduce(inner), group, [(s, zero) for s in own], (w, zero))
            add(asked & np.logical_and.reduce(between), group, span, (zero, asks))
        else:
            point = [(axis, zero) for axis in axes]
            add(given, own[0], point, (w, zero))
            add(asked, first[0], box, (zero, asks))
            add(asked & (last[0] > first[0]), last[0], box, (zero, asks))
            if n == 2:
                ahead = len(bounds[0][0]) + 1
                add(given & inner[0], ahead + own[1], [(own[0], zero), point[1]], (w, zero))
                add(asked & between[0], ahead + first[1], [span[0], box[1]], (zero, asks))
                add(asked & between[0] & (last[1] > first[1]), ahead + last[1], [span[0], box[1]], (zero, asks))
        names = ["part", "h0", "h1", "w", "asks", *[f"{x}{i}" for i in range(n) for x in ("at", "long")]]
        joined = [np.concatenate(column) for column in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in joined], names=names)


class _Strip:
    """The points of one part, and which number each of its groups has."""

    def __init__(self, columns: list[Array]) -> None:
        h0, h1, w, *places = columns
        self.first, code = np.unique(h0, return_inverse=True)
        self.second = np.zeros(len(self.first), np.int64)
        self.second[code] = h1
        self.pairs = None
        if not np.array_equal(self.second[code], h1):
            # Two groups share the first half of their hash.
            self.pairs = {pair: i for i, pair in enumerate(dict.fromkeys(zip(h0.tolist(), h1.tolist(), strict=True)))}
            code = self.code(h0, h1)
        self.points = Points(code, places, w)

    def code(self, h0: Array, h1: Array) -> Array:
        if self.pairs is not None:
            return np.array([self.pairs.get(pair, -1) for pair in zip(h0.tolist(), h1.tolist(), strict=True)], np.int64)
        at = np.minimum(np.searchsorted(self.first, h0), len(self.first) - 1)
        return np.where((self.first[at] == h0) & (self.second[at] == h1), at, -1)


def answered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """``n``: the sum over the boxes of all parts of asks times the weight in them; of a part, points come before boxes."""
    part, points, strip, total = None, [], None, 0
    for batch in batches:
        parts, h0, h1, w, asks, *places = _columns(batch, ["part", "h0", "h1", "w", "asks", *[f"{x}{i}" for i in range(n) for x in ("at", "long")]])
        cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | ((asks[1:] > 0) != (asks[:-1] > 0))) + 1), len(parts)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            cut = slice(start, end)
            if parts[start] != part:
                part, points, strip = parts[start], [], None
            if asks[start] == 0:
                points.append([h0[cut], h1[cut], w[cut], *[at[cut] for at in places[::2]]])
            elif points or strip:
                strip = strip or _Strip([np.concatenate(column) for column in zip(*points, strict=True)])
                points = []
                boxes = [(at[cut], at[cut] + long[cut]) for at, long in zip(places[::2], places[1::2], strict=True)]
                total += product_sum(asks[cut], strip.points.within(strip.code(h0[cut], h1[cut]), boxes))
    yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["n"])


# Keys: rows that come sorted by key


def by_keys(batches: Iterator[pa.RecordBatch], questions: list[tuple[str | None, list[tuple[str, int]]]], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Per question, the pairs of a row of A and a row of B of one key that agree in a label and lie within reaches.

    Rows come sorted by key hash, ``h0, h1``; the rows of the last key of a batch wait for the next one.
    """
    totals, waiting = [0] * len(questions), None
    for batch in batches:
        rows = dict(zip(columns, _columns(batch, columns), strict=True))
        if waiting is not None:
            rows = {name: np.concatenate((waiting[name], rows[name])) for name in columns}
        if not len(rows["h0"]):
            continue
        last = (rows["h0"] == rows["h0"][-1]) & (rows["h1"] == rows["h1"][-1])
        whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        waiting = {name: column[whole:] for name, column in rows.items()}
        if whole:
            found = _of_keys({name: column[:whole] for name, column in rows.items()}, questions)
            totals = [x + y for x, y in zip(totals, found, strict=True)]
    if waiting is not None:
        totals = [x + y for x, y in zip(totals, _of_keys(waiting, questions), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([str(total)]) for total in totals], names=[f"n{i}" for i in range(len(totals))])


def _of_keys(rows: dict[str, Array], questions: list[tuple[str | None, list[tuple[str, int]]]]) -> list[int]:
    a = rows["a"]
    starts = np.concatenate(([0], np.flatnonzero((rows["h0"][1:] != rows["h0"][:-1]) | (rows["h1"][1:] != rows["h1"][:-1])) + 1))
    size, of_a = np.diff(starts, append=len(a)), np.add.reduceat(a, starts)
    # One row on each side is one pair, as most keys have it.
    i = starts[(size == 2) & (of_a == 1)]
    more = np.repeat((size > 2) & (of_a > 0) & (of_a < size), size)
    key, a = np.repeat(np.arange(len(starts)), size)[more], a[more]
    found = []
    for label, axes in questions:
        same = np.ones(len(i), bool) if label is None else rows[label][i] == rows[label][i + 1]
        for axis, reach in axes:
            same &= np.abs(rows[axis][i] - rows[axis][i + 1]) <= reach
        found.append(int(same.sum()))
        if not len(key):
            continue
        group = key
        if label is not None:
            labels = rows[label][more]
            order = np.lexsort((labels, key))
            new = (key[order][1:] != key[order][:-1]) | (labels[order][1:] != labels[order][:-1])
            group = np.empty(len(key), np.int64)
            group[order] = np.concatenate(([0], np.cumsum(new)))
        if axes:
            given, asked = a == 0, a == 1
            values = [rows[axis][more] for axis, _ in axes]
            points = Points(group[given], [value[given] for value in values], np.ones(int(given.sum()), np.int64))
            boxes = [(value[asked] - reach, value[asked] + reach) for value, (_, reach) in zip(values, axes, strict=True)]
            found[-1] += int(points.within(group[asked], boxes).sum())
        else:
            in_a, both = np.bincount(group[a == 1], minlength=group.max() + 1), np.bincount(group)
            found[-1] += int(np.dot(in_a, both - in_a))
    return found
