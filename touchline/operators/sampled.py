"""Fields sampled along edges: all points of an edge at once, folded where they are made.

An edge travels as one row with the arrays of its defenders. A task evaluates the edges of an Arrow batch as
matrices (defenders x points), at every spacing in one pass, and gives back a few numbers per edge or
the runs and brackets found; no point is ever a row and nothing is shuffled. Slices of about ``CELLS``
values stay in a core's cache and bound the memory, whatever the length of the edges. The points are the
long, contiguous axis, as a loop over a few defenders costs more than its arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.functions.geometry import FIELD_ANGLE_DEGREES, FIELD_SIGMA
from touchline.functions.scalars import LENGTH_GUARD, TIE
from touchline.operators.options import EDGE_KEYS, candidate_rows

CELLS = 32_768


class Edges(NamedTuple):
    """Edges with equally many defenders: ends as vectors, defenders as matrices (defenders x edges)."""

    cx: np.ndarray
    cy: np.ndarray
    rx: np.ndarray
    ry: np.ndarray
    px: np.ndarray
    py: np.ndarray

    @property
    def length(self) -> np.ndarray:
        vx, vy = self.rx - self.cx, self.ry - self.cy
        return np.sqrt(vx * vx + vy * vy)

    @property
    def defenders(self) -> int:
        return self.px.shape[0]

    def some(self, which: np.ndarray) -> "Edges":
        return Edges(*(column.take(which, -1) for column in self))

    def at(self, edge: np.ndarray, t: np.ndarray, field: "Field") -> np.ndarray:
        """Strengths (defenders x points) at fractions ``t`` of the edges ``edge``."""
        qx = self.cx.take(edge) + t * (self.rx - self.cx).take(edge)
        qy = self.cy.take(edge) + t * (self.ry - self.cy).take(edge)
        if isinstance(field, Shadow):
            # What depends on the edge alone is made once for an edge, not for each of its points.
            ux, uy = field.directions(self.cx, self.cy, self.px, self.py)
            return field.behind(self.px.take(edge, 1), self.py.take(edge, 1), ux.take(edge, 1), uy.take(edge, 1), qx, qy)
        own = self.some(edge)
        return field(own.cx, own.cy, own.px, own.py, qx, qy)


Field = Callable[..., np.ndarray]


def isotropic(ox, oy, dx, dy, qx, qy) -> np.ndarray:
    reach = np.sqrt((qx - dx) ** 2 + (qy - dy) ** 2) / FIELD_SIGMA
    return np.exp(-0.5 * reach * reach)


class Shadow:
    """The field behind a defender as seen from an origin."""

    def __init__(self, tangent: float):
        self.tangent = tangent

    def directions(self, ox, oy, dx, dy) -> tuple[np.ndarray, np.ndarray]:
        radius = np.sqrt((dx - ox) ** 2 + (dy - oy) ** 2)
        return (dx - ox) / radius, (dy - oy) / radius

    def behind(self, dx, dy, ux, uy, qx, qy) -> np.ndarray:
        ex, ey = qx - dx, qy - dy
        behind = ex * ux + ey * uy
        lateral = np.abs(ex * uy - ey * ux) / (FIELD_SIGMA + np.maximum(behind, 0.0) * self.tangent if self.tangent else FIELD_SIGMA)
        onset = np.minimum(np.maximum(behind, 0.0), 1.0)
        return onset * onset * (3.0 - 2.0 * onset) * np.exp(-0.5 * lateral * lateral)

    def along(self, ax, ay, vx, vy, t) -> tuple[np.ndarray, np.ndarray]:
        """The edges that reach behind their defender, and the strengths at the fractions ``t`` of each of them.

        ``a`` leads from the origin to the defender, ``v`` along the edge, so distances behind and beside it are linear in ``t``.
        """
        radius = np.sqrt(ax * ax + ay * ay)
        slope = (vx * ax + vy * ay) / radius
        reached = np.nonzero(slope > radius)[0]
        radius, slope = radius[reached], slope[reached]
        cross = (vx[reached] * ay[reached] - vy[reached] * ax[reached]) / radius
        onset = np.multiply.outer(slope, t)
        onset -= radius[:, None]
        np.maximum(onset, 0.0, out=onset)
        if self.tangent:
            values = np.multiply.outer(cross, t)
            values /= onset * self.tangent + FIELD_SIGMA
            values *= values
            values *= -0.5
        else:
            values = np.multiply.outer(-0.5 * np.square(cross / FIELD_SIGMA), t * t)
        np.exp(values, out=values)
        np.minimum(onset, 1.0, out=onset)
        values *= onset
        values *= onset
        onset *= -2.0
        onset += 3.0
        values *= onset
        return reached, values

    def __call__(self, ox, oy, dx, dy, qx, qy) -> np.ndarray:
        return self.behind(dx, dy, *self.directions(ox, oy, dx, dy), qx, qy)


FIELDS: dict[str, Field] = {
    "isotropic": isotropic,
    "constant_width": Shadow(0.0),
    "expanding": Shadow(math.tan(math.radians(FIELD_ANGLE_DEGREES))),
}


def with_combined(values: np.ndarray) -> np.ndarray:
    """The strengths of each point with their union and maximum as two further rows."""
    highest = values.max(0)
    with np.errstate(divide="ignore"):
        union = np.where(highest >= 1, 1.0, -np.expm1(np.log1p(-np.minimum(values, 1.0)).sum(0)))
    return np.vstack([values, union, highest])


def intervals(length: np.ndarray, spacing: float) -> np.ndarray:
    """An even number of intervals no longer than ``spacing``, two at least."""
    return np.maximum(2, 2 * np.ceil(length / (2 * spacing))).astype(np.int64)


class Grid(NamedTuple):
    """Points of several edges (or pieces) one after the other: their owner, step and number of steps."""

    owner: np.ndarray
    step: np.ndarray
    n: np.ndarray
    starts: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        inner = np.where(self.step % 2 == 1, 4.0, 2.0)
        return np.where((self.step == 0) | (self.step == self.n), 1.0, inner) / (3.0 * self.n)

    def averages(self, values: np.ndarray) -> np.ndarray:
        """Simpson's average of each row over each owner."""
        return np.add.reduceat(self.weights * values, self.starts, axis=1)


def grid(n: np.ndarray) -> Grid:
    points = n + 1
    starts = np.cumsum(points) - points
    owner = np.repeat(np.arange(len(n)), points)
    return Grid(owner, np.arange(points.sum()) - starts[owner], n[owner], starts)


def edge_rows(states: DataFrame) -> DataFrame:
    """One row per edge of the states whose geometry allows a direction, with its defenders as arrays."""
    from touchline.operators.fields import geometry_error

    rows = candidate_rows(states.where(geometry_error().isNull()), "defenders")
    axis = lambda a: F.transform("defenders", lambda d: d[a]).alias(f"p{a}")
    return rows.select(*EDGE_KEYS, "cx", "cy", "rx", "ry", axis("x"), axis("y"))


def _slices(batch: pa.RecordBatch, points_a_metre: float) -> Iterator[tuple[np.ndarray, Edges]]:
    """Row numbers and edges, by number of defenders, at most CELLS values at once by the density of points."""
    lists = {a: batch.column(f"p{a}") for a in "xy"}
    sizes = lists["x"].value_lengths().to_numpy(False)
    begins = np.cumsum(sizes) - sizes
    flat = {a: lists[a].flatten().to_numpy(False) for a in "xy"}
    ends = {name: batch.column(name).to_numpy(False) for name in ("cx", "cy", "rx", "ry")}
    for size in np.unique(sizes):
        rows = np.nonzero(sizes == size)[0]
        places = begins[rows] + np.arange(size)[:, None]
        edges = Edges(*(ends[name][rows] for name in ("cx", "cy", "rx", "ry")), flat["x"][places], flat["y"][places])
        cost = np.cumsum((edges.length * points_a_metre + 3) * size)
        # The cost rises from edge to edge, so a slice is a run of them.
        for which in np.split(np.arange(len(rows)), np.nonzero(np.diff(cost // CELLS))[0] + 1):
            yield rows[which], edges.some(which)


def per_edge(rows: DataFrame, output: str, compute: Callable[[Edges], tuple[np.ndarray, Sequence]], points_a_metre: float = 16.0) -> DataFrame:
    """EDGE_KEYS and ``output``: the rows that ``compute`` gives for the edges, each with the number of its edge."""
    keys = rows.select(*EDGE_KEYS).schema
    parts = [part.split() for part in output.split(", ")]
    names = [name for name, _ in parts]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}[k] for _, k in parts]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + output

    def run(batches):
        for batch in batches:
            for numbers, edges in _slices(batch, points_a_metre):
                found = compute(edges)
                for edge, columns in [found] if isinstance(found, tuple) else found:
                    again = pa.array(numbers[edge])
                    own = [batch.column(name).take(again) for name in EDGE_KEYS]
                    yield pa.RecordBatch.from_arrays([*own, *[c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]], [*EDGE_KEYS, *names])

    return rows.mapInArrow(run, schema)


def tie_positions(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position (1-based) of the tie block of every value down sorted columns; blocks are anchored at their first value."""
    first, last = np.ones(values.shape, dtype=np.int64), np.full(values.shape, len(values), dtype=np.int64)
    anchor = values[0]
    for at in range(1, len(values)):
        opens = values[at] - anchor > TIE
        anchor = np.where(opens, values[at], anchor)
        first[at] = np.where(opens, at + 1, first[at - 1])
    for at in range(len(values) - 2, -1, -1):
        last[at] = np.where(first[at + 1] == at + 2, at + 1, last[at + 1])
    return first, last


def owner_study(rows: DataFrame, field: str | Field, tops: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Endpoint field per edge beside the defenders nearest to it: who owns its maximum, and what share of it the nearest hold."""
    function = FIELDS[field] if isinstance(field, str) else field

    def compute(edges: Edges):
        count = len(edges.cx)
        vx, vy = edges.rx - edges.cx, edges.ry - edges.cy
        square = vx * vx + vy * vy
        with np.errstate(divide="ignore", invalid="ignore"):
            along = ((edges.px - edges.cx) * vx + (edges.py - edges.cy) * vy) / square
        t = np.where(square <= LENGTH_GUARD * LENGTH_GUARD, 0.0, np.clip(along, 0.0, 1.0))
        apart = lambda x, y: np.sqrt((edges.px - x) ** 2 + (edges.py - y) ** 2)
        distance = apart(edges.cx + t * vx, edges.cy + t * vy)
        values = function(edges.cx, edges.cy, edges.px, edges.py, edges.rx, edges.ry)
        union, maximum = with_combined(values)[-2:]
        owners = (maximum - values <= TIE) & (values > 0)
        order = np.argsort(distance, axis=0, kind="stable")
        first, last = tie_positions(np.take_along_axis(distance, order, 0))
        ranked, own = np.take_along_axis(values, order, 0), np.take_along_axis(owners, order, 0)
        near, total = first == 1, values.sum(0)
        shares = []
        for k in tops:
            inside = np.maximum(0, np.minimum(last, k) - first + 1) / (last - first + 1)
            shares.append(pa.array((ranked * inside).sum(0) / np.where(total > 0, total, 1.0), mask=~(total > 0)))
        held = owners.T
        offsets = np.append(0, np.cumsum(held.sum(1))).astype(np.int32)
        listed = pa.ListArray.from_arrays(offsets, np.nonzero(held)[1].astype(np.int32))
        columns = [
            union + 0.0, maximum, apart(edges.rx, edges.ry).min(0), owners.any(0).astype(float),
            (own & near).sum(0), (own | near).sum(0), listed, *shares,
        ]
        return np.arange(count), columns

    shares = "".join(f", segment_top{k}_strength_fraction double" for k in tops)
    output = f"union double, maximum double, rd double, field_owner_available double, both long, any long, owners array<int>{shares}"
    return per_edge(rows, output, compute, points_a_metre=0.0)


def summaries(rows: DataFrame, field: str | Field, spacings: Sequence[float], agreement: float) -> DataFrame:
    """Endpoint and segment field per edge; where the spacings disagree, the component and both its values."""
    function = FIELDS[field] if isinstance(field, str) else field

    def compute(edges: Edges):
        count, length = len(edges.cx), edges.length
        endpoint = with_combined(edges.at(np.arange(count), np.ones(count), function))
        proper = np.nonzero(length > LENGTH_GUARD)[0]
        averages, steps = [], []
        for spacing in spacings:
            n = intervals(length, spacing)
            average = endpoint.copy()  # an edge without length takes its endpoint's values
            if len(proper):
                points = grid(n[proper])
                average[:, proper] = points.averages(with_combined(edges.at(proper[points.owner], points.step / points.n, function)))
            averages.append(average)
            steps.append(np.where(length > LENGTH_GUARD, n, 0).astype(np.int32))
        apart = np.abs(averages[1] - averages[0])
        error = apart.max(0)
        # The first component that is as far apart as any: a defender's own field, the union, the maximum.
        worst = (apart >= error - TIE).argmax(0)
        ok, each = error <= agreement, np.arange(count)
        kind = np.where(worst < edges.defenders, "individual", np.where(worst == edges.defenders, "union", "maximum"))
        unless = lambda v: pa.array(v, mask=ok)
        columns = [
            endpoint[-2], endpoint[-1], averages[1][-2], averages[1][-1], *steps, error, ok,
            unless(kind), unless(averages[0][worst, each]), unless(averages[1][worst, each]),
        ]
        return each, columns

    output = (
        "receiver_union double, receiver_maximum double, segment_union double, segment_maximum double, coarse_intervals int, "
        "fine_intervals int, agreement_error double, agrees boolean, failed_component string, coarse_value double, fine_value double"
    )
    return per_edge(rows, output, compute)


def individual_averages(rows: DataFrame, field: str | Field, spacings: Sequence[float]) -> DataFrame:
    """(EDGE_KEYS, d, coarse, fine): the segment average of every defender of an edge with a length."""
    function = FIELDS[field] if isinstance(field, str) else field

    def compute(edges: Edges):
        proper = np.nonzero(edges.length > LENGTH_GUARD)[0]
        defenders = edges.defenders
        averages = []
        for spacing in spacings:
            points = grid(intervals(edges.length[proper], spacing))
            values = edges.at(proper[points.owner], points.step / points.n, function)
            averages.append(points.averages(values).T.ravel() if len(proper) else np.zeros(0))
        return np.repeat(proper, defenders), [np.tile(np.arange(defenders, dtype=np.int32), len(proper)), *averages]

    return per_edge(rows, "d int, coarse double, fine double", compute)


def _sums(edges: Edges, function: Field, t: np.ndarray, combined: bool) -> np.ndarray:
    """The sums of all components over the same fractions ``t`` of every edge (components x edges).

    The points of an edge are a row of a matrix, one defender at a time, so nothing is gathered point by point; a shadow
    is evaluated only on the edges that reach behind its defender, as it is zero on all others.
    """
    count, defenders = len(edges.cx), edges.defenders
    sums = np.zeros((defenders + 2 * combined, count))
    at_once = max(1, CELLS // (2 * len(t)))
    vx, vy = edges.rx - edges.cx, edges.ry - edges.cy
    for start in range(0, count, at_once):
        part = slice(start, start + at_once)
        union, highest = (np.zeros((len(vx[part]), len(t))) for _ in range(2)) if combined else (None, None)
        for d in range(defenders):
            ax, ay = edges.px[d, part] - edges.cx[part], edges.py[d, part] - edges.cy[part]
            if isinstance(function, Shadow):
                reached, values = function.along(ax, ay, vx[part], vy[part], t)
            elif function is isotropic:
                reached, values = slice(None), _isotropic_along(ax, ay, vx[part], vy[part], t)
            else:
                own = [c[part, None] for c in (edges.cx, edges.cy, edges.px[d], edges.py[d])]
                reached, values = slice(None), function(*own, own[0] + t * vx[part, None], own[1] + t * vy[part, None])
            sums[d, part][reached] = values.sum(1)
            if combined:
                highest[reached] = np.maximum(highest[reached], values)
                before = union[reached]
                values *= 1.0 - before
                union[reached] = before + values
        if combined:
            sums[-2, part], sums[-1, part] = union.sum(1), highest.sum(1)
    return sums


def _isotropic_along(ax, ay, vx, vy, t) -> np.ndarray:
    """``isotropic`` at fractions of edges, by the distance from the foot of the defender's perpendicular and its length."""
    length = np.sqrt(vx * vx + vy * vy)
    with np.errstate(divide="ignore", invalid="ignore"):
        foot, apart = (np.where(length > 0, part / length, other) for part, other in ((ax * vx + ay * vy, 0.0), (ax * vy - ay * vx, np.hypot(ax, ay))))
    scale = math.sqrt(0.5) / FIELD_SIGMA
    values = np.multiply.outer(length * scale, t)
    values -= (foot * scale)[:, None]
    values *= values
    values += np.square(apart * scale)[:, None]
    np.negative(values, out=values)
    return np.exp(values, out=values)


def _climb(edges: Edges, function: Field, counts: Sequence[int], limit: float, combined: bool):
    """Averages (components x edges), intervals, last change and whether an edge settled, climbing ``counts``."""
    count = len(edges.cx)
    everyone, own = np.arange(count), edges
    ends = _sums(edges, function, np.array([0.0, 1.0]), combined)
    first = counts[0]
    odd = _sums(edges, function, np.arange(1, first, 2) / first, combined)
    even = _sums(edges, function, np.arange(2, first, 2) / first, combined)
    average = (ends + 4 * odd + 2 * even) / (3 * first)
    used, change, still = np.full(count, first), np.full(count, np.nan), everyone
    settled = np.zeros(count, bool)
    for n in counts[1:]:
        even = even + odd
        odd = _sums(own, function, np.arange(1, n, 2) / n, combined)
        finer = (ends + 4 * odd + 2 * even) / (3 * n)
        change[still] = np.abs(finer - average[:, still]).max(0)
        average[:, still], used[still] = finer, n
        settled[still] = change[still] <= limit
        goes = np.nonzero(~settled[still])[0]
        if not len(goes):
            break
        still, own = still[goes], own.some(goes)
        ends, odd, even = ends[:, goes], odd[:, goes], even[:, goes]
    return average, used, change, settled


def ladder(rows: DataFrame, field: str | Field | Sequence[str], counts: Sequence[int], limit: float, combined: bool = True) -> DataFrame:
    """(EDGE_KEYS, component, average, intervals, change): intervals doubled until all components move by at most ``limit``.

    Components are the defenders by number and, with ``combined``, union and maximum. A level keeps the sums of the
    points before and evaluates only the new ones between them, and only for the edges that are still open. An edge open
    after the last level has null intervals. Several named fields share one pass; each row then has its ``field``.
    """
    several = not isinstance(field, str) and not callable(field)
    functions = {name: FIELDS[name] if isinstance(name, str) else name for name in (field if several else [field])}

    def compute(edges: Edges):
        count, defenders = len(edges.cx), edges.defenders
        width = defenders + 2 * combined
        each = np.repeat(np.arange(count), width)
        names = pa.array([*map(str, range(defenders)), *(["union", "maximum"] if combined else [])], pa.string())
        component = names.take(pa.array(np.tile(np.arange(width), count)))
        for name, function in functions.items():
            average, used, change, settled = _climb(edges, function, counts, limit, combined)
            columns = [component, average.T.ravel(), pa.array(used[each].astype(np.int32), mask=~settled[each]), change[each]]
            yield each, [*([pa.repeat(name, len(each))] if several else []), *columns]

    output = "component string, average double, intervals int, change double"
    return per_edge(rows, "field string, " * several + output, compute, 0.0)


def open_edges(rows: DataFrame, fields: Sequence[str], counts: Sequence[int], limit: float) -> DataFrame:
    """(field, intervals, open_edges): how many edges of each field are open after each level of their ladder.

    A task gives back one row per field and level for a slice of edges, no component of any edge.
    """

    def compute(edges: Edges):
        for name in fields:
            _, used, _, settled = _climb(edges, FIELDS[name], counts, limit, True)
            still = [(~settled | (used > n)).sum() for n in counts]
            yield np.zeros(len(counts), int), [pa.repeat(name, len(counts)), np.array(counts, np.int32), np.array(still, np.int64)]

    output = "field string, intervals int, open_edges long"
    found = per_edge(rows, output, compute, 0.0).select("field", "intervals", "open_edges")
    # Every level has a row, also where there is no edge at all.
    levels = rows.sparkSession.createDataFrame([(name, n, 0) for name in fields for n in counts], output)
    return found.unionByName(levels).groupBy("field", "intervals").agg(F.sum("open_edges").alias("open_edges"))


def split_averages(rows: DataFrame, field: str | Field, spacing: float) -> DataFrame:
    """(EDGE_KEYS, average, evaluations): the maximum's segment average, piece by piece between onset breakpoints.

    A piece gets the share of the edge's intervals at ``spacing`` that its width is of the edge, two at least.
    """
    function = FIELDS[field] if isinstance(field, str) else field

    def compute(edges: Edges):
        count = len(edges.cx)
        radius = np.sqrt((edges.px - edges.cx) ** 2 + (edges.py - edges.cy) ** 2)
        ux, uy = (edges.px - edges.cx) / radius, (edges.py - edges.cy) / radius
        slope = (edges.rx - edges.cx) * ux + (edges.ry - edges.cy) * uy
        with np.errstate(divide="ignore", invalid="ignore"):
            breaks = np.concatenate([radius / slope, (1.0 + radius) / slope])
        inside = np.tile(slope != 0, (2, 1)) & (breaks > 0) & (breaks < 1)
        marks = np.sort(np.vstack([np.zeros(count), np.where(inside, breaks, 1.0), np.ones(count)]).T, 1)
        edge, piece = np.nonzero(marks[:, 1:] - marks[:, :-1] > TIE)
        lower, upper = marks[edge, piece], marks[edge, piece + 1]
        nominal = intervals(edges.length, spacing)[edge]
        points = grid(np.maximum(2, 2 * np.ceil(nominal * (upper - lower) / 2)).astype(np.int64))
        t = lower[points.owner] + points.step / points.n * (upper - lower)[points.owner]
        peak = edges.at(edge[points.owner], t, function).max(0)
        averages = np.bincount(edge, (upper - lower) * points.averages(peak[None, :])[0], count)
        evaluations = np.bincount(edge[points.owner], minlength=count)
        return np.arange(count), [averages, evaluations]

    return per_edge(rows, "average double, evaluations long", compute, 32.0)


def _sampled(edges: Edges, function: Field, spacing: float) -> tuple[Grid, np.ndarray, np.ndarray]:
    """The grid of all edges with a length, their numbers, and the values."""
    proper = np.nonzero(edges.length > LENGTH_GUARD)[0]
    points = grid(intervals(edges.length[proper], spacing))
    return points, proper, edges.at(proper[points.owner], points.step / points.n, function)


def _owners(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The envelope at each point, and who owns it (within 1e-12 of a positive maximum)."""
    envelope = values.max(0)
    return envelope, (envelope - values <= TIE) & (envelope > 0)


def owner_runs(rows: DataFrame, field: str | Field, spacing: float) -> DataFrame:
    """(EDGE_KEYS, owners, first_step, last_step): runs of grid points with the same owners of the envelope."""
    function = FIELDS[field] if isinstance(field, str) else field

    def compute(edges: Edges):
        points, proper, values = _sampled(edges, function, spacing)
        if not len(proper):
            return proper, [np.array([], object), *[np.zeros(0, np.int32)] * 2]
        _, owns = _owners(values)
        begins = np.append(True, (owns[:, 1:] != owns[:, :-1]).any(0)) | (points.step == 0)
        first = np.nonzero(begins)[0]
        last = np.append(first[1:], len(begins)) - 1
        names = np.array([",".join(map(str, np.nonzero(o)[0])) for o in owns[:, first].T], object)
        return proper[points.owner[first]], [names, points.step[first].astype(np.int32), points.step[last].astype(np.int32)]

    return per_edge(rows, "owners string, first_step int, last_step int", compute)


def slope_changes(rows: DataFrame, field: str | Field, spacing: float) -> DataFrame:
    """(EDGE_KEYS, i, left_slope, right_slope, slope_change) of the envelope where its owners change inside an edge."""
    function = FIELDS[field] if isinstance(field, str) else field

    def compute(edges: Edges):
        points, proper, values = _sampled(edges, function, spacing)
        if not len(proper):
            return proper, [np.zeros(0, np.int32), *[np.zeros(0)] * 3]
        envelope, owns = _owners(values)
        changed = np.append(False, (owns[:, 1:] != owns[:, :-1]).any(0)) & (points.step > 0) & (points.step < points.n)
        here = np.nonzero(changed)[0]
        n = points.n[here]
        left, right = (envelope[here] - envelope[here - 1]) * n, (envelope[here + 1] - envelope[here]) * n
        return proper[points.owner[here]], [points.step[here].astype(np.int32), left, right, right - left]

    return per_edge(rows, "i int, left_slope double, right_slope double, slope_change double", compute)


def brackets(rows: DataFrame, field: str | Field, spacing: float) -> DataFrame:
    """(EDGE_KEYS, a, b, kind, lower, upper): steps between which two defenders swap order, and runs where they are equal.

    Signs are compared, not multiplied values, so tiny strengths do not underflow.
    """
    function = FIELDS[field] if isinstance(field, str) else field

    def compute(edges: Edges):
        points, proper, values = _sampled(edges, function, spacing)
        inside = points.step[1:] > 0
        found: list[tuple[np.ndarray, ...]] = []
        for a in range(len(values)):
            for b in range(a + 1, len(values)):
                sign = np.sign(values[a] - values[b]).astype(np.int8)
                crossed = np.nonzero((sign[1:] * sign[:-1] < 0) & inside)[0] + 1
                found.append((crossed - 1, crossed, a, b, "bracket"))
                zero = sign == 0
                before = np.append(False, zero[:-1])[: len(zero)] & (points.step > 0)
                after = np.append(zero[1:], False)[: len(zero)] & (points.step < points.n)
                found.append((np.nonzero(zero & ~before)[0], np.nonzero(zero & ~after)[0], a, b, "plateau"))
        lower, upper = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        spread = lambda k, kind: np.concatenate([np.full(len(f[0]), f[k]) for f in found] or [np.zeros(0)]).astype(kind)
        return proper[points.owner[lower]], [
            spread(2, np.int32), spread(3, np.int32), spread(4, object), points.step[lower].astype(np.int32), points.step[upper].astype(np.int32),
        ]

    return per_edge(rows, "a int, b int, kind string, lower int, upper int", compute)
