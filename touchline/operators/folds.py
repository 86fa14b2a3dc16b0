"""Choice models fitted with one match left out, for all matches together.

A fold is a row of parameters: its own means and scales, its coefficients, and how well it converged. All
averages are nested (candidates, choices, matches), so the scaling of every fold follows from one row of moments
per match. For the fit, a choice is one row with its candidates' features as arrays and the weight that its match
gives it. A step evaluates all open folds for a choice at once, as a matrix of candidates x folds, and a partition returns a
handful of sums per fold; rows are never multiplied by folds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.operators.options import EDGE_KEYS, KEYS
from touchline.plans.sizing import counted_side
from touchline.session import cut_lineage

ALL = "all"
GRADIENT_LIMIT = 1e-6
# Steps stop well inside the limit, so that sums in another order stay below it.
STOP = GRADIENT_LIMIT * 1e-3
MAX_STEPS = 40


class Fold(NamedTuple):
    """Fitted parameters of the fold that leaves out the match of its name; ``all`` leaves out none."""

    fold: str
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    objective: float
    max_gradient: float
    steps: int


FOLD_SCHEMA = (
    "fold string, ord int, feature string, mean double, scale double, coef double, objective double, max_gradient double, steps int"
)


def fold_table(spark: SparkSession, folds: Sequence[Fold], features: Sequence[str]) -> DataFrame:
    """The folds as rows (fold, ord, feature, mean, scale, coef, objective, max_gradient, steps)."""
    rows = [
        (f.fold, i, name, float(f.mean[i]), float(f.scale[i]), float(f.coef[i]), f.objective, f.max_gradient, f.steps)
        for f in folds for i, name in enumerate(features)
    ]
    return spark.createDataFrame(rows, FOLD_SCHEMA)


def match_moments(edges: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Centre, matches, and per match the nested means of (x - centre) and of its square.

    Squares are taken around the overall nested mean, so the spread of a fold is no difference of large numbers.
    """
    def by_match(columns):
        per_choice = edges.groupBy(*KEYS).agg(*[F.avg(c).alias(n) for n, c in columns.items()])
        return per_choice.groupBy("match_id").agg(*[F.avg(n).alias(n) for n in columns]).orderBy("match_id").collect()

    first = by_match({f: F.col(f) for f in features})
    centre = np.mean([[row[f] for f in features] for row in first], axis=0)
    off = {f: F.col(f) - F.lit(float(c)) for f, c in zip(features, centre)}
    rows = by_match({f"m_{f}": v for f, v in off.items()} | {f"s_{f}": v * v for f, v in off.items()})
    take = lambda prefix: np.array([[row[f"{prefix}_{f}"] for f in features] for row in rows])
    return centre, [row["match_id"] for row in rows], take("m"), take("s")


def fold_scaling(moments, fold: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of every feature over the matches of a fold; a scale of zero becomes 1."""
    centre, matches, means, squares = moments
    inside = np.array([m != fold for m in matches])
    off = means[inside].mean(0)
    spread = np.sqrt(np.maximum(squares[inside].mean(0) - off * off, 0.0))
    spread[squares[inside].max(0) == 0] = 0.0
    return centre + off, np.where(spread == 0, 1.0, spread)


def choice_rows(edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per choice with a target: match, weight, the target's place, and an array per feature."""
    usable = edges.where(F.col("target_index").isNotNull())
    row = F.struct("ord", *features)
    # A state's candidates are a few rows.
    choices = usable.groupBy(*KEYS).agg(F.sort_array(F.collect_list(row)).alias("c"), F.first("target_index").alias("target"))
    sizes = choices.groupBy("match_id").agg((1.0 / F.count(F.lit(1))).alias("w"))
    place = F.array_position(F.col("c.ord"), F.col("target")) - 1
    return choices.join(counted_side(sizes), "match_id").where(place >= 0).select(
        "match_id", "w", place.alias("target"), *[F.col(f"c.{f}").alias(f) for f in features]
    )


class Choices(NamedTuple):
    """What the fits of nested models share: moments, packed choices, and the matches with a choice."""

    features: tuple[str, ...]
    moments: tuple
    packed: DataFrame
    represented: set


def prepared_choices(edges: DataFrame, features: Sequence[str]) -> Choices:
    """Read and packed once for all steps of all models whose features are the first of ``features``."""
    features = list(features)
    edges = cut_lineage(edges.select(*EDGE_KEYS, "target_index", *features))
    moments = match_moments(edges, features)
    packed = cut_lineage(choice_rows(edges, features).mapInArrow(_pack(features, moments[1]), "x binary, lengths binary, match binary, w binary"))
    own = edges.where("ord = target_index").select("match_id").distinct().collect()
    return Choices(tuple(features), moments, packed, {row["match_id"] for row in own})


def _pack(features: Sequence[str], matches: Sequence[str]):
    """A batch of choices as one row: features against the target's, candidates, match number and weight of each choice."""

    def run(batches):
        number = {m: i for i, m in enumerate(matches)}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(f) for f in features]
            lengths = lists[0].value_lengths().to_numpy(False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            x = np.column_stack([column.flatten().to_numpy(False) for column in lists])
            x = x - np.repeat(x[starts + batch.column("target").to_numpy(False)], lengths, 0)  # the target's score is then 0
            match = np.array([number[m] for m in batch.column("match_id").to_pylist()], dtype=np.int32)
            arrays = (x, lengths, match, batch.column("w").to_numpy(False))
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["x", "lengths", "match", "w"])

    return run


def _sums(width: int, p: int, names: Sequence[str], matches: Sequence[str], weights: np.ndarray):
    """Per fold: weighted sums of loss, gradient and second moments in raw units, over the choices of other matches.

    The first ``p`` of ``width`` packed features are the model's.
    """
    folds = len(names)
    left_out = [matches.index(n) if n in matches else -1 for n in names]

    def run(batches):
        total = np.zeros((folds, 1 + p + p * p))
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("x", "lengths", "match", "w"))):
                x = np.ascontiguousarray(np.frombuffer(row[0]).reshape(-1, width)[:, :p])
                lengths, match, own = np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int32), np.frombuffer(row[3])
                starts = np.cumsum(lengths) - lengths
                score = x @ weights.T
                top = np.maximum.reduceat(score, starts)
                e = np.exp(score - np.repeat(top, lengths, 0))
                z = np.add.reduceat(e, starts)
                share = e / np.repeat(z, lengths, 0)
                for k, out in enumerate(left_out):
                    w = np.where(match != out, own, 0.0)
                    weighed = share[:, k : k + 1] * x
                    mean = np.add.reduceat(weighed, starts)
                    second = (weighed * np.repeat(w, lengths)[:, None]).T @ x - (mean * w[:, None]).T @ mean
                    total[k] += np.concatenate([[w @ (top[:, k] + np.log(z[:, k]))], w @ mean, second.ravel()])
        slots = np.arange(total.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array((slots // total.shape[1]).astype(np.int32)), pa.array((slots % total.shape[1]).astype(np.int32)), pa.array(total.ravel())],
            ["fold", "slot", "v"],
        )

    return run


def fit_folds(
    edges: DataFrame | Choices,
    features: Sequence[str],
    folds: Sequence[str] | None = None,
    on_step: Callable[[int, str, float, float], None] | None = None,
) -> list[Fold]:
    """Newton fits of all folds together, each in its own scaling; without ``folds``, one per match.

    ``edges`` may be choices prepared for a larger model, whose first features are ``features``.
    The model of all matches is fitted first and every fold starts from it. Each step is one Spark job over the choices for the
    folds that are still open; solving and step halving are p x p work on the driver. ``on_step(step, fold,
    objective, max_gradient)`` sees every accepted step.
    """
    features, p = list(features), len(features)
    known = edges if isinstance(edges, Choices) else prepared_choices(edges, features)
    if list(known.features[:p]) != features:
        raise ValueError(f"choices were prepared for {known.features}, not for {features}")
    centre, matches, means, squares = known.moments
    moments = (centre[:p], matches, means[:, :p], squares[:, :p])
    represented = known.represented
    folds = list(matches) if folds is None else list(folds)

    def measured(names, scales, betas):
        weights = np.array([b / s for b, s in zip(betas, scales)])
        sums_of = _sums(len(known.features), p, names, matches, weights)
        parts = known.packed.mapInArrow(sums_of, "fold int, slot int, v double")
        found = np.zeros((len(names), 1 + p + p * p))
        for row in parts.groupBy("fold", "slot").agg(F.sum("v").alias("v")).collect():  # folds x p squared
            found[row["fold"], row["slot"]] = row["v"]
        out = []
        for k, (name, scale) in enumerate(zip(names, scales)):
            sums = found[k] / max(1, len(represented - {name}))
            out.append((sums[0], sums[1 : p + 1] / scale, sums[p + 1 :].reshape(p, p) / np.outer(scale, scale)))
        return out

    def newton(names, start):
        scaling = {n: fold_scaling(moments, n) for n in names}
        # Start values are in raw units, shared by all folds.
        trial = {n: start * scaling[n][1] for n in names}
        beta, accepted, length, direction, done = dict(trial), {}, dict.fromkeys(names, 1.0), {}, {}
        for step in range(1, MAX_STEPS + 1):
            still = [n for n in names if n not in done]
            if not still:
                break
            for n, (loss, gradient, hessian) in zip(still, measured(still, [scaling[n][1] for n in still], [trial[n] for n in still])):
                if n in accepted and loss > accepted[n][0] + 1e-12 * abs(accepted[n][0]):
                    length[n] /= 2
                    trial[n] = beta[n] + length[n] * direction[n]
                    continue
                beta[n], accepted[n] = trial[n], (loss, gradient)
                worst = float(np.abs(gradient).max())
                if on_step:
                    on_step(step, n, float(loss), worst)
                if worst <= STOP or step == MAX_STEPS:
                    done[n] = Fold(n, *scaling[n], beta[n], float(loss), worst, step)
                    continue
                direction[n], length[n] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0], 1.0
                trial[n] = beta[n] + direction[n]
        for n in names:
            if n not in done:
                loss, gradient = accepted[n]
                done[n] = Fold(n, *scaling[n], beta[n], float(loss), float(np.abs(gradient).max()), MAX_STEPS)
            if not np.isfinite(done[n].coef).all() or done[n].max_gradient > GRADIENT_LIMIT:
                raise RuntimeError(f"optimization gate failed for fold {n}: {done[n].max_gradient}")
        return done

    whole = newton([ALL], np.zeros(p))[ALL]
    others = [f for f in folds if f != ALL]
    fitted = {ALL: whole} | (newton(others, whole.coef / whole.scale) if others else {})
    return [fitted[f] for f in folds]


def scored_by_fold(edges: DataFrame, table: DataFrame, features: Sequence[str], model: str, on: str | None = "match_id") -> DataFrame:
    """Utilities under the fold that left the edge's match out, or (``on`` None) under the table's only fold."""
    parameters = table.groupBy("fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "mean", "scale", "coef"))), lambda r: F.struct(r["mean"], r["scale"], r["coef"])).alias("theta")
    )
    utility = F.lit(0.0)
    for i, f in enumerate(features):
        theta = F.col("theta")[i]
        utility = utility + (F.col(f) - theta["mean"]) / theta["scale"] * theta["coef"]
    side = counted_side(parameters)
    joined = edges.join(side, edges[on] == side["fold"]) if on else edges.join(side)
    return joined.select(*EDGE_KEYS, "id", "target_index", F.lit(model).alias("model"), utility.alias("utility"))
