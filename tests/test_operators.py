import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as sc
from touchline.operators import choice_model as cm
from touchline.operators import diagnostics as dg
from touchline.operators import evaluation as ev
from touchline.operators import fields as fd
from touchline.operators import options as op
from touchline.operators import relations as rel
from touchline.plans.asof import asof_before
from touchline.plans.ordered import (
    average_rank, linear_quantiles, match_macro_summary, previous_row, running_sum, unit_sum, value_bucket, weighted_summary,
)
from touchline.plans.ties import tie_blocks
from touchline.sources import files as fl
from touchline.sources.models import DEMO_MODELS, model_table, model_violations

STATE = "match_id string, event_id string, ordinal long, target_index int, carrier struct<x:double,y:double>, " \
    "candidates array<struct<id:string,x:double,y:double>>, defenders array<struct<x:double,y:double>>"


def state(spark, candidates, defenders, carrier=(0.0, 0.0), target=None):
    return spark.createDataFrame([("m", "e", 1, target, carrier, candidates, defenders)], STATE)


def test_clock_texts(spark):
    texts = ["00:00.200", "1:02:03.5", "45:00", "x", "1:2:3:4", "00:00.1234567", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(sc.clock_microseconds(F.col("t"))).collect()]
    assert got == [200_000, 3_723_500_000, 2_700_000_000, None, None, 123_456, None]


def test_identity_forms(spark):
    df = spark.createDataFrame([(v,) for v in [None, "", " ", " a", "a"]], "v string")
    got = [r[0] for r in df.select(sc.identity_form(F.col("v"))).collect()]
    assert got == ["null", "empty", "whitespace_only", "padded", "ordinary"]


@pytest.mark.parametrize("descending", [True, False])
def test_tie_blocks_are_anchored(spark, descending):
    step = -0.75e-12 if descending else 0.75e-12
    values = [1.0, 1.0 + step, 1.0 + 2 * step, 1.0 + 5 * step, 1.0 + 5 * step]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "g int, i int, v double")
    rows = tie_blocks(df, ["g"], "v", descending=descending, order=["i"]).orderBy("i").collect()
    assert [r["block"] for r in rows] == [0, 0, 1, 2, 2]
    assert [(r["first"], r["last"]) for r in rows] == [(1, 2), (1, 2), (3, 3), (4, 5), (4, 5)]
    assert [r["rank"] for r in rows] == [1.5, 1.5, 3.0, 4.5, 4.5]


def test_asof_is_strict_and_bounded(spark):
    frames = spark.createDataFrame([("m", 1, 900_000, 9), ("m", 1, 1_000_000, 10), ("m", 1, 1_100_000, 11)],
                                   "match_id string, period int, t_us long, frame long")
    events = spark.createDataFrame(
        [("m", 1, "a", 1_000_000), ("m", 1, "b", 1_000_001), ("m", 1, "c", 1_200_001), ("m", 1, "d", 900_000)],
        "match_id string, period int, event_id string, t_us long",
    )
    got = {r["event_id"]: r["frame"] for r in asof_before(events, frames, ["match_id", "period"], "event_id", "t_us", "frame", 100_000).collect()}
    assert got == {"a": 9, "b": 10, "c": None, "d": None}


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    frames = sorted(rng.sample(range(5_000), 300))
    events = [rng.randrange(5_000) for _ in range(400)]
    f = spark.createDataFrame([("m", 1, t, i) for i, t in enumerate(frames)], "match_id string, period int, t_us long, frame long")
    e = spark.createDataFrame([("m", 1, str(i), t) for i, t in enumerate(events)], "match_id string, period int, event_id string, t_us long")
    for bucket in (None, 37, 1_000):
        got = {r["event_id"]: r["frame"] for r in asof_before(e, f, ["match_id", "period"], "event_id", "t_us", "frame", 20, bucket).collect()}
        for i, t in enumerate(events):
            past = [j for j, u in enumerate(frames) if u < t and t - u <= 20]
            assert got[str(i)] == (past[-1] if past else None)


def test_ordered_plans_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i % 3, round(rng.gauss(0, 40), 1), float(rng.randint(1, 9)), i) for i in range(900)]
    rows += [(0, 0.0, 1.0, 900), (0, 0.0, 2.0, 901)]
    df = spark.createDataFrame(rows, "g int, v double, w double, id long")
    running = {r["id"]: r["run"] for r in running_sum(df, ["g"], ["v", "id"], value_bucket(F.col("v")), F.col("w"), "run").collect()}
    ranks = {r["id"]: r["rank"] for r in average_rank(df, ["g"], "v", "rank").collect()}
    summary = {r["g"]: r for r in weighted_summary(df, ["g"], "v", "w").collect()}
    linear = {r["g"]: r for r in linear_quantiles(df, ["g"], "v").collect()}
    import numpy as np

    for g in range(3):
        own = sorted((v, i, w) for h, v, w, i in rows if h == g)
        total, cum = sum(w for _, _, w in own), 0
        for v, i, w in own:
            cum += w
            assert running[i] == cum
            below, same = sum(x < v for x, _, _ in own), sum(x == v for x, _, _ in own)
            assert ranks[i] == below + (same + 1) / 2
        for q, name in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95")):
            acc = 0
            for v, _, w in own:
                acc += w
                if acc >= q * total:
                    break
            assert summary[g][name] == v
            assert linear[g][name] == pytest.approx(np.quantile([x for x, _, _ in own], q))
        assert summary[g]["mean"] == pytest.approx(sum(v * w for v, _, w in own) / total)


def test_previous_row_crosses_empty_buckets(spark):
    df = spark.createDataFrame([("m", t, i) for i, t in enumerate([1, 5, 6, 500, 501])], "k string, t long, i int")
    got = {r["i"]: r["p"] and r["p"]["i"] for r in previous_row(df, ["k"], "t", F.floor(F.col("t") / 10), ["i"], "p").collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 2, 4: 3}


def test_macro_weighs_matches_equally(spark):
    rows = [("x", "a", 1.0)] * 9 + [("x", "b", 5.0)] + [("x", "c", None)]
    df = spark.createDataFrame(rows, "metric string, match_id string, value double")
    got = {r["alias"]: r for r in match_macro_summary(df, ["metric"], "match_id", "value").collect()}
    assert set(got) == {"a", "b", "macro"}
    assert got["macro"]["mean"] == pytest.approx(3.0) and got["macro"]["represented_matches"] == 2
    assert got["macro"]["q50"] == 1.0 and got["macro"]["q75"] == 5.0


def test_option_shares_and_comparison(spark):
    df = state(spark, [("a", 10.0, 0.0), ("b", 15.0, 4.0), ("c", -4.0, 10.0)], [(5.0, 1.0), (13.0, 2.0)])
    scored = op.evaluate_options(df, (DEMO_MODELS["m0"], DEMO_MODELS["m1"]))
    rows = [r for r in scored.collect() if r["model"] == "m0"]
    utility = {r["id"]: -math.hypot(x, y) / 20 + 0.35 * x / 20 for r in rows for i, x, y in [("a", 10, 0), ("b", 15, 4), ("c", -4, 10)] if i == r["id"]}
    top = max(utility.values())
    total = sum(math.exp(u - top) for u in utility.values())
    for r in rows:
        assert r["share"] == pytest.approx(math.exp(utility[r["id"]] - top) / total)
    summary = [r for r in op.state_summaries(scored).collect() if r["model"] == "m0"][0]
    assert summary["top_options"] == [max(utility, key=utility.get)]
    change = op.compare_options(scored, "m0", "m1").first()
    assert change["strict_reversal"] is not None


def test_single_candidate_has_no_pairs(spark):
    scored = op.evaluate_options(state(spark, [("a", 10.0, 0.0)], [(5.0, 1.0)]), (DEMO_MODELS["m0"], DEMO_MODELS["m1"]))
    change = op.compare_options(scored, "m0", "m1").first()
    assert change["ordering_changed"] is None and change["normalized_entropy"] == 0.0


def test_tied_defenders_share_membership(spark):
    df = state(spark, [("a", 10.0, 0.0)], [(5.0, 1.0), (5.0, -1.0), (20.0, 20.0)])
    rows = rel.defender_relations(df).withColumn("t1", rel.membership("receiver", 1)).orderBy("d").collect()
    assert [r["receiver_rank"] for r in rows] == [1.5, 1.5, 3.0]
    assert [r["t1"] for r in rows] == [0.5, 0.5, 0.0]


def test_expected_credits(spark):
    rows = [("m", "e", 1, "m0", i, f"p{i}", 1, u) for i, u in enumerate([3.0, 2.0, 2.0, 1.0])]
    rows += [("m", "f", 2, "m0", i, f"p{i}", None, float(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "match_id string, event_id string, ordinal long, model string, ord int, id string, target_index int, utility double")
    got = {r["event_id"]: r for r in ev.expected_credits(op.score(df)).collect()}
    assert got["e"]["rr"] == pytest.approx((1 / 2 + 1 / 3) / 2) and got["e"]["hit3"] == 1.0 and got["e"]["tied"]
    assert got["f"]["rr"] == 0.0 and not got["f"]["tied"]


def test_field_values_and_union(spark):
    df = state(spark, [("a", 0.0, 0.0), ("b", 5.0, 0.0), ("c", 5.5, 0.0), ("d", 6.0, 0.0), ("e", 40.0, 0.0)], [(5.0, 0.0)])
    rows = fd.endpoint_strengths(fd.field_relations(df), "constant_width").orderBy("ord").collect()
    assert [r["value"] for r in rows] == pytest.approx([0.0, 0.0, 0.5, 1.0, 1.0])
    values = spark.createDataFrame([(0, v) for v in (0.2, 0.3, 0.8)] + [(1, v) for v in (1.0, 0.5)] + [(2, 0.0)], "k int, value double")
    got = {r["k"]: r["union"] for r in fd.combined(values, ["k"]).collect()}
    assert got[0] == pytest.approx(1 - 0.8 * 0.7 * 0.2) and got[1] == 1.0 and got[2] == 0.0


def test_defender_on_carrier_is_rejected(spark):
    df = state(spark, [("a", 3.0, 0.0)], [(0.0, 0.0)])
    assert df.select(fd.geometry_error()).first()[0] == "origin_defender_direction_undefined"
    assert fd.field_relations(df).count() == 0


def test_resolution_ladder_settles_all_components(spark):
    counts = (8, 16, 32, 64, 128, 256)
    lone = state(spark, [("a", 12.0, 1.0), ("b", 3.0, -4.0)], [(5.0, 1.0)])
    rows = fd.resolution_ladder(lone, "isotropic", counts).collect()
    assert {r["component"] for r in rows} == {"0", "union", "maximum"}
    assert len(rows) == 6 and all(r["intervals"] is not None and r["change"] <= 1e-7 for r in rows)
    # The maximum of two fields has a kink, so its edge stays open on a short ladder.
    pair = state(spark, [("a", 12.0, 1.0)], [(5.0, 1.0), (8.0, -2.0)])
    assert {r["intervals"] for r in fd.resolution_ladder(pair, "isotropic", counts).collect()} == {None}
    assert all(r["intervals"] for r in fd.resolution_ladder(pair, "isotropic", counts, with_combined=False).collect())


FIELD_COUNTS = (4, 8, 16, 32, 64, 128)


def plain_strength(kind, o, d, q):
    if kind == "isotropic":
        return math.exp(-((q[0] - d[0]) ** 2 + (q[1] - d[1]) ** 2) / 8)
    r = math.hypot(d[0] - o[0], d[1] - o[1])
    u = ((d[0] - o[0]) / r, (d[1] - o[1]) / r)
    ell, side = (q[0] - d[0]) * u[0] + (q[1] - d[1]) * u[1], abs((q[0] - d[0]) * u[1] - (q[1] - d[1]) * u[0])
    gate = min(1.0, max(0.0, ell))
    width = 2.0 + (max(ell, 0.0) * math.tan(math.radians(10)) if kind == "expanding" else 0.0)
    return gate * gate * (3 - 2 * gate) * math.exp(-0.5 * (side / width) ** 2)


def plain_components(kind, end, defenders, n):
    """Simpson averages of every component over n intervals of the edge from the origin."""
    totals = [0.0] * (len(defenders) + 2)
    for i in range(n + 1):
        weight = 1 if i in (0, n) else 4 if i % 2 else 2
        v = [plain_strength(kind, (0, 0), d, (end[0] * i / n, end[1] * i / n)) for d in defenders]
        v += [1 - math.prod(1 - x for x in v), max(v)]
        totals = [t + weight * x / (3 * n) for t, x in zip(totals, v)]
    return totals


@pytest.mark.parametrize("kind", ["isotropic", "constant_width", "expanding"])
def test_sampled_fields_against_single_points(spark, kind):
    from touchline.operators import sampled as sm

    defenders, ends = [(4.0, 1.0), (8.0, -2.0), (9.0, 2.5)], {0: (14.0, 1.0), 1: (3.0, -4.0), 2: (0.0, 0.0)}
    rows = sm.edge_rows(state(spark, [(str(k), *v) for k, v in ends.items()], defenders))
    found = {r["ord"]: r for r in sm.summaries(rows, kind, (0.25, 0.125), 1e-6).collect()}
    single = {(r["ord"], r["d"]): r for r in sm.individual_averages(rows, kind, (0.25, 0.125)).collect()}
    for k, end in ends.items():
        length = math.hypot(*end)
        at_end = plain_components(kind, end, defenders, 1)[:0] + [plain_strength(kind, (0, 0), d, end) for d in defenders]
        assert found[k]["receiver_maximum"] == pytest.approx(max(at_end), abs=1e-12)
        if not length:
            assert found[k]["fine_intervals"] == 0 and found[k]["agrees"] and found[k]["segment_maximum"] == found[k]["receiver_maximum"]
            continue
        coarse, fine = (plain_components(kind, end, defenders, max(2, 2 * math.ceil(length / (2 * s)))) for s in (0.25, 0.125))
        assert [single[k, d]["fine"] for d in range(3)] == pytest.approx(fine[:3], abs=1e-12)
        assert [found[k]["segment_union"], found[k]["segment_maximum"]] == pytest.approx(fine[3:], abs=1e-12)
        error = max(abs(a - b) for a, b in zip(coarse, fine))
        assert found[k]["agreement_error"] == pytest.approx(error, abs=1e-12)
        assert found[k]["agrees"] == (error <= 1e-6) == (found[k]["failed_component"] is None)
    rungs = {}
    for r in sm.ladder(rows, kind, FIELD_COUNTS, 1e-4).collect():
        rungs.setdefault(r["ord"], {})[r["component"]] = (r["average"], r["intervals"], r["change"])
    for k, end in ends.items():
        before = plain_components(kind, end, defenders, FIELD_COUNTS[0])
        for n in FIELD_COUNTS[1:]:
            now = plain_components(kind, end, defenders, n)
            change = max(abs(a - b) for a, b in zip(before, now))
            before = now
            if change <= 1e-4:
                break
        names = ["0", "1", "2", "union", "maximum"]
        assert [rungs[k][c][0] for c in names] == pytest.approx(before, abs=1e-12)
        assert {rungs[k][c][1] for c in names} == {n if change <= 1e-4 else None}
        assert rungs[k]["0"][2] == pytest.approx(change, abs=1e-12)


def test_ladder_tells_a_recorder_its_open_edges(spark):
    seen = []
    pair = state(spark, [("a", 12.0, 1.0), ("b", 0.0, 0.0)], [(5.0, 1.0), (8.0, -2.0)])
    fd.resolution_ladder(pair, "isotropic", (8, 16, 32), on_level=lambda n, left: seen.append((n, left)))
    assert seen == [(8, 2), (16, 1), (32, 1)]


def test_ladder_takes_all_fields_in_one_pass(spark):
    from touchline.operators import sampled as sm

    defenders, ends = [(4.0, 1.0), (8.0, -2.0), (-3.0, 0.5)], [("a", 14.0, 1.0), ("b", 3.0, -4.0), ("c", 0.0, 0.0), ("d", -9.0, 2.0)]
    rows = sm.edge_rows(state(spark, ends, defenders))
    together = {}
    for r in sm.ladder(rows, tuple(sm.FIELDS), FIELD_COUNTS, 1e-4).collect():
        together.setdefault(r["field"], {})[r["ord"], r["component"]] = (r["average"], r["intervals"])
    for kind, plain in sm.FIELDS.items():
        # A field given as a function is evaluated point by point, without the short cut of the named ones.
        slow = sm.ladder(rows, lambda *a, plain=plain: plain(*a), FIELD_COUNTS, 1e-4).collect()
        assert len(slow) == len(together[kind]) == 20
        for r in slow:
            average, intervals = together[kind][r["ord"], r["component"]]
            assert average == pytest.approx(r["average"], abs=1e-12) and intervals == r["intervals"]


def test_recorded_levels_are_counted_without_components(spark):
    from touchline.operators import sampled as sm

    rows = sm.edge_rows(state(spark, [("a", 12.0, 1.0), ("b", 0.0, 0.0)], [(5.0, 1.0), (8.0, -2.0)]))
    seen = {(r["field"], r["intervals"]): r["open_edges"] for r in sm.open_edges(rows, tuple(sm.FIELDS), (8, 16, 32), 1e-7).collect()}
    assert [seen["isotropic", n] for n in (8, 16, 32)] == [2, 1, 1] and len(seen) == 9
    none = sm.open_edges(rows.limit(0), ["isotropic"], (8, 16), 1e-7).collect()
    assert sorted((r["intervals"], r["open_edges"]) for r in none) == [(8, 0), (16, 0)]


def test_model_validation(spark):
    m0 = DEMO_MODELS["m0"]
    faults = [m0[:2], [m0[1]._replace(ord=0), *m0[1:]], [m0[0]._replace(scale=0.0), *m0[1:]], [*m0[:2], m0[2]._replace(coef=float("inf"))]]
    rules = [{r["rule"] for r in model_violations(model_table(spark, [fault])).collect()} for fault in faults]
    assert rules == [{"feature_count"}, {"feature_order"}, {"nonpositive_scale"}, {"nonfinite_parameter"}]
    assert model_violations(model_table(spark)).count() == 0


def test_rank_gate_sees_small_scales(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1e-8)) for _ in range(2000)]
    assert cm.identifiability(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])["rank"] == 2
    doubled = spark.createDataFrame([(a, 2 * a) for a, _ in rows], "a double, b double")
    assert cm.identifiability(doubled, ["a", "b"]) == {"rank": 1, "columns": 2, "rows": 2000}
    assert cm.identifiability(doubled.limit(0), ["a", "b"])["rank"] == 0


def test_event_files_are_read_by_their_own_headers(spark, tmp_path):
    names = list(fl.EVENT_FIELDS)
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(f"a{n}" for n in names) + "\n")
    turned = ["extra", *reversed(names)]
    (tmp_path / "b.csv").write_text("\ufeff" + ",".join(turned) + "\n" + ",".join(f"b{n}" for n in turned) + "\n" + f"short,{names[-1]}x\n")
    got = {r["event_id"]: r for r in fl.event_rows(spark, str(tmp_path)).collect()}
    for name in names:
        assert got["aevent_id"][name] == f"a{name}" and got["bevent_id"][name] == f"b{name}"
    assert got[None][names[-1]] == f"{names[-1]}x" and len(got) == 3
    (tmp_path / "c.csv").write_text(",".join(names[1:]) + "\n")
    with pytest.raises(ValueError, match="missing"):
        fl.event_rows(spark, str(tmp_path))


def test_newton_fits_reach_zero_gradient(spark):
    import numpy as np

    from touchline.operators import folds as fo

    rng = random.Random(1)
    rows, choices = [], []
    for k in range(240):
        xs = [(rng.gauss(3, 2), rng.gauss(0, 1)) for _ in range(2 + k % 3)]
        scores = [0.6 * a - 0.7 * b - math.log(-math.log(rng.random())) for a, b in xs]
        target = scores.index(max(scores)) if k % 11 else None
        rows += [(str(k % 7 % 3), str(k), k, i, target, a, b) for i, (a, b) in enumerate(xs)]
        choices.append((str(k % 7 % 3), np.array(xs), target))
    df = spark.createDataFrame(rows, "match_id string, event_id string, ordinal long, ord int, target_index int, f0 double, f1 double")
    seen = []
    fits = {f.fold: f for f in fo.fit_folds(df, ["f0", "f1"], [fo.ALL, "0", "1", "2"], on_step=lambda *step: seen.append(step))}
    assert {fold for _, fold, _, _ in seen} == set(fits) and all(f.max_gradient <= 1e-6 for f in fits.values())
    for name, fit in fits.items():
        kept = [c for c in choices if c[0] != name]
        matches = sorted({m for m, _, _ in kept})
        nested = lambda f: np.mean([np.mean([f(x) for m, x, _ in kept if m == match], axis=0) for match in matches], axis=0)
        mean = nested(lambda x: x.mean(0))
        scale = np.sqrt(nested(lambda x: ((x - mean) ** 2).mean(0)))
        assert fit.mean == pytest.approx(mean, abs=1e-12) and fit.scale == pytest.approx(scale, abs=1e-12)
        per_match = []
        for match in matches:
            own = []
            for m, x, target in kept:
                if m == match and target is not None:
                    z = (x - mean) / scale
                    e = np.exp(z @ fit.coef)
                    own.append(np.append(np.log(e.sum()) - z[target] @ fit.coef, (e / e.sum()) @ z - z[target]))
            per_match.append(np.mean(own, axis=0))
        loss, *gradient = np.mean(per_match, axis=0)
        assert np.abs(gradient).max() < 1e-6 and fit.objective == pytest.approx(loss, abs=1e-12)
    at = cm.conditional_objective(df, ["f0", "f1"], fits["all"].coef / fits["all"].scale).first()
    assert abs(at["g0"]) <= 1e-6 and at["loss"] == pytest.approx(fits["all"].objective)
    assert cm.identifiability(cm.within_choice_differences(df, ["f0", "f1"]), ["f0", "f1"])["rank"] == 2
    # A fold's parameters score the match that it left out.
    table = fo.fold_table(spark, [fits[m] for m in "012"], ["f0", "f1"])
    first = fo.scored_by_fold(df.withColumn("id", F.lit("x")), table, ["f0", "f1"], "m").where("ordinal = 5 AND ord = 1").first()
    fit = fits[str(5 % 7 % 3)]
    x = next(r for r in rows if r[2] == 5 and r[3] == 1)
    assert first["utility"] == pytest.approx(sum((x[5 + i] - fit.mean[i]) / fit.scale[i] * fit.coef[i] for i in range(2)))


def test_fitted_folds_have_no_gradient_in_sql(spark):
    """The gradient of every fold of every model, measured by DuckDB at the fitted coefficients."""
    import duckdb

    import __spark_entry__ as driver
    from touchline.catalog.base import EDGES, with_ctes

    sf = "/root/testdata/sf0.001"
    sql = {"distance": "dist", "longitudinal_displacement": "dx", "lateral_displacement": "dy", "nearest_receiver_defender_distance": "rd",
           "minimum_segment_defender_distance": "sd", "summed_segment_attenuation": "att"}
    folds = {}
    for r in driver.queries()["agg11_fold_parameters"](spark, sf).collect():
        folds.setdefault((r["model"], r["fold"]), {})[r["feature"]] = (r["mean"], r["scale"], r["coef"])
    assert {m for m, _ in folds} == {"m0", "m1", "m2"} and len(folds) == 27
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    con.execute("CREATE TABLE edges AS " + with_ctes(EDGES) + " SELECT * FROM edge WHERE target_index IS NOT NULL")
    for (model, fold), rows in folds.items():
        score = " + ".join(f"({sql[f]} - {m!r}) / {s!r} * {c!r}" for f, (m, s, c) in rows.items())
        gaps = ", ".join(f"sum(p * {sql[f]}) - sum(CASE WHEN j = target_index THEN {sql[f]} ELSE 0 END) AS g{i}" for i, f in enumerate(rows))
        means = ", ".join(f"avg(g{i}) AS g{i}" for i in range(len(rows)))
        gradient = con.execute(
            f"""WITH scored AS (SELECT *, {score} AS s FROM edges WHERE match_id <> '{fold}'),
            shares AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY k) AS p FROM scored),
            choice AS (SELECT match_id, {gaps} FROM shares GROUP BY match_id, k),
            per_match AS (SELECT {means} FROM choice GROUP BY match_id) SELECT {means} FROM per_match"""
        ).fetchall()[0]
        assert max(abs(g) / rows[f][1] for g, f in zip(gradient, rows)) < 1e-6, (model, fold)


def test_case_selection_matches_a_loop(spark):
    from touchline.operators.diagnostics import select_cases

    rng = random.Random(9)
    data = [(i, str(i % 4), f"{rng.random():.12f}", float(rng.randint(0, 4)), float(rng.randint(0, 4))) for i in range(60)]
    df = spark.createDataFrame(data, "ordinal long, match_id string, tie_key string, a double, b double")
    pools = [
        ("one", F.col("a") >= 2, 5, [(-F.col("a")).alias("_a"), F.col("tie_key").alias("_k")]),
        ("two", F.col("b") >= 2, 4, [F.col("tie_key").alias("_k")]),
    ]
    got = {(r["ordinal"], r["category"]) for r in select_cases(df, pools).collect()}
    used, per, want = set(), {}, set()
    for name, keep, quota, key in (
        ("one", lambda r: r[3] >= 2, 5, lambda r: (-r[3], r[2])), ("two", lambda r: r[4] >= 2, 4, lambda r: r[2])
    ):
        for r in sorted(filter(keep, data), key=key):
            if not quota:
                break
            if r[0] in used or per.get(r[1], 0) >= 2:
                continue
            used.add(r[0]); per[r[1]] = per.get(r[1], 0) + 1; want.add((r[0], name)); quota -= 1
    assert got == want


def test_outside_runs(spark):
    from touchline.operators.boundary import run_summary

    sides = [1, 1, 0, 1, -1, -1, 0, 0, 1]
    rows = [("m", 1, "p", i, s, i in (0, 8)) for i, s in enumerate(sides)]
    df = spark.createDataFrame(rows, "match_id string, period int, player_id string, pos long, side int, edge boolean")
    assert tuple(run_summary(df).first()) == (4, 2, 2)


def test_records_round_trip(spark, tmp_path):
    from touchline.sources import files, sinks

    df = state(spark, [("a", 10.0, 0.5)], [(5.0, 1.0)], target=0)
    sinks.write_canonical(df, str(tmp_path / "states"))
    back = files.choice_states(spark, str(tmp_path / "states")).first()
    assert back["carrier"].asDict() == {"x": 0.0, "y": 0.0} and back["candidates"][0]["id"] == "a"
    assert files.key_violations(spark, str(tmp_path / "states"), files.CHOICE_RECORD.names).count() == 0
    assert "target_index" not in files.geometry_states(spark, str(tmp_path / "states")).columns
    assert sinks.write_once(df, str(tmp_path / "once")) and not sinks.write_once(df, str(tmp_path / "once"))


def test_canonical_states_are_written_small_and_unshuffled(spark, tmp_path):
    from touchline.sources import files, sinks, testtables

    stored = testtables.stored_states(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    sinks.write_canonical(stored, str(tmp_path / "states"))
    parts = list((tmp_path / "states").glob("part-*"))
    plain = sinks.canonical_lines(stored).agg(F.sum(F.length("value") + 1)).first()[0]
    assert sum(part.stat().st_size for part in parts) < plain / 3
    assert files.geometry_states(spark, str(tmp_path / "states")).count() == stored.count()


def test_tie_positions_of_a_matrix_are_those_of_tie_blocks(spark):
    import numpy as np

    from touchline.operators import sampled
    from touchline.plans.ties import tie_blocks

    rng = random.Random(6)
    columns = [sorted(rng.choice((0.0, 1.0, 2.0)) + rng.randrange(6) * 4e-13 for _ in range(7)) for _ in range(40)]
    first, last = sampled.tie_positions(np.array(columns).T)
    rows = [(g, d, v) for g, column in enumerate(columns) for d, v in enumerate(column)]
    found = tie_blocks(spark.createDataFrame(rows, "g long, d long, v double"), ["g"], "v", order=["d"]).collect()
    assert {(r["g"], r["d"]): (r["first"], r["last"]) for r in found} == {(g, d): (first[d, g], last[d, g]) for g, d, _ in rows}


def test_quantiles_know_steps_of_any_size(spark):
    rows = [("a", 1.0, 0.5 - 5e-10), ("a", 2.0, 0.5 + 5e-10), ("b", 1.0, 0.5 - 5e-14), ("b", 2.0, 0.5), ("c", 1.0, 0.5), ("c", 2.0, 0.5)]
    rows += [("d", float(i), 1.0) for i in range(1000)] + [("e", 1.0, 0.0), ("e", 2.0, 0.0)]
    got = {r["g"]: r["q50"] for r in weighted_summary(spark.createDataFrame(rows, "g string, v double, w double"), ["g"], "v", "w").collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == (2.0, 2.0, 1.0, 499.0)


def test_nested_differences_are_exact(spark):
    from touchline.operators import quality as ql

    pairs = [
        ('{"a":0.0}', '{"a":-0.0}', [("$.a", "numeric_value", False)]),
        ('{"a":9007199254740993}', '{"a":9007199254740992}', [("$.a", "numeric_value", False)]),
        ('{"a":{}}', '{"a":[]}', [("$.a", "container_type", None)]),
        ("[1,2]", "[1,2,3]", [("$", "sequence_length", None)]),
        ('{"a":1,"b":2}', '{"b":2,"a":1}', []),
        ('{"a":1}', '{"a":1.0,"c":null}', [("$.a", "scalar_type", None), ("$.c", "mapping_keys", None)]),
        ('{"a":"x"}', '{"a":"y"}', [("$.a", "scalar_value", None)]),
        ("1", None, [("$", "record", None)]),
    ]
    left = spark.createDataFrame([(i, l) for i, (l, _, _) in enumerate(pairs)], "k long, doc string")
    right = spark.createDataFrame([(i, r) for i, (_, r, _) in enumerate(pairs)], "k long, doc string")
    got = {}
    for row in ql.exact_differences(left, right, "k", "doc").collect():
        got.setdefault(row["k"], []).append((row["path"], row["category"], row["bits_equal"]))
    assert {i: got.get(i, []) for i in range(len(pairs))} == {i: want for i, (_, _, want) in enumerate(pairs)}
    docs = ['{"a":1,"b":[1,2]}', '{"a":5,"b":[3,4]}', '{"b":[1,2],"a":1}', '{"a":1,"b":[1]}', '{"a":1.5,"b":[1,2]}', '{"a":{},"b":[1,2]}']
    prints = [r["fingerprint"] for r in ql.schema_fingerprint(spark.createDataFrame([(d,) for d in docs], "doc string").coalesce(1), "doc").collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 5


def test_lengths_are_those_of_sql(spark):
    """To the last bit: a length that rounds differently falls on another side of a cut that equals it."""
    import math

    import numpy as np

    from touchline.operators.options import pass_vector

    rng = np.random.default_rng(5)
    ends = [tuple(float(v) for v in np.round(rng.uniform(-50, 50, 4), 2)) for _ in range(2000)]
    rows = pass_vector(spark.createDataFrame(ends, "cx double, cy double, rx double, ry double"))
    for r in rows.collect():
        dx, dy = r["rx"] - r["cx"], r["ry"] - r["cy"]
        assert r["distance"] == math.sqrt(dx * dx + dy * dy)


def sorts_of(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_components_of_all_models_share_one_sort(spark):
    candidates = [("a", 10.0, 1.0), ("b", 25.0, -6.0), ("c", -4.0, 3.0)]
    edges = op.edge_features(state(spark, candidates, [(5.0, 2.0), (12.0, -3.0)]))
    parts = dg.components(edges, list(DEMO_MODELS.values()))
    assert sorts_of(parts) <= 1
    rows = parts.collect()
    assert len(rows) == 3 * 8 and all(r["reconstructs"] for r in rows)
    for r in rows:
        values = [o["value"] for o in rows if (o["model"], o["component"]) == (r["model"], r["component"])]
        assert (r["choice_size"], r["first_ord"]) == (3, 0)
        assert r["choice_range"] == max(values) - min(values)
        assert r["centred"] == pytest.approx(r["value"] - sum(values) / 3, abs=1e-12)


def test_units_sum_exactly_beyond_doubles(spark):
    units = [2**52, 2**52 - 1, 1, 0, 3] * 400
    got = spark.createDataFrame([(u,) for u in units], "u long").agg(unit_sum(F.col("u")).alias("s")).first()["s"]
    assert int(got) == sum(units)


def test_nested_models_share_packed_choices(spark):
    from touchline.operators import folds as fo

    rng = random.Random(7)
    rows = [
        (m, f"{m}{k}", k, j, k % 3, f"P{j}", rng.gauss(0, 1), rng.gauss(0, 1))
        for m in ("0", "1", "2") for k in range(30) for j in range(3)
    ]
    rows.append(("3", "30", 0, 0, None, "P0", 1.0, 2.0))  # a match without any target still has moments
    df = spark.createDataFrame(rows, "match_id string, event_id string, ordinal long, ord int, target_index int, id string, f0 double, f1 double")
    shared = fo.prepared_choices(df, ["f0", "f1"])
    assert shared.represented == {"0", "1", "2"}
    for features in (["f0"], ["f0", "f1"]):
        for a, b in zip(fo.fit_folds(shared, features), fo.fit_folds(df.select("*"), features)):
            assert (a.fold, a.steps) == (b.fold, b.steps)
            assert a.coef == pytest.approx(b.coef, abs=1e-9) and a.objective == pytest.approx(b.objective, abs=1e-12)
    with pytest.raises(ValueError):
        fo.fit_folds(shared, ["f1"])


def test_tie_blocks_sort_once(spark):
    rows = [("g", v, i) for i, v in enumerate([0.0, 6e-13, 12e-13, 18e-13, 24e-13, 1.0, 1.0, 2.0, 2.0 + 9e-13, 2.0 + 15e-13])]
    found = tie_blocks(spark.createDataFrame(rows, "g string, v double, i int"), ["g"], "v", order=["i"])
    assert sorts_of(found) == 1
    assert [tuple(r) for r in found.orderBy("position").select("block", "first", "last").collect()] == [
        (0, 1, 2), (0, 1, 2), (1, 3, 4), (1, 3, 4), (2, 5, 5), (3, 6, 7), (3, 6, 7), (4, 8, 9), (4, 8, 9), (5, 10, 10),
    ]


def odd_states(spark):
    """States with ties, an edge without length, a lone edge, no defender, no candidate, a target that is no candidate and none at all."""
    kinds = [
        ([(6.0, 1.0), (0.0, 0.0), (9.0, -4.0)], [(3.0, 1.0), (3.0, 1.0), (7.0, -3.0)], 0),
        ([(6.0, 1.0), (6.0, 1.0)], [(2.0, 2.0), (2.0, -2.0)], 1),
        ([(12.0, 2.0), (-5.0, 3.0), (4.0, 9.0), (8.0, -8.0)], [(5.0, 1.0), (1.0, 4.0), (-2.0, 3.0), (9.0, 9.0)], 9),
        ([(4.0, 4.0)], [(2.0, 1.0)], 0),
        ([(4.0, 4.0)], [], 0),
        ([], [(2.0, 1.0)], 0),
        ([(4.0, 4.0), (5.0, 1.0)], [(2.0, 1.0)], None),
    ]
    rows = [
        ("m", str(k), k, target, (0.0, 0.0), [(chr(122 - i), *p) for i, p in enumerate(candidates)], defenders)
        for k, (candidates, defenders, target) in enumerate(kinds)
    ]
    return spark.createDataFrame(rows, STATE), kinds


def plain_blocks(values):
    """First and last position of the tie block of every value."""
    order = sorted(range(len(values)), key=lambda i: values[i])
    blocks = []
    for i in order:
        if not blocks or values[i] - values[blocks[-1][0]] > 1e-12:
            blocks.append([])
        blocks[-1].append(i)
    found, at = {}, 1
    for block in blocks:
        found |= {i: (at, at + len(block) - 1) for i in block}
        at += len(block)
    return [found[i] for i in range(len(values))]


def plain_edges(candidates, defenders):
    """Distances of every edge to all defenders, to receiver and segment."""
    rows = []
    for x, y in candidates:
        square = x * x + y * y
        t = [0.0 if square <= 1e-18 else min(1.0, max(0.0, (p * x + q * y) / square)) for p, q in defenders]
        rows.append(([math.hypot(p - x, q - y) for p, q in defenders], [math.hypot(p - f * x, q - f * y) for (p, q), f in zip(defenders, t)]))
    return rows


def plain_utility(model, edge, candidate):
    receiver, segment = edge
    values = {
        "distance": math.hypot(*candidate), "longitudinal_displacement": candidate[0], "lateral_displacement": candidate[1],
        "nearest_receiver_defender_distance": min(receiver), "minimum_segment_defender_distance": min(segment),
        "summed_segment_attenuation": sum(math.exp(-v / 5) for v in segment),
    }
    return sum((values[r.feature] - r.mean) / r.scale * r.coef for r in model)


def steps_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_state_metrics_come_from_the_record_alone(spark):
    df, kinds = odd_states(spark)
    metrics = rel.state_metrics(df, DEMO_MODELS["m1"])
    assert not any(step in steps_of(metrics) for step in ("Exchange", "Sort", "Window", "Join"))
    found = {r["ordinal"]: r for r in metrics.collect()}
    assert sorted(found) == [0, 1, 2, 3, 6]
    for k, row in found.items():
        candidates, defenders, _ = kinds[k]
        edges = plain_edges(candidates, defenders)
        u = [plain_utility(DEMO_MODELS["m1"], e, c) for e, c in zip(edges, candidates)]
        share = [math.exp(x - max(u)) / sum(math.exp(y - max(u)) for y in u) for x in u]
        near, ranks = {}, [plain_blocks(segment) for _, segment in edges]
        for i, kind in enumerate(("receiver", "segment")):
            near[kind] = [{d for d, (first, _) in enumerate(plain_blocks(e[i])) if first == 1} for e in edges]
            held = [sum(d in s for s in near[kind]) for d in range(len(defenders))]
            assert row[f"max_{kind}_nearest_edges"] == max(held) and row[f"any_{kind}_multi_edge"] == float(max(held) >= 2)
            assert row[f"{kind}_unique_nearest_defenders"] == sum(n > 0 for n in held)
            assert row[f"{kind}_unique_nearest_edges"] == pytest.approx(sum(len(s) == 1 for s in near[kind]) / len(edges))
            assert row[f"{kind}_distance_mean"] == pytest.approx(sum(sum(e[i]) for e in edges) / len(edges) / len(defenders))
        both = list(zip(near["receiver"], near["segment"]))
        assert row["nearest_intersects"] == pytest.approx(sum(bool(a & b) for a, b in both) / len(edges))
        assert row["nearest_equal"] == pytest.approx(sum(a == b for a, b in both) / len(edges))
        assert row["same_unique_nearest"] == pytest.approx(sum(a == b and len(a) == 1 for a, b in both) / len(edges))
        assert (row["edges"], row["defenders"]) == (len(edges), len(defenders))
        for n in (2, 3):
            gaps = [sorted(e[1])[n - 1] - min(e[1]) for e in edges] if len(defenders) >= n else []
            assert row[f"segment_d{n}_d1"] == (pytest.approx(sum(gaps) / len(gaps)) if gaps else None)
        for n in (1, 2, 3):
            inside = [[max(0, min(last, n) - first + 1) / (last - first + 1) for first, last in r] for r in ranks]
            sides = range(len(defenders))
            assert row[f"max_segment_top{n}_edge_share"] == pytest.approx(max(sum(e[d] for e in inside) / len(edges) for d in sides))
            assert row[f"max_segment_top{n}_m1_weighted"] == pytest.approx(max(sum(w * e[d] for w, e in zip(share, inside)) for d in sides))
            sets = [{d for d, (first, _) in enumerate(r) if first <= n} for r in ranks]
            pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
            assert row[f"segment_top{n}_pair_jaccard"] == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)


def test_match_macro_metrics_write_no_wide_rows(spark, monkeypatch):
    import __spark_entry__ as driver
    from touchline import session
    from touchline.plans import sizing

    written = []
    cut = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    monkeypatch.setattr(sizing, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    driver.queries()["agg22_match_macro_metrics"](spark, "/root/testdata/sf0.001").collect()
    assert written and not any("edges" in columns or "ord" in columns for columns in written)


def test_diagnosis_comes_from_the_record_alone(spark):
    df, kinds = odd_states(spark)
    models = [DEMO_MODELS[m] for m in ("m0", "m1", "m2")]
    rows = dg.diagnose(df, models, "population")
    assert not any(step in steps_of(rows) for step in ("Exchange", "Sort", "Window", "Join"))
    found = {r["ordinal"]: r for r in rows.collect()}
    assert sorted(found) == [0, 1, 2, 3]
    sign = lambda x: (x > 0) - (x < 0)
    for k, row in found.items():
        candidates, defenders, target = kinds[k]
        edges, ids = plain_edges(candidates, defenders), [chr(122 - i) for i in range(len(candidates))]
        blocks = [plain_blocks([-plain_utility(m, e, c) for e, c in zip(edges, candidates)]) for m in models]
        known = target < len(candidates)
        rank = [sum(b[target]) / 2 if known else None for b in blocks]
        assert [row["m1_delta"], row["m2_delta"]] == ([rank[1] - rank[0], rank[2] - rank[1]] if known else [None, None])
        for i, b in enumerate(blocks):
            assert row[f"m{i}_top"] == ",".join(sorted(ids[j] for j, (first, _) in enumerate(b) if first == 1))
        mass = [sum(math.exp(-v / 5) for v in s) - math.exp(-min(s) / 5) for _, s in edges]
        assert row["nonnearest_mass"] == pytest.approx(sum(mass) / len(mass))
        assert row["target_id"] == (ids[target] if known else None)
        if known:
            x, y = candidates[target]
            assert [row[c] for c in ("distance", "longitudinal", "absolute_lateral")] == pytest.approx([math.hypot(x, y), x, abs(y)])
            assert [row["receiver_distance"], row["segment_distance"]] == pytest.approx([min(side) for side in edges[target]])
            assert row["attenuation"] == pytest.approx(sum(math.exp(-v / 5) for v in edges[target][1]))
        else:
            assert all(row[c] is None for c in [*dg.STRATUM_VALUES, "direction"])
        pairs = [(a, b) for a in range(len(edges)) for b in range(a + 1, len(edges))]
        if not pairs:
            assert all(row[c] is None for c in ("eligible_pairs", "discordant_pairs", "disagreement_fraction", "pairs", "changed_fraction"))
            continue
        gaps = [[min(edges[a][i]) - min(edges[b][i]) for i in (0, 1)] for a, b in pairs]
        eligible = [g for g in gaps if abs(g[0]) > 1e-12 and abs(g[1]) > 1e-12]
        discordant = sum((r > 0) != (s > 0) for r, s in eligible)
        moves = [(sign(blocks[1][a][0] - blocks[1][b][0]), sign(blocks[2][a][0] - blocks[2][b][0])) for a, b in pairs]
        assert (row["eligible_pairs"], row["discordant_pairs"], row["pairs"]) == (len(eligible), discordant, len(pairs))
        assert row["disagreement_fraction"] == (pytest.approx(discordant / len(eligible)) if eligible else None)
        assert row["unchanged"] == sum(x == y for x, y in moves) and row["strict_reversal"] == sum(x * y < 0 for x, y in moves)
        assert row["tie_created"] == sum(x != 0 and y == 0 for x, y in moves) and row["tie_removed"] == sum(x == 0 and y != 0 for x, y in moves)
    assert found[0]["direction"] == "forward"


def test_cases_are_found_behind_a_match_that_is_full(spark):
    rows = [(f"k{i:03d}", i, "crowd") for i in range(3 * dg.CASES_AT_ONCE)] + [("x1", 1001, "a"), ("x2", 1002, "a"), ("x3", 1003, "b"), ("x0", 1004, "a")]
    df = spark.createDataFrame(rows, "tie_key string, ordinal long, match_id string")
    pools = [("first", F.lit(True), 4, [F.col("tie_key").alias("_k")]), ("second", F.lit(True), 5, [F.col("tie_key").alias("_k")])]
    got = {(r["ordinal"], r["category"]) for r in dg.select_cases(df, pools).collect()}
    assert got == {(0, "first"), (1, "first"), (1004, "first"), (1001, "first"), (1003, "second")}


@pytest.mark.parametrize("name", ["top05_quota_case_selection", "agg42_strata_table"])
def test_diagnosis_is_read_without_rows_per_edge_or_model(spark, monkeypatch, name):
    import __spark_entry__ as driver
    from touchline.plans import sizing

    written = []
    cut = dg.cut_lineage
    for module in (dg, sizing):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    driver.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert not any(columns & {"ordinal", "event_id"} for columns in written)
