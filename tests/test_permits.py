"""Access periods, grid and features against day-by-day loops; the model on features."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import features as fe
from kerbline.operators import modelling as ml
from kerbline.operators import permits as pm

D, DAY = dt.datetime, dt.timedelta(days=1)
LO, HI = dt.date(2024, 1, 1), dt.date(2024, 4, 30)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    periods, visits = [], []
    for p in range(12):
        start = D(2024, 1, 1) + DAY * rng.randint(0, 30)
        policy = rng.choice(["M-F 6-18", "24/7", "Sa-Su 0-23"])
        periods.append((f"L{p}", p, "c", start, start + DAY * rng.randint(10, 60), 1, "g", policy))
        periods.append((f"L{p}", p, "c", start + DAY * 50, None, rng.choice([0, 1]), "g", policy))
        for _ in range(rng.randint(5, 60)):
            a = D(2023, 12, 20) + dt.timedelta(minutes=rng.randint(0, 130 * 1440))
            visits.append((f"L{p}", a, a + dt.timedelta(minutes=rng.randint(1, 3000))))
    pf = spark.createDataFrame(periods, "permit string, card_id int, customer string, period_start timestamp_ntz, period_end timestamp_ntz, has_access int, group_at_start string, access_policy string")
    vf = spark.createDataFrame(visits, "permit string, entry_ts timestamp_ntz, exit_ts timestamp_ntz")
    return periods, visits, pf, vf


def days_of(policy):
    return {"M-F 6-18": range(5), "24/7": range(7), "Sa-Su 0-23": (5, 6)}[policy]


def expected(periods, visits):
    out = {}
    for p in {x[0] for x in periods}:
        mine = [x for x in periods if x[0] == p and x[5] == 1]
        ok = days_of(mine[0][7])
        seen = set()
        for _, a, b in (v for v in visits if v[0] == p):
            d = a.date()
            while d <= b.date():
                if d.weekday() in ok:
                    seen.add(d)
                d += DAY
        grid = set()
        for x in mine:
            d, end = max(x[3].date(), LO), min(x[4].date() if x[4] else HI, HI)
            while d <= end:
                if d.weekday() in ok:
                    grid.add(d)
                d += DAY
        grid = sorted(grid)
        for i, d in enumerate(grid):
            prior, pv = grid[:i], sorted(v for v in seen if v < d)
            hits = [int(q in seen) for q in prior]
            streak = 0
            for h in reversed(hits):
                if h != hits[-1]:
                    break
                streak += 1
            dow = [q for q in prior if q.weekday() == d.weekday()]
            out[p, d] = (
                int(d in seen), len(pv) / len(prior) if prior else None, sum(hits[-10:]) / len(hits[-10:]) if hits else None,
                sum(hits[-20:]) / len(hits[-20:]) if hits else None, sum(v.weekday() == d.weekday() for v in pv) / len(dow) if dow else None,
                (streak if hits and hits[-1] else -streak), (d - pv[-1]).days if pv else None, int(d - 7 * DAY in seen), (d - grid[0]).days)
    return out


def build(pf, vf):
    return fe.historical_features(fe.permit_day_grid(pf, vf, str(LO), str(HI)), fe.policy_visit_dates(vf, fe.permit_profile(pf), str(HI)))


COLUMNS = ["showed_up", "presence_rate", "presence_rate_10", "presence_rate_20", "day_of_week_rate", "streak", "days_since_last_visit", "visited_same_last_week", "tenure_days"]


def test_features_by_brute_force(world):
    periods, visits, pf, vf = world
    got = {(r.permit, r.date): tuple(r[c] for c in COLUMNS) for r in build(pf, vf).collect()}
    want = expected(periods, visits)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row), key


def test_features_use_only_earlier_days(world, spark):
    _, visits, pf, vf = world
    cut = dt.date(2024, 2, 20)
    extra = spark.createDataFrame([("L1", D(2024, 2, 21, 8), D(2024, 3, 5, 9))], vf.schema)
    early = lambda v: sorted(map(str, build(pf, v).filter(F.col("date") <= F.lit(cut)).drop("showed_up").collect()))
    assert early(vf) == early(vf.union(extra))


def test_one_job_equals_grid_then_features(world):
    _, _, pf, vf = world
    one, two = fe.permit_features(pf, vf, str(LO), str(HI)), build(pf, vf)
    assert one.columns == two.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))


def test_access_periods(spark):
    t = lambda d: D(2024, 1, d, 9)
    log = [
        (1, 7, t(1), 2, "", "G: A", "o"), (2, 7, t(3), 110, "True", "G: A", "o"), (3, 7, t(4), 110, "True", "G: A", "o"), (4, 7, t(6), 110, "False", "G: A", "o"),
        (5, 7, t(8), 2, "", "G: LOST CARDS", "o"), (6, 7, t(8), 2, "", "G: B", "o"), (7, 8, t(2), 104, "05-Jan-2024", "G: C", "o"), (8, 9, t(2), 110, "True", "", "o"),
    ]
    lf = spark.createDataFrame(log, "log_id int, card_id int, ts timestamp_ntz, property_type int, new_value string, group_detail string, customer string")
    cards = spark.createDataFrame([(7, "L7", D(2023, 12, 1)), (8, "L8", None), (9, "L9", None)], "card_id int, permit string, start_date timestamp_ntz")
    got = [(r.permit, r.period_start, r.period_end, r.has_access, r.group_at_start) for r in pm.access_periods(lf, cards).orderBy("permit", "period_start", "period_end").collect()]
    assert sorted(got, key=str) == sorted([
        ("L7", D(2024, 1, 1), t(3), 1, "G: A"), ("L7", t(3), t(6), 0, "G: A"), ("L7", t(6), t(8), 1, "G: A"), ("L7", t(8), t(8), 0, "G: LOST CARDS"),
        ("L7", t(8), None, 1, "G: B"), ("L8", D(2024, 1, 5), None, 1, "G: C")], key=str)


def test_visits_without_a_period_are_told(world):
    _, visits, pf, vf = world
    matched = pm.visit_to_policy(vf, pf, "2024-04-30 00:00:00")
    left = pm.unmatched_visits(vf, matched)
    assert matched.count() + left.count() == len(set(visits))


def test_model_on_features(world, spark):
    _, _, pf, vf = world
    split = fe.temporal_split(build(pf, vf), "2024-03-01", "2024-03-31").withColumn("showed_up", (F.rand(3) < F.col("presence_rate_10") * 0.5 + 0.25).cast("int"))
    parts = {n: split.filter(F.col("split") == n) for n in ("train", "validation", "test")}
    model = ml.fit_show_model(parts["train"], trees=5, depth=3)
    assert set(ml.feature_importance(model)) == set(fe.FEATURES)
    scored = ml.with_probability(model, parts["test"])
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    other = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="show_probability").evaluate(scored.withColumn("label", F.col("showed_up").cast("double")))
    assert abs(ml.roc_auc(scored).first().auc - other) < 1e-9
    report = {r.label: r for r in ml.class_report(scored).collect()}
    assert sum(r.support for r in report.values()) == parts["test"].count()
    curve = ml.calibration_curve(scored).agg(F.sum("n")).first()[0]
    assert curve == parts["test"].count()
    steps = ml.isotonic_steps(ml.with_probability(model, parts["validation"]))
    calibrated = ml.calibrated(scored, steps)
    assert calibrated.filter("calibrated is null or calibrated < 0 or calibrated > 1").count() == 0 and calibrated.columns == [*scored.columns, "calibrated"]
    assert calibrated.count() == scored.count()

    coming = fe.prediction_rows(pf, vf, "2024-04-29")
    active = vf.select("permit").union(spark.createDataFrame([("L99",)], "permit string")).distinct()
    result = {r.permit: r for r in ml.score_permits(model, coming, active).collect()}
    assert len(result) == active.count() and result["L99"].show_probability == 0.02 and result["L99"].predicted == 0
    assert ml.expected_total(ml.score_permits(model, coming, active)).first().expected > 0


def plain_isotonic(rows):
    """For each distinct probability the greatest, over starts at or before it, of the least mean to an end at or after it."""
    cells = {}
    for p, y in rows:
        n, hits = cells.get(p, (0, 0))
        cells[p] = (n + 1, hits + y)
    ps = sorted(cells)
    mean = lambda j, k: sum(cells[p][1] for p in ps[j:k + 1]) / sum(cells[p][0] for p in ps[j:k + 1])
    return {ps[i]: max(min(mean(j, k) for k in range(i, len(ps))) for j in range(i + 1)) for i in range(len(ps))}


def test_isotonic_fit_equals_min_max_means(spark):
    import random

    rng = random.Random(4)
    rows = [(round(rng.random(), 2) * 0.9 + 0.05, int(rng.random() < 0.5)) for _ in range(120)] + [(0.5, None), (None, 1)]
    scored = spark.createDataFrame(rows, "show_probability double, showed_up int").repartition(5)
    want = plain_isotonic([r for r in rows if None not in r])
    steps = sorted(map(tuple, ml.isotonic_steps(scored).collect()))
    assert all(a[1] < b[0] and a[3] < b[3] for a, b in zip(steps, steps[1:]))
    got = {r.show_probability: r.calibrated for r in ml.calibrated(scored, ml.isotonic_steps(scored)).collect()}
    assert got.pop(None) is None and got.keys() == want.keys() | {0.5} and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    # Between two steps a line, outside them their values.
    low, high = steps[0], steps[-1]
    middle = (steps[0][1] + steps[1][0]) / 2
    outside = spark.createDataFrame([(0.0,), (1.0,), (middle,)], "show_probability double")
    values = {r.show_probability: r.calibrated for r in ml.calibrated(outside, ml.isotonic_steps(scored)).collect()}
    assert values[0.0] == low[3] and values[1.0] == high[3] and abs(values[middle] - (steps[0][3] + steps[1][3]) / 2) < 1e-12


def test_areas_and_order_statistics_at_the_edges(spark):
    from kerbline.operators.ordered import order_statistics, prefix_sums

    frame = lambda rows: spark.createDataFrame(rows, "show_probability double, showed_up int")
    assert ml.roc_auc(frame([(0.5, 1), (0.5, 0), (0.5, 1)])).first().auc == 0.5
    assert ml.roc_auc(frame([(0.1, 0), (0.9, 1)])).first().auc == 1.0
    assert ml.roc_auc(frame([(0.1, 1), (0.9, 1), (None, 0)])).first().auc is None
    assert ml.roc_auc(frame([])).first().asDict() == {"positives": 0, "negatives": 0, "auc": None}
    values = spark.createDataFrame([(v,) for v in (4.0, 1.0, 1.0, 1.0, 9.0, None)], "v double").repartition(3)
    assert order_statistics(values, "v", {"a": 0.0, "b": 0.5, "c": 0.625, "d": 1.0}).first().asDict() == {"a": 1.0, "b": 1.0, "c": 2.5, "d": 9.0}
    assert order_statistics(values.filter("v > 99"), "v", {"a": 0.5}).first().a is None
    sums = prefix_sums(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), ["k"], ["id"]).collect()
    total = 0
    for r in sorted(sums, key=lambda r: r.k):
        assert r.before_id == total
        total += r.id
