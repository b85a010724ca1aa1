import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from vigilume.operators import metrics as mt

SCHEMA = "user_id string, seq_no long, copy int, end_date date, label int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(u, i, 0, date(2024, 1, 1 + i % 28), y, s) for i, (u, y, s) in enumerate(rows)], SCHEMA)


def sample(n=300, seed=3):
    rng = random.Random(seed)
    return [(rng.choice("abcdef"), y := int(rng.random() < 0.3), round(rng.randrange(25) / 25 + 0.2 * y, 3)) for _ in range(n)]


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


def brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        flagged = s >= t
        recall, precision = (y[flagged] == 1).sum() / (y == 1).sum(), (y[flagged] == 1).mean()
        total, last = total + (recall - last) * precision, recall
    return total


def test_ranking_thresholds_and_percentiles(spark):
    rows = sample()
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    steps = mt.ladder(frame(spark, rows)).cache()
    got = mt.ranking_metrics(steps).first()
    assert got["auroc"] == pytest.approx(brute_auroc(y, s)) and got["auprc"] == pytest.approx(brute_ap(y, s))
    flipped = mt.ranking_metrics(mt.ladder(frame(spark, [(u, l, -x) for u, l, x in rows]))).first()
    assert flipped["auroc"] == pytest.approx(1 - got["auroc"])

    cuts = sorted(set(s))
    f1s = []
    for t in cuts:
        p, r = (y[s >= t] == 1).mean(), (y[s >= t] == 1).sum() / (y == 1).sum()
        f1s.append(2 * p * r / (p + r + 1e-10))
    assert mt.best_f1(steps).first()[0] == cuts[int(np.argmax(f1s))]

    probs = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    everyone = mt.percentiles(steps, probs).first()
    negatives = mt.percentiles(steps, probs, "neg").first()
    for name, p in probs.items():
        assert everyone[name] == pytest.approx(np.percentile(s, 100 * p))
        assert negatives[name] == pytest.approx(np.percentile(s[y == 0], 100 * p))


def test_fixed_recall_skips_points_on_a_straight_stretch(spark):
    # going down: three single positives on one stretch, then negatives
    rows = [("u", 1, 0.9), ("u", 1, 0.8), ("u", 1, 0.7), ("u", 0, 0.6), ("u", 1, 0.5), ("u", 0, 0.4)]
    steps = mt.ladder(frame(spark, rows))
    # recall 0.5 would be at 0.8, which lies inside the first stretch; its upper end is nearest
    assert mt.fixed_recall(steps, 0.5).first()[0] == 0.9
    assert mt.fixed_recall(steps, 0.95).first()[0] == 0.5


def test_one_class(spark):
    got = mt.ranking_metrics(mt.ladder(frame(spark, [("u", 0, 0.1), ("u", 0, 0.2)]))).first()
    assert (got["auprc"], got["auroc"]) == (0.0, 0.5)


def test_confusion_without_denominators(spark):
    limits = spark.createDataFrame([("m", 0.5, False)], "method string, threshold double, is_oracle boolean")
    r = mt.threshold_metrics(mt.ladder(frame(spark, [("u", 0, 0.1), ("u", 0, 0.2)])), limits).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["fnr"], r["specificity"]) == (2, 0.0, 0.0, 0.0, 0.0, 1.0)


def test_breakdown_latency_and_summary(spark):
    rows = [("hit", 0, 0.9), ("hit", 1, 0.1), ("hit", 1, 0.2), ("hit", 1, 0.9), ("first", 1, 0.9), ("miss", 1, 0.1), ("calm", 0, 0.9)]
    limits = spark.createDataFrame([("m", 0.5)], "method string, threshold double")
    judged = mt.judge(frame(spark, rows), limits)
    truth = spark.createDataFrame(
        [("hit", 1, "x", datetime(2024, 1, 1), datetime(2024, 1, 3)), ("hit", 2, "y", datetime(2024, 1, 2), datetime(2024, 1, 6, 6)), ("calm", 3, "z", datetime(2024, 1, 1), datetime(2024, 1, 2))],
        "user_id string, scenario int, details string, start_date timestamp_ntz, end_date timestamp_ntz",
    )
    table = mt.detection_latency(mt.per_user_breakdown(judged), truth).cache()
    got = {r["user_id"]: r for r in table.collect()}
    assert set(got) == {"hit", "first", "miss"}
    assert [got[u]["latency_sequences"] for u in ("hit", "first", "miss")] == [2, 0, -1]
    assert got["hit"]["latency_hours"] == 48.0 and got["miss"]["latency_days"] == -1.0
    assert got["hit"]["scenario"] == 2 and got["hit"]["lead_time_hours"] == 54.0
    s = mt.latency_summary(table).first()
    assert (s["caught_users"], s["missed_users"], s["mean_latency_sequences"], s["median_latency_hours"]) == (2, 1, 1.0, 24.0)
    scenarios = {r["scenario"]: (r["insider_users"], r["users_detected"], r["sequence_recall"]) for r in mt.per_scenario(judged, truth).collect()}
    assert scenarios == {0: (2, 1, 0.5), 2: (1, 1, pytest.approx(1 / 3))}
    users = mt.user_level_metrics(judged).first()
    assert (users["tp"], users["fp"], users["fn"], users["tn"]) == (2, 1, 1, 0)
    assert {r["user_id"] for r in mt.exclude_scenarios(judged, truth, [2]).collect()} == {"first", "miss", "calm"}


def test_threshold_lookup_order(spark):
    cal = spark.createDataFrame([(float(i),) for i in range(101)], "score double")
    known = spark.createDataFrame([("percentile_95", 1.0), ("mean_plus_3std", 2.0)], "method string, threshold double")
    assert tuple(mt.lookup_threshold(known, "percentile_95", cal).first()) == ("percentile_95", 1.0)
    assert tuple(mt.lookup_threshold(known, "best_f1", cal).first()) == ("mean_plus_3std", 2.0)
    assert tuple(mt.lookup_threshold(known.limit(0), "best_f1", cal).first()) == ("calibration percentile_99", 99.0)
    with pytest.raises(ValueError):
        mt.thresholds(None, cal, ["best_f1"])
    with pytest.raises(ValueError):
        mt.thresholds(None, cal, ["nonsense"])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40))
def test_rates_stay_within_bounds(spark, rows):
    steps = mt.ladder(frame(spark, [(u, y, x / 4) for u, y, x in rows]))
    for table in (mt.pr_curve(steps), mt.roc_curve(steps), mt.ranking_metrics(steps)):
        for r in table.drop("threshold").collect():
            assert all(0 <= v <= 1 for v in r)


def test_sketched_percentiles_by_date(spark):
    """Sketches of dates merge to the percentiles of all scores, within their rank error; a date can be replaced."""
    rows = spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("end_date"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("score")
    )
    found = {r["method"]: r["threshold"] for r in mt.sketched_percentiles(mt.score_sketches(rows), {"a": 0.95, "b": 0.5}).collect()}
    for name, p in (("a", 0.95), ("b", 0.5)):
        rank = rows.where(F.col("score") <= found[name]).count() / 60_000
        assert abs(rank - p) < 0.005
    assert mt.sketched_percentiles(mt.score_sketches(rows.limit(0)), {"a": 0.5}).collect() == []
