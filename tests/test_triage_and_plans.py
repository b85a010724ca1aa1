import json
from datetime import date, datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilume import session
from vigilume.config import Settings
from vigilume.operators import metrics as mt, profiling as pr, sessions as se, triage as tr
from vigilume.plans import evaluation, inference, prepare
from vigilume.sources import artifacts, fixtures as fx, logs

DATA = "/root/testdata/sf0.001"
LIMIT = "method string, threshold double"


def judged(spark, rows, threshold):
    scores = spark.createDataFrame(rows, "user_id string, seq_no long, copy int, end_date date, label int, score double")
    return mt.judge(scores, spark.createDataFrame([("m", threshold)], LIMIT))


def test_severity_levels(spark):
    rows = [("high", i, 0, date(2024, 1, 1), 0, s) for i, s in enumerate((1.0, 1.0, 0.1))]
    rows += [("top", i, 0, date(2024, 1, 1), 0, s) for i, s in enumerate((0.1, 0.1, 0.1, 0.1, 2.1))]
    rows += [("mid", i, 0, date(2024, 1, 1), 0, s) for i, s in enumerate((1.0, 0.1, 0.1))]
    rows += [("low", i, 0, date(2024, 1, 1), 0, s) for i, s in enumerate((1.0, 0.1, 0.1, 0.1))]
    rows += [("none", 0, 0, date(2024, 1, 1), 0, 0.5)]
    risk = tr.user_risk(judged(spark, rows, 1.0)).cache()
    assert {r["user_id"]: r["severity"] for r in risk.collect()} == {"high": "HIGH", "top": "HIGH", "mid": "MEDIUM", "low": "LOW", "none": "NORMAL"}
    assert [r["user_id"] for r in tr.top_users(risk, 2).collect()] == ["top", "high"]
    assert {r["severity"]: r["users"] for r in tr.severity_counts(risk).collect()} == {"HIGH": 2, "MEDIUM": 1, "LOW": 1}


def test_indicator_texts():
    assert tr.indicator_text("emails_sent") == "Email volume deviation"
    assert tr.indicator_text("emails_sent_zscore") == "Email volume deviation from user baseline"
    assert tr.indicator_text("day_of_week_sin") == "Anomalous day_of_week_sin"
    assert tr.indicator_text("active_hours_zscore") == "Anomalous active_hours (deviation from user baseline)"
    assert tr.indicator_text("active_hours_rolling_std") == "Anomalous active_hours (rolling statistic)"


def test_indicators_follow_the_largest_errors(spark):
    errors = spark.createDataFrame(
        [("u", date(2024, 1, d), 0, 5.0, 1.0, 3.0) for d in (1, 2)], "user_id string, date date, is_insider int, openness double, emails_sent double, neuroticism double"
    )
    flags = judged(spark, [("u", 0, 0, date(2024, 1, 2), 0, 9.0)], 1.0)
    got = tr.risk_indicators(errors, flags, ["openness", "emails_sent", "neuroticism"], 2, 1).first()["indicators"]
    assert got == ["Personality trait deviation", "Email volume deviation"]


def test_drilldown_counts_all_events_over_bins_and_applies_rules(spark, events):
    rows = [("2024-01-01T19:00:00", "u", "p", "Logon"), ("2024-01-02T06:00:00", "u", "p", "Logoff")]
    rows += [(f"2024-01-01T{19 + i // 4}:{15 * (i % 4):02d}:30", "u", "other", "Http", {"url": f"http://h/{i}"}) for i in range(15)]
    rows += [(f"2024-01-02T0{i // 4}:{15 * (i % 4):02d}:30", "u", "other", "File", {"filename": f"f{i}.EXE"}) for i in range(12)]
    rows += [("2024-01-03T10:00:00", "u", "p", "Logon"), ("2024-01-03T10:05:00", "u", "p", "Logoff"), ("2024-01-03T10:01:00", "u", "p", "File", {"filename": "x.bat"})]
    ev = events(*rows)
    cfg = Settings()
    flags = judged(spark, [("u", i, 0, date(2024, 1, d), 0, 2.0) for i, d in enumerate((1, 3))], 1.0)
    got = {r["date"].day: r for r in tr.session_drilldown(flags, se.sessions(ev, cfg), ev, cfg).collect()}
    night, brief = got[1], got[3]
    assert night["risk"] == "medium" and night["indicators"] == ["After-hours session (19:00)"]
    assert night["summary"] == "660-min session: 1 Logon, 15 Http, 12 File, 1 Logoff" and len(night["events"]) == 10
    assert brief["risk"] == "high" and brief["summary"] == "5-min session: 1 Logon, 1 File, 1 Logoff"
    assert brief["indicators"] == ["Short session (<15 min)", "Executable file copied", "File activity in short session"]


def test_an_executable_behind_many_events_counts(spark, events):
    rows = [("2024-01-01T09:00:00", "u", "p", "Logon"), ("2024-01-01T17:00:00", "u", "p", "Logoff")]
    rows += [(f"2024-01-01T10:{i:02d}:00", "u", "p", "Http", {"url": f"http://h/{i}"}) for i in range(40)]
    rows += [("2024-01-01T16:00:00", "u", "p", "File", {"filename": "tool.exe"})]
    ev, cfg = events(*rows), Settings(shown_events=3)
    flags = judged(spark, [("u", i, 0, date(2024, 1, 1 + i), 0, 2.0) for i in range(12)], 1.0)
    (row,) = tr.session_drilldown(flags, se.sessions(ev, cfg), ev, cfg).collect()
    assert row["risk"] == "high" and row["summary"] == "480-min session: 1 Logon, 40 Http, 1 File, 1 Logoff" and len(row["events"]) == 3
    dated = ev.withColumn("date", F.to_date("datetime"))
    assert tr.session_drilldown(flags, se.sessions(ev, cfg), dated, cfg).first()["summary"] == row["summary"]


def test_sessions_of_an_alert_are_rows_of_their_own(spark, tmp_path):
    flags = judged(spark, [("busy", 0, 0, date(2024, 1, 2), 0, 9.0), ("calm", 0, 0, date(2024, 1, 2), 0, 0.1)], 1.0)
    rows = [("busy", date(2024, 1, 1 + k % 2), f"s{k}", datetime(2024, 1, 1 + k % 2, k // 120, k // 2 % 60), "high" if k == 7 else "low") for k in range(2000)]
    rows.append(("calm", date(2024, 1, 2), "c", datetime(2024, 1, 2, 9), "low"))
    drill = spark.createDataFrame(rows, "user_id string, date date, session_id string, session_start timestamp_ntz, risk string")
    alerts = tr.alerts(tr.flagged_users(flags), flags, drilldown=drill)
    (alert,) = alerts.collect()
    assert [tuple(x) for x in alert["session_drilldown"]] == [(date(2024, 1, 1), 1000, "low"), (date(2024, 1, 2), 1000, "high")]
    sessions = tr.alert_sessions(alerts, drill)
    artifacts.save_report(sessions, str(tmp_path / "sessions"))
    back = spark.read.schema(sessions.schema).json(str(tmp_path / "sessions")).collect()
    assert back[0].__fields__[:3] == ["alert_id", "date", "session_start"] and {r["alert_id"] for r in back} == {alert["alert_id"]}
    assert sorted((r["date"], r["session_id"], r["session_start"]) for r in back) == sorted((r[1], r[2], r[3]) for r in rows[:-1])


def test_indicators_take_all_flagged_windows(spark):
    rows = [("u", date(2024, 1, d), 0, float(d == 9), 0.4) for d in range(1, 13)]
    errors = spark.createDataFrame(rows, "user_id string, date date, is_insider int, emails_sent double, openness double")
    flags = judged(spark, [("u", k, 0, date(2024, 1, k + 2), 0, 9.0) for k in range(11)], 1.0)
    found = tr.risk_indicators(errors, flags, ["emails_sent", "openness"], 2, 1, top=1)
    assert found.first()["indicators"] == [tr.indicator_text("openness")]
    late = tr.risk_indicators(errors, flags.where("seq_no in (7, 8)"), ["emails_sent", "openness"], 2, 1, top=1)
    assert late.first()["indicators"] == [tr.indicator_text("emails_sent")]
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()


def test_histogram_has_one_bin_less_than_edges(spark):
    values = np.round(np.random.default_rng(0).gamma(2, size=1000), 6)
    scores = spark.createDataFrame([("u", i, 0, None, 0, float(v)) for i, v in enumerate(values)], "user_id string, seq_no long, copy int, end_date date, label int, score double")
    got = {r["bin"]: r["n"] for r in pr.score_histogram(scores, mt.ladder(scores)).collect()}
    high = np.percentile(values, 99.5)
    want, _ = np.histogram(values, bins=np.linspace(values.min(), high, 120))
    assert max(got) <= 118 and sum(got.values()) == want.sum() and sum(abs(got.get(k, 0) - n) for k, n in enumerate(want)) <= 2
    flat = scores.withColumn("score", F.lit(0.5))
    assert [(r["bin"], r["n"], r["density"]) for r in pr.score_histogram(flat, mt.ladder(flat)).collect()] == [(0, 1000, None)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", "x" * 60), (2, "a", None), (None, "b", "y")], "n int, t string, long string")
    (r,) = pr.numeric_profile(df).collect()
    assert tuple(r) == ("n", 2, 2, 1.0, 2.0, 1.5)
    assert [(r["value"], r["n"]) for r in pr.top_values(df.select("t")).orderBy("place").collect()] == [("a", 2), ("b", 1)]
    shown = pr.sample_rows(df).collect()
    assert shown[0]["long"] == "x" * 47 + "..." and shown[1]["long"] == "NULL"
    assert pr.schema_listing(df) == [("n", "int"), ("t", "string"), ("long", "string")]


@pytest.fixture(scope="module")
def inputs(spark):
    return prepare.Inputs(
        fx.events(spark, DATA), fx.snapshots(spark, DATA), logs.traits(fx.psychometric(spark, DATA)), logs.truth_intervals(fx.labels(spark, DATA), fx.FIXTURE)
    )


def test_whole_run_from_logs_to_reports(spark, inputs, tmp_path):
    cfg = fx.FIXTURE
    ready = prepare.prepare(inputs, cfg)
    prepare.save_prepared(ready, inputs, cfg, str(tmp_path / "prepared"))
    cut = prepare.training_windows(ready, cfg)
    assert {r["split"] for r in cut.select("split").distinct().collect()} <= {"train", "val", "test"}
    fitted = artifacts.load(spark, str(tmp_path / "prepared/artifacts"))
    assert fitted.columns["vector"] == cfg.vector
    limit = inference.calibration_limit(ready, cfg)
    days = inference.inference_features(inputs, cfg, fitted, users=["U00000", "U00001"], date_range=("2024-01-25", "2024-01-28"))
    assert {r["user_id"] for r in days.select("user_id").distinct().collect()} == {"U00000", "U00001"}
    inference.write_risk_report(days, limit, "percentile_95", cfg, str(tmp_path / "report"))
    users = [json.loads(line) for f in Path(tmp_path / "report/users").glob("*.json") for line in f.read_text().splitlines()]
    assert {u["user_id"] for u in users} == {"U00000", "U00001"} and all(len(u["top_anomalous_windows"]) <= 5 for u in users)
    late = inference.dense_scores(days, cfg, since="2024-01-27").agg({"end_date": "min"}).first()[0]
    assert late >= date(2024, 1, 27)


def test_evaluation_report(spark, inputs, tmp_path):
    own = fx.user_scores(spark, DATA)
    stored = se.sessions(inputs.events, fx.FIXTURE)
    report = evaluation.evaluate(own.where("label is not null"), own.where("label is null"), inputs.truth, stored, excluded_scenarios=[3])
    evaluation.write_evaluation(report, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(report)
    assert spark.read.json(str(tmp_path / "threshold_results")).count() == 6


def test_feature_layout():
    cfg = Settings()
    assert len(cfg.scaled) == 68 and len(cfg.vector) == 75 and len(cfg.behavioural) == 70


def test_missing_table_is_reported(spark):
    got = {r["table"]: (r["rows"], r["status"]) for r in pr.table_counts(spark, {"a": spark.range(3), "b": None}).collect()}
    assert got == {"a": (3, "ok"), "b": (0, "not found")}


def test_last_truth_interval_wins(spark):
    truth = spark.createDataFrame([("u", 1, None, datetime(2024, 1, 1), datetime(2024, 1, 2)), ("u", None, None, datetime(2024, 2, 1), datetime(2024, 2, 2))],
                                  "user_id string, scenario int, details string, start_date timestamp_ntz, end_date timestamp_ntz")
    assert mt.last_interval(truth).first()["scenario"] == 0


def test_drilldown_reads_the_folders_of_its_dates_only(spark, tmp_path):
    log = fx.events(spark, DATA)
    logs.write_events(log, str(tmp_path / "log"))
    dated = spark.read.parquet(str(tmp_path / "log"))
    keys = ["session_id", "user_id", "pc", "session_start", "session_end"]
    targets = session.stored(se.sessions(log, fx.FIXTURE).where("session_date = date'2024-01-10'").select(*keys), "targets")
    inside = tr.session_events(targets, dated)
    assert sorted(map(str, inside.collect())) == sorted(map(str, tr.session_events(targets, log).collect()))
    assert "dynamicpruning" in inside._jdf.queryExecution().executedPlan().toString()
    # files of other days may hold anything: they aren't opened
    for path in (tmp_path / "log").glob("date=2024-01-2*/*.parquet"):
        path.write_bytes(b"no parquet")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    again = tr.session_events(targets, spark.read.schema(dated.schema).parquet(str(tmp_path / "log")))
    assert sorted(map(str, again.collect())) == sorted(map(str, inside.collect()))
    with pytest.raises(Exception, match="no parquet|FAILED_READ_FILE|Parquet"):
        spark.read.schema(dated.schema).parquet(str(tmp_path / "log")).select("id").collect()
