from datetime import date, datetime

import pytest

from vigilume.config import Settings
from vigilume.operators import context, daily
from vigilume.sources import logs

CFG = Settings()


def test_daily_rules(events):
    ev = events(
        ("2024-01-06T07:59:59", "u", "b", "Http", {"url": "http://x.org:80/a"}),
        ("2024-01-06T09:00:00", "u", "b", "Http", {"url": "nohost"}),
        ("2024-01-06T09:10:00", "u", "a", "Http", {"url": None}),
        ("2024-01-06T18:00:00", "u", "a", "Email", {"to_addr": "a@dtaa.com", "cc": None, "bcc": "b@dtaa.com", "attachments": "2"}),
        ("2024-01-06T10:00:00", "u", "a", "Email", {"to_addr": "a@dtaa.com", "cc": "c@dtaa.com", "bcc": "b@dtaa.com", "attachments": "bad"}),
        ("2024-01-06T10:30:00", "u", "b", "File", {"filename": "A.EXE"}),
        ("2024-01-06T10:31:00", "u", None, "File", {"filename": "a.exe.bak"}),
    )
    (r,) = daily.daily_activity(ev, CFG).collect()
    assert (r["date"], r["dow"], r["pc"]) == (date(2024, 1, 6), 5, "a")
    assert r["unique_domains"] == 2 and r["http_request_count"] == 3
    assert r["external_email_count"] == 1 and r["total_attachments"] == 2 and r["unique_recipients"] == 1
    assert r["exe_copy_count"] == 1 and r["file_copy_count"] == 2
    assert r["num_distinct_pcs"] == 2 and r["active_hours"] == 4
    assert r["after_hours_actions"] == 2 and r["after_hours_ratio"] == pytest.approx(2 / 7)
    assert r["peak_hour_concentration"] == pytest.approx(3 / 7)


@pytest.fixture
def snapshots(spark):
    rows = [
        ("a", "2023-11", "R1", "D", "F"), ("a", "2023-12", "R2", "D", None), ("a", "2024-01", "R2", "E", "F"),
        ("b", "2023-11", None, "D", "F"), ("b", "2023-12", "R1", "D", "F"),
        ("c", "2023-11", "R1", "D", "F"), ("c", "2024-01", "R9", "D", "F"),
    ]
    return spark.createDataFrame(rows, "user_id string, ldap_month string, role string, department string, functional_unit string")


def test_changes_terminations_and_profile(snapshots):
    changes = {(r["user_id"], r["ldap_month"]): tuple(r[2:]) for r in context.attribute_changes(snapshots).collect()}
    assert changes == {("a", "2023-12"): (1, 0, 0), ("a", "2024-01"): (0, 1, 0), ("c", "2024-01"): (1, 0, 0)}
    gone = {r["user_id"]: r["termination_month"] for r in context.terminations(snapshots).collect()}
    assert gone == {"b": "2024-01", "c": "2023-12"}
    roles = {r["user_id"]: r["role"] for r in context.latest_profile(snapshots).collect()}
    assert roles == {"a": "R2", "b": "R1", "c": "R9"}


def test_truth_flag_is_midnight_based_and_never_duplicates(spark):
    days = spark.createDataFrame([("u", date(2024, 1, d)) for d in (10, 11, 12)] + [("v", date(2024, 1, 11))], "user_id string, date date")
    spans = [("u", datetime(2024, 1, 10, 9), datetime(2024, 1, 11, 9)), ("u", datetime(2024, 1, 11), datetime(2024, 1, 11, 23))]
    truth = spark.createDataFrame(spans, "user_id string, start_date timestamp_ntz, end_date timestamp_ntz")
    got = sorted((r["user_id"], r["date"].day, r["is_insider"]) for r in context.flag_truth_days(days, truth).collect())
    assert got == [("u", 10, 0), ("u", 11, 1), ("u", 12, 0), ("v", 11, 0)]


def test_median_fill(spark):
    traits = spark.createDataFrame([("a", 1, 1, 1, 1, 1), ("b", 4, 2, 2, 2, 2)], "user_id string, O int, C int, E int, A int, N int")
    users = spark.createDataFrame([("a",), ("z",)], "user_id string")
    got = {r["user_id"]: r["openness"] for r in context.impute_traits(users, logs.traits(traits)).collect()}
    assert got == {"a": 1.0, "z": 2.5}


def test_union_needs_a_log_and_warns_without_http(spark):
    with pytest.raises(ValueError):
        logs.unify_events({})
    logon = spark.createDataFrame([("1", "1/2/2010 06:30:00", "u", "p", "Logon")], "id string, date string, user string, pc string, activity string")
    with pytest.warns(UserWarning, match="http"):
        out = logs.unify_events({"logon": logon})
    (r,) = out.collect()
    assert r["datetime"] == datetime(2010, 1, 2, 6, 30) and r["url"] is None and len(out.columns) == 13


def test_conversion_failure_is_collected(spark, tmp_path):
    from vigilume.schema import LOG_SCHEMAS

    (tmp_path / "file.csv").write_text("id,date,user,pc,filename,content\n1,01/02/2010 06:30:00,u,p,a.doc,\"x, y\"\n")
    done = logs.csv_to_parquet(
        spark,
        {
            "http": (str(tmp_path / "none.csv"), str(tmp_path / "http.parquet"), LOG_SCHEMAS["http"]),
            "file": (str(tmp_path / "file.csv"), str(tmp_path / "file.parquet"), LOG_SCHEMAS["file"]),
        },
    )
    assert (done["file"].rows, done["file"].kept) == (1, False) and done["http"].error
    found = logs.load_logs(spark, str(tmp_path))
    assert list(found) == ["file"] and found["file"].first()["content"] == "x, y"


def test_columns_are_found_by_name(spark, tmp_path):
    from vigilume.schema import LOG_SCHEMAS

    for kind, schema in LOG_SCHEMAS.items():
        names = ["extra", *reversed(schema.names)]
        (tmp_path / f"{kind}.csv").write_text(",".join(names) + "\n" + ",".join(n.upper() for n in names) + "\n")
        row = logs.read_csv(spark, str(tmp_path / f"{kind}.csv"), schema).first().asDict()
        assert row == {n: n.upper() for n in schema.names}
    (tmp_path / "short.csv").write_text("id,date\n1,2\n")
    with pytest.raises(ValueError, match="has no column user"):
        logs.read_csv(spark, str(tmp_path / "short.csv"), LOG_SCHEMAS["logon"])


def test_incomplete_target_is_rewritten_and_a_complete_one_kept(spark, tmp_path):
    from vigilume.schema import LOG_SCHEMAS

    (tmp_path / "file.csv").write_text("id,date,user,pc,filename,content\n1,01/02/2010 06:30:00,u,p,a.doc,x\n")
    target = tmp_path / "file.parquet"
    job = {"file": (str(tmp_path / "file.csv"), str(target), LOG_SCHEMAS["file"])}
    target.mkdir()
    (target / "part-0.parquet").write_text("half")
    first, second = (logs.csv_to_parquet(spark, job)["file"] for _ in range(2))
    assert (first.rows, first.kept, second.rows, second.kept) == (1, False, 1, True)


def test_a_log_that_cannot_be_read_is_not_absent(spark, tmp_path):
    (tmp_path / "logon.parquet").write_text("no parquet")
    (tmp_path / "device.parquet").mkdir()
    found = logs.load_logs(spark, str(tmp_path))
    assert "http" not in found
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark says about the file
        found["logon"].count()


def test_snapshot_month_comes_from_the_file_name(spark, tmp_path):
    head = "employee_name,user_id,email,role,business_unit,functional_unit,department,team,supervisor\n"
    for month in ("2010-01", "2010-02"):
        (tmp_path / f"{month}.csv").write_text(head + "A,u,e,R,1,F,D,T,S\n")
    got = sorted(r["ldap_month"] for r in logs.read_snapshots(spark, str(tmp_path / "*.csv")).collect())
    assert got == ["2010-01", "2010-02"]
    assert logs.read_traits(spark, str(tmp_path / "psychometric.csv")) is None


def test_date_range_reads_only_its_folders(spark, events, tmp_path):
    ev = events(*[(f"2024-0{m}-05T10:00:00", "u", "p", "Http") for m in range(1, 7)])
    logs.write_events(ev, str(tmp_path / "events"))
    cfg = Settings(lookback=20, rolling_window=10)
    kept = logs.events_in_range(spark.read.parquet(str(tmp_path / "events")), "2024-05-01", "2024-05-31", cfg)
    assert sorted(r["datetime"].month for r in kept.collect()) == [4, 5]
    assert "PartitionFilters: [isnotnull(date" in kept._jdf.queryExecution().executedPlan().toString()
