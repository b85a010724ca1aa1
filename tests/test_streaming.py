from datetime import datetime, timedelta

import pytest

from vigilume.config import Settings
from vigilume.operators import daily, sessions as se
from vigilume.streaming import daily as sd, sessions as ss

CFG = Settings()


def as_stream(spark, batches, path):
    """Files with rising times, read one per trigger."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    schema = batches[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_daily_counts_over_several_batches(spark, events, tmp_path):
    first = events(("2024-01-01T09:00:00", "u", "p", "Logon"), ("2024-01-01T10:00:00", "u", "p", "Email"), ("2024-01-02T23:00:00", "v", "p", "Http"))
    second = events(("2024-01-02T23:30:00", "v", "p", "Http"), ("2024-01-03T08:00:00", "u", "p", "File"))
    counts = sd.live_daily(as_stream(spark, [first, second], str(tmp_path)), CFG)
    got = {(r["user_id"], r["date"]): r["total_actions"] for r in sd.run_available(counts, ["user_id", "date"]).collect()}
    want = {(r["user_id"], r["date"]): r["total_actions"] for r in daily.daily_activity(first.unionByName(second), CFG).collect()}
    assert got == want


def sessions_of(df):
    columns = ("user_id", "pc", "session_start", "session_end", "session_date", "hour_of_start", "duration_min", "is_after_hours")
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_sessions_equal_the_batch_operator(spark, events, tmp_path, zone):
    start = datetime(2024, 1, 1)
    marks = [((start + timedelta(hours=h)).isoformat(), "u", "p", a) for h, a in ((1, "Logon"), (1, "Logon"), (3, "Logoff"), (20, "Logon"), (25, "Logoff"), (30, "Logon"), (43, "Logoff"))]
    marks += [((start + timedelta(hours=46)).isoformat(), u, p, "Logon") for u, p in (("u", "p"), ("v", None))]
    # a late Logoff that comes before a known one, and the newest sessions, whose bins are still open
    last = [((start + timedelta(hours=2)).isoformat(), "u", "p", "Logoff"), ((start + timedelta(hours=47)).isoformat(), "u", "p", "Logoff")]
    last += [((start + timedelta(hours=47)).isoformat(), "v", None, "Logoff")]
    one_day, later = events(*marks), events(*last)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        live = ss.live_sessions(as_stream(spark, [one_day, later], str(tmp_path)), CFG)
        got = sessions_of(sd.run_available(live, ss.SESSION_KEYS))
        want = sessions_of(se.sessions(one_day.unionByName(later), CFG))
        counts = sd.live_daily(as_stream(spark, [one_day, later], str(tmp_path / "daily")), CFG)
        days = {(r["user_id"], r["date"]): (r["total_actions"], r["after_hours_actions"]) for r in sd.run_available(counts, ["user_id", "date"]).collect()}
        batch = daily.daily_activity(one_day.unionByName(later), CFG)
        assert days == {(r["user_id"], r["date"]): (r["total_actions"], r["after_hours_actions"]) for r in batch.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want and len(got) == 6


def test_live_domains_are_exact_over_batches(spark, events, tmp_path):
    """A host met again after more than the lateness, in another batch, still counts once for its day."""
    visit = lambda t, host: (t, "u", "p", "Http", {"url": f"http://{host}/x"})
    batches = [
        events(visit("2024-01-01T01:00:00", "a.org"), visit("2024-01-01T01:05:00", "a.org:80")),
        events(visit("2024-01-01T12:00:00", "b.org"), ("2024-01-01T13:00:00", "u", "p", "Http")),
        events(visit("2024-01-01T23:00:00", "a.org"), visit("2024-01-02T01:00:00", "a.org")),
        events(visit("2024-01-02T02:00:00", "c.org"), ("2024-01-02T03:00:00", "v", "p", "Email")),
    ]
    counts = sd.live_daily(as_stream(spark, batches, str(tmp_path)), CFG, late="1 hour")
    got = {(r["user_id"], str(r["date"])): (r["total_actions"], r["unique_domains"]) for r in sd.run_available(counts, ["user_id", "date"]).collect()}
    assert got == {("u", "2024-01-01"): (5, 2), ("u", "2024-01-02"): (2, 2), ("v", "2024-01-02"): (1, 0)}


def test_state_written_follows_the_new_marks(spark, events, tmp_path, monkeypatch):
    """Six batches of as many marks of one bin write as much state each, however many marks the bin holds already."""
    monkeypatch.setattr(sd, "shared_dir", lambda spark, label: str(tmp_path / label))
    start = datetime(2024, 1, 1, 1)
    marks = [((start + timedelta(seconds=10 * i)).isoformat(), "u", "p", "Logoff" if i % 3 else "Logon") for i in range(1200)]
    batches = [events(*marks[k : k + 200]) for k in range(0, 1200, 200)]
    live = ss.live_sessions(as_stream(spark, batches, str(tmp_path / "in")), CFG)
    assert sd.run_available(live, ss.SESSION_KEYS).count() == 400
    written = {}
    for path in (tmp_path / "stream" / "checkpoint" / "state").rglob("*.changelog"):
        version = int(path.name.split(".")[0].split("_")[0])
        written[version] = written.get(version, 0) + path.stat().st_size
    sizes = [written[v] for v in sorted(written)][:6]
    assert len(sizes) == 6 and max(sizes[1:]) <= 1.5 * min(sizes[1:])
