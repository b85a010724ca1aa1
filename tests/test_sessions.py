import math
import random
from datetime import datetime, timedelta

from vigilume.config import Settings
from vigilume.operators import sessions as se

CFG = Settings()


def ends(df):
    return {(r["pc"], r["session_start"].isoformat()): r["session_end"].isoformat() for r in df.collect()}


def test_pairing_rules(events):
    ev = events(
        ("2024-01-01T08:00:00", "u", "two", "Logon"), ("2024-01-01T09:00:00", "u", "two", "Logon"), ("2024-01-01T10:00:00", "u", "two", "Logoff"),
        ("2024-01-01T08:00:00", "u", "none", "Logon"),
        ("2024-01-01T08:00:00", "u", "edge", "Logon"), ("2024-01-01T20:00:00", "u", "edge", "Logoff"),
        ("2024-01-01T08:00:00", "u", "over", "Logon"), ("2024-01-01T20:00:00.000001", "u", "over", "Logoff"),
        ("2024-01-01T08:00:00", "u", "same", "Logoff"), ("2024-01-01T08:00:00", "u", "same", "Logon"),
        ("2024-01-01T23:00:00", "u", "night", "Logon"), ("2024-01-02T05:00:00", "u", "night", "Logoff"),
        ("2024-01-01T23:59:59.5", "u", "late", "Logon"),
        ("2024-01-01T08:00:00", "u", None, "Logon"), ("2024-01-01T09:00:00", "u", None, "Logoff"),
        ("2024-01-01T07:00:00", "u", "orphan", "Logoff"),
    )
    got = ends(se.sessions(ev, CFG))
    day_end = "2024-01-01T23:59:59"
    assert got == {
        ("two", "2024-01-01T08:00:00"): "2024-01-01T10:00:00",
        ("two", "2024-01-01T09:00:00"): "2024-01-01T10:00:00",
        ("none", "2024-01-01T08:00:00"): day_end,
        ("edge", "2024-01-01T08:00:00"): "2024-01-01T20:00:00",
        ("over", "2024-01-01T08:00:00"): day_end,
        ("same", "2024-01-01T08:00:00"): day_end,
        ("night", "2024-01-01T23:00:00"): "2024-01-02T05:00:00",
        ("late", "2024-01-01T23:59:59.500000"): day_end,
        (None, "2024-01-01T08:00:00"): day_end,
    }


def test_duration_is_capped_and_repeated_logons_are_kept(events):
    ev = events(("2024-01-01T01:00:00", "u", "p", "Logon"), ("2024-01-01T01:00:00", "u", "p", "Logon"))
    rows = se.sessions(ev, CFG).collect()
    assert [r["duration_min"] for r in rows] == [720.0, 720.0]
    assert len({r["session_id"] for r in rows}) == 2
    assert all(r["is_after_hours"] == 1 for r in rows)


def brute(rows, cfg):
    """Session features by comparing every session with every event."""
    out = {}
    for t, user, pc, activity, _ in rows:
        if activity != "Logon":
            continue
        offs = [x[0] for x in rows if x[1:4] == (user, pc, "Logoff") and t < x[0] <= t + timedelta(hours=cfg.pairing_hours)]
        end = min(offs) if offs else datetime(t.year, t.month, t.day, 23, 59, 59)
        inside = [x for x in rows if x[1] == user and x[2] == pc and x[3] not in ("Logon", "Logoff") and t <= x[0] <= end]
        n = {a: sum(x[3] == a for x in inside) for a in {x[3] for x in inside}}
        share = [c / len(inside) for c in n.values()] if inside else []
        hosts = {x[4]["url"].split("/")[2].split(":")[0] for x in inside if x[3] == "Http" and x[4].get("url")}
        out[(user, pc, t)] = (
            len(inside), n.get("File", 0), n.get("Email", 0), n.get("Http", 0), int(n.get("Connect", 0) > 0),
            len(hosts), round(-sum(p * math.log2(p) for p in share), 9) + 0.0,
        )
    return out


def test_features_equal_brute_force_on_overlapping_sessions(events):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows, seen = [], set()
    while len(rows) < 900:
        # whole quarters of an hour make borders and events meet often
        t = start + timedelta(minutes=15 * rng.randrange(0, 4 * 24 * 3))
        user, pc = rng.choice("ab"), rng.choice(("p", "q"))
        kind = rng.choices(["Logon", "Logoff", "Http", "Email", "File", "Connect", "Disconnect"], [4, 3, 10, 2, 2, 1, 1])[0]
        if kind in ("Logon", "Logoff"):
            if (t, user, pc, kind) in seen:
                continue
            seen.add((t, user, pc, kind))
        extra = {"url": f"http://h{rng.randrange(12)}.org:80/x"} if kind == "Http" else {}
        rows.append((t, user, pc, kind, extra))
    ev = events(*[(t.isoformat(), u, p, a, e) for t, u, p, a, e in rows])
    feats = se.session_features(se.sessions(ev, CFG), ev, CFG).collect()
    got = {
        (r["user_id"], r["pc"], r["session_start"]): (
            r["session_event_count"], r["session_file_count"], r["session_email_count"], r["session_http_count"],
            r["session_usb_used"], r["session_unique_domains"], round(r["session_event_entropy"], 9) + 0.0,
        )
        for r in feats
    }
    assert got == brute(rows, CFG)
    assert max(v[-1] for v in got.values()) <= math.log2(5) + 1e-9


def test_entropy_counts_every_activity(events):
    """Two activities without counts of their own are two classes of the mix, not one."""
    ev = events(
        ("2024-01-01T08:00:00", "u", "a", "Logon"), ("2024-01-01T12:00:00", "u", "a", "Logoff"),
        *[(f"2024-01-01T09:0{i}:00", "u", "a", kind) for i, kind in enumerate(("Print", "Print", "Scan", "Scan"))],
        ("2024-01-01T13:00:00", "u", "a", "Logon"), ("2024-01-01T14:00:00", "u", "a", "Print"),
    )
    rows = sorted(se.session_features(se.sessions(ev, CFG), ev, CFG).collect(), key=lambda r: r["session_start"])
    assert [(r["session_event_count"], r["session_event_entropy"]) for r in rows] == [(4, 1.0), (1, 0.0)]


def test_a_machine_with_most_marks_is_paired_right(events):
    """Nine marks in ten are of one machine within half a day."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1, 6)
    rows = []
    for i in range(1500):
        user, pc = ("u", "hot") if i % 10 else (rng.choice("vw"), rng.choice("pq"))
        rows.append((start + timedelta(seconds=rng.randrange(40_000), microseconds=i), user, pc, rng.choice(["Logon", "Logoff", "File"]), {}))
    ev = events(*[(t.isoformat(), u, p, a, e) for t, u, p, a, e in rows])
    feats = se.session_features(se.sessions(ev, CFG), ev, CFG).collect()
    got = {(r["user_id"], r["pc"], r["session_start"]): r["session_event_count"] for r in feats}
    assert got == {k: v[0] for k, v in brute([r for r in rows], CFG).items()}


def test_gap_uses_the_previous_session_and_ignores_overlap(events):
    ev = events(
        ("2024-01-01T08:00:00", "u", "a", "Logon"), ("2024-01-01T12:00:00", "u", "a", "Logoff"),
        ("2024-01-01T09:00:00", "u", "b", "Logon"), ("2024-01-01T10:00:00", "u", "b", "Logoff"),
        ("2024-01-01T11:00:00", "u", "c", "Logon"), ("2024-01-01T11:30:00", "u", "c", "Logoff"),
    )
    rows = se.session_gaps(se.sessions(ev, CFG)).collect()
    assert [r["longest_inter_session_gap"] for r in rows] == [60.0]
