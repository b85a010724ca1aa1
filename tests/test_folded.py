"""Users with several trait rows and several change rows in a month: days are folded, and nothing else changes."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from vigilume.config import Settings
from vigilume.functions.folded import FLAGS, SCORES, trait_copies, unfold
from vigilume.operators import context, daily, features as ft, scoring as sc, sessions as se, windows as wn

FIRST = date(2024, 1, 29)
CFG = Settings(rolling_window=3, profile_days=2)
CONTEXT = [*FLAGS, *SCORES]


@pytest.fixture
def parts(spark):
    """Merged days of three users; a has 2 trait rows and 3 change rows a month, b 1 and 4, c none."""
    names = [*daily.DAILY_COLUMNS, *se.SESSION]
    rows = [
        (u, FIRST + timedelta(days=i), i % 7, f"pc{i}", *[float(((k % 4 + 1) * i + ord(u)) % 5) for k in range(len(names))])
        for u, n in (("a", 6), ("b", 1), ("c", 4)) for i in range(n)
    ]
    days = spark.createDataFrame(rows, "user_id string, date date, dow int, pc string, " + ", ".join(f"{c} double" for c in names))
    snaps = [(u, f"R{(i + m) % 2}", "D", f"F{i}", month) for u, n in (("a", 3), ("b", 4)) for i in range(n) for m, month in enumerate(("2023-12", "2024-01", "2024-02"))]
    snapshots = spark.createDataFrame(snaps, "user_id string, role string, department string, functional_unit string, ldap_month string")
    traits = spark.createDataFrame([("a", 1, 2, 3, 4, 5), ("a", 9, None, 7, 6, 5), ("b", 2, 2, 2, 2, 2)], "user_id string, " + ", ".join(f"{s} int" for s in SCORES))
    return days, snapshots, traits


def rows_of(df, columns):
    return sorted(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_features_of_folded_days_are_those_of_the_rows_behind_them(parts):
    plain = ft.featured(context.enrich(*parts, None), CFG)
    folded = ft.featured(context.enrich_folded(*parts, None), CFG)
    assert plain.count() == 6 * 6 + 4 + 4
    assert folded.count() == 6 * CFG.rolling_window + 3 + 4  # not one row for each pair of a trait row and a change row
    back = unfold(folded)
    own = ["user_id", "date", "pc", *[c for c in CFG.vector if c not in CONTEXT]]
    assert rows_of(back, own) == rows_of(plain, own)
    assert rows_of(back, ["user_id", "date", *CONTEXT]) == rows_of(plain, ["user_id", "date", *CONTEXT])


def test_scaler_counts_folded_days_as_often_as_they_stand_for(parts):
    plain = ft.featured(context.enrich(*parts, None), CFG)
    folded = ft.featured(context.enrich_folded(*parts, None), CFG)
    want = {r["feature"]: (r["mean"], r["std"]) for r in ft.fit_scaler(plain, CFG.scaled).collect()}
    scaler = ft.fit_scaler(folded, CFG.scaled)
    got = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    assert set(got) == set(want) == set(CFG.scaled)
    for c, (mean, std) in want.items():
        assert got[c] == (pytest.approx(mean, abs=1e-9), pytest.approx(std, abs=1e-9)), c
    scaled = unfold(ft.apply_scaler(folded, scaler, CFG.scaled))
    columns = ["user_id", "date", *SCORES]
    assert rows_of(scaled, columns) == rows_of(ft.apply_scaler(plain, scaler, CFG.scaled), columns)


def test_copies_of_traits_and_least_days(parts, spark):
    folded = context.enrich_folded(*parts, None)
    assert {r["user_id"] for r in wn.min_days_filter(folded, 5).select("user_id").collect()} == {"a"}
    assert {r["user_id"] for r in wn.min_days_filter(folded, 4).select("user_id").collect()} == {"a", "b", "c"}
    some = spark.range(1).select(F.expr("array(named_struct('x', 1), named_struct('x', 2), named_struct('x', 3))").alias("_traits"), F.lit(4).alias("_first"), F.lit(7).alias("_copies"))
    assert some.select(trait_copies().alias("n")).first()["n"] == [2, 3, 2]  # pairs 4 to 10 hold traits 1, 2, 0, 1, 2, 0, 1


def test_errors_of_folded_days_follow_the_order_of_the_pairs(parts):
    columns = ["total_actions", "http_request_count_rolling_mean", "openness", "neuroticism", *FLAGS]
    folded = ft.featured(context.enrich_folded(*parts, None), CFG)
    rows = {}
    for r in folded.orderBy("user_id", "date", "_place").collect():
        for pair in range(r["_first"], r["_first"] + r["_copies"]):
            n = len(r["_traits"])
            held = {**r.asDict(), **r["_changes"][pair // n].asDict(), **r["_traits"][pair % n].asDict()}
            rows.setdefault(r["user_id"], []).append((r["date"], [float(held[c]) for c in columns]))
    want = []
    for user, own in rows.items():
        for i, (day, x) in enumerate(own):
            seen = [y for _, y in own[max(0, i - CFG.profile_days):i]]
            errors = [(v - sum(y[k] for y in seen) / len(seen)) ** 2 if seen else 0.0 for k, v in enumerate(x)]
            want.append((user, day, *[round(e, 6) + 0.0 for e in errors]))
    found = sc.profile_errors(folded, columns, CFG.profile_days)
    assert found.count() == 6 * (CFG.rolling_window + CFG.profile_days) + 4 + 4
    assert len({w[2:] for w in want if w[0] == "a"}) > 6
    assert rows_of(sc.unfold_errors(found, columns, CFG.profile_days), ["user_id", "date", *columns]) == sorted(want)
    mean = sorted((w[0], w[1], round(sum(w[2:]) / len(columns), 5)) for w in want)
    got = sorted((r["user_id"], r["date"], round(r["error"], 5)) for r in sc.day_error(found, columns, CFG.profile_days).collect())
    assert [g[:2] for g in got] == [m[:2] for m in mean] and all(abs(g[2] - m[2]) < 2e-5 for g, m in zip(got, mean))
