from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from vigilume.config import Settings
from vigilume.operators import augment, features as ft, scoring as sc, windows as wn
from vigilume.session import stored
from vigilume.sources import artifacts

FIRST = date(2024, 1, 1)


@pytest.fixture
def days(spark):
    """Users with 1, 5, 7 and 12 active days; y is 1 on the last day of user d."""
    rows = [(u, FIRST + timedelta(days=2 * i), int(u == "d" and i == 11), float(i)) for u, n in (("a", 1), ("b", 5), ("c", 7), ("d", 12)) for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, date date, is_insider int, x double")


def test_window_counts_padding_and_labels(days):
    lookback, stride = 5, 3
    got = {(r["user_id"], r["seq_no"]): r for r in wn.window_labels(wn.window_days(days, lookback, stride)).collect()}
    assert sorted(got) == [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("d", 1), ("d", 2)]
    for u, n in (("b", 5), ("c", 7), ("d", 12)):
        assert sum(k[0] == u for k in got) == 1 + (n - lookback) // stride
    assert got[("a", 0)]["padding"] == 4 and got[("b", 0)]["padding"] == 0
    assert [got[("d", i)]["label"] for i in range(3)] == [0, 0, 0]
    dense = wn.window_labels(wn.window_days(days, lookback, 1)).where("user_id = 'd'").orderBy("seq_no").collect()
    assert len(dense) == 8 and [r["label"] for r in dense] == [0] * 7 + [1]


def test_padded_arrays(days):
    rows = wn.sliding_windows(days, ["x"], [], 5, 3).where("user_id = 'a'").collect()
    assert [(d["pos"], d["date"], d["x"]) for d in rows[0]["days"]] == [(i, None, [0.0]) for i in range(4)] + [(4, FIRST, [0.0])]


def test_splits_are_disjoint_sized_by_floor_and_leak_free(spark):
    rows = [(f"u{i:03d}", FIRST, int(i % 25 == 0)) for i in range(100)]
    days = spark.createDataFrame(rows, "user_id string, date date, is_insider int")
    splits = wn.split_users(days, Settings())
    got = {r["user_id"]: r["split"] for r in splits.collect()}
    assert len(got) == 100 and all(got[f"u{i:03d}"] == "test" for i in range(0, 100, 25))
    sizes = {s: list(got.values()).count(s) for s in ("train", "val", "test")}
    assert sizes == {"train": int(96 * 0.7), "val": int(96 * 0.15), "test": 100 - int(96 * 0.7) - int(96 * 0.15)}
    wn.check_clean_splits(wn.window_labels(wn.window_days(days, 1, 1)), splits)
    with pytest.raises(ValueError, match="positive windows"):
        wn.check_clean_splits(wn.window_labels(wn.window_days(days, 1, 1)), splits.withColumn("split", F.lit("val")))


def test_min_days(days):
    assert {r[0] for r in wn.min_days_filter(days, 7).select("user_id").distinct().collect()} == {"c", "d"}
    assert wn.min_days_filter(days, None) is days


def test_constant_feature_and_unknown_column(spark):
    days = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    scaler = ft.fit_scaler(days, ["a", "b"])
    assert {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()} == {"a": (2.0, 1.0), "b": (2.0, 1.0)}
    assert [tuple(r) for r in ft.apply_scaler(days, scaler, ["a", "b"]).collect()] == [(0.0, -1.0), (0.0, 1.0)]
    with pytest.raises(ValueError, match="differ"):
        ft.apply_scaler(days, scaler, ["a"])


def test_scaler_is_one_narrow_aggregate(spark):
    """However many features: two aggregates in all, with NULLs left out and a feature without values dropped."""
    names = [f"f{i}" for i in range(40)]
    rows = [(*[float(d * i) if (d + i) % 7 else None for i in range(39)], None) for d in range(9)]
    scaler = ft.fit_scaler(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names)
    plan = scaler._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1 and plan.count("stddev_pop(") == 1
    got = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    assert sorted(got) == sorted(names[:-1])
    for i, name in enumerate(names[:-1]):
        own = [r[i] for r in rows if r[i] is not None]
        mean = sum(own) / len(own)
        std = (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5
        assert got[name] == pytest.approx((mean, std if std >= 1e-8 else 1.0))
    assert ft.fit_scaler(spark.createDataFrame([], "a double"), ["a"]).collect() == []


def test_dictionary_null_last_and_unseen(spark):
    days = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "role string")
    codes = ft.fit_dictionary(days, ["role"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, None: 2}
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "role string")
    assert [r["role_encoded"] for r in ft.encode(new, codes, ["role"]).collect()] == [1, 3, 2]
    assert ft.dictionary_sizes(codes, ["role"]).first()["size"] == 3
    with pytest.raises(ValueError, match="no dictionary"):
        ft.dictionary_sizes(codes, ["role", "pc"])


def test_frequent_values_stay_out_of_the_shuffled_join(spark):
    """Nine days in ten have one role: codes are right, and with no broadcast of the dictionary no task gets most days."""
    rows = [(f"u{i}", "boss" if i % 10 else (None if i % 20 == 0 else f"r{i % 300:03d}")) for i in range(6000)]
    days = spark.createDataFrame(rows, "user_id string, role string")
    codes = stored(ft.fit_dictionary(days, ["role"]), "codes")
    frequent = ft.frequent_values(days, ["role"], most=4)
    assert "boss" in frequent["role"] and len(frequent["role"]) <= 4
    names = sorted({r for _, r in rows if r}) + [None]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for known in (frequent, {"role": [None, "boss"]}, {"role": []}):
            out = ft.encode(days, codes, ["role"], known)
            assert {(r.user_id, r.role_encoded) for r in out.collect()} == {(u, names.index(r)) for u, r in rows}
        tasks = [r["n"] for r in ft.encode(days, codes, ["role"], frequent).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == 6000 and max(tasks) <= 1.5 * 6000 / len(tasks) and len(tasks) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_artifacts_appear_all_at_once(spark, tmp_path, monkeypatch):
    cfg = Settings()
    scaler = lambda x: spark.createDataFrame([("a", float(x), 1.0)], "feature string, mean double, std double")
    codes = lambda x: spark.createDataFrame([("role", "r", x)], "feature string, value string, code int")
    home = str(tmp_path / "artifacts")
    assert artifacts.save(home, scaler(1), codes(1), cfg) == 1

    # the write breaks off between the tables
    with pytest.raises(Exception, match="does_not_exist"):
        artifacts.save(home, artifacts.load(spark, home).scaler, codes(2).select(F.raise_error(F.lit("does_not_exist")).alias("code")), cfg)
    found = artifacts.load(spark, home)
    assert artifacts.versions(spark, home) == [1] and found.scaler.first()["mean"] == 1.0 and found.dictionary.first()["code"] == 1
    assert artifacts.save(home, scaler(3), codes(3), cfg) == 2
    assert artifacts.load(spark, home).scaler.first()["mean"] == 3.0 and artifacts.load(spark, home, 1).dictionary.first()["code"] == 1
    # what was read before the second version stays as it was
    assert found.scaler.first()["mean"] == 1.0
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, home, 7)


def test_missing_artifacts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, str(tmp_path / "none"))


def test_profile_error_without_history_is_zero(days):
    errors = sc.profile_errors(days, ["x"], 3).where("user_id = 'b'").orderBy("date").collect()
    assert [r["x"] for r in errors] == [0.0, 1.0, 2.25, 4.0, 4.0]


def test_window_score_counts_padding(spark, days):
    scores = sc.window_score(days.withColumnRenamed("x", "error"), 5, 3, Settings())
    got = {(r["user_id"], r["seq_no"]): r["score"] for r in scores.collect()}
    assert got[("a", 0)] == 0.0 and got[("b", 0)] == pytest.approx(0.5 * 2 + 0.5 * 4)


def test_augmentation_only_copies_positives_and_repeats(spark, days):
    cfg = Settings(copies=3)
    windows = wn.sliding_windows(days, ["x"], [], 5, 1)
    out = augment.augment(windows, 1, cfg)
    counts = {(r["copy"], r["label"]): r["count"] for r in out.groupBy("copy", "label").count().collect()}
    assert counts == {(0, 0): 12, (0, 1): 1, (1, 1): 1, (2, 1): 1, (3, 1): 1}
    first = sorted(map(str, out.select("copy", "days").collect()))
    again = sorted(map(str, augment.augment(windows.repartition(7), 1, cfg).select("copy", "days").collect()))
    assert first == again
    assert augment.augment(windows, 1, cfg, enabled=False).count() == 13
    none = augment.augment(windows.where("label = 0"), 1, cfg)
    assert none.count() == 12


def test_gaussian_moments(spark):
    draws = spark.range(20_000).select(augment.gaussian(F.col("id")).alias("z"))
    r = draws.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03


def test_calibration_falls_back_to_training(spark):
    scored = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "user_id string, score double")
    splits = spark.createDataFrame([("a", "train"), ("b", "val")], "user_id string, split string")
    assert [r["user_id"] for r in sc.calibration_scores(scored, splits).collect()] == ["b"]
    assert [r["user_id"] for r in sc.calibration_scores(scored, splits.where("split = 'train'")).collect()] == ["a"]


def test_pca_error_equals_projection_residual(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    cols = ["p", "q", "r", "s"]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{c} double" for c in cols))
    vectors = sc.day_vectors(df, cols)
    model = sc.fit_pca(vectors, 2)
    got = np.array([r["error"] for r in sc.pca_errors(vectors, model, 4).collect()])
    p = model.pc.toArray()
    assert np.allclose(got, ((x - x @ p @ p.T) ** 2).mean(axis=1))


def test_windows_copy_no_days(spark, days):
    """Windows are framed on a user's days: no day is exploded into the windows that cover it."""
    encoded = sc.day_vectors(days, ["x"])
    model = sc.fit_pca(encoded, 1)
    for df in (wn.sliding_windows(days, ["x"], [], 5, 3), sc.window_embedding(model.transform(encoded), 1, 5, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("Exchange") == 1


def test_supplied_model_and_pooling_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    cols = ["p", "q", "r"]
    x = rng.normal(size=(6, 3))
    rows = [("u", FIRST + timedelta(days=i), 0, *map(float, v)) for i, v in enumerate(x)]
    days = spark.createDataFrame(rows, "user_id string, date date, is_insider int, p double, q double, r double")
    basis = np.linalg.qr(rng.normal(size=(3, 2)))[0]
    windows = wn.sliding_windows(days, cols, [], 4, 1)
    make = sc.linear_autoencoder(basis.tolist(), 4, Settings())
    got = {r["seq_no"]: r["score"] for r in sc.batch_score(windows, make, 4, 3).collect()}
    per_day = ((x - x @ basis @ basis.T) ** 2).mean(axis=1)
    assert got == {i: pytest.approx(0.5 * per_day[i : i + 4].mean() + 0.5 * per_day[i : i + 4].max()) for i in range(3)}

    vectors = sc.day_vectors(days, cols)
    model = sc.fit_pca(vectors, 2)
    z = x @ model.pc.toArray()
    encoded = model.transform(vectors)
    mean = {r["seq_no"]: r["embedding"] for r in sc.window_embedding(encoded, 2, 4, 1).collect()}
    last = {r["seq_no"]: r["embedding"] for r in sc.window_embedding(encoded, 2, 4, 1, "last").collect()}
    assert all(np.allclose(mean[i], z[i : i + 4].mean(axis=0)) and np.allclose(last[i], z[i + 3]) for i in range(3))
    with pytest.raises(ValueError):
        sc.window_embedding(encoded, 2, 4, 1, "max")
