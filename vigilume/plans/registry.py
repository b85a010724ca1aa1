"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vigilume.config import CATEGORICAL, CONTEXT_ONLY, CYCLICAL, SESSION
from vigilume.functions.columns import with_scalars
from vigilume.functions.folded import FOLD, is_folded, map_traits, unfold
from vigilume.operators import (
    augment as ag, context, daily as dy, features as ft, metrics as mt, profiling as pr, scoring as sc, sessions as se,
    triage as tr, windows as wn,
)
from vigilume.plans.evaluation import evaluate, write_evaluation
from vigilume.plans.inference import calibration_limit, inference_features as run_features, score_range as run_scores, write_risk_report
from vigilume.plans.prepare import Inputs, Prepared, enriched_days, enriched_folded, merged_days, prepare, training_windows as cut_windows
from vigilume.schema import LOG_SCHEMAS, SNAPSHOT
from vigilume.session import shared_dir, stored
from vigilume.sources import artifacts, fixtures as fx, logs
from vigilume.streaming import daily as sd, sessions as ss

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CFG = fx.FIXTURE
RANGE = ("2024-01-25", "2024-01-28")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; folded days with their traits."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    done = {c: F.round(c, digits).alias(c) for c in doubles}
    if is_folded(df):
        done["_traits"] = map_traits(lambda _, x: F.round(x, digits))
    return df.select(*[done.get(c, F.col(c)) for c in df.columns])


def raw_logs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The test events split into five raw logs with text times, as the sources deliver them."""
    ev = fx.events(spark, d)
    base = [
        F.col("id").cast("string").alias("id"),
        F.date_format("datetime", "MM/dd/yyyy HH:mm:ss").alias("date"),
        F.col("user_id").alias("user"),
        "pc",
    ]
    fields = {"to": "to_addr"}
    members = {
        "logon": ("Logon", "Logoff"), "device": ("Connect", "Disconnect"),
        "email": ("Email",), "file": ("File",), "http": ("Http",),
    }
    out = {}
    for kind, names in members.items():
        own = [c for c in LOG_SCHEMAS[kind].names if c not in ("id", "date", "user", "pc")]
        out[kind] = ev.where(F.col("activity").isin(*names)).select(
            *base, *[F.col(fields.get(c, c)).cast("string").alias(c) for c in own]
        )
    return out


# --- sources ------------------------------------------------------------------------------------


@query
def ingest_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "csv")
    raw = raw_logs(spark, d)
    for kind, log in raw.items():
        # in another order, and with a column that isn't read: columns are found by name
        own = log.withColumn("from", F.lit("someone@example.org")).select("from", *reversed(log.columns))
        own.write.csv(f"{root}/{kind}.csv", header=True, escape='"')
    done = logs.csv_to_parquet(
        spark, {k: (f"{root}/{k}.csv", f"{root}/{k}.parquet", LOG_SCHEMAS[k]) for k in raw}
    )
    failed = {k: v.error for k, v in done.items() if v.error}
    if failed:
        raise RuntimeError(f"conversion failed: {failed}")
    return logs.unify_events(logs.load_logs(spark, root)).select(
        "id", "datetime", "user_id", "pc", "activity", "url", "filename", "to_addr", "attachments"
    )


@query
def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a conversion, and of a second one that finds its targets complete."""
    root = shared_dir(spark, "csv")
    raw = raw_logs(spark, d)
    for kind, log in raw.items():
        log.write.csv(f"{root}/{kind}.csv", header=True, escape='"')
    jobs = {k: (f"{root}/{k}.csv", f"{root}/{k}.parquet", LOG_SCHEMAS[k]) for k in raw}
    rows = [(k, c.rows, c.kept) for _ in range(2) for k, c in logs.csv_to_parquet(spark, jobs).items()]
    return spark.createDataFrame(rows, "log string, rows long, kept boolean")


@query
def ingest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Monthly directory files, one for each month, read by one glob; the month is in the file's name."""
    root = shared_dir(spark, "ldap")
    snaps = fx.snapshots(spark, d)
    missing = [c for c in SNAPSHOT.names if c not in snaps.columns]
    full = snaps.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{root}/LDAP"))
    for month in ("2023-11", "2023-12", "2024-01", "2024-02"):
        one = full.where(F.col("ldap_month") == month).select(*reversed(SNAPSHOT.names)).coalesce(1)
        one.write.csv(f"{root}/written/{month}", header=True, escape='"')
        (part,) = files.globStatus(path(f"{root}/written/{month}/part-*.csv"))
        files.rename(part.getPath(), path(f"{root}/LDAP/{month}.csv"))
    read = logs.read_snapshots(spark, f"{root}/LDAP/*.csv")
    return read.select("employee_name", "user_id", "role", "department", "functional_unit", "ldap_month")


@query
def ingest_truth(spark: SparkSession, d: str) -> DataFrame:
    """The label file, written with other columns and read by name."""
    home = shared_dir(spark, "answers")
    form = lambda c: F.date_format(c, "MM/dd/yyyy HH:mm:ss")
    raw = fx.labels(spark, d)
    raw.select(F.lit("x").alias("note"), *reversed(raw.columns)).write.csv(home, header=True, escape='"')
    return logs.read_truth(spark, home, CFG).select("dataset", "scenario", "user_id", form("start_date").alias("start"), form("end_date").alias("end"))


@query
def unified_events(spark: SparkSession, d: str) -> DataFrame:
    return logs.unify_events(raw_logs(spark, d)).drop("size", "content")


@query
def labels_load(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d)


@query
def lookup_encode(spark: SparkSession, d: str) -> DataFrame:
    names = {
        "FU0": "Administration", "FU1": "ResearchAndEngineering", "FU2": "Manufacturing",
        "FU3": "Finance", "FU4": "SalesAndMarketing",
    }
    unit = reduce(lambda c, kv: c.when(F.col("functional_unit") == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    profile = context.latest_profile(fx.snapshots(spark, d)).select("user_id", unit.otherwise("Unlisted").alias("functional_unit"))
    return logs.encode_units(profile, "functional_unit").select(
        "user_id", "functional_unit", F.coalesce("code", F.lit(-1)).alias("code")
    )


@query
def events_in_range(spark: SparkSession, d: str) -> DataFrame:
    return logs.events_in_range(fx.events(spark, d), *RANGE, CFG).select("id", "datetime", "user_id", "activity")


@query
def user_filter(spark: SparkSession, d: str) -> DataFrame:
    chosen = truth(spark, d).select("user_id").distinct()
    return logs.for_users(fx.events(spark, d), chosen).groupBy("user_id", "activity").agg(F.count("*").alias("n"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return logs.truth_intervals(fx.labels(spark, d), CFG)


def traits(spark: SparkSession, d: str) -> DataFrame:
    return logs.traits(fx.psychometric(spark, d))


# --- context ------------------------------------------------------------------------------------


@query
def latest_profile(spark: SparkSession, d: str) -> DataFrame:
    return context.latest_profile(fx.snapshots(spark, d))


@query
def attribute_changes(spark: SparkSession, d: str) -> DataFrame:
    return context.attribute_changes(fx.snapshots(spark, d))


@query
def terminated_users(spark: SparkSession, d: str) -> DataFrame:
    return context.terminations(fx.snapshots(spark, d))


@query
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    users = fx.snapshots(spark, d).select("user_id").distinct()
    return context.impute_traits(users, traits(spark, d))


@query
def insider_days(spark: SparkSession, d: str) -> DataFrame:
    days = fx.events(spark, d).select("user_id", F.to_date("datetime").alias("date")).distinct()
    return context.flag_truth_days(days, truth(spark, d))


@query
def enriched_daily(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d).select(
        "user_id", "date", "pc", "total_actions", "sess_count", "role", "department", "functional_unit",
        *CONTEXT_ONLY, "role_changed", "dept_changed", "functional_unit_changed", "terminated_flag", "is_insider",
    )


# --- daily activity and sessions ----------------------------------------------------------------


def daily(spark: SparkSession, d: str) -> DataFrame:
    return dy.daily_activity(fx.events(spark, d), CFG)


def session_table(spark: SparkSession, d: str) -> DataFrame:
    return se.sessions(fx.events(spark, d), CFG)


def session_feature_table(spark: SparkSession, d: str) -> DataFrame:
    return se.session_features(session_table(spark, d), fx.events(spark, d), CFG)


def inputs(spark: SparkSession, d: str) -> Inputs:
    return Inputs(fx.events(spark, d), fx.snapshots(spark, d), traits(spark, d), truth(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return merged_days(fx.events(spark, d), CFG)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return enriched_days(inputs(spark, d), CFG)


@query
def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(daily(spark, d).drop("pc"))


@query
def daily_file_types(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select(
        "user_id", "date", "file_copy_count", "exe_copy_count", "doc_copy_count", "archive_copy_count"
    )


@query
def daily_mode_pc(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select("user_id", "date", "pc")


@query
def peak_hour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dy.peak_hours(fx.events(spark, d)))


@query
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(session_table(spark, d).drop("session_id", "closed_by_logoff"))


@query
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return session_feature_table(spark, d).select(
        "user_id", "pc", "session_start", "session_event_count", "session_file_count", "session_email_count",
        "session_http_count", "session_usb_used", "session_external_email", "session_exe_copied",
        "session_unique_domains", "session_attachment_count",
    )


@query
def session_entropy(spark: SparkSession, d: str) -> DataFrame:
    features = se.session_features(session_table(spark, d), fx.events(spark, d), CFG, hosts=False)
    return rounded(features.select("user_id", "pc", "session_start", "session_event_entropy"))


def total_time(days: DataFrame) -> DataFrame:
    """A sum of minutes can end in a 5 behind the sixth digit, which the order of summation then rounds either way."""
    return days.withColumn("total_session_time", F.round("total_session_time", 5))


@query
def daily_session_stats(spark: SparkSession, d: str) -> DataFrame:
    features = se.session_features(session_table(spark, d), fx.events(spark, d), CFG, hosts=False)
    return rounded(total_time(se.daily_session_stats(features, CFG)))


@query
def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.session_gaps(session_table(spark, d)))


@query
def daily_merged(spark: SparkSession, d: str) -> DataFrame:
    return rounded(total_time(merged(spark, d).select("user_id", "date", *dy.DAILY_COLUMNS, *SESSION)))


# --- features -----------------------------------------------------------------------------------


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return prepare(inputs(spark, d), CFG).scaled(CFG)


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return prepare(inputs(spark, d), CFG).encoded(CFG)


def keys_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Days with their category values only."""
    days = dy.daily_activity(fx.events(spark, d), CFG).select("user_id", "date", "pc")
    profile = context.latest_profile(fx.snapshots(spark, d)).select("user_id", *context.PROFILE)
    return days.join(profile, "user_id", "left")


@query
def log_features(spark: SparkSession, d: str) -> DataFrame:
    logged = ft.log_features(enriched_folded(inputs(spark, d), CFG))
    return unfold(rounded(logged)).select("user_id", "date", *ft.LOGGED)


@query
def interaction_features(spark: SparkSession, d: str) -> DataFrame:
    days = daily(spark, d)
    return rounded(days.select("user_id", "date", *[e.alias(n) for n, e in ft.interaction_columns().items()]))


@query
def user_zscore(spark: SparkSession, d: str) -> DataFrame:
    days = ft.user_relative(ft.log_features(merged(spark, d)), CFG)
    return rounded(days.select("user_id", "date", *[f"{c}_zscore" for c in CFG.normalized]))


@query
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    days = ft.user_relative(ft.log_features(merged(spark, d)), CFG)
    kinds = [f"{c}_{k}" for c in CFG.normalized for k in ("rolling_mean", "rolling_std")]
    return rounded(days.select("user_id", "date", *kinds))


@query
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.calendar(daily(spark, d)).select("user_id", "date", *CYCLICAL, "is_weekend"))


@query
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    days = stored(keys_of_days(spark, d), "keys")
    out = ft.encode(days, stored(ft.fit_dictionary(days, CATEGORICAL), "dictionary"), CATEGORICAL, ft.frequent_values(days, CATEGORICAL))
    return out.select("user_id", "date", *[f"{c}_encoded" for c in CATEGORICAL])


@query
def encode_unseen(spark: SparkSession, d: str) -> DataFrame:
    days = stored(keys_of_days(spark, d), "keys")
    known = stored(ft.fit_dictionary(days.where(F.col("date") < "2024-01-08"), CATEGORICAL), "dictionary")
    return ft.encode(days, known, CATEGORICAL, ft.frequent_values(days, CATEGORICAL)).select("user_id", "date", *[f"{c}_encoded" for c in CATEGORICAL])


@query
def dictionary_sizes(spark: SparkSession, d: str) -> DataFrame:
    days = stored(keys_of_days(spark, d), "keys")
    return ft.dictionary_sizes(ft.fit_dictionary(days, CATEGORICAL), CATEGORICAL)


@query
def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    days = prepare(inputs(spark, d), CFG).scaled_folded(CFG)
    return unfold(rounded(days)).select("user_id", "date", "is_insider", *CFG.vector)


def saved_artifacts(spark: SparkSession, d: str) -> tuple[Prepared, artifacts.Artifacts]:
    """Fitted, written and loaded again."""
    ready = prepare(inputs(spark, d), CFG)
    home = shared_dir(spark, "artifacts")
    artifacts.save(home, ready.scaler, ready.dictionary(CFG), CFG)
    return ready, artifacts.load(spark, home)


@query
def apply_artifacts(spark: SparkSession, d: str) -> DataFrame:
    ready, fitted = saved_artifacts(spark, d)
    return unfold(rounded(fitted.apply(ready.days))).select("user_id", "date", *CFG.behavioural, *[f"{c}_encoded" for c in CATEGORICAL])


# --- windows ------------------------------------------------------------------------------------


def labelled_days(spark: SparkSession, d: str) -> DataFrame:
    """Active days with the truth flag, without any feature."""
    days = fx.events(spark, d).select("user_id", F.to_date("datetime").alias("date")).distinct()
    return context.flag_truth_days(days, truth(spark, d))


@query
def user_split(spark: SparkSession, d: str) -> DataFrame:
    return wn.split_users(labelled_days(spark, d), CFG)


def window_table(spark: SparkSession, d: str, lookback: int, stride: int) -> DataFrame:
    return wn.sliding_windows(encoded(spark, d), CFG.vector, [f"{c}_encoded" for c in CATEGORICAL], lookback, stride)


def over_days(feature: str, fold: Callable[[Column], Column]) -> Column:
    """Fold one feature over the days of a window."""
    at = CFG.vector.index(feature)
    return fold(F.transform("days", lambda day: F.get(day["x"], F.lit(at))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


@query
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = window_table(spark, d, CFG.lookback, CFG.stride)
    return rounded(
        w.select(
            "user_id", "seq_no", "label", "end_date", "padding",
            F.size("days").alias("n_days"),
            over_days("total_actions", total).alias("sum_actions"),
            over_days("sess_count", F.array_max).alias("max_sessions"),
        )
    )


@query
def padded_windows(spark: SparkSession, d: str) -> DataFrame:
    w = window_table(spark, d, 28, 5)
    at = CFG.vector.index("total_actions")
    weighted = F.aggregate("days", F.lit(0.0), lambda a, day: a + day["pos"] * F.get(day["x"], F.lit(at)))
    return rounded(
        w.select(
            "user_id", "seq_no", "label", "end_date", "padding",
            F.size("days").alias("n_days"),
            over_days("total_actions", total).alias("sum_actions"),
            weighted.alias("weighted_actions"),
        )
    )


@query
def window_labels(spark: SparkSession, d: str) -> DataFrame:
    return wn.window_labels(wn.window_days(labelled_days(spark, d), CFG.lookback, CFG.stride))


@query
def dense_windows(spark: SparkSession, d: str) -> DataFrame:
    days = scaled(spark, d).select("user_id", "date", "total_actions")
    return rounded(
        wn.window_totals(
            days, CFG.lookback, 1,
            first_date=F.min("date"), end_date=F.max("date"), n_days=F.count("*"), mean_actions=F.avg("total_actions"),
        ).drop("padding")
    )


@query
def min_days_filter(spark: SparkSession, d: str) -> DataFrame:
    days = fx.events(spark, d).select("user_id", F.to_date("datetime").alias("date")).distinct()
    return wn.min_days_filter(days, 26).groupBy("user_id").agg(F.count("*").alias("active_days"))


# --- augmentation -------------------------------------------------------------------------------


def augmented(spark: SparkSession, d: str, **chosen: bool) -> DataFrame:
    windows = stored(window_table(spark, d, CFG.lookback, CFG.stride), "windows")
    return ag.augment(windows, len(CFG.vector), CFG, **chosen)


def augmented_totals(copies: DataFrame) -> DataFrame:
    weights = F.transform(F.sequence(F.lit(1), F.lit(len(CFG.vector))), lambda i: i.cast("double"))

    def weighted(day: Column) -> Column:
        return total(F.zip_with(day["x"], weights, lambda x, w: x * w)) * (day["pos"] + 1)

    return rounded(
        copies.where(F.col("copy") > 0).select(
            "user_id", "seq_no", "copy",
            total(F.transform("days", lambda day: total(day["x"]))).alias("total"),
            total(F.transform("days", weighted)).alias("weighted"),
        ),
        3,
    )


@query
def augment_jitter(spark: SparkSession, d: str) -> DataFrame:
    return augmented_totals(augmented(spark, d, dropout=False, scale=False))


@query
def augment_dropout(spark: SparkSession, d: str) -> DataFrame:
    return augmented_totals(augmented(spark, d, jitter=False, scale=False))


@query
def augment_scale(spark: SparkSession, d: str) -> DataFrame:
    return augmented_totals(augmented(spark, d, jitter=False, dropout=False))


@query
def augment_counts(spark: SparkSession, d: str) -> DataFrame:
    return augmented(spark, d).groupBy("copy", "label").agg(F.count("*").alias("windows"))


# --- scoring ------------------------------------------------------------------------------------


def profile_error_table(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    days = prepare(inputs(spark, d), CFG).scaled_folded(CFG)
    return sc.profile_errors(days, CFG.vector if columns is None else columns, CFG.profile_days)


def day_errors(spark: SparkSession, d: str) -> DataFrame:
    return sc.day_error(profile_error_table(spark, d), CFG.behavioural, CFG.profile_days)


@query
def profile_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    shown = ["total_actions", "emails_sent", "sess_count", "mean_session_entropy", "http_request_count_zscore"]
    return rounded(sc.unfold_errors(profile_error_table(spark, d, shown), shown, CFG.profile_days).select("user_id", "date", *shown))


@query
def day_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(day_errors(spark, d).select("user_id", "date", "error"))


def window_scores(spark: SparkSession, d: str) -> DataFrame:
    return sc.window_score(day_errors(spark, d), CFG.lookback, CFG.stride, CFG)


@query
def window_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(window_scores(spark, d).drop("mean_error"))


@query
def window_mean_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(window_scores(spark, d).select("user_id", "seq_no", "end_date", "mean_error"))


def pca_days(spark: SparkSession, d: str, k: int = 8) -> tuple[DataFrame, sc.PCAModel]:
    ready = prepare(inputs(spark, d), CFG)
    vectors = sc.day_vectors(ready.scaled(CFG), CFG.behavioural).select("user_id", "date", "is_insider", "vector")
    train = vectors.join(ready.splits.where(F.col("split") == "train"), "user_id", "left_semi")
    return vectors, sc.fit_pca(train, k)


@query
def pca_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    vectors, model = pca_days(spark, d)
    errors = sc.pca_errors(vectors, model, len(CFG.behavioural))
    return rounded(sc.window_score(errors, CFG.lookback, CFG.stride, CFG))


@query
def batch_model_score(spark: SparkSession, d: str) -> DataFrame:
    vectors, model = pca_days(spark, d)
    days = vectors.select(
        "user_id", "date", "is_insider",
        *[F.get(sc.vector_to_array("vector"), F.lit(i)).alias(c) for i, c in enumerate(CFG.behavioural)],
    )
    windows = wn.sliding_windows(days, CFG.behavioural, [], CFG.lookback, CFG.stride)
    make = sc.linear_autoencoder(model.pc.toArray().tolist(), CFG.lookback, CFG)
    return rounded(sc.batch_score(windows, make, CFG.lookback, len(CFG.behavioural)))


@query
def window_embedding(spark: SparkSession, d: str) -> DataFrame:
    vectors, model = pca_days(spark, d)
    pooled = sc.window_embedding(model.transform(vectors), model.getK(), CFG.lookback, CFG.stride)
    return pooled.select("user_id", "seq_no", "end_date", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def fixed_basis() -> list[list[float]]:
    """Two orthonormal components over the behavioural features: the first two added, the next two subtracted."""
    half = 0.5**0.5
    rows = [[half, 0.0], [half, 0.0], [0.0, half], [0.0, -half]]
    return rows + [[0.0, 0.0]] * (len(CFG.behavioural) - 4)


def fixed_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Scaled days with their projection on the fixed basis."""
    days = prepare(inputs(spark, d), CFG).scaled(CFG)
    vectors = sc.day_vectors(days, CFG.behavioural)
    x = [F.get(sc.vector_to_array("vector"), F.lit(i)) for i in range(4)]
    half = F.lit(0.5**0.5)
    return vectors.withColumn("encoded", sc.array_to_vector(F.array((x[0] + x[1]) * half, (x[2] - x[3]) * half)))


@query
def fixed_basis_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """The linear reconstruction with components that SQL can write down."""
    errors = sc.projection_errors(fixed_encoding(spark, d), len(CFG.behavioural))
    return rounded(sc.window_score(errors, CFG.lookback, CFG.stride, CFG).select("user_id", "seq_no", "label", "end_date", "max_error", "score"))


@query
def fixed_model_score(spark: SparkSession, d: str) -> DataFrame:
    """A supplied model, loaded in each Python worker, over whole windows."""
    days = prepare(inputs(spark, d), CFG).scaled(CFG)
    windows = wn.sliding_windows(days, CFG.behavioural, [], CFG.lookback, CFG.stride)
    make = sc.linear_autoencoder(fixed_basis(), CFG.lookback, CFG)
    return rounded(sc.batch_score(windows, make, CFG.lookback, len(CFG.behavioural)).select("user_id", "seq_no", "score"))


@query
def fixed_window_embedding(spark: SparkSession, d: str) -> DataFrame:
    pooled = sc.window_embedding(fixed_encoding(spark, d), 2, CFG.lookback, CFG.stride)
    return rounded(pooled.select("user_id", "seq_no", "end_date", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second")))


@query
def embedding_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.mean_pool(fx.table(spark, d, "embeddings"), "label", "embedding"))


# --- thresholds and metrics ---------------------------------------------------------------------


def test_set(spark: SparkSession, d: str) -> DataFrame:
    return fx.scores(spark, d).where(F.col("label").isNotNull())


def calibration_set(spark: SparkSession, d: str) -> DataFrame:
    return fx.scores(spark, d).where(F.col("label").isNull())


def test_ladder(spark: SparkSession, d: str) -> DataFrame:
    return stored(mt.ladder(test_set(spark, d)), "ladder")


def all_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return mt.thresholds(test_ladder(spark, d), calibration_set(spark, d))


def judged_users(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the sixty fixture users, judged at their best F1."""
    own = fx.user_scores(spark, d).where(F.col("label").isNotNull())
    limit = mt.best_f1(mt.ladder(own)).select(F.lit("best_f1").alias("method"), "threshold", F.lit(True).alias("is_oracle"))
    return mt.judge(own, limit)


@query
def threshold_percentile_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from sketches stored by date, one date written after the others: is each one's rank within one percent?"""
    scored = calibration_set(spark, d)
    home = shared_dir(spark, "sketches")
    late = F.col("end_date") >= F.lit("2024-01-28").cast("date")
    artifacts.save_sketches(mt.score_sketches(scored.where(~late)), home)
    artifacts.save_sketches(mt.score_sketches(scored.where(late)), home)
    found = mt.sketched_percentiles(artifacts.load_sketches(spark, home), {"percentile_99": 0.99, "percentile_95": 0.95})
    ranks = with_scalars(scored, found.agg(F.collect_list(F.struct("method", "threshold")).alias("_found"))).select("score", F.inline("_found"))
    share = F.lit(0.01) + F.when(F.col("method") == "percentile_99", 0.99).otherwise(0.95)
    return ranks.groupBy("method").agg(
        F.count("*").alias("n"),
        ((F.count_if(F.col("score") < F.col("threshold")) <= F.first(share) * F.count("*"))
         & (F.count_if(F.col("score") <= F.col("threshold")) >= (F.first(share) - 0.02) * F.count("*"))).alias("within"),
    )


@query
def threshold_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.thresholds(None, calibration_set(spark, d), ["percentile_99", "percentile_95"]))


@query
def threshold_mean3std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.thresholds(None, calibration_set(spark, d), ["mean_plus_3std"]))


@query
def threshold_best_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.best_f1(mt.ladder(test_set(spark, d))))


@query
def threshold_fixed_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.thresholds(test_ladder(spark, d), calibration_set(spark, d), ["fixed_recall_95", "fixed_recall_99"]))


@query
def threshold_lookup(spark: SparkSession, d: str) -> DataFrame:
    cal = calibration_set(spark, d)
    known = mt.thresholds(None, cal, ["percentile_95", "mean_plus_3std"])
    parts = [
        mt.lookup_threshold(k, asked, cal).select(F.lit(asked).alias("asked"), "method", "threshold")
        for asked, k in (("percentile_95", known), ("best_f1", known), ("percentile_99", known.limit(0)))
    ]
    return rounded(reduce(DataFrame.unionByName, parts))


def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    steps = test_ladder(spark, d)
    return mt.threshold_metrics(steps, mt.thresholds(steps, calibration_set(spark, d)))


@query
def threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(threshold_table(spark, d))


@query
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.pr_curve(mt.ladder(test_set(spark, d))))


@query
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.roc_curve(mt.ladder(test_set(spark, d))))


@query
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.ranking_metrics(mt.ladder(test_set(spark, d))).select("auprc"))


@query
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.ranking_metrics(mt.ladder(test_set(spark, d))).select("auroc"))


@query
def score_separation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.score_separation(test_set(spark, d), test_ladder(spark, d)))


@query
def user_level_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.user_level_metrics(judged_users(spark, d)))


@query
def per_user_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.per_user_breakdown(judged_users(spark, d)))


def latencies(spark: SparkSession, d: str) -> DataFrame:
    return mt.detection_latency(mt.per_user_breakdown(judged_users(spark, d)), truth(spark, d))


@query
def detection_latency(spark: SparkSession, d: str) -> DataFrame:
    return latencies(spark, d).select(
        "user_id", "first_insider_date", "first_detection_date", "latency_hours", "latency_days",
        F.coalesce("scenario", F.lit(0)).alias("scenario"), "truth_start", "truth_end", "lead_time_hours",
    )


@query
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.latency_summary(mt.detection_latency(mt.per_user_breakdown(judged_users(spark, d)))))


@query
def per_scenario(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mt.per_scenario(judged_users(spark, d), truth(spark, d)))


@query
def exclude_scenarios(spark: SparkSession, d: str) -> DataFrame:
    kept = mt.exclude_scenarios(fx.user_scores(spark, d), truth(spark, d), [1, 3])
    return kept.groupBy("user_id").agg(F.count("*").alias("windows"))


@query
def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    return mt.session_metrics(judged_users(spark, d), session_table(spark, d), truth(spark, d))


# --- triage -------------------------------------------------------------------------------------


@query
def severity(spark: SparkSession, d: str) -> DataFrame:
    return tr.user_risk(judged_users(spark, d)).select("user_id", "severity")


@query
def user_risk(spark: SparkSession, d: str) -> DataFrame:
    return tr.user_risk(judged_users(spark, d))


@query
def top_windows(spark: SparkSession, d: str) -> DataFrame:
    return tr.top_windows(judged_users(spark, d))


@query
def top_k_users(spark: SparkSession, d: str) -> DataFrame:
    return tr.top_users(tr.user_risk(judged_users(spark, d)), 10)


@query
def risk_report_counts(spark: SparkSession, d: str) -> DataFrame:
    return tr.severity_counts(tr.user_risk(judged_users(spark, d)))


def judged_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Daily errors and windows judged at the 90th percentile of all window scores."""
    errors = profile_error_table(spark, d)
    errors = stored(errors.select("user_id", "date", "is_insider", *[c for c in errors.columns if c in (*CFG.vector, *FOLD)]), "errors")
    scored = sc.window_score(sc.day_error(errors, CFG.behavioural, CFG.profile_days), CFG.lookback, CFG.stride, CFG)
    scored = stored(scored.select("user_id", "seq_no", F.lit(0).alias("copy"), "end_date", "label", F.round("score", 6).alias("score")), "scores")
    limit = mt.percentiles(mt.ladder(scored), {"threshold": 0.9})
    return sc.unfold_errors(errors, CFG.vector, CFG.profile_days), mt.judge(scored, limit.select(F.lit("percentile_90").alias("method"), "threshold"))


@query
def risk_indicators(spark: SparkSession, d: str) -> DataFrame:
    errors, judged = judged_windows(spark, d)
    found = tr.risk_indicators(errors, judged, CFG.vector, CFG.lookback, CFG.stride)
    return found.select("user_id", F.array_join("indicators", "; ").alias("indicators"))


def drilldown(spark: SparkSession, d: str) -> DataFrame:
    """Sessions behind the windows that reach the median score."""
    own = fx.user_scores(spark, d).where(F.col("label").isNotNull())
    median = mt.percentiles(mt.ladder(own), {"threshold": 0.5})
    judged = mt.judge(own, median.select(F.lit("median").alias("method"), "threshold"))
    return tr.session_drilldown(judged, session_table(spark, d), fx.events(spark, d), CFG)


@query
def session_drilldown(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform(
        "events", lambda e: F.concat_ws(" ", F.date_format(e["time"], "yyyy-MM-dd HH:mm:ss"), e["type"], e["detail"])
    )
    return drilldown(spark, d).select(
        "user_id", "date", "pc", "session_start", "session_end", "duration_min", "risk", "summary",
        F.array_join("indicators", "; ").alias("indicators"), F.array_join(shown, "; ").alias("events"),
    )


@query
def session_drilldown_dated(spark: SparkSession, d: str) -> DataFrame:
    """The drill-down over a log stored by date: only the folders of the sessions' dates are read."""
    home = shared_dir(spark, "dated-events")
    logs.write_events(fx.events(spark, d), home)
    own = fx.user_scores(spark, d).where(F.col("label").isNotNull() & (F.col("end_date") < F.lit("2024-01-08").cast("date")))
    median = mt.percentiles(mt.ladder(own), {"threshold": 0.5})
    judged = mt.judge(own, median.select(F.lit("median").alias("method"), "threshold"))
    found = tr.session_drilldown(judged, session_table(spark, d), spark.read.parquet(home), CFG)
    return found.select("user_id", "date", "pc", "session_start", "session_end", "duration_min", "risk", "summary")


def shown_window(score: str, day: str) -> Callable[[Column], Column]:
    """A window of a report as text: rank, score in millionths and the day it ends."""
    return lambda w: F.concat_ws(" ", w["rank"], F.round(w[score] * 1_000_000).cast("long"), w[day].cast("string"))


@query
def alert_report(spark: SparkSession, d: str) -> DataFrame:
    """Alerts and their sessions through the JSON sink, read back and flattened."""
    home = shared_dir(spark, "alerts")
    judged = judged_users(spark, d)
    breakdown = mt.detection_latency(mt.per_user_breakdown(judged), truth(spark, d))
    drill = stored(drilldown(spark, d), "drilldown")
    errors, windows = judged_windows(spark, d)
    found = tr.risk_indicators(errors, windows, CFG.vector, CFG.lookback, CFG.stride)
    nested = tr.alerts(breakdown, judged, indicators=found, truth=truth(spark, d), drilldown=drill)
    artifacts.save_report(nested, f"{home}/alerts")
    back = spark.read.schema(nested.schema).json(f"{home}/alerts")
    sessions = tr.alert_sessions(back, drill)
    artifacts.save_report(sessions, f"{home}/sessions")
    counts = spark.read.schema(sessions.schema).json(f"{home}/sessions").groupBy("alert_id").agg(F.count("*").alias("n_sessions"))
    return rounded(
        back.join(counts, "alert_id", "left").select(
            "alert_id", "severity", "user_id", "detection_summary.*",
            F.size("top_anomalous_windows").cast("long").alias("n_windows"),
            F.get("top_anomalous_windows", F.lit(0))["anomaly_score"].alias("best_score"),
            F.array_join(F.transform("top_anomalous_windows", shown_window("anomaly_score", "timestamp")), "; ").alias("windows"),
            F.array_join("risk_indicators", "; ").alias("risk_indicators"),
            F.coalesce("scenario", F.lit(0)).alias("scenario"), F.coalesce("scenario_description", F.lit("")).alias("scenario_description"),
            F.col("ground_truth_window.start").alias("truth_start"), F.col("ground_truth_window.end").alias("truth_end"),
            F.greatest(F.size("session_drilldown"), F.lit(0)).cast("long").alias("n_days"),
            F.coalesce("n_sessions", F.lit(0).cast("long")).alias("n_sessions"),
        )
    )


@query
def alert_report_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of flagged users where no truth is known."""
    judged = judged_users(spark, d).drop("label")
    nested = tr.alerts(tr.flagged_users(judged), judged)
    return rounded(nested.select("alert_id", "severity", "user_id", "detection_summary.*", F.size("top_anomalous_windows").cast("long").alias("n_windows")))


@query
def alert_summary(spark: SparkSession, d: str) -> DataFrame:
    judged = judged_users(spark, d)
    breakdown = mt.per_user_breakdown(judged)
    return rounded(tr.alert_summary(tr.alerts(breakdown, judged), breakdown, judged, "best_f1"))


# --- profiling ----------------------------------------------------------------------------------


@query
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    snaps = fx.snapshots(spark, d)
    return pr.table_counts(
        spark,
        {
            "events": fx.events(spark, d), "users": context.latest_profile(snaps), "insiders": truth(spark, d),
            "psychometric": traits(spark, d), "user_changes": context.attribute_changes(snaps),
            "terminated_users": context.terminations(snaps), "sessions": session_table(spark, d), "activity_encoding": None,
        },
    )


@query
def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.numeric_profile(fx.table(spark, d, "lineitem")), 4)


@query
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return pr.top_values(fx.events(spark, d).drop("content"))


@query
def event_overview(spark: SparkSession, d: str) -> DataFrame:
    return pr.event_overview(fx.events(spark, d))


@query
def top_users_sample(spark: SparkSession, d: str) -> DataFrame:
    return pr.top_users_sample(fx.events(spark, d))


@query
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "source", F.regexp_replace("text", r"\s", " ").alias("text"))
    return pr.sample_rows(docs.orderBy("doc_id"))


@query
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    snaps = fx.snapshots(spark, d)
    return pr.context_summary(truth(spark, d), traits(spark, d), context.attribute_changes(snaps), context.terminations(snaps))


@query
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.score_histogram(test_set(spark, d), test_ladder(spark, d)))


@query
def chart_threshold_long(spark: SparkSession, d: str) -> DataFrame:
    metrics = threshold_table(spark, d)
    return rounded(pr.long_form(metrics, ["method", "is_oracle"], ["precision", "recall", "f1", "fpr", "fnr"]))


@query
def chart_scenario_long(spark: SparkSession, d: str) -> DataFrame:
    scenarios = mt.per_scenario(judged_users(spark, d), truth(spark, d))
    return rounded(pr.long_form(scenarios, ["scenario"], ["sequence_recall", "user_recall"]))


@query
def chart_confusion(spark: SparkSession, d: str) -> DataFrame:
    return pr.confusion_cells(mt.confusion(judged_users(spark, d)))


@query
def chart_session_confusion(spark: SparkSession, d: str) -> DataFrame:
    return pr.session_confusion(mt.session_metrics(judged_users(spark, d), session_table(spark, d), truth(spark, d)))


@query
def chart_timeline(spark: SparkSession, d: str) -> DataFrame:
    return pr.timeline(latencies(spark, d))


@query
def chart_scatter(spark: SparkSession, d: str) -> DataFrame:
    return pr.scatter_points(test_set(spark, d), CFG.seed)


# --- inference and streaming --------------------------------------------------------------------


@query
def inference_features(spark: SparkSession, d: str) -> DataFrame:
    _, fitted = saved_artifacts(spark, d)
    users = truth(spark, d).select("user_id").distinct()
    days = run_features(inputs(spark, d), CFG, fitted, users=users, date_range=RANGE)
    return unfold(rounded(days)).select("user_id", "date", *CFG.behavioural, *[f"{c}_encoded" for c in CATEGORICAL])


@query
def score_range(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: fit on training users, then score a date range and rank its users by risk."""
    ready, fitted = saved_artifacts(spark, d)
    limit = stored(calibration_limit(ready, CFG), "limit")
    days = stored(run_features(inputs(spark, d), CFG, fitted, date_range=RANGE), "range")
    return run_scores(days, limit, CFG)


@query
def risk_report(spark: SparkSession, d: str) -> DataFrame:
    """A scored date range written as a report, its users read back."""
    ready, fitted = saved_artifacts(spark, d)
    limit = stored(calibration_limit(ready, CFG), "limit")
    days = stored(run_features(inputs(spark, d), CFG, fitted, date_range=RANGE), "range")
    home = shared_dir(spark, "risk-report")
    write_risk_report(days, limit, "percentile_95", CFG, home)
    window = "struct<rank:int,score:double,date:date>"
    schema = (
        "user_id string, severity string, anomaly_score_max double, anomaly_score_mean double, total_sequences long, flagged_sequences long, "
        f"detection_rate double, top_anomalous_windows array<{window}>, indicators array<string>"
    )
    users = spark.read.schema(schema).json(f"{home}/users")
    return users.select(
        "user_id", "severity", "anomaly_score_max", "anomaly_score_mean", "total_sequences", "flagged_sequences", "detection_rate",
        F.array_join(F.transform("top_anomalous_windows", shown_window("score", "date")), "; ").alias("windows"),
        F.coalesce(F.array_join("indicators", "; "), F.lit("")).alias("indicators"),
    )


@query
def risk_report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Scores, severities and metadata of the same report, by a few counts of each."""
    ready, fitted = saved_artifacts(spark, d)
    limit = stored(calibration_limit(ready, CFG), "limit")
    days = stored(run_features(inputs(spark, d), CFG, fitted, date_range=RANGE), "range")
    home = shared_dir(spark, "risk-report")
    write_risk_report(days, limit, "percentile_95", CFG, home)
    scored = artifacts.load_scores(spark, f"{home}/scores").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(
        F.inline(F.array(*[F.struct(F.lit(f"score {c}").alias("item"), F.col(c).alias("value")) for c in ("n", "users")]))
    )
    levels = spark.read.schema("severity string, users long").json(f"{home}/by_severity").select(F.concat(F.lit("severity "), "severity").alias("item"), F.col("users").alias("value"))
    names = ("total_users", "flagged_users", "total_sequences", "flagged_sequences")
    meta = spark.read.schema(", ".join(f"{n} long" for n in names)).json(f"{home}/metadata")
    whole = meta.select(F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in names])))
    return scored.unionByName(levels).unionByName(whole)


@query
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The parts of an evaluation written and read back: one row for each number."""
    own = fx.user_scores(spark, d)
    report = evaluate(own.where(F.col("label").isNotNull()), own.where(F.col("label").isNull()), truth(spark, d), session_table(spark, d))
    home = shared_dir(spark, "evaluation")
    write_evaluation(report, home)
    keys = {"per_user_results": "user_id", "per_scenario_results": "scenario"}
    parts = ["user_level_metrics", "detection_latency_summary", "per_scenario_results", "session_level_metrics", "per_user_results"]
    out = []
    for part in parts:
        schema = report[part].schema
        table = spark.read.schema(schema).json(f"{home}/{part}")
        key = keys.get(part)
        kinds = (T.LongType, T.IntegerType, T.DoubleType)
        numbers = [f.name for f in schema.fields if isinstance(f.dataType, kinds) and f.name != key and not (part == "per_user_results" and f.name == "scenario")]
        item = F.col(key).cast("string") if key else F.lit("")
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers])
        out.append(table.select(F.lit(part).alias("part"), item.alias("item"), F.inline(cells)))
    return rounded(reduce(DataFrame.unionByName, out).where(F.col("value").isNotNull()), 4)


@query
def saved_days(spark: SparkSession, d: str) -> DataFrame:
    """Scaled days written by split; the validation split read back."""
    ready = prepare(inputs(spark, d), CFG)
    home = shared_dir(spark, "days")
    artifacts.save_days(ready.scaled(CFG), ready.splits, home)
    return rounded(artifacts.load_days(spark, home, "val").select("user_id", "date", "split", "total_actions", "sess_count"))


@query
def saved_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions written twice, the second time replacing the first, and read back."""
    home = shared_dir(spark, "saved-sessions")
    found = session_table(spark, d)
    artifacts.save_sessions(found.limit(0), home)
    artifacts.save_sessions(found, home)
    return rounded(artifacts.load_sessions(spark, home).drop("session_id", "closed_by_logoff"))


@query
def saved_scores(spark: SparkSession, d: str) -> DataFrame:
    home = shared_dir(spark, "saved-scores")
    _, judged = judged_windows(spark, d)
    artifacts.save_scores(judged.select("user_id", "seq_no", "end_date", "score"), home)
    return artifacts.load_scores(spark, home)


@query
def training_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of all splits behind the guard against leaks, by split."""
    cut = cut_windows(prepare(inputs(spark, d), CFG), CFG)
    return cut.groupBy("split").agg(F.count("*").alias("windows"), F.max("label").cast("long").alias("positive"), F.countDistinct("user_id").alias("users"))


def event_stream(spark: SparkSession, d: str, batches: int = 10) -> DataFrame:
    """The test events as a source that delivers them in so many batches, by time."""
    events = spark.read.schema(fx.SCHEMAS["events"]).parquet(f"{d}/events.parquet")
    home = shared_dir(spark, "arrivals")
    first, last = events.select(F.min("ts"), F.max("ts")).first()
    edges = [first + (last - first) * i / batches for i in range(1, batches)]
    # one after the other, as a source hands files on by their age
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        after = F.lit(True) if low is None else F.col("ts") >= F.lit(low).cast("timestamp_ntz")
        before = F.lit(True) if high is None else F.col("ts") < F.lit(high).cast("timestamp_ntz")
        events.where(after & before).coalesce(1).write.parquet(f"{home}/arrival={i}")
    return fx.events_from(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/arrival=*"))


@query
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    counts = sd.live_daily(event_stream(spark, d), CFG)
    return sd.run_available(counts, ["user_id", "date"])


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = ss.live_sessions(event_stream(spark, d), CFG)
    return rounded(sd.run_available(found, ss.SESSION_KEYS).drop("nth"))
