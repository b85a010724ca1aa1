"""DuckDB SQL for the registered queries, written from the operator definitions.

``CTE`` holds named building blocks; ``with_ctes`` prepends those a query mentions.
"""

from __future__ import annotations

import re

from vigilume.config import BINARY, CATEGORICAL, CONTEXT_ONLY, CONTINUOUS, CYCLICAL, INTERACTION, SESSION, UNLOGGED
from vigilume.operators.daily import DAILY_COLUMNS
from vigilume.sources.fixtures import FIXTURE as P

TRAITS = CONTEXT_ONLY
CTE: dict[str, str] = {}


def r6(x: str) -> str:
    """Rounded to six digits, without a negative zero."""
    return f"(CASE WHEN abs({x}) < 5e-7 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def with_ctes(sql: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTE[name])

    visit(sql)
    if not needed:
        return sql
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in CTE if n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql


# --- inputs -------------------------------------------------------------------------------------

CTE["raw_k"] = """
SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events"""
CTE["raw_a"] = """
SELECT *, CASE event_type WHEN 'signup' THEN 'Logon' WHEN 'error' THEN 'Logoff' WHEN 'view' THEN 'Http'
  WHEN 'purchase' THEN 'Email'
  ELSE CASE k % 4 WHEN 2 THEN 'Connect' WHEN 3 THEN 'Disconnect' ELSE 'File' END END AS activity
FROM raw_k"""
CTE["ev"] = """
SELECT event_id AS id, ts AS datetime, 'U' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS user_id,
  'PC-' || CAST(user_id * 2 + CASE WHEN k % 10 < 8 THEN 0 ELSE 1 END AS VARCHAR) AS pc,
  activity,
  CASE WHEN activity = 'Email' THEN 'u' || k || CASE WHEN k % 3 = 0 THEN '@example.org' ELSE '@dtaa.com' END END AS to_addr,
  CASE WHEN activity = 'Email' AND k % 2 = 1 THEN 'c@dtaa.com' END AS cc,
  CASE WHEN activity = 'Email' AND k % 4 > 0 THEN 'b@dtaa.com' END AS bcc,
  value AS size,
  CASE WHEN activity = 'Email' THEN k % 4 END AS attachments,
  CASE WHEN activity = 'Http' AND k % 20 <> 0 THEN
    'http://d' || (k % 17) || '.example.com' || CASE WHEN k % 2 = 0 THEN ':8080' ELSE '' END || '/p/' || event_id END AS url,
  CASE WHEN activity = 'File' THEN 'f' || k ||
    (['.exe', '.DOCX', '.zip', '.txt', '.bat', '.pdf', '.7z', '.jpg'])[(k // 4) % 8 + 1] END AS filename
FROM raw_a"""
CTE["months"] = """
SELECT * FROM (VALUES (0, '2023-11'), (1, '2023-12'), (2, '2024-01'), (3, '2024-02')) t(m, ldap_month)"""
CTE["snap"] = """
SELECT c_name AS employee_name, 'U' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS user_id,
  CASE WHEN c_custkey % 50 <> 49 THEN 'R' || ((c_custkey + CASE WHEN c_custkey % 5 = 0 THEN m ELSE 0 END) % 7) END AS role,
  CASE WHEN c_custkey % 7 = 0 AND m >= 2 THEN 'MOVED' ELSE c_mktsegment END AS department,
  'FU' || ((c_nationkey + CASE WHEN c_custkey % 11 = 0 AND m >= 3 THEN 1 ELSE 0 END) % 6) AS functional_unit,
  ldap_month
FROM customer CROSS JOIN months
WHERE NOT (c_custkey % 9 = 4 AND m >= 2) AND NOT (c_custkey % 9 = 5 AND m >= 3)"""
CTE["psy"] = """
SELECT 'U' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS user_id,
  CAST(20 + (c_custkey * 1) % 31 AS INTEGER) AS openness, CAST(20 + (c_custkey * 7) % 31 AS INTEGER) AS conscientiousness,
  CAST(20 + (c_custkey * 11) % 31 AS INTEGER) AS extraversion, CAST(20 + (c_custkey * 13) % 31 AS INTEGER) AS agreeableness,
  CAST(20 + (c_custkey * 17) % 31 AS INTEGER) AS neuroticism
FROM customer WHERE c_custkey % 3 <> 0"""
CTE["truth"] = """
SELECT '4.2' AS dataset, CAST(1 + (c_custkey // 25) % 3 AS INTEGER) AS scenario, 'case ' || c_custkey AS details,
  'U' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS user_id,
  TIMESTAMP '2024-01-10 09:00:00' + to_days(CAST(c_custkey % 5 + later AS INT)) AS start_date,
  TIMESTAMP '2024-01-20 09:00:00' + to_days(CAST(c_custkey % 5 + later AS INT)) AS end_date
FROM customer, (VALUES (0), (12)) l(later)
WHERE c_custkey % 25 = 3 AND (later = 0 OR c_custkey = 3)"""
CTE["score_set"] = """
SELECT d.source AS user_id, d.doc_id AS seq_no, 0 AS copy,
  DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS end_date, l.toxic AS label,
  round((d.n_chars % 97) / 97.0::DOUBLE + 0.3::DOUBLE * coalesce(l.toxic, 0), 6) AS score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
CTE["test_set"] = "SELECT * FROM score_set WHERE label IS NOT NULL"
CTE["cal_set"] = "SELECT * FROM score_set WHERE label IS NULL"

# --- daily activity -----------------------------------------------------------------------------

_EXE = "lower(filename) SIMILAR TO '.*\\.(exe|msi|bat|cmd)'"
_DOC = "lower(filename) SIMILAR TO '.*\\.(doc|docx|pdf|xls|xlsx|ppt|pptx|txt|csv)'"
_ARC = "lower(filename) SIMILAR TO '.*\\.(zip|rar|7z|tar|gz)'"
_OUT = "coalesce({0}, '') NOT LIKE '%@dtaa.com%'"
CTE["hourly"] = """
SELECT user_id, CAST(datetime AS DATE) AS date, hour(datetime) AS h, count(*) AS n FROM ev GROUP BY ALL"""
CTE["busiest"] = "SELECT user_id, date, max(n) AS n, sum(n) AS total FROM hourly GROUP BY user_id, date"
CTE["pc_use"] = """
SELECT user_id, date, pc FROM (
  SELECT user_id, CAST(datetime AS DATE) AS date, pc, row_number() OVER (
    PARTITION BY user_id, CAST(datetime AS DATE) ORDER BY count(*) DESC, pc) AS place
  FROM ev WHERE pc IS NOT NULL GROUP BY 1, 2, 3) WHERE place = 1"""
CTE["daily"] = f"""
SELECT e.user_id, CAST(e.datetime AS DATE) AS date,
  count(*) FILTER (activity = 'Http') AS http_request_count,
  count(DISTINCT CASE WHEN activity = 'Http' AND url IS NOT NULL
    THEN split_part(split_part(url, '/', 3), ':', 1) END) AS unique_domains,
  count(*) FILTER (activity = 'Email') AS emails_sent,
  CAST(coalesce(sum(attachments) FILTER (activity = 'Email'), 0) AS BIGINT) AS total_attachments,
  count(*) FILTER (activity = 'Email' AND ({_OUT.format('to_addr')} OR {_OUT.format('cc')} OR {_OUT.format('bcc')})) AS external_email_count,
  count(DISTINCT to_addr) FILTER (activity = 'Email') AS unique_recipients,
  count(*) FILTER (activity = 'File') AS file_copy_count,
  count(*) FILTER (activity = 'File' AND {_EXE}) AS exe_copy_count,
  count(*) FILTER (activity = 'File' AND {_DOC}) AS doc_copy_count,
  count(*) FILTER (activity = 'File' AND {_ARC}) AS archive_copy_count,
  count(*) FILTER (activity = 'Connect') AS usb_connect_count,
  count(*) FILTER (activity = 'Disconnect') AS usb_disconnect_count,
  count(*) AS total_actions,
  count(*) FILTER (activity = 'Logon') AS num_sessions,
  count(DISTINCT hour(datetime)) AS active_hours,
  count(*) FILTER (hour(datetime) < 8 OR hour(datetime) >= 18) AS after_hours_actions,
  count(*) FILTER (hour(datetime) < 8 OR hour(datetime) >= 18) / count(*)::DOUBLE AS after_hours_ratio,
  max(b.n) / count(*)::DOUBLE AS peak_hour_concentration,
  count(DISTINCT e.pc) AS num_distinct_pcs,
  CAST(isodow(CAST(e.datetime AS DATE)) - 1 AS INTEGER) AS dow,
  any_value(u.pc) AS pc
FROM ev e
JOIN busiest b ON b.user_id = e.user_id AND b.date = CAST(e.datetime AS DATE)
LEFT JOIN pc_use u ON u.user_id = e.user_id AND u.date = CAST(e.datetime AS DATE)
GROUP BY e.user_id, CAST(e.datetime AS DATE)"""

# --- sessions -----------------------------------------------------------------------------------

CTE["sess"] = """
SELECT *, least(epoch_us(session_end - session_start) / 60e6::DOUBLE, 720.0::DOUBLE) AS duration_min,
  CAST(CASE WHEN hour_of_start < 8 OR hour_of_start >= 18 THEN 1 ELSE 0 END AS INTEGER) AS is_after_hours
FROM (
  SELECT user_id, pc, CAST(datetime AS DATE) AS session_date, datetime AS session_start,
    CAST(hour(datetime) AS INTEGER) AS hour_of_start,
    coalesce((SELECT min(f.datetime) FROM ev f WHERE f.activity = 'Logoff' AND f.user_id = o.user_id AND f.pc = o.pc
        AND f.datetime > o.datetime AND f.datetime <= o.datetime + INTERVAL 12 HOUR),
      CAST(CAST(datetime AS DATE) + INTERVAL 1 DAY - INTERVAL 1 SECOND AS TIMESTAMP)) AS session_end
  FROM ev o WHERE activity = 'Logon')"""
CTE["sess_ev"] = """
SELECT s.user_id, s.pc, s.session_start, e.id, e.activity, e.to_addr, e.filename, e.url, e.attachments
FROM sess s JOIN ev e ON e.user_id = s.user_id AND e.pc = s.pc AND e.datetime BETWEEN s.session_start AND s.session_end
  AND e.activity NOT IN ('Logon', 'Logoff')"""
CTE["sess_mix"] = """
SELECT user_id, pc, session_start, -sum(p * log2(p)) AS h FROM (
  SELECT user_id, pc, session_start, count(*) / sum(count(*)) OVER (PARTITION BY user_id, pc, session_start)::DOUBLE AS p
  FROM sess_ev GROUP BY user_id, pc, session_start, activity)
GROUP BY user_id, pc, session_start"""
CTE["sess_feat"] = f"""
SELECT s.*,
  coalesce(c.n, 0) AS session_event_count, coalesce(c.n_file, 0) AS session_file_count,
  coalesce(c.n_email, 0) AS session_email_count, coalesce(c.n_http, 0) AS session_http_count,
  CAST(coalesce(c.n_usb, 0) > 0 AS INTEGER) AS session_usb_used,
  CAST(coalesce(c.n_ext, 0) > 0 AS INTEGER) AS session_external_email,
  CAST(coalesce(c.n_exe, 0) > 0 AS INTEGER) AS session_exe_copied,
  coalesce(c.n_host, 0) AS session_unique_domains,
  CAST(coalesce(c.n_att, 0) AS BIGINT) AS session_attachment_count,
  coalesce(m.h, 0) AS session_event_entropy
FROM sess s
LEFT JOIN (
  SELECT user_id, pc, session_start, count(*) AS n,
    count(*) FILTER (activity = 'File') AS n_file, count(*) FILTER (activity = 'Email') AS n_email,
    count(*) FILTER (activity = 'Http') AS n_http, count(*) FILTER (activity = 'Connect') AS n_usb,
    count(*) FILTER (activity = 'Email' AND {_OUT.format('to_addr')}) AS n_ext,
    count(*) FILTER (activity = 'File' AND {_EXE}) AS n_exe,
    count(DISTINCT split_part(split_part(url, '/', 3), ':', 1)) FILTER (activity = 'Http' AND url IS NOT NULL) AS n_host,
    sum(attachments) FILTER (activity = 'Email') AS n_att
  FROM sess_ev GROUP BY user_id, pc, session_start) c USING (user_id, pc, session_start)
LEFT JOIN sess_mix m USING (user_id, pc, session_start)"""
CTE["gaps"] = """
SELECT user_id, session_date AS date, max(gap) AS longest_inter_session_gap FROM (
  SELECT user_id, session_date, epoch_us(session_start - lag(session_end) OVER (
    PARTITION BY user_id, session_date ORDER BY session_start, pc)) / 60e6::DOUBLE AS gap FROM sess)
WHERE gap >= 0 GROUP BY user_id, session_date"""
CTE["day_sess"] = f"""
SELECT user_id, session_date AS date, count(*) AS sess_count, avg(duration_min) AS mean_session_duration,
  max(duration_min) AS max_session_duration, stddev_pop(duration_min) AS std_session_duration,
  sum(duration_min) AS total_session_time, CAST(sum(is_after_hours) AS BIGINT) AS num_after_hours_sessions,
  sum(is_after_hours) / count(*)::DOUBLE AS after_hours_session_ratio,
  min(hour_of_start) AS earliest_session_hour, max(hour_of_start) AS latest_session_hour,
  max(hour_of_start) - min(hour_of_start) AS session_hour_spread,
  avg(session_event_count) AS mean_session_event_count, max(session_event_count) AS max_session_event_count,
  avg(session_event_entropy) AS mean_session_entropy, CAST(sum(session_usb_used) AS BIGINT) AS num_usb_sessions,
  CAST(sum(session_exe_copied) AS BIGINT) AS num_exe_sessions,
  count(*) FILTER (session_usb_used = 1 AND is_after_hours = 1) AS usb_after_hours_sessions,
  count(*) FILTER (session_file_count > {P.heavy_files}) AS file_heavy_sessions,
  count(*) FILTER (duration_min < {P.short_session_min} AND session_usb_used = 1) AS short_usb_sessions
FROM sess_feat GROUP BY user_id, session_date"""
CTE["merged"] = "SELECT d.*, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in SESSION) + """
FROM daily d LEFT JOIN day_sess s USING (user_id, date) LEFT JOIN gaps g USING (user_id, date)"""

# --- context ------------------------------------------------------------------------------------

CTE["profile"] = """
SELECT employee_name, user_id, role, department, functional_unit FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ldap_month DESC) AS place FROM snap) WHERE place = 1"""
CTE["changes"] = """
SELECT user_id, ldap_month, CAST(coalesce(role <> r0, false) AS INTEGER) AS role_changed,
  CAST(coalesce(department <> d0, false) AS INTEGER) AS dept_changed,
  CAST(coalesce(functional_unit <> f0, false) AS INTEGER) AS fu_changed
FROM (SELECT *, lag(role) OVER w AS r0, lag(department) OVER w AS d0, lag(functional_unit) OVER w AS f0
  FROM snap WINDOW w AS (PARTITION BY user_id ORDER BY ldap_month)) WHERE r0 IS NOT NULL"""
CTE["ended"] = """
SELECT user_id, min(next_month) AS termination_month FROM (
  SELECT s.user_id, n.ldap_month AS next_month FROM snap s
  JOIN months a ON a.ldap_month = s.ldap_month JOIN months n ON n.m = a.m + 1
  WHERE NOT EXISTS (SELECT 1 FROM snap t WHERE t.user_id = s.user_id AND t.ldap_month = n.ldap_month))
GROUP BY user_id"""
CTE["medians"] = "SELECT " + ", ".join(f"quantile_cont({t}, 0.5) AS {t}" for t in TRAITS) + " FROM psy"
CTE["enriched"] = (
    "SELECT d.*, u.role, u.department, u.functional_unit, "
    + ", ".join(f"coalesce(p.{t}, (SELECT {t} FROM medians))::DOUBLE AS {t}" for t in TRAITS)
    + """,
  coalesce(c.role_changed, 0) AS role_changed, coalesce(c.dept_changed, 0) AS dept_changed,
  coalesce(c.fu_changed, 0) AS functional_unit_changed,
  CAST(coalesce(strftime(d.date, '%Y-%m') >= x.termination_month, false) AS INTEGER) AS terminated_flag,
  CAST(EXISTS (SELECT 1 FROM truth i WHERE i.user_id = d.user_id AND d.date >= i.start_date AND d.date <= i.end_date) AS INTEGER) AS is_insider
FROM merged d
LEFT JOIN profile u ON u.user_id = d.user_id
LEFT JOIN psy p ON p.user_id = d.user_id
LEFT JOIN changes c ON c.user_id = d.user_id AND c.ldap_month = strftime(d.date, '%Y-%m')
LEFT JOIN ended x ON x.user_id = d.user_id"""
)

SQL: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    SQL[name] = sql


_REAL_DAILY = ("after_hours_ratio", "peak_hour_concentration")
_REAL_SESSION = (
    "mean_session_duration", "max_session_duration", "std_session_duration", "total_session_time",
    "after_hours_session_ratio", "mean_session_event_count", "mean_session_entropy", "longest_inter_session_gap",
)


def pick(columns, real=(), digits=6) -> str:
    shown = lambda c: 5 if c == "total_session_time" else digits
    return ", ".join(f"round({c}, {shown(c)}) AS {c}" if c in real else c for c in columns)


_FILES = ("exe_copy_count", "doc_copy_count", "archive_copy_count")
oracle("daily_activity", f"SELECT user_id, date, dow, {pick(DAILY_COLUMNS, _REAL_DAILY)} FROM daily")
oracle("daily_file_types", f"SELECT user_id, date, file_copy_count, {pick(_FILES)} FROM daily")
oracle("daily_mode_pc", "SELECT user_id, date, pc FROM daily")
oracle("peak_hour", "SELECT user_id, date, n AS busiest_hour_actions, CAST(total AS BIGINT) AS total_actions, round(n / total::DOUBLE, 6) AS peak_hour_concentration FROM busiest")
oracle("sessions", "SELECT user_id, pc, session_date, session_start, session_end, round(duration_min, 6) AS duration_min, is_after_hours, hour_of_start FROM sess")
oracle("session_counts", """SELECT user_id, pc, session_start, session_event_count, session_file_count, session_email_count,
  session_http_count, session_usb_used, session_external_email, session_exe_copied, session_unique_domains,
  session_attachment_count FROM sess_feat""")
oracle("session_entropy", "SELECT user_id, pc, session_start, round(session_event_entropy, 6) AS session_event_entropy FROM sess_feat")
oracle("daily_session_stats", f"SELECT user_id, date, {pick([c for c in SESSION if c != 'longest_inter_session_gap'], _REAL_SESSION)} FROM day_sess")
oracle("session_gaps", "SELECT user_id, date, round(longest_inter_session_gap, 6) AS longest_inter_session_gap FROM gaps")
oracle("daily_merged", f"SELECT user_id, date, {pick(DAILY_COLUMNS, _REAL_DAILY)}, {pick(SESSION, _REAL_SESSION)} FROM merged")
oracle("latest_profile", "SELECT employee_name, user_id, role, department, functional_unit FROM profile")
oracle("attribute_changes", "SELECT * FROM changes")
oracle("terminated_users", "SELECT * FROM ended")
oracle("median_impute", "SELECT u.user_id, " + ", ".join(f"coalesce(p.{t}, (SELECT {t} FROM medians))::DOUBLE AS {t}" for t in TRAITS) + " FROM (SELECT DISTINCT user_id FROM snap) u LEFT JOIN psy p ON p.user_id = u.user_id")
oracle("insider_days", "SELECT user_id, date, is_insider FROM enriched")
oracle("enriched_daily", f"SELECT user_id, date, pc, total_actions, sess_count, role, department, functional_unit, {pick(TRAITS)}, role_changed, dept_changed, functional_unit_changed, terminated_flag, is_insider FROM enriched")
oracle("unified_events", "SELECT CAST(id AS VARCHAR) AS id, datetime, user_id, pc, activity, to_addr, cc, bcc, CAST(attachments AS VARCHAR) AS attachments, url, filename FROM (SELECT * REPLACE (date_trunc('second', datetime) AS datetime) FROM ev)")
oracle("ingest_csv_roundtrip", "SELECT CAST(id AS VARCHAR) AS id, date_trunc('second', datetime) AS datetime, user_id, pc, activity, url, filename, to_addr, CAST(attachments AS VARCHAR) AS attachments FROM ev")
oracle("ingest_counts", """SELECT log, rows, kept FROM (SELECT CASE activity WHEN 'Logon' THEN 'logon' WHEN 'Logoff' THEN 'logon' WHEN 'Connect' THEN 'device'
  WHEN 'Disconnect' THEN 'device' ELSE lower(activity) END AS log, count(*) AS rows FROM ev GROUP BY 1), (VALUES (false), (true)) k(kept)""")
oracle("ingest_snapshots", "SELECT employee_name, user_id, role, department, functional_unit, ldap_month FROM snap")
oracle("ingest_truth", """SELECT dataset, scenario, user_id, strftime(start_date, '%m/%d/%Y %H:%M:%S') AS start, strftime(end_date, '%m/%d/%Y %H:%M:%S') AS "end" FROM truth""")
oracle("labels_load", "SELECT dataset, scenario, details, user_id, start_date, end_date FROM truth")
oracle("lookup_encode", """SELECT u.user_id, u.functional_unit, coalesce(t.code, -1) AS code FROM (SELECT user_id,
  CASE functional_unit WHEN 'FU0' THEN 'Administration' WHEN 'FU1' THEN 'ResearchAndEngineering' WHEN 'FU2' THEN 'Manufacturing'
    WHEN 'FU3' THEN 'Finance' WHEN 'FU4' THEN 'SalesAndMarketing' ELSE 'Unlisted' END AS functional_unit FROM profile) u
LEFT JOIN (VALUES ('Administration', 1), ('ResearchAndEngineering', 2), ('Manufacturing', 3), ('Finance', 4),
  ('SalesAndMarketing', 5), ('PurchasingAndContracts', 6)) t(name, code) ON t.name = u.functional_unit""")
oracle("events_in_range", f"SELECT id, datetime, user_id, activity FROM ev WHERE CAST(datetime AS DATE) BETWEEN DATE '2024-01-25' - {P.lookback + P.rolling_window} AND DATE '2024-01-28'")
oracle("user_filter", "SELECT user_id, activity, count(*) AS n FROM ev WHERE user_id IN (SELECT user_id FROM truth) GROUP BY ALL")


# --- features -----------------------------------------------------------------------------------

_LOGGED = [c for c in (*CONTINUOUS, *SESSION) if c not in UNLOGGED]
_LATE = "CAST(after_hours_actions > 0 AS INTEGER)"
CTE["logged"] = (
    "SELECT * REPLACE (" + ", ".join(f"ln(1 + {c}) AS {c}" for c in _LOGGED) + f"""),
  ln(1 + file_copy_count * CAST(usb_connect_count > usb_disconnect_count AS INTEGER)) AS file_usb_interaction,
  ln(1 + external_email_count * total_attachments) AS external_email_attachments,
  ln(1 + http_request_count * {_LATE}) AS http_after_hours,
  ln(1 + emails_sent * {_LATE}) AS email_after_hours
FROM enriched"""
)
_REL = ",\n".join(
    f"""({c} - avg({c}) OVER u) / greatest(stddev_pop({c}) OVER u, 1e-8::DOUBLE) AS {c}_zscore,
  avg({c}) OVER r AS {c}_rolling_mean, coalesce(stddev_pop({c}) OVER r, 0) AS {c}_rolling_std"""
    for c in P.normalized
)


def featured_cte(source: str) -> str:
    return f"""
SELECT *, {_REL},
  sin(2 * pi() * dow / 7.0::DOUBLE) AS day_of_week_sin, cos(2 * pi() * dow / 7.0::DOUBLE) AS day_of_week_cos,
  CAST(dow >= 5 AS INTEGER) AS is_weekend
FROM {source}
WINDOW u AS (PARTITION BY user_id), r AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN {P.rolling_window - 1} PRECEDING AND CURRENT ROW)"""


CTE["featured"] = featured_cte("logged")
CTE["codes"] = """
SELECT *, CAST(dense_rank() OVER (ORDER BY user_id NULLS LAST) - 1 AS INTEGER) AS user_id_encoded,
  CAST(dense_rank() OVER (ORDER BY pc NULLS LAST) - 1 AS INTEGER) AS pc_encoded,
  CAST(dense_rank() OVER (ORDER BY role NULLS LAST) - 1 AS INTEGER) AS role_encoded,
  CAST(dense_rank() OVER (ORDER BY department NULLS LAST) - 1 AS INTEGER) AS department_encoded,
  CAST(dense_rank() OVER (ORDER BY functional_unit NULLS LAST) - 1 AS INTEGER) AS functional_unit_encoded
FROM enriched"""
CTE["user_pos"] = "SELECT user_id, max(is_insider) AS positive FROM enriched GROUP BY user_id"
CTE["normals"] = f"""
SELECT user_id, row_number() OVER (ORDER BY md5('{P.seed}|' || user_id)) AS place, count(*) OVER () AS n
FROM user_pos WHERE positive = 0"""
CTE["splits"] = f"""
SELECT user_id, CASE WHEN place <= floor(n * {P.train_share}::DOUBLE) THEN 'train'
  WHEN place <= floor(n * {P.train_share}::DOUBLE) + floor(n * {P.val_share}::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM normals
UNION ALL SELECT user_id, 'test' FROM user_pos WHERE positive = 1"""


def scaler_cte(source: str) -> str:
    return "SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in P.scaled
    ) + f" FROM {source} JOIN splits USING (user_id) WHERE split = 'train'"


def scaled_cte(source: str, scaler: str) -> str:
    return f"SELECT {source}.* REPLACE (" + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in P.scaled) + f") FROM {source}, {scaler}"


CTE["scaler"] = scaler_cte("featured")
CTE["scaled"] = scaled_cte("featured", "scaler")

oracle("log_features", "SELECT user_id, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in _LOGGED) + " FROM logged")
oracle("interaction_features", "SELECT user_id, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in INTERACTION) + " FROM logged")
oracle("user_zscore", "SELECT user_id, date, " + ", ".join(f"{r6(c + '_zscore')} AS {c}_zscore" for c in P.normalized) + " FROM featured")
oracle("rolling_stats", "SELECT user_id, date, " + ", ".join(f"{r6(f'{c}_{k}')} AS {c}_{k}" for c in P.normalized for k in ("rolling_mean", "rolling_std")) + " FROM featured")
oracle("calendar_features", "SELECT user_id, date, " + ", ".join(f"{r6(c)} AS {c}" for c in CYCLICAL) + ", is_weekend FROM featured")
oracle("dictionary_encode", "SELECT user_id, date, " + ", ".join(f"{c}_encoded" for c in CATEGORICAL) + " FROM codes")
_EARLY = "(SELECT * FROM enriched WHERE date < DATE '2024-01-08')"
oracle("encode_unseen", "SELECT e.user_id, e.date, " + ", ".join(
    f"""coalesce(d_{c}.code, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {_EARLY})))::INTEGER AS {c}_encoded""" for c in CATEGORICAL
) + " FROM enriched e " + " ".join(
    f"""LEFT JOIN (SELECT {c}, row_number() OVER (ORDER BY {c} NULLS LAST) - 1 AS code FROM (SELECT DISTINCT {c} FROM {_EARLY})) d_{c}
  ON d_{c}.{c} IS NOT DISTINCT FROM e.{c}""" for c in CATEGORICAL))
oracle("dictionary_sizes", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS size FROM (SELECT DISTINCT {c} FROM enriched)" for c in CATEGORICAL))
oracle("user_split", "SELECT user_id, split FROM splits")
oracle("scaled_features", "SELECT user_id, date, is_insider, " + ", ".join(c if c in BINARY else f"{r6(c)} AS {c}" for c in P.vector) + " FROM scaled")
oracle("apply_artifacts", "SELECT s.user_id, s.date, " + ", ".join(f"s.{c}" if c in BINARY else f"{r6('s.' + c)} AS {c}" for c in P.behavioural) + ", " + ", ".join(f"{c}_encoded" for c in CATEGORICAL) + " FROM scaled s JOIN codes c ON c.user_id = s.user_id AND c.date = s.date")

# --- windows ------------------------------------------------------------------------------------

CTE["numbered"] = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM scaled"


def members_cte(lookback: int, stride: int, source: str = "numbered") -> str:
    """Windows by their start row; a short user has one window that starts before the first row."""
    return f"""
SELECT d.*, w.seq_no, CAST(d.rn - w.start AS INTEGER) AS pos, w.padding FROM {source} d JOIN (
  SELECT user_id, (rn // {stride})::BIGINT AS seq_no, rn AS start, 0 AS padding FROM {source} WHERE rn % {stride} = 0 AND rn + {lookback} <= n
  UNION ALL SELECT DISTINCT user_id, 0::BIGINT, n - {lookback}, CAST({lookback} - n AS INTEGER) FROM {source} WHERE n < {lookback}) w
ON w.user_id = d.user_id AND d.rn >= w.start AND d.rn < w.start + {lookback}"""


CTE["members"] = members_cte(P.lookback, P.stride)
CTE["members_long"] = members_cte(28, 5)
CTE["members_dense"] = members_cte(P.lookback, 1)
_WIN = "SELECT user_id, seq_no, CAST(max(is_insider) AS INTEGER) AS label, max(date) AS end_date, CAST(max(padding) AS INTEGER) AS padding"
_SUMS = f", CAST({P.lookback} AS INTEGER) AS n_days, {r6('sum(total_actions)')} AS sum_actions, {r6('max(sess_count)')} AS max_sessions"
oracle("sliding_windows", f"{_WIN}{_SUMS} FROM members GROUP BY user_id, seq_no")
oracle("padded_windows", f"{_WIN}, CAST(28 AS INTEGER) AS n_days, {r6('sum(total_actions)')} AS sum_actions, {r6('sum(pos * total_actions)')} AS weighted_actions FROM members_long GROUP BY user_id, seq_no")
oracle("window_labels", "SELECT user_id, seq_no, CAST(max(is_insider) AS INTEGER) AS label, min(date) AS first_date, max(date) AS end_date, CAST(max(padding) AS INTEGER) AS padding, count(*) AS n_days FROM members GROUP BY user_id, seq_no")
oracle("dense_windows", f"SELECT user_id, seq_no, min(date) AS first_date, max(date) AS end_date, count(*) AS n_days, {r6('avg(total_actions)')} AS mean_actions FROM members_dense GROUP BY user_id, seq_no")
oracle("min_days_filter", "SELECT user_id, count(*) AS active_days FROM daily GROUP BY user_id HAVING count(*) >= 26")

# --- augmentation -------------------------------------------------------------------------------

CTE["copies"] = f"SELECT unnest(generate_series(1, {P.copies}))::INTEGER AS copy"


def unit(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_F = list(P.vector)
CTE["pos_days"] = "SELECT m.* FROM members m JOIN (SELECT user_id, seq_no FROM members GROUP BY 1, 2 HAVING max(is_insider) = 1) USING (user_id, seq_no)"
CTE["pos_long"] = "SELECT user_id, seq_no, pos, unnest(range(0, " + str(len(_F)) + ")) AS f, unnest([" + ", ".join(f"{c}::DOUBLE" for c in _F) + "]) AS x FROM pos_days"
# padded days are zeros and count towards the spread; the test tables have no short user here
CTE["spread"] = "SELECT f, stddev_pop(x) AS sd FROM pos_long GROUP BY f"
_DROP = unit(f"'drop{P.seed}|' || copy || '|' || f")
_FACTOR = "(0.9::DOUBLE + " + unit(f"'scale{P.seed}|' || copy") + " * (1.1::DOUBLE - 0.9::DOUBLE))"
_DRAWN = f"|{P.seed}|' || user_id || '|' || seq_no || '|' || copy || '|' || pos || '|' || f"
_GAUSS = "(sqrt(-2.0::DOUBLE * ln(" + unit("'u1" + _DRAWN) + " + power(2.0::DOUBLE, -33))) * cos(2 * pi() * " + unit("'u2" + _DRAWN) + "))"


def augmented(value: str) -> str:
    return f"SELECT user_id, seq_no, copy, round(sum({value}), 3) AS total, round(sum({value} * (f + 1) * (pos + 1)), 3) AS weighted FROM pos_long JOIN spread USING (f), copies GROUP BY user_id, seq_no, copy"


oracle("augment_dropout", augmented(f"x * CASE WHEN {_DROP} > {P.dropout_rate}::DOUBLE THEN 1 ELSE 0 END"))
oracle("augment_scale", augmented(f"x * {_FACTOR}"))
oracle("augment_jitter", augmented(f"(x + {_GAUSS} * {P.noise_std}::DOUBLE * sd)"))
oracle("augment_counts", """SELECT copy, label, count(*) AS windows FROM (
  SELECT 0 AS copy, CAST(max(is_insider) AS INTEGER) AS label FROM members GROUP BY user_id, seq_no
  UNION ALL SELECT copy, 1 FROM copies, (SELECT DISTINCT user_id, seq_no FROM pos_days)) GROUP BY copy, label""")

# --- scoring ------------------------------------------------------------------------------------

_B = P.behavioural


def profile_cte(source: str) -> str:
    return "SELECT user_id, date, is_insider, rn, n, " + ", ".join(
        f"coalesce(power({c} - avg({c}) OVER h, 2), 0) AS {c}" for c in P.vector
    ) + f" FROM {source} WINDOW h AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN {P.profile_days} PRECEDING AND 1 PRECEDING)"


def day_error_cte(source: str) -> str:
    return "SELECT user_id, date, is_insider, rn, n, (" + " + ".join(_B) + f") / {len(_B)}.0::DOUBLE AS error FROM {source}"


def window_score_cte(source: str) -> str:
    return f"""SELECT user_id, seq_no, CAST(max(is_insider) AS INTEGER) AS label, max(date) AS end_date, sum(error) / {P.lookback}.0::DOUBLE AS mean_error,
  max(error) AS max_error, 0.5::DOUBLE * sum(error) / {P.lookback}.0::DOUBLE + 0.5::DOUBLE * max(error) AS score
FROM {source} GROUP BY user_id, seq_no"""


CTE["profile_err"] = profile_cte("numbered")
CTE["day_err"] = day_error_cte("profile_err")
CTE["err_members"] = members_cte(P.lookback, P.stride, "day_err")
CTE["win_score"] = window_score_cte("err_members")
_P = P.behavioural
_ROOT = "sqrt(0.5::DOUBLE)"
_FIRST, _SECOND = f"({_P[0]} + {_P[1]}) * {_ROOT}", f"({_P[2]} - {_P[3]}) * {_ROOT}"
CTE["fixed_err"] = ("SELECT user_id, date, is_insider, rn, n, " + f"{_FIRST} AS z1, {_SECOND} AS z2, greatest((" + " + ".join(f"{c}::DOUBLE * {c}" for c in _P)
    + f") - ({_FIRST}) * ({_FIRST}) - ({_SECOND}) * ({_SECOND}), 0) / {len(_P)}.0::DOUBLE AS error FROM numbered")
CTE["fixed_members"] = members_cte(P.lookback, P.stride, "fixed_err")
CTE["fixed_score"] = window_score_cte("fixed_members")
oracle("fixed_basis_reconstruction", f"SELECT user_id, seq_no, label, end_date, {r6('max_error')} AS max_error, {r6('score')} AS score FROM fixed_score")
oracle("fixed_model_score", f"SELECT user_id, seq_no, {r6('score')} AS score FROM fixed_score")
oracle("fixed_window_embedding", f"""SELECT user_id, seq_no, max(date) AS end_date, {r6(f'sum(z1) / {P.lookback}.0::DOUBLE')} AS first,
  {r6(f'sum(z2) / {P.lookback}.0::DOUBLE')} AS second FROM fixed_members GROUP BY user_id, seq_no""")
_SHOWN = ("total_actions", "emails_sent", "sess_count", "mean_session_entropy", "http_request_count_zscore")
oracle("profile_reconstruction", "SELECT user_id, date, " + ", ".join(f"{r6(c)} AS {c}" for c in _SHOWN) + " FROM profile_err")
oracle("day_error", "SELECT user_id, date, round(error, 6) AS error FROM day_err")
oracle("window_score", "SELECT user_id, seq_no, label, end_date, round(max_error, 6) AS max_error, round(score, 6) AS score FROM win_score")
oracle("window_mean_error", "SELECT user_id, seq_no, end_date, round(mean_error, 6) AS mean_error FROM win_score")
oracle("embedding_mean_pool", "SELECT label, dim, " + r6("avg(value::DOUBLE)") + """ AS value FROM (
  SELECT label, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim, unnest(embedding) AS value FROM embeddings) GROUP BY label, dim""")


# --- thresholds and metrics ---------------------------------------------------------------------


def points_cte(source: str) -> str:
    """Counts at or above every distinct score."""
    return f"""
SELECT t.score, (SELECT count(*) FROM {source} s WHERE s.label = 1 AND s.score >= t.score) AS tp,
  (SELECT count(*) FROM {source} s WHERE s.label = 0 AND s.score >= t.score) AS fp,
  (SELECT count(*) FROM {source} WHERE label = 1) AS p, (SELECT count(*) FROM {source} WHERE label = 0) AS n
FROM (SELECT DISTINCT score FROM {source}) t"""


def best_f1_cte(points: str) -> str:
    return f"""
SELECT score AS threshold FROM (
  SELECT score, tp / (tp + fp)::DOUBLE AS pr, tp / p::DOUBLE AS re FROM {points})
ORDER BY 2 * pr * re / (pr + re + 1e-10::DOUBLE) DESC, score LIMIT 1"""


CTE["points"] = points_cte("test_set")
CTE["f1_point"] = best_f1_cte("points")
CTE["corners"] = """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS place, count(*) OVER () AS last,
  lead(fp, 1) OVER o - 2 * fp + coalesce(lag(fp, 1) OVER o, 0) AS d_fp,
  lead(tp, 1) OVER o - 2 * tp + coalesce(lag(tp, 1) OVER o, 0) AS d_tp FROM points WINDOW o AS (ORDER BY score DESC))
WHERE place = 1 OR place = last OR d_fp <> 0 OR d_tp <> 0"""
CTE["limits"] = """
SELECT 'percentile_99' AS method, quantile_cont(score, 0.99) AS threshold, false AS is_oracle FROM cal_set
UNION ALL SELECT 'percentile_95', quantile_cont(score, 0.95), false FROM cal_set
UNION ALL SELECT 'mean_plus_3std', avg(score) + 3 * stddev_pop(score), false FROM cal_set
UNION ALL SELECT 'best_f1', threshold, true FROM f1_point
UNION ALL SELECT 'fixed_recall_95', (SELECT score FROM corners ORDER BY abs(tp / p::DOUBLE - 0.95::DOUBLE), score DESC LIMIT 1), true
UNION ALL SELECT 'fixed_recall_99', (SELECT score FROM corners ORDER BY abs(tp / p::DOUBLE - 0.99::DOUBLE), score DESC LIMIT 1), true"""
CTE["cells"] = """
SELECT method, threshold, is_oracle, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
  count(*) FILTER (label = 0 AND score < threshold) AS tn, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
  count(*) FILTER (label = 1 AND score < threshold) AS fn
FROM test_set, limits GROUP BY ALL"""


def rates(source: str, keys: str = "") -> str:
    def r(num: str, den: str, name: str) -> str:
        return f"round(CASE WHEN {den} > 0 THEN ({num})::DOUBLE / ({den}) ELSE 0 END, 6) AS {name}"

    return f"SELECT {keys} tp, tn, fp, fn, " + ", ".join(
        [
            r("tp + tn", "(tp + tn + fp + fn)", "accuracy"), r("tp", "(tp + fp)", "precision"), r("tp", "(tp + fn)", "recall"),
            r("2 * tp", "(2 * tp + fp + fn)", "f1"), r("fp", "(fp + tn)", "fpr"), r("fn", "(fn + tp)", "fnr"), r("tn", "(tn + fp)", "specificity"),
        ]
    ) + f" FROM {source}"


oracle("threshold_percentile", "SELECT method, round(threshold, 6) AS threshold, is_oracle FROM limits WHERE method LIKE 'percentile%'")
oracle("threshold_mean3std", "SELECT method, round(threshold, 6) AS threshold, is_oracle FROM limits WHERE method LIKE 'mean%'")
oracle("threshold_best_f1", "SELECT round(threshold, 6) AS threshold FROM f1_point")
oracle("threshold_fixed_recall", "SELECT method, round(threshold, 6) AS threshold, is_oracle FROM limits WHERE method LIKE 'fixed%'")
oracle("threshold_lookup", """SELECT 'percentile_95' AS asked, method, round(threshold, 6) AS threshold FROM limits WHERE method = 'percentile_95'
UNION ALL SELECT 'best_f1', method, round(threshold, 6) FROM limits WHERE method = 'mean_plus_3std'
UNION ALL SELECT 'percentile_99', 'calibration percentile_99', round(threshold, 6) FROM limits WHERE method = 'percentile_99'""")
oracle("threshold_metrics", rates("cells", "method, round(threshold, 6) AS threshold, is_oracle,"))
oracle("pr_curve", "SELECT round(score, 6) AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall FROM points")
oracle("roc_curve", "SELECT round(score, 6) AS threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM points")
oracle("average_precision", "SELECT round(sum((tp - before) / p::DOUBLE * tp / (tp + fp)::DOUBLE), 6) AS auprc FROM (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS before FROM points)")
oracle("auroc", """SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auroc
FROM (SELECT score FROM test_set WHERE label = 1) a, (SELECT score FROM test_set WHERE label = 0) b""")
oracle("score_separation", """SELECT round(normal_mean, 6) AS normal_mean, round(normal_std, 6) AS normal_std, round(normal_median, 6) AS normal_median,
  round(insider_mean, 6) AS insider_mean, round(insider_std, 6) AS insider_std, round(insider_median, 6) AS insider_median,
  round(insider_mean / greatest(normal_mean, 1e-10::DOUBLE), 6) AS mean_ratio, round(insider_median / greatest(normal_median, 1e-10::DOUBLE), 6) AS median_ratio,
  round(normal_p95, 6) AS normal_p95,
  (SELECT round(avg(CAST(score < normal_p95 AS INT)), 6) FROM test_set WHERE label = 1) AS overlap_below_normal_p95
FROM (SELECT avg(score) FILTER (label = 0) AS normal_mean, stddev_pop(score) FILTER (label = 0) AS normal_std,
  quantile_cont(score, 0.5) FILTER (label = 0) AS normal_median, quantile_cont(score, 0.95) FILTER (label = 0) AS normal_p95,
  avg(score) FILTER (label = 1) AS insider_mean, stddev_pop(score) FILTER (label = 1) AS insider_std,
  quantile_cont(score, 0.5) FILTER (label = 1) AS insider_median FROM test_set)""")

CTE["own_set"] = "SELECT * REPLACE ('U' || lpad(CAST(seq_no % 60 AS VARCHAR), 5, '0') AS user_id) FROM score_set"
CTE["own_test"] = "SELECT * FROM own_set WHERE label IS NOT NULL"
CTE["own_points"] = points_cte("own_test")
CTE["own_limit"] = best_f1_cte("own_points")
CTE["judged"] = "SELECT *, CAST(score >= threshold AS INTEGER) AS pred FROM own_test, own_limit"
CTE["user_cells"] = """
SELECT count(*) FILTER (l = 1 AND q = 1) AS tp, count(*) FILTER (l = 0 AND q = 0) AS tn, count(*) FILTER (l = 0 AND q = 1) AS fp,
  count(*) FILTER (l = 1 AND q = 0) AS fn, count(*) AS total_users, count(*) FILTER (l = 1) AS insider_users, count(*) FILTER (l = 0) AS normal_users
FROM (SELECT user_id, max(label) AS l, max(pred) AS q FROM judged GROUP BY user_id)"""
CTE["placed"] = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY copy, end_date, seq_no) AS place FROM judged"
CTE["per_user"] = """
SELECT user_id, count(*) AS total_sequences, count(*) FILTER (label = 1) AS insider_sequences,
  count(*) FILTER (label = 1 AND pred = 1) AS detected, max(score) AS max_score, avg(score) AS mean_score,
  coalesce(min(place) FILTER (label = 1 AND pred = 1) - min(place) FILTER (label = 1), -1) AS latency_sequences,
  arg_min(end_date, place) FILTER (label = 1) AS first_insider_date,
  arg_min(end_date, place) FILTER (label = 1 AND pred = 1) AS first_detection_date
FROM placed GROUP BY user_id HAVING count(*) FILTER (label = 1) > 0"""
CTE["last_truth"] = """
SELECT user_id, scenario, details, start_date AS truth_start, end_date AS truth_end FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC) AS place FROM truth) WHERE place = 1"""
CTE["latency"] = """
SELECT u.*, t.scenario, t.truth_start, t.truth_end,
  coalesce(date_diff('day', first_insider_date, first_detection_date) * 24.0::DOUBLE, -1) AS latency_hours,
  coalesce(date_diff('day', first_insider_date, first_detection_date)::DOUBLE, -1) AS latency_days,
  round(epoch_us(truth_end - CAST(first_detection_date AS TIMESTAMP)) / 3600e6::DOUBLE, 1) AS lead_time_hours
FROM per_user u LEFT JOIN last_truth t USING (user_id)"""
_RATE = "detected / insider_sequences::DOUBLE"
oracle("user_level_metrics", rates("user_cells", "total_users, insider_users, normal_users,"))
oracle("per_user_breakdown", f"SELECT user_id, total_sequences, insider_sequences, detected, round({_RATE}, 6) AS detection_rate, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score, latency_sequences, first_insider_date, first_detection_date FROM per_user")
oracle("detection_latency", "SELECT user_id, first_insider_date, first_detection_date, latency_hours, latency_days, coalesce(scenario, 0) AS scenario, truth_start, truth_end, lead_time_hours FROM latency")
oracle("latency_summary", """SELECT count(*) FILTER (detected > 0) AS caught_users, count(*) FILTER (detected = 0) AS missed_users, count(*) AS total_insider_users,
  round(avg(latency_sequences) FILTER (detected > 0), 6) AS mean_latency_sequences,
  round(quantile_cont(latency_sequences::DOUBLE, 0.5) FILTER (detected > 0), 6) AS median_latency_sequences,
  round(avg(h), 1) AS mean_latency_hours, round(quantile_cont(h, 0.5), 1) AS median_latency_hours, round(min(h), 1) AS min_latency_hours, round(max(h), 1) AS max_latency_hours
FROM (SELECT *, CASE WHEN detected > 0 AND latency_hours >= 0 THEN latency_hours END AS h FROM latency)""")
CTE["scenario_sums"] = """
SELECT coalesce(t.scenario, 0) AS scenario, CAST(sum(insider_sequences) AS BIGINT) AS insider_sequences, CAST(sum(detected) AS BIGINT) AS detected_sequences,
  count(*) AS insider_users, count(*) FILTER (detected > 0) AS users_detected
FROM per_user u LEFT JOIN last_truth t USING (user_id) GROUP BY 1"""
oracle("per_scenario", "SELECT *, round(detected_sequences / insider_sequences::DOUBLE, 6) AS sequence_recall, round(users_detected / insider_users::DOUBLE, 6) AS user_recall FROM scenario_sums")
oracle("exclude_scenarios", "SELECT user_id, count(*) AS windows FROM own_set WHERE user_id NOT IN (SELECT user_id FROM last_truth WHERE scenario IN (1, 3)) GROUP BY user_id")
CTE["window_sessions"] = """
SELECT j.user_id, j.seq_no, j.pred, s.session_start, s.is_after_hours, CAST(j.end_date >= t.truth_start AND j.end_date <= t.truth_end AS INTEGER) AS true_day
FROM judged j JOIN last_truth t USING (user_id) LEFT JOIN sess s ON s.user_id = j.user_id AND s.session_date = j.end_date"""
CTE["session_sums"] = """
SELECT count(session_start) FILTER (true_day = 1) AS total_insider_sessions,
  count(session_start) FILTER (true_day = 1 AND pred = 1) AS flagged_insider_sessions,
  count(session_start) FILTER (pred = 1) AS total_flagged_sessions,
  count(DISTINCT seq_no) FILTER (pred = 1) AS total_flagged_days,
  count(DISTINCT seq_no) FILTER (pred = 1 AND true_day = 1 AND is_after_hours = 1) AS correct_localizations FROM window_sessions"""
oracle("session_metrics", """SELECT * EXCLUDE (a, b), round(a, 4) AS session_precision, round(b, 4) AS session_recall,
  round(2 * a * b / greatest(a + b, 1e-10::DOUBLE), 4) AS session_f1,
  round(correct_localizations / greatest(total_flagged_days, 1)::DOUBLE, 4) AS session_localization_accuracy
FROM (SELECT *, flagged_insider_sessions / greatest(total_flagged_sessions, 1)::DOUBLE AS a,
  flagged_insider_sessions / greatest(total_insider_sessions, 1)::DOUBLE AS b FROM session_sums)""")

# --- triage -------------------------------------------------------------------------------------


def risk_cte(source: str) -> str:
    return f"""
SELECT user_id, CASE WHEN f / n::DOUBLE > 0.5 OR top > 2 * threshold THEN 'HIGH' WHEN f / n::DOUBLE > 0.25 THEN 'MEDIUM'
    WHEN f > 0 THEN 'LOW' ELSE 'NORMAL' END AS severity,
  round(top, 6) AS anomaly_score_max, round(mean, 6) AS anomaly_score_mean, n AS total_sequences, f AS flagged_sequences,
  round(f / n::DOUBLE, 4) AS detection_rate
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (pred = 1) AS f, max(score) AS top, avg(score) AS mean, max(threshold) AS threshold
  FROM {source} GROUP BY user_id)"""


CTE["risk"] = risk_cte("judged")
oracle("severity", "SELECT user_id, severity FROM risk")
oracle("user_risk", "SELECT * FROM risk")
oracle("top_k_users", "SELECT * FROM risk ORDER BY anomaly_score_max DESC, user_id LIMIT 10")
oracle("risk_report_counts", "SELECT severity, count(*) AS users FROM risk WHERE severity <> 'NORMAL' GROUP BY severity")
CTE["best"] = "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, end_date DESC, seq_no DESC) AS INTEGER) AS rank, seq_no, end_date, round(score, 6) AS score FROM judged"
oracle("top_windows", "SELECT * FROM best WHERE rank <= 5")
CTE["scored6"] = "SELECT * REPLACE (round(score, 6) AS score) FROM win_score"
CTE["sampled"] = """
SELECT user_id, seq_no FROM scored6 WHERE score >= (SELECT quantile_cont(score, 0.9) FROM scored6)"""
CTE["feat_members"] = members_cte(P.lookback, P.stride, "profile_err")
CTE["feat_long"] = "SELECT user_id, seq_no, unnest(range(0, " + str(len(_F)) + ")) AS f, unnest([" + ", ".join(f"{c}::DOUBLE" for c in _F) + f"]) / {P.lookback}.0::DOUBLE AS e FROM feat_members SEMI JOIN sampled USING (user_id, seq_no)"
CTE["feat_mean"] = "SELECT user_id, f, sum(e) / count(DISTINCT seq_no) AS e FROM feat_long GROUP BY user_id, f"


def texts() -> str:
    from vigilume.operators.triage import indicator_text

    return "(VALUES " + ", ".join(f"({i}, '{indicator_text(c)}')" for i, c in enumerate(_F)) + ") t(f, text)"


def indicators_of(means: str) -> str:
    return f"""SELECT user_id, string_agg(text, '; ' ORDER BY place) AS indicators FROM (
  SELECT user_id, text, min(place) AS place FROM (
    SELECT user_id, f, row_number() OVER (PARTITION BY user_id ORDER BY e DESC, f DESC) AS place FROM {means}) JOIN {texts()} USING (f)
  WHERE place <= 3 GROUP BY user_id, text) GROUP BY user_id"""


def windows_text(table: str) -> str:
    """The five best windows of each user as text."""
    return f"""SELECT user_id, string_agg(place || ' ' || CAST(round(round(score, 6) * 1000000) AS BIGINT) || ' ' || CAST(end_date AS DATE), '; ' ORDER BY place) AS windows FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, end_date DESC, seq_no DESC) AS place FROM {table}) WHERE place <= 5 GROUP BY user_id"""


CTE["indicator_text"] = indicators_of("feat_mean")
CTE["own_windows"] = windows_text("own_test")
oracle("risk_indicators", "SELECT * FROM indicator_text")
CTE["flag_dates"] = """
SELECT DISTINCT user_id, end_date FROM own_test WHERE score >= (SELECT quantile_cont(score, 0.5) FROM own_test)"""
CTE["drill_ev"] = """
SELECT * FROM (
  SELECT s.user_id, s.pc, s.session_start, e.datetime, e.activity AS type,
    coalesce(e.filename, e.url, CASE WHEN e.activity = 'Email' THEN 'to: ' || coalesce(e.to_addr, '') END, e.activity) AS detail,
    row_number() OVER (PARTITION BY s.user_id, s.pc, s.session_start ORDER BY e.datetime, e.id) AS nth
  FROM sess s JOIN flag_dates d ON d.user_id = s.user_id AND d.end_date = s.session_date
  JOIN ev e ON e.user_id = s.user_id AND e.datetime BETWEEN s.session_start AND s.session_end)"""
CTE["drill_sum"] = """
SELECT user_id, pc, session_start, string_agg(c || ' ' || type, ', ' ORDER BY first) AS mix FROM (
  SELECT user_id, pc, session_start, type, count(*) AS c, min(nth) AS first FROM drill_ev GROUP BY ALL) GROUP BY ALL"""
CTE["drill"] = """
SELECT s.*, d.end_date AS date, m.mix, x.usb, x.exe, x.fil, x.shown FROM sess s
JOIN flag_dates d ON d.user_id = s.user_id AND d.end_date = s.session_date
LEFT JOIN drill_sum m ON m.user_id = s.user_id AND m.pc = s.pc AND m.session_start = s.session_start
LEFT JOIN (SELECT user_id, pc, session_start, bool_or(type IN ('Connect', 'Disconnect')) AS usb,
    bool_or(detail LIKE '%.exe' OR detail LIKE '%.msi' OR detail LIKE '%.bat') AS exe, bool_or(type = 'File') AS fil,
    string_agg(strftime(datetime, '%Y-%m-%d %H:%M:%S') || ' ' || type || ' ' || detail, '; ' ORDER BY nth) FILTER (nth <= 10) AS shown
  FROM drill_ev GROUP BY ALL) x ON x.user_id = s.user_id AND x.pc = s.pc AND x.session_start = s.session_start"""
CTE["drill_risk"] = """
SELECT *, CASE WHEN exe THEN 'high' WHEN usb THEN CASE WHEN is_after_hours = 1 THEN 'high' ELSE 'medium' END
  WHEN is_after_hours = 1 THEN CASE WHEN duration_min < 15 THEN 'high' ELSE 'medium' END ELSE 'low' END AS risk FROM drill"""
oracle("session_drilldown", """SELECT user_id, date, pc, session_start, session_end, round(duration_min, 1) AS duration_min, risk,
  CAST(round_even(duration_min, 0) AS INT) || '-min session' || coalesce(': ' || mix, '') AS summary,
  concat_ws('; ', CASE WHEN is_after_hours = 1 THEN 'After-hours session (' || hour_of_start || ':00)' END,
    CASE WHEN duration_min < 15 THEN 'Short session (<15 min)' END, CASE WHEN usb THEN 'USB device activity' END,
    CASE WHEN exe THEN 'Executable file copied' END, CASE WHEN fil AND duration_min < 15 THEN 'File activity in short session' END) AS indicators,
  CASE WHEN risk IN ('medium', 'high') THEN coalesce(shown, '') ELSE '' END AS events FROM drill_risk""")
CTE["own_test_e"] = "SELECT * FROM own_test WHERE end_date < DATE '2024-01-08'"
CTE["flag_dates_e"] = """
SELECT DISTINCT user_id, end_date FROM own_test_e WHERE score >= (SELECT quantile_cont(score, 0.5) FROM own_test_e)"""
for _name in ("drill_ev", "drill_sum", "drill", "drill_risk"):
    CTE[f"{_name}_e"] = re.sub(r"\b(flag_dates|drill_ev|drill_sum|drill)\b", r"\1_e", CTE[_name])
oracle("session_drilldown_dated", """SELECT user_id, date, pc, session_start, session_end, round(duration_min, 1) AS duration_min, risk,
  CAST(round_even(duration_min, 0) AS INT) || '-min session' || coalesce(': ' || mix, '') AS summary FROM drill_risk_e""")
oracle("alert_report", f"""SELECT 'INSIDER-' || u.user_id || '-' || lpad(CAST(place AS VARCHAR), CAST(greatest(3, length(CAST(place AS VARCHAR))) AS INTEGER), '0') AS alert_id,
  CASE WHEN {_RATE} > 0.5 OR max_score > 2 * (SELECT threshold FROM own_limit) THEN 'HIGH' WHEN {_RATE} > 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  u.user_id, total_sequences, detected AS flagged_sequences, round({_RATE}, 6) AS detection_rate, round(max_score, 6) AS max_anomaly_score,
  round(mean_score, 6) AS mean_anomaly_score, insider_sequences, latency_sequences, first_detection_date AS first_detection, latency_hours, lead_time_hours,
  least(5, total_sequences) AS n_windows, round(max_score, 6) AS best_score, ow.windows, coalesce(it.indicators, '') AS risk_indicators,
  coalesce(t.scenario, 0) AS scenario, coalesce(t.details, '') AS scenario_description, t.truth_start, t.truth_end,
  (SELECT count(DISTINCT date) FROM drill d WHERE d.user_id = u.user_id) AS n_days,
  (SELECT count(*) FROM drill d WHERE d.user_id = u.user_id) AS n_sessions
FROM (SELECT * EXCLUDE (scenario, truth_start, truth_end), row_number() OVER (ORDER BY user_id) AS place FROM latency) u LEFT JOIN last_truth t ON t.user_id = u.user_id
LEFT JOIN own_windows ow ON ow.user_id = u.user_id LEFT JOIN indicator_text it ON it.user_id = u.user_id WHERE detected > 0""")

_SHARE = "flagged / total_sequences::DOUBLE"
CTE["all_users"] = """
SELECT user_id, count(*) AS total_sequences, CAST(sum(pred) AS BIGINT) AS flagged, max(score) AS max_score, avg(score) AS mean_score,
  max(threshold) AS threshold, row_number() OVER (ORDER BY user_id) AS place FROM judged GROUP BY user_id"""
oracle("alert_report_unlabelled", f"""SELECT 'INSIDER-' || user_id || '-' || lpad(CAST(place AS VARCHAR), CAST(greatest(3, length(CAST(place AS VARCHAR))) AS INTEGER), '0') AS alert_id,
  CASE WHEN {_SHARE} > 0.5 OR max_score > 2 * threshold THEN 'HIGH' WHEN {_SHARE} > 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  user_id, total_sequences, flagged AS flagged_sequences, round({_SHARE}, 6) AS detection_rate, round(max_score, 6) AS max_anomaly_score,
  round(mean_score, 6) AS mean_anomaly_score, least(5, total_sequences) AS n_windows FROM all_users WHERE flagged > 0""")
oracle("alert_summary", f"""SELECT 'best_f1' AS threshold_method, (SELECT round(max(threshold), 6) FROM judged) AS threshold_value,
  (SELECT count(*) FROM all_users) AS total_users, (SELECT count(*) FROM all_users WHERE flagged > 0) AS flagged_users,
  (SELECT CAST(sum(total_sequences) AS BIGINT) FROM all_users) AS total_sequences, (SELECT CAST(sum(flagged) AS BIGINT) FROM all_users) AS flagged_sequences,
  count(*) FILTER (detected > 0) AS total_alerts, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (detected = 0) AS users_missed
FROM (SELECT *, CASE WHEN detected = 0 THEN NULL WHEN {_RATE} > 0.5 OR max_score > 2 * (SELECT threshold FROM own_limit) THEN 'HIGH'
  WHEN {_RATE} > 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM per_user)""")

# --- profiling ----------------------------------------------------------------------------------

oracle("table_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", count(*) AS rows, 'ok' AS status FROM {cte}" for name, cte in
    (("events", "ev"), ("users", "profile"), ("insiders", "truth"), ("psychometric", "psy"), ("user_changes", "changes"), ("terminated_users", "ended"), ("sessions", "sess"))
) + " UNION ALL SELECT 'activity_encoding', 0, 'not found'")
_LI = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
oracle("numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS avg FROM lineitem" for c in _LI))
oracle("top_values", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, n, place FROM (SELECT {c}, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS place
  FROM ev WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 5""" for c in ("user_id", "pc", "activity", "to_addr", "cc", "bcc", "url", "filename")))
oracle("event_overview", """SELECT 'first_event' AS metric, strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS value FROM ev
UNION ALL SELECT 'last_event', strftime(max(datetime), '%Y-%m-%d %H:%M:%S') FROM ev
UNION ALL SELECT 'days', CAST(count(DISTINCT CAST(datetime AS DATE)) AS VARCHAR) FROM ev
UNION ALL SELECT 'users', CAST(count(DISTINCT user_id) AS VARCHAR) FROM ev
UNION ALL SELECT 'first_user', min(user_id) FROM ev UNION ALL SELECT 'last_user', max(user_id) FROM ev
UNION ALL SELECT 'pcs', CAST(count(DISTINCT pc) AS VARCHAR) FROM ev
UNION ALL SELECT 'null_pcs', CAST(count(*) FILTER (pc IS NULL) AS VARCHAR) FROM ev
UNION ALL SELECT 'activity ' || activity, CAST(count(*) AS VARCHAR) FROM ev GROUP BY activity""")
oracle("top_users_sample", """SELECT user_id, events, nth, datetime, activity, pc, url[1:40] AS url, to_addr[1:30] AS to_addr FROM (
  SELECT e.*, b.events, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY datetime, id) AS INTEGER) AS nth FROM ev e
  JOIN (SELECT user_id, count(*) AS events FROM ev GROUP BY user_id ORDER BY events DESC, user_id LIMIT 3) b ON b.user_id = e.user_id) WHERE nth <= 5""")
oracle("sample_rows", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CASE WHEN length(t) > 50 THEN t[1:47] || '...' ELSE t END AS text
FROM (SELECT *, regexp_replace(text, '\\s', ' ', 'g') AS t FROM documents ORDER BY doc_id LIMIT 10)""")
oracle("context_summary", "SELECT 'scenario' AS part, CAST(scenario AS VARCHAR) AS item, count(*) AS value FROM truth GROUP BY scenario UNION ALL "
    + " UNION ALL ".join(f"SELECT 'trait', '{t} min', min({t})::BIGINT FROM psy UNION ALL SELECT 'trait', '{t} max', max({t})::BIGINT FROM psy" for t in TRAITS)
    + " UNION ALL SELECT 'changes', 'rows', count(*) FROM changes UNION ALL "
    + " UNION ALL ".join(f"SELECT 'changes', '{c}', CAST(sum({c}) AS BIGINT) FROM changes" for c in ("role_changed", "dept_changed", "fu_changed"))
    + " UNION ALL SELECT 'terminated', termination_month, count(*) FROM ended GROUP BY termination_month")
oracle("score_histogram", """SELECT label, bin, n, round(n / (sum(n) OVER (PARTITION BY label) * w), 6) AS density FROM (
  SELECT label, least(CAST(floor((score - lo) / w) AS INTEGER), 118) AS bin, count(*) AS n, any_value(w) AS w FROM test_set,
    (SELECT lo, hi, (hi - lo) / 119.0::DOUBLE AS w FROM (SELECT min(score) AS lo, quantile_cont(score, 0.995) AS hi FROM test_set))
  WHERE score <= hi GROUP BY 1, 2)""")
_CHART = ("precision", "recall", "f1", "fpr", "fnr")
oracle("chart_threshold_long", " UNION ALL ".join(f"SELECT method, is_oracle, '{m}' AS metric, {m} AS value FROM ({rates('cells', 'method, is_oracle,')})" for m in _CHART))
oracle("chart_scenario_long", """SELECT scenario, 'sequence_recall' AS metric, round(detected_sequences / insider_sequences::DOUBLE, 6) AS value FROM scenario_sums
UNION ALL SELECT scenario, 'user_recall', round(users_detected / insider_users::DOUBLE, 6) FROM scenario_sums""")
oracle("chart_confusion", """SELECT CAST(t AS INTEGER) AS truth, CAST(p AS INTEGER) AS predicted, (SELECT count(*) FROM judged WHERE label = t AND pred = p) AS n
FROM (VALUES (0), (1)) a(t), (VALUES (0), (1)) b(p)""")
oracle("chart_session_confusion", """SELECT 0 AS truth, 0 AS predicted, 0::BIGINT AS n
UNION ALL SELECT 0, 1, total_flagged_sessions - flagged_insider_sessions FROM session_sums
UNION ALL SELECT 1, 0, total_insider_sessions - flagged_insider_sessions FROM session_sums
UNION ALL SELECT 1, 1, flagged_insider_sessions FROM session_sums""")
oracle("chart_timeline", "SELECT user_id, truth_start, truth_end, first_insider_date, first_detection_date, CASE WHEN detected > 0 THEN 'caught' ELSE 'missed' END AS outcome FROM latency")
oracle("chart_scatter", f"SELECT user_id, seq_no, copy, label, score, md5('{P.seed}|' || user_id || '|' || seq_no || '|' || copy) AS draw FROM test_set")

oracle("threshold_percentile_sketch", """SELECT m AS method, (SELECT count(*) FROM cal_set) AS n, true AS within FROM (VALUES ('percentile_99'), ('percentile_95')) t(m)""")

# --- inference and streaming --------------------------------------------------------------------

_RANGED = (
    "ev", "hourly", "busiest", "pc_use", "daily", "sess", "sess_ev", "sess_mix", "sess_feat", "gaps", "day_sess",
    "merged", "enriched", "logged", "featured", "scaled", "numbered", "profile_err", "day_err", "members_dense",
)


def ranged(text: str) -> str:
    """The same SQL over the events of the scored date range."""
    return re.sub(r"\b(" + "|".join(_RANGED) + r")\b", r"\1_r", text)


CTE["ev_r"] = f"SELECT * FROM ev WHERE CAST(datetime AS DATE) BETWEEN DATE '2024-01-25' - {P.lookback + P.rolling_window} AND DATE '2024-01-28'"
for _name in _RANGED[1:-1]:
    CTE[f"{_name}_r"] = ranged(CTE[_name])
CTE["err_dense_r"] = members_cte(P.lookback, 1, "day_err_r")
CTE["range_scores"] = window_score_cte("err_dense_r")
CTE["range_limit"] = "SELECT quantile_cont(score, 0.95) AS threshold FROM win_score JOIN splits USING (user_id) WHERE split = 'val'"
CTE["range_judged"] = "SELECT *, CAST(score >= threshold AS INTEGER) AS pred FROM range_scores, range_limit"
CTE["range_risk"] = risk_cte("range_judged")
oracle("score_range", "SELECT * FROM range_risk")
CTE["range_windows"] = windows_text("range_scores")
CTE["feat_members_r"] = members_cte(P.lookback, 1, "profile_err_r")
CTE["range_flags"] = "SELECT user_id, seq_no FROM range_judged WHERE pred = 1"
CTE["feat_long_r"] = ("SELECT user_id, seq_no, unnest(range(0, " + str(len(_F)) + ")) AS f, unnest([" + ", ".join(f"{c}::DOUBLE" for c in _F)
    + f"]) / {P.lookback}.0::DOUBLE AS e FROM feat_members_r SEMI JOIN range_flags USING (user_id, seq_no)")
CTE["feat_mean_r"] = "SELECT user_id, f, sum(e) / count(DISTINCT seq_no) AS e FROM feat_long_r GROUP BY user_id, f"
CTE["indicator_text_r"] = indicators_of("feat_mean_r")
oracle("risk_report", """SELECT r.*, w.windows, coalesce(i.indicators, '') AS indicators FROM range_risk r
LEFT JOIN range_windows w ON w.user_id = r.user_id LEFT JOIN indicator_text_r i ON i.user_id = r.user_id""")
oracle("risk_report_totals", """SELECT 'score n' AS item, count(*) AS value FROM range_scores UNION ALL SELECT 'score users', count(DISTINCT user_id) FROM range_scores
UNION ALL SELECT 'severity ' || severity, count(*) FROM range_risk WHERE severity <> 'NORMAL' GROUP BY severity
UNION ALL SELECT 'total_users', count(DISTINCT user_id) FROM range_judged UNION ALL SELECT 'flagged_users', count(DISTINCT user_id) FROM range_judged WHERE pred = 1
UNION ALL SELECT 'total_sequences', count(*) FROM range_judged UNION ALL SELECT 'flagged_sequences', count(*) FROM range_judged WHERE pred = 1""")
oracle("saved_days", f"SELECT s.user_id, s.date, p.split, {r6('s.total_actions')} AS total_actions, {r6('s.sess_count')} AS sess_count FROM scaled s JOIN splits p ON p.user_id = s.user_id WHERE p.split = 'val'")
oracle("saved_sessions", "SELECT user_id, pc, session_date, session_start, session_end, round(duration_min, 6) AS duration_min, is_after_hours, hour_of_start FROM sess")
oracle("saved_scores", "SELECT user_id, seq_no, end_date, score FROM scored6")
oracle("training_windows", """SELECT split, count(*) AS windows, CAST(max(label) AS BIGINT) AS positive, count(DISTINCT user_id) AS users FROM (
  SELECT user_id, seq_no, max(is_insider) AS label FROM members GROUP BY user_id, seq_no) JOIN splits USING (user_id) GROUP BY split""")


def cells(part: str, sql: str, key: str = "''", numbers: tuple[str, ...] = ()) -> str:
    """One row for each number of a table."""
    return " UNION ALL ".join(
        f"SELECT '{part}' AS part, {key} AS item, '{n}' AS metric, round(CAST({n} AS DOUBLE), 4) AS value FROM ({sql}) WHERE {n} IS NOT NULL" for n in numbers
    )


oracle("evaluation_report", " UNION ALL ".join((
    cells("user_level_metrics", SQL["user_level_metrics"], numbers=("total_users", "insider_users", "normal_users", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "fnr", "accuracy", "specificity")),
    cells("detection_latency_summary", SQL["latency_summary"], numbers=("caught_users", "missed_users", "total_insider_users", "mean_latency_sequences",
        "median_latency_sequences", "mean_latency_hours", "median_latency_hours", "min_latency_hours", "max_latency_hours")),
    cells("per_scenario_results", SQL["per_scenario"], "CAST(scenario AS VARCHAR)", ("insider_sequences", "detected_sequences", "insider_users", "users_detected", "sequence_recall", "user_recall")),
    cells("session_level_metrics", SQL["session_metrics"], numbers=("total_insider_sessions", "flagged_insider_sessions", "total_flagged_sessions", "total_flagged_days",
        "correct_localizations", "session_precision", "session_recall", "session_f1", "session_localization_accuracy")),
    cells("per_user_results", f"SELECT *, {_RATE} AS detection_rate FROM latency", "user_id", ("total_sequences", "insider_sequences", "detected", "max_score", "mean_score",
        "latency_sequences", "latency_hours", "latency_days", "lead_time_hours", "detection_rate")),
)))
oracle("inference_features", "SELECT s.user_id, s.date, " + ", ".join(f"s.{c}" if c in BINARY else f"{r6('s.' + c)} AS {c}" for c in P.behavioural)
    + ", " + ", ".join(f"(SELECT any_value({c}_encoded) FROM codes k WHERE k.{c} IS NOT DISTINCT FROM s.{c}) AS {c}_encoded" for c in CATEGORICAL)
    + " FROM scaled_r s WHERE s.user_id IN (SELECT user_id FROM truth)")
oracle("stream_daily", """SELECT user_id, CAST(datetime AS DATE) AS date, count(*) AS total_actions, count(*) FILTER (activity = 'Logon') AS num_sessions,
  count(*) FILTER (activity = 'Http') AS http_request_count, count(*) FILTER (activity = 'Email') AS emails_sent,
  count(*) FILTER (activity = 'File') AS file_copy_count, count(*) FILTER (activity = 'Connect') AS usb_connect_count,
  count(*) FILTER (hour(datetime) < 8 OR hour(datetime) >= 18) AS after_hours_actions,
  count(DISTINCT split_part(split_part(url, '/', 3), ':', 1)) FILTER (activity = 'Http') AS unique_domains
FROM ev GROUP BY user_id, CAST(datetime AS DATE)""")
oracle("stream_sessions", f"""SELECT user_id, pc, session_date, session_start, session_end, hour_of_start, {r6('duration_min')} AS duration_min,
  is_after_hours FROM sess""")
