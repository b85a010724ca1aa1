"""Explicit schemas of the raw inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LOG_SCHEMAS = {
    "logon": _text("id", "date", "user", "pc", "activity"),
    "device": _text("id", "date", "user", "pc", "activity"),
    "email": _text("id", "date", "user", "pc", "to", "cc", "bcc", "size", "attachments", "content"),
    "file": _text("id", "date", "user", "pc", "filename", "content"),
    "http": _text("id", "date", "user", "pc", "url", "content"),
}
PSYCHOMETRIC = T.StructType(
    [T.StructField("employee_name", T.StringType()), T.StructField("user_id", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in "OCEAN"]
)
SNAPSHOT = _text(
    "employee_name", "user_id", "email", "role", "business_unit",
    "functional_unit", "department", "team", "supervisor",
)
LABELS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("scenario", T.IntegerType()),
        T.StructField("details", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
    ]
)
EVENT_COLUMNS = {
    "id": "string", "datetime": "timestamp_ntz", "user_id": "string", "pc": "string",
    "activity": "string", "to_addr": "string", "cc": "string", "bcc": "string",
    "size": "string", "attachments": "string", "url": "string", "filename": "string",
    "content": "string",
}
TRAITS = {
    "O": "openness", "C": "conscientiousness", "E": "extraversion",
    "A": "agreeableness", "N": "neuroticism",
}
