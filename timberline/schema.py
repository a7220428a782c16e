"""Schemas of the log table and of the nested telemetry documents it is fed from."""

from __future__ import annotations

from pyspark.sql import types as T

DAY = "day"

BAG = T.MapType(T.StringType(), T.StringType())

#: One row per log record. ``(timestamp, log_id)`` identifies a record and is the
#: total order every newest-first operator uses.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("service_instance_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("severity_text", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("resource_attributes", BAG),
        T.StructField("log_attributes", BAG),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
    ]
)

LOG_COLUMNS = LOG_SCHEMA.fieldNames()

#: On disk the table carries its partition column as well.
STORED_SCHEMA = T.StructType([*LOG_SCHEMA.fields, T.StructField(DAY, T.DateType())])

#: What a search page shows: the record without its resource bag.
PAGE_COLUMNS = [c for c in LOG_COLUMNS if c not in ("log_id", "resource_attributes")]

#: Kinds of values in a document; one of them is set. Fixed values. All are read as text,
#: which for lists and maps is their JSON.
VALUE_KINDS = (
    "stringValue", "intValue", "doubleValue", "boolValue", "bytesValue", "arrayValue", "kvlistValue",
)
_VALUE = T.StructType([T.StructField(kind, T.StringType()) for kind in VALUE_KINDS])

_PAIRS = T.ArrayType(
    T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("value", _VALUE),
        ]
    )
)

_RECORD = T.StructType(
    [
        T.StructField("timeUnixNano", T.StringType()),
        T.StructField("observedTimeUnixNano", T.StringType()),
        T.StructField("severityNumber", T.IntegerType()),
        T.StructField("severityText", T.StringType()),
        T.StructField("traceId", T.StringType()),
        T.StructField("spanId", T.StringType()),
        T.StructField("body", _VALUE),
        T.StructField("attributes", _PAIRS),
    ]
)

_SCOPE_LOGS = T.StructType(
    [
        T.StructField(
            "scope",
            T.StructType(
                [
                    T.StructField("name", T.StringType()),
                    T.StructField("version", T.StringType()),
                ]
            ),
        ),
        T.StructField("logRecords", T.ArrayType(_RECORD)),
    ]
)

#: Export document: resources hold scopes, scopes hold records.
OTLP_SCHEMA = T.StructType(
    [
        T.StructField(
            "resourceLogs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "resource", T.StructType([T.StructField("attributes", _PAIRS)])
                        ),
                        T.StructField("scopeLogs", T.ArrayType(_SCOPE_LOGS)),
                    ]
                )
            ),
        )
    ]
)

CORRUPT = "_corrupt_record"
