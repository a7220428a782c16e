"""Documents in, table rows out; retention; parsing; streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from timberline.fixtures import ORACLE_WEEKDAY, WEEKDAY_ERRORS_SQL, event_logs, weekday_errors
from timberline.functions.scalars import LEVELS, level_severity, status_severity
from timberline.operators import parsing
from timberline.operators.patterns import mine_patterns
from timberline.registry.base import (
    AS_OF,
    END,
    IN_RANGE,
    SQL_AS_OF,
    START,
    on_logs,
    quoted,
    register,
    text,
)
from timberline.sources import logs as table
from timberline.sources.files import Files
from timberline.sources.otlp import flatten_otlp, parse_otlp, to_otlp
from timberline.sources.scratch import scratch_path
from timberline.streaming.ingest import compact_day, dedupe_stream, stream_logs, write_stream
from timberline.streaming.live import (
    merge_volume,
    read_volume,
    stream_counts,
    stream_match,
    stream_volume,
)

# --- telemetry documents ----------------------------------------------------------------

FLAT_SQL = """
SELECT CAST(timestamp AS VARCHAR) AS timestamp, service_name, service_instance_id, trace_id, span_id,
       severity_number, severity_text, body,
       json_extract_string(resource_attributes, '$."service.version"') AS version,
       json_extract_string(log_attributes, '$."http.status_code"') AS status,
       scope_name, scope_version
FROM logs
"""


def _flat(rows):
    return rows.select(
        text(), "service_name", "service_instance_id", "trace_id", "span_id", "severity_number",
        "severity_text", "body",
        F.try_element_at("resource_attributes", F.lit("service.version")).alias("version"),
        F.try_element_at("log_attributes", F.lit("http.status_code")).alias("status"),
        "scope_name", "scope_version",
    )


@register("otlp_flatten", on_logs(FLAT_SQL))
def _otlp_flatten(spark, sf):
    """Logs as nested JSON documents, and back."""
    documents = to_otlp(event_logs(spark, sf)).select(F.to_json(F.struct("*")).alias("value"))
    return _flat(flatten_otlp(parse_otlp(documents)))


@register(
    "otlp_value_kinds",
    """
SELECT CAST(event_id AS VARCHAR) AS log_id,
       CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR)
            WHEN event_id % 3 = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END
            ELSE '{"values":[{"key":"t","value":{"stringValue":"' || event_type || '"}}]}' END AS body,
       CAST(user_id AS VARCHAR) AS user_id, '0.5' AS share,
       '{"values":[{"intValue":"' || user_id || '"},{"stringValue":"x"}]}' AS list
FROM events
""",
)
def _otlp_value_kinds(spark, sf):
    """Numbers, truth values, lists and maps as attribute values and bodies."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    number, kind = F.col("user_id").cast("string"), F.col("event_id") % 3
    body = (
        F.when(kind == 0, F.format_string('{"intValue":"%s"}', number))
        .when(kind == 1, F.format_string('{"boolValue":%s}', (F.col("user_id") % 2 == 0).cast("string")))
        .otherwise(
            F.format_string(
                '{"kvlistValue":{"values":[{"key":"t","value":{"stringValue":"%s"}}]}}', "event_type"
            )
        )
    )
    document = F.format_string(
        '{"resourceLogs":[{"resource":{},"scopeLogs":[{"logRecords":[{"spanId":"%s","body":%s,'
        '"attributes":[{"key":"user_id","value":{"intValue":"%s"}},'
        '{"key":"share","value":{"doubleValue":0.5}},'
        '{"key":"list","value":{"arrayValue":{"values":[{"intValue":"%s"},{"stringValue":"x"}]}}}]'
        "}]}]}]}",
        F.col("event_id").cast("string"), body, number, number,
    )
    rows = flatten_otlp(parse_otlp(events.select(document.alias("value"))))

    def attribute(name: str):
        return F.try_element_at("log_attributes", F.lit(name)).alias(name)

    return rows.select(
        F.col("span_id").alias("log_id"), "body", attribute("user_id"), attribute("share"), attribute("list")
    )


@register("log_table", on_logs(FLAT_SQL + f"WHERE {IN_RANGE}"))
def _log_table(spark, sf):
    """Append to a day-partitioned table and read a range of it."""
    path = scratch_path(spark, "log-table")
    table.write_logs(event_logs(spark, sf), path)
    return _flat(table.read_logs(spark, path, START, END))


@register(
    "retention_split",
    on_logs(
        f"""
SELECT CASE WHEN CAST(timestamp AS DATE) BETWEEN CAST({SQL_AS_OF} AS DATE) - 10
                 AND CAST({SQL_AS_OF} AS DATE) - 2
            THEN 'kept' ELSE 'rejected' END AS outcome,
       CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS count
FROM logs GROUP BY 1, 2
"""
    ),
)
def _retention(spark, sf):
    parts = table.apply_retention(event_logs(spark, sf), AS_OF, past=10, future=-2)

    def counted(rows, outcome):
        day = F.to_date("timestamp").cast("string").alias("day")
        return rows.groupBy(F.lit(outcome).alias("outcome"), day).count()

    return counted(parts.kept, "kept").unionByName(counted(parts.rejected, "rejected"))


@register(
    "sample_preview",
    on_logs(
        """
SELECT log_id, CAST(timestamp AS VARCHAR) AS timestamp FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC, log_id DESC) AS r FROM logs)
WHERE r <= 3 OR CAST('0x' || substr(md5(CAST(log_id AS VARCHAR)), 1, 8) AS BIGINT) % 50 = 0
"""
    ),
)
def _preview(spark, sf):
    return table.sample_preview(event_logs(spark, sf)).select("log_id", text())


# --- parsing ----------------------------------------------------------------------------

_ACCESS = parsing.ACCESS.removeprefix("(?s)")
_SLASHED = parsing.SLASHED
_BRACKETED = parsing.BRACKETED


def _group(pattern: str, names: tuple[str, ...], name: str, source: str = "body") -> str:
    return f"regexp_extract({source}, {quoted(pattern)}, {names.index(name) + 1})"


def _access(name: str) -> str:
    fields = "[" + ", ".join(quoted(f) for f in parsing.ACCESS_FIELDS) + "]"
    return f"struct_extract(regexp_extract(body, {quoted(_ACCESS)}, {fields}), {quoted(name)})"


_ACCESS_COLUMNS = ", ".join(
    [
        f"CAST(strptime(replace({_access('time')}, ' +0000', ''), '%d/%b/%Y:%H:%M:%S') AS VARCHAR) AS event_time",
        *[
            f"{_access(c)} AS \"{c}\""
            for c in ("ip", "user", "method", "target", "protocol", "referer", "agent")
        ],
        f"CAST({_access('status')} AS INT) AS status",
        f"TRY_CAST({_access('size')} AS BIGINT) AS size",
    ]
)


@register(
    "parse_access",
    on_logs(
        f"SELECT log_id, {_ACCESS_COLUMNS} FROM logs WHERE regexp_matches(body, {quoted(_ACCESS)})"
    ),
)
def _parse_access(spark, sf):
    rows = parsing.parse_access(event_logs(spark, sf)).where(F.col("method").isNotNull())
    return rows.select(
        "log_id", text("event_time"), "ip", "user", "method", "target", "protocol", "referer",
        "agent", "status", "size",
    )


def _slashed(name: str) -> str:
    return _group(_SLASHED, parsing.SLASHED_FIELDS, name)


@register(
    "parse_nginx_error",
    on_logs(
        f"""
SELECT log_id, CAST(strptime({_slashed('time')}, '%Y/%m/%d %H:%M:%S') AS VARCHAR) AS event_time,
       {_slashed('level')} AS level, CAST({_slashed('pid')} AS INT) AS pid,
       CAST({_slashed('tid')} AS INT) AS tid, CAST({_slashed('cid')} AS BIGINT) AS cid,
       {_slashed('message')} AS message
FROM logs WHERE regexp_matches(body, {quoted(_SLASHED)})
"""
    ),
)
def _parse_nginx(spark, sf):
    rows = parsing.parse_nginx_error(event_logs(spark, sf)).where(F.col("level").isNotNull())
    return rows.select("log_id", text("event_time"), "level", "pid", "tid", "cid", "message")


def _bracketed(name: str) -> str:
    return _group(_BRACKETED, parsing.BRACKETED_FIELDS, name)


_NUMBER = "CASE {level} " + " ".join(
    f"WHEN '{k}' THEN {v[0]}" for k, v in LEVELS.items()
) + " ELSE 9 END"
_TEXT = "CASE {level} " + " ".join(
    f"WHEN '{k}' THEN '{v[1]}'" for k, v in LEVELS.items()
) + " ELSE 'INFO' END"
_ERRORS_CTE = f"WITH errors AS ({WEEKDAY_ERRORS_SQL.format(weekday=ORACLE_WEEKDAY)})"


@register(
    "parse_apache_error",
    _ERRORS_CTE
    + f"""
SELECT log_id, CAST(strptime('2024 ' || {_bracketed('month')} || ' ' || {_bracketed('dom')} || ' ' ||
         {_bracketed('clock')}, '%Y %b %d %H:%M:%S.%g') AS VARCHAR) AS event_time,
       {_bracketed('level')} AS level, CAST({_bracketed('pid')} AS INT) AS pid,
       {_bracketed('message')} AS message
FROM errors
""",
)
def _parse_apache(spark, sf):
    rows = parsing.parse_apache_error(weekday_errors(spark, sf))
    return rows.select("log_id", text("event_time"), "level", "pid", "message")


@register(
    "level_severity",
    _ERRORS_CTE
    + f"""
SELECT level, {_NUMBER.format(level='level')} AS severity_number,
       {_TEXT.format(level='level')} AS severity_text, count(*) AS count
FROM (SELECT {_bracketed('level')} AS level FROM errors) GROUP BY 1, 2, 3
""",
)
def _level(spark, sf):
    rows = parsing.parse_apache_error(weekday_errors(spark, sf))
    severity = level_severity(F.col("level"))
    return rows.groupBy(
        "level", severity["number"].alias("severity_number"), severity["text"].alias("severity_text")
    ).count()


@register(
    "status_severity",
    on_logs(
        f"""
SELECT status, CASE status // 100 WHEN 4 THEN 13 WHEN 5 THEN 17 ELSE 9 END AS severity_number,
       CASE status // 100 WHEN 4 THEN 'WARN' WHEN 5 THEN 'ERROR' ELSE 'INFO' END AS severity_text,
       count(*) AS count
FROM (SELECT TRY_CAST({_access('status')} AS INT) AS status FROM logs) GROUP BY 1, 2, 3
"""
    ),
)
def _status(spark, sf):
    rows = parsing.parse_access(event_logs(spark, sf))
    severity = status_severity(F.col("status"))
    return rows.groupBy(
        "status", severity["number"].alias("severity_number"), severity["text"].alias("severity_text")
    ).count()


_MIXED_CTES = (
    f"errors AS ({WEEKDAY_ERRORS_SQL.format(weekday=ORACLE_WEEKDAY)})",
    "mixed AS (SELECT log_id, timestamp, service_name, body FROM logs UNION ALL "
    "SELECT log_id + 1000000000, timestamp, service_name, body FROM errors)",
)


def mixed_lines(spark, sf):
    """All three formats, lines of none, empty and missing ones."""
    columns = parsing.ID_COLUMNS
    other = weekday_errors(spark, sf).withColumn("log_id", F.col("log_id") + 1_000_000_000)
    return event_logs(spark, sf).select(*columns).unionByName(other.select(*columns))


@register(
    "parse_logs",
    on_logs(
        f"""
SELECT log_id, log_type, error_type, level, status, pid,
       CASE log_type WHEN 'access' THEN CASE status // 100 WHEN 4 THEN 13 WHEN 5 THEN 17 ELSE 9 END
            ELSE {_NUMBER.format(level='level')} END AS severity_number
FROM (
  SELECT log_id,
    CASE WHEN regexp_matches(body, {quoted(_ACCESS)}) THEN 'access' ELSE 'error' END AS log_type,
    CASE WHEN regexp_matches(body, {quoted(_BRACKETED)}) THEN 'apache_error'
         WHEN regexp_matches(body, {quoted(_SLASHED)}) THEN 'nginx_error' END AS error_type,
    coalesce(nullif({_bracketed('level')}, ''), nullif({_slashed('level')}, '')) AS level,
    TRY_CAST({_access('status')} AS INT) AS status,
    coalesce(TRY_CAST({_bracketed('pid')} AS INT), TRY_CAST({_slashed('pid')} AS INT)) AS pid
  FROM mixed WHERE regexp_matches(body, {quoted(_ACCESS)})
     OR regexp_matches(body, {quoted(_BRACKETED)}) OR regexp_matches(body, {quoted(_SLASHED)}))
""",
        *_MIXED_CTES,
    ),
)
def _parse_logs(spark, sf):
    parsed = parsing.parse_logs(mixed_lines(spark, sf)).parsed
    return parsed.select(
        "log_id", "log_type", "error_type", "level", "status", "pid", "severity_number"
    )


@register(
    "parse_rejects",
    on_logs(
        f"""
SELECT log_id, CASE WHEN coalesce(body, '') = '' THEN 'empty' ELSE 'no known format' END AS reason
FROM mixed WHERE NOT coalesce(regexp_matches(body, {quoted(_ACCESS)})
     OR regexp_matches(body, {quoted(_BRACKETED)}) OR regexp_matches(body, {quoted(_SLASHED)}), false)
""",
        *_MIXED_CTES,
    ),
)
def _parse_rejects(spark, sf):
    return parsing.parse_logs(mixed_lines(spark, sf)).rejects.select("log_id", "reason")


# --- streams ----------------------------------------------------------------------------


def _stream_table(spark, sf, copies: int = 1):
    """The fixture as a stream over a written table, each record ``copies`` times."""
    path = scratch_path(spark, "stream-source")
    rows = event_logs(spark, sf)
    for _ in range(copies):
        rows.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@register("stream_ingest", on_logs(FLAT_SQL))
def _stream_ingest(spark, sf):
    """Documents dropped in a folder, loaded to the table by a stream."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    to_otlp(event_logs(spark, sf)).write.json(source)
    stream_logs(spark, source, target, checkpoint, available_now=True).awaitTermination()
    return _flat(table.read_logs(spark, target))


@register("stream_dedupe", on_logs(FLAT_SQL))
def _stream_dedupe(spark, sf):
    """Every record sent twice, in files and batches of their own, kept once.

    The records span a month, far more than the lateness, which counts from arrival.
    """
    target, checkpoint, path = (scratch_path(spark, n) for n in ("out", "check", "stream-source"))
    rows = event_logs(spark, sf, dealt=True)
    for _ in range(2):
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        write_stream(dedupe_stream(stream), target, checkpoint, available_now=True).awaitTermination()
        rows = spark.read.schema(rows.schema).parquet(path)  # the same files once more
    return _flat(table.read_logs(spark, target))


@register("stream_then_append", on_logs(FLAT_SQL + "UNION ALL " + FLAT_SQL))
def _stream_then_append(spark, sf):
    """A table that a stream and a batch both write to."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    logs = event_logs(spark, sf)
    to_otlp(logs).write.json(source)
    stream_logs(spark, source, target, checkpoint, available_now=True).awaitTermination()
    table.write_logs(logs, target)
    return _flat(table.read_logs(spark, target))


_RETAINED = "CAST(timestamp AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-22'"


@register(
    "stream_retention",
    on_logs(
        f"SELECT CASE WHEN {_RETAINED} THEN 'kept' ELSE 'rows' END AS place, count(*) AS n "
        "FROM logs GROUP BY 1 UNION ALL SELECT 'documents', count(*) FROM events WHERE event_id % 50 = 0"
    ),
)
def _stream_retention(spark, sf):
    """Retention and broken documents as part of the load: what is kept and what is put aside."""
    source, target, checkpoint, aside = (
        scratch_path(spark, n) for n in ("in", "out", "check", "aside")
    )
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 50 = 0")
    good = to_otlp(event_logs(spark, sf)).select(F.to_json(F.struct("*")).alias("value"))
    good.union(events.selectExpr("concat('{broken ', event_id)")).write.text(source)
    stream_logs(
        spark, source, target, checkpoint, available_now=True, quarantine=aside,
        as_of="2024-01-15T12:00:00Z", past=5, future=7,
    ).awaitTermination()
    places = {
        "kept": table.read_logs(spark, target),
        "rows": spark.read.parquet(f"{aside}/rows"),
        "documents": spark.read.parquet(f"{aside}/documents"),
    }
    counts = [p.select(F.lit(n).alias("place")) for n, p in places.items()]
    return counts[0].union(counts[1]).union(counts[2]).groupBy("place").agg(F.count("*").alias("n"))


@register(
    "drop_expired_read",
    on_logs(FLAT_SQL + "WHERE CAST(timestamp AS DATE) >= DATE '2024-01-12'"),
)
def _drop_expired_read(spark, sf):
    """A streamed table after its oldest days are dropped."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    to_otlp(event_logs(spark, sf)).write.json(source)
    stream_logs(spark, source, target, checkpoint, available_now=True).awaitTermination()
    table.drop_expired(spark, target, date(2024, 1, 17), past=5)
    return _flat(table.read_logs(spark, target))


@register(
    "stream_volume",
    on_logs(
        """
SELECT service_name, strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS ts, count(*) AS count
FROM (SELECT service_name, time_bucket(INTERVAL '1 hour', timestamp, TIMESTAMP '1970-01-01') AS b
      FROM logs)
WHERE b + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM logs) - INTERVAL 10 MINUTE
GROUP BY 1, 2
"""
    ),
)
def _stream_volume(spark, sf):
    """Closed hours only: the last ones wait for the watermark."""
    target, checkpoint = (scratch_path(spark, n) for n in ("out", "check"))
    volume = stream_volume(_stream_table(spark, sf), "1h", "10 minutes", ["service_name"])
    query = (
        volume.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.schema(volume.schema).parquet(target)
    return written.select(
        "service_name",
        F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        "count",
    )


@register("stream_dedupe_history", on_logs(FLAT_SQL))
def _stream_dedupe_history(spark, sf):
    """The whole month sent again by a stream of its own after the first has ended; the filters tell."""
    target, seen = scratch_path(spark, "out"), scratch_path(spark, "seen")
    for _ in range(2):
        write_stream(
            _stream_table(spark, sf), target, scratch_path(spark, "check"), available_now=True, seen=seen
        ).awaitTermination()
    return _flat(table.read_logs(spark, target))


@register(
    "stream_volume_late",
    on_logs(
        """
SELECT service_name, strftime(time_bucket(INTERVAL '1 hour', timestamp, TIMESTAMP '1970-01-01'),
       '%Y-%m-%dT%H:%M:%SZ') AS ts, count(*) AS count
FROM logs GROUP BY 1, 2
"""
    ),
)
def _stream_volume_late(spark, sf):
    """Newest records first, so that nearly all of them are days late; one day is merged on the way."""
    target, checkpoint, path = (scratch_path(spark, n) for n in ("out", "check", "stream-source"))
    rows = event_logs(spark, sf)
    keys = ["service_name"]
    for part in (F.col("timestamp") >= "2024-01-15", F.col("timestamp") < "2024-01-15"):
        rows.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        stream_counts(stream, target, checkpoint, "1h", keys, available_now=True).awaitTermination()
        merge_volume(spark, target, "2024-01-20", keys)
    return read_volume(spark, target, keys).select(
        "service_name",
        F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        "count",
    )


@register("compact_read", on_logs(FLAT_SQL))
def _compact_read(spark, sf):
    """A streamed table after a compaction that stopped half-way and the one that finished it."""
    target, checkpoint, path = (scratch_path(spark, n) for n in ("out", "check", "stream-source"))
    rows = event_logs(spark, sf)
    for part in range(3):
        rows.where(F.pmod("log_id", F.lit(3)) == part).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        write_stream(stream, target, checkpoint, available_now=True).awaitTermination()
    real = Files.delete

    def stop(self, path):
        if "day=2024-01-10" in path:
            raise InterruptedError(path)
        real(self, path)

    Files.delete = stop
    try:
        compact_day(spark, target, "2024-01-10")
    except InterruptedError:
        pass
    finally:
        Files.delete = real
    compact_day(spark, target, "2024-01-11")
    return _flat(table.read_logs(spark, target))


@register(
    "stream_match_two",
    on_logs("SELECT log_id, service_name FROM logs WHERE body <> ''"),
)
def _stream_match_two(spark, sf):
    """Two streams of different rows that write their matches to one folder."""
    rows = event_logs(spark, sf)
    patterns = mine_patterns(rows.where("severity_text = 'ERROR'")).patterns
    target = scratch_path(spark, "matched")
    for part in (0, 1):
        path, checkpoint = scratch_path(spark, "stream-source"), scratch_path(spark, "check")
        rows.where(F.col("log_id") % 2 == part).write.parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        stream_match(stream, patterns, target, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(target).select("log_id", "service_name")
