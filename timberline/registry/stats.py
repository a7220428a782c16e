"""Filters, pages and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.fixtures import event_logs
from timberline.functions import scalars
from timberline.operators import filters, paging, stats
from timberline.plans.explorer import overview_report
from timberline.operators import rollup
from timberline.registry.base import (
    AS_OF,
    END,
    IN_RANGE,
    ORACLES,
    SQL_AS_OF,
    START,
    on_logs,
    register,
    text,
)
from timberline.sources.logs import read_logs
from timberline.sources.scratch import scratch_path
from timberline.streaming.ingest import append_batch, compact_day

# --- counts ---------------------------------------------------------------------------


@register("total", on_logs(f"SELECT count(*) AS total FROM logs WHERE {IN_RANGE}"))
def _total(spark, sf):
    return stats.total(filters.time_range(event_logs(spark, sf), START, END))


@register(
    "severity_counts",
    on_logs(
        f"SELECT severity_text, count(*) AS count FROM logs WHERE {IN_RANGE} GROUP BY severity_text"
    ),
)
def severity_counts(spark, sf):
    return stats.by_severity_counts(filters.time_range(event_logs(spark, sf), START, END))


@register(
    "service_counts",
    on_logs("SELECT service_name, count(*) AS count FROM logs GROUP BY service_name"),
)
def _service_counts(spark, sf):
    return stats.by_service_counts(event_logs(spark, sf))


@register(
    "top_services",
    on_logs(
        "SELECT service_name, count(*) AS count FROM logs GROUP BY service_name "
        "ORDER BY count DESC, service_name NULLS FIRST LIMIT 8"
    ),
)
def _top_services(spark, sf):
    return stats.top_services(event_logs(spark, sf), 8)


@register(
    "services",
    on_logs(
        "SELECT DISTINCT service_name FROM logs "
        "WHERE service_name IS NOT NULL AND service_name <> ''"
    ),
)
def _services(spark, sf):
    return stats.services(event_logs(spark, sf))


@register(
    "overview_sets",
    on_logs(
        f"""
SELECT CASE WHEN grouping(severity_text) = 1 AND grouping(service_name) = 1 THEN 'total'
            WHEN grouping(severity_text) = 0 THEN 'severity' ELSE 'service' END AS facet,
       coalesce(severity_text, service_name) AS value,
       count(*) AS count
FROM logs WHERE {IN_RANGE}
GROUP BY GROUPING SETS ((), (severity_text), (service_name))
"""
    ),
)
def _overview(spark, sf):
    return stats.overview(event_logs(spark, sf), START, END)


@register(
    "hourly_volume",
    on_logs(
        f"""
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%dT%H:00:00Z') AS ts, count(*) AS count
FROM logs WHERE timestamp >= {SQL_AS_OF} - INTERVAL 24 HOUR GROUP BY 1
"""
    ),
)
def _hourly(spark, sf):
    return stats.hourly_volume(event_logs(spark, sf), AS_OF)


@register(
    "severity_cards",
    on_logs(
        f"""
SELECT count(*) AS total,
       count(*) FILTER (severity_text = 'ERROR') AS error,
       CASE WHEN count(*) FILTER (severity_text = 'WARN') > 0
            THEN count(*) FILTER (severity_text = 'WARN')
            ELSE count(*) FILTER (severity_text = 'WARNING') END AS warn,
       count(*) FILTER (severity_text = 'INFO') AS info
FROM logs WHERE {IN_RANGE}
"""
    ),
)
def _cards(spark, sf):
    return stats.severity_cards(filters.time_range(event_logs(spark, sf), START, END))


@register("overview_cards", ORACLES["severity_cards"])
def _overview_cards(spark, sf):
    """The cards of the whole overview, from its single scan."""
    return overview_report(event_logs(spark, sf), START, END, AS_OF).cards


def _bucket_sql(width: str) -> str:
    interval = scalars.WIDTHS[width]
    return on_logs(
        f"""
SELECT strftime(time_bucket(INTERVAL '{interval}', timestamp, TIMESTAMP '1970-01-01'),
                '%Y-%m-%dT%H:%M:%SZ') AS ts, count(*) AS count
FROM logs GROUP BY 1
"""
    )


def _bucket_query(width: str):
    def run(spark, sf):
        return stats.labelled(stats.bucket_counts(event_logs(spark, sf), width))

    return run


for _width in scalars.WIDTHS:
    register(f"bucket_counts_{_width}", _bucket_sql(_width))(_bucket_query(_width))


@register(
    "bucket_counts_by_service",
    on_logs(
        """
SELECT service_name,
       strftime(time_bucket(INTERVAL '6 hours', timestamp, TIMESTAMP '1970-01-01'),
                '%Y-%m-%dT%H:%M:%SZ') AS ts, count(*) AS count
FROM logs GROUP BY 1, 2
"""
    ),
)
def _bucket_by_service(spark, sf):
    return stats.labelled(stats.bucket_counts(event_logs(spark, sf), "6h", ["service_name"]))


@register(
    "filled_series",
    on_logs(
        """
SELECT g.service_name, strftime(g.b, '%Y-%m-%dT%H:%M:%SZ') AS ts, coalesce(c.count, 0) AS count
FROM (SELECT service_name, unnest(generate_series(TIMESTAMP '2024-01-05 06:00:00',
             TIMESTAMP '2024-01-20 18:30:00', INTERVAL 15 MINUTE)) AS b
      FROM (SELECT DISTINCT service_name FROM counts)) g
LEFT JOIN counts c ON c.service_name IS NOT DISTINCT FROM g.service_name AND c.b = g.b
""",
        f"""counts AS (SELECT service_name,
  time_bucket(INTERVAL '15 minutes', timestamp, TIMESTAMP '1970-01-01') AS b, count(*) AS count
  FROM logs WHERE severity_text = 'ERROR' AND {IN_RANGE} GROUP BY 1, 2)""",
    ),
)
def _filled(spark, sf):
    errors = filters.filter_logs(event_logs(spark, sf), severity="error", start=START, end=END)
    series = stats.bucket_counts(errors, "15m", ["service_name"])
    return stats.labelled(stats.fill_buckets(series, START, END, "15m", ["service_name"]))


@register(
    "share_of_max",
    on_logs(
        """
SELECT service_name, count, round(100.0 * count / max(count) OVER (), 2) AS share
FROM (SELECT service_name, count(*) AS count FROM logs GROUP BY service_name)
"""
    ),
)
def _share(spark, sf):
    return stats.share_of_max(stats.by_service_counts(event_logs(spark, sf)))


# --- pages ----------------------------------------------------------------------------

PAGE_SQL = """
SELECT log_id, CAST(timestamp AS VARCHAR) AS timestamp, service_name, service_instance_id, trace_id,
       span_id, severity_number, severity_text, body,
       json_extract_string(log_attributes, '$."http.status_code"') AS status,
       scope_name, scope_version
"""


def _flat_page(page):
    status = F.try_element_at("log_attributes", F.lit("http.status_code"))
    return page.withColumn("status", status).drop("log_attributes")


@register(
    "log_page",
    on_logs(
        PAGE_SQL
        + f"FROM logs WHERE severity_text = 'ERROR' AND service_name = 'orders-api' AND {IN_RANGE} "
        "ORDER BY logs.timestamp DESC, log_id DESC LIMIT 100 OFFSET 40"
    ),
)
def _log_page(spark, sf):
    page = paging.log_page(
        event_logs(spark, sf), limit=100, offset=40, with_id=True,
        severity="error", service="orders-api", start=START, end=END,
    )
    return _flat_page(page.rows)


@register(
    "log_page_total",
    on_logs(
        f"SELECT count(*) AS total FROM logs WHERE severity_text = 'ERROR' "
        f"AND service_name = 'orders-api' AND {IN_RANGE}"
    ),
)
def _log_page_total(spark, sf):
    return paging.log_page(
        event_logs(spark, sf), severity="error", service="orders-api", start=START, end=END
    ).total


@register(
    "log_page_after",
    on_logs(
        PAGE_SQL
        + """FROM logs WHERE logs.timestamp < TIMESTAMP '2024-01-15 12:00:00'
OR (logs.timestamp = TIMESTAMP '2024-01-15 12:00:00' AND log_id < 5000)
ORDER BY logs.timestamp DESC, log_id DESC LIMIT 200"""
    ),
)
def _log_page_after(spark, sf):
    logs = event_logs(spark, sf)
    return _flat_page(paging.log_page_after(logs, "2024-01-15T12:00:00Z", 5000, 200))


@register(
    "log_page_deep",
    on_logs(
        PAGE_SQL
        + "FROM logs ORDER BY logs.timestamp DESC, log_id DESC "
        "LIMIT 150 OFFSET (SELECT CAST(0.7 * count(*) AS BIGINT) FROM logs)"
    ),
)
def _log_page_deep(spark, sf):
    """A page far down, found by counts."""
    logs = event_logs(spark, sf)
    offset = (logs.count() * 7 + 5) // 10
    return _flat_page(paging.log_page(logs, 150, offset, with_id=True, deep_offset=0).rows)


@register(
    "log_page_deep_counts",
    on_logs(
        PAGE_SQL
        + "FROM logs WHERE severity_text = 'INFO' ORDER BY logs.timestamp DESC, log_id DESC "
        "LIMIT 150 OFFSET (SELECT CAST(0.4 * count(*) AS BIGINT) FROM logs WHERE severity_text = 'INFO')"
    ),
)
def _log_page_deep_counts(spark, sf):
    """A page far down under a filter, found from the kept counts."""
    logs, beside = event_logs(spark, sf), scratch_path(spark, "beside")
    rollup.write_counts(logs, beside, "all")
    own = logs.where("severity_text = 'INFO'").count()
    page = paging.log_page(
        logs, 150, (own * 4 + 5) // 10, with_id=True, deep_offset=0,
        counts=rollup.read_counts(spark, beside), severity="INFO",
    )
    return _flat_page(page.rows)


@register(
    "log_page_ties",
    on_logs(
        PAGE_SQL
        + """FROM (SELECT * FROM logs UNION ALL SELECT * FROM logs UNION ALL SELECT * FROM logs) AS logs
ORDER BY logs.timestamp DESC, log_id DESC LIMIT 100 OFFSET 50"""
    ),
)
def _log_page_ties(spark, sf):
    """Every record stored three times: the cursor says how many equal ones were shown."""
    logs = event_logs(spark, sf)
    thrice = logs.unionByName(logs).unionByName(logs)
    last = paging.log_page(thrice, 50, 0, with_id=True).rows.collect()[-1]
    return _flat_page(
        paging.log_page_after(thrice, last["timestamp"], last["log_id"], 100, shown=2)
    )


@register(
    "tail_logs",
    on_logs(
        """
SELECT CAST(timestamp AS VARCHAR) AS timestamp, severity_text, service_name, left(body, 80) AS body
FROM logs ORDER BY logs.timestamp DESC, log_id DESC LIMIT 20
"""
    ),
)
def _tail(spark, sf):
    return paging.tail_logs(event_logs(spark, sf))


@register(
    "cap_newest",
    on_logs(
        "SELECT severity_text, count(*) AS count FROM (SELECT severity_text FROM logs "
        "ORDER BY timestamp DESC, log_id DESC LIMIT 3000) GROUP BY 1"
    ),
)
def _cap_newest(spark, sf):
    return stats.by_severity_counts(paging.cap_rows(event_logs(spark, sf), 3000))


@register(
    "cap_oldest",
    on_logs(
        "SELECT severity_text, count(*) AS count FROM (SELECT severity_text FROM logs "
        "ORDER BY timestamp, log_id LIMIT 3000) GROUP BY 1"
    ),
)
def _cap_oldest(spark, sf):
    return stats.by_severity_counts(paging.cap_rows(event_logs(spark, sf), 3000, newest=False))


# --- filters --------------------------------------------------------------------------


def _ids(logs):
    return logs.select("log_id", text())


IDS = "SELECT log_id, CAST(timestamp AS VARCHAR) AS timestamp FROM logs WHERE "


@register("range_filter", on_logs(IDS + IN_RANGE))
def _range(spark, sf):
    return _ids(filters.time_range(event_logs(spark, sf), START, END))


@register(
    "relative_window",
    on_logs(
        IDS + f"timestamp >= {SQL_AS_OF} - INTERVAL 6 HOUR AND timestamp <= {SQL_AS_OF}"
    ),
)
def _relative(spark, sf):
    return _ids(filters.last(event_logs(spark, sf), "6h", AS_OF))


@register(
    "combined_filter",
    on_logs(
        IDS
        + f"severity_text = 'WARN' AND service_name = 'edge-gateway' AND {IN_RANGE} "
        "AND list_contains(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}_]+'), 'timed')"
    ),
)
def _combined(spark, sf):
    return _ids(
        filters.filter_logs(
            event_logs(spark, sf), q="Timed", severity="warn", service="edge-gateway",
            start=START, end=END,
        )
    )


@register(
    "attr_filter",
    on_logs(IDS + "json_extract_string(log_attributes, '$.\"http.status_code\"') = '503'"),
)
def _attr(spark, sf):
    return _ids(filters.by_attribute(event_logs(spark, sf), "log_attributes", "http.status_code", "503"))


@register(
    "resource_filter",
    on_logs(IDS + "json_extract_string(resource_attributes, '$.\"service.version\"') = '1.2.0'"),
)
def _resource(spark, sf):
    return _ids(
        filters.by_attribute(event_logs(spark, sf), "resource_attributes", "service.version", "1.2.0")
    )


@register("trace_lookup", on_logs(IDS + "trace_id = md5('888')"))
def _trace(spark, sf):
    return _ids(filters.by_trace(event_logs(spark, sf), "0a113ef6b61820daa5611c870ed8d5ee"))


@register("span_lookup", on_logs(IDS + "span_id = substr(md5('42'), 1, 16)"))
def _span(spark, sf):
    return _ids(filters.by_span(event_logs(spark, sf), "a1d0c6e83f027327"))


@register("instance_lookup", on_logs(IDS + "service_instance_id = 'node-3'"))
def _instance(spark, sf):
    return _ids(filters.by_instance(event_logs(spark, sf), "node-3"))


@register(
    "scope_lookup", on_logs(IDS + "scope_name = 'fixture.events' AND scope_version = '1.0.0'")
)
def _scope(spark, sf):
    return _ids(filters.by_scope(event_logs(spark, sf), "fixture.events", "1.0.0"))


@register(
    "zero_ids",
    on_logs(
        "SELECT log_id, nullif(trace_id, repeat('0', 32)) AS trace_id, "
        "nullif(span_id, repeat('0', 16)) AS span_id FROM logs"
    ),
)
def _zero(spark, sf):
    return filters.nullify_zero_ids(event_logs(spark, sf)).select("log_id", "trace_id", "span_id")


@register("non_empty_bodies", on_logs(IDS + "body IS NOT NULL AND body <> ''"))
def _non_empty(spark, sf):
    return _ids(filters.non_empty_body(event_logs(spark, sf)))


@register(
    "row_labels",
    on_logs(
        """
SELECT log_id,
       coalesce(substr(nullif(trace_id, repeat('0', 32)), 1, 16) || '…', '—') AS short_trace,
       strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS short_time,
       strftime(timestamp, '%Y-%m-%dT%H:00:00Z') AS hour,
       strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS iso,
       replace(replace(log_attributes, ': ', ':'), ', ', ',') AS attributes,
       CAST(json_extract_string(log_attributes, '$."http.status_code"') AS INT) // 100 AS family
FROM logs
"""
    ),
)
def _labels(spark, sf):
    ts = F.col("timestamp")
    bag = F.col("log_attributes")
    status = F.try_element_at(bag, F.lit("http.status_code")).try_cast("int")
    return event_logs(spark, sf).select(
        "log_id",
        scalars.short_trace(F.col("trace_id")).alias("short_trace"),
        scalars.short_time(ts).alias("short_time"),
        scalars.hour_label(ts).alias("hour"),
        scalars.iso_label(ts).alias("iso"),
        scalars.bag_to_json(bag).alias("attributes"),
        F.floor(status / 100).cast("int").alias("family"),
    )


# --- answers from kept counts -----------------------------------------------------------


def _kept_counts(spark, sf):
    """A table written in two batches, one of them twice, and compacted; with its counts."""
    target, beside = scratch_path(spark, "out"), scratch_path(spark, "index")
    rows = event_logs(spark, sf)
    for name, part in (("a", 0), ("b", 1), ("a", 0)):
        append_batch(rows.where(F.col("log_id") % 2 == part), target, name, index=beside)
    compact_day(spark, target, "2024-01-15", index=beside)
    return read_logs(spark, target), rollup.read_counts(spark, beside)


@register("overview_counted", ORACLES["overview_sets"])
def _overview_counted(spark, sf):
    return rollup.overview(*_kept_counts(spark, sf), START, END)


@register("hourly_volume_counted", ORACLES["hourly_volume"])
def _hourly_counted(spark, sf):
    return rollup.hourly_volume(*_kept_counts(spark, sf), AS_OF)
