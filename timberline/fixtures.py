"""Log rows derived from the ``events`` table, for tests, checks and benchmarks.

The SQL is portable: it runs unchanged in Spark SQL and in the engine the results are
checked against. Only the weekday needs a dialect of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalars import json_to_bag
from timberline.schema import LOG_COLUMNS

LOGS_SQL = """
SELECT
  event_id AS log_id,
  ts AS timestamp,
  CASE WHEN event_id % 101 = 0 THEN NULL
       WHEN event_id % 103 = 0 THEN ''
       WHEN event_id % 4 = 0 THEN 'web-frontend'
       WHEN event_id % 4 = 1 THEN 'edge-gateway'
       WHEN event_id % 4 = 2 THEN 'orders-api'
       ELSE 'asset-server' END AS service_name,
  concat('node-', user_id % 7) AS service_instance_id,
  CASE WHEN event_id % 5 = 0 THEN NULL
       WHEN event_id % 5 = 1 THEN repeat('0', 32)
       ELSE md5(CAST(event_id AS STRING)) END AS trace_id,
  CASE WHEN event_id % 5 < 2 THEN repeat('0', 16)
       ELSE substr(md5(CAST(user_id AS STRING)), 1, 16) END AS span_id,
  CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 13
       WHEN event_type = 'error' OR user_id % 17 = 0 THEN 17
       WHEN user_id % 11 = 0 THEN 13 ELSE 9 END AS severity_number,
  CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'WARN'
       WHEN event_type = 'error' OR user_id % 17 = 0 THEN 'ERROR'
       WHEN user_id % 11 = 0 THEN 'WARN' ELSE 'INFO' END AS severity_text,
  CASE WHEN event_id % 97 = 0 THEN NULL
       WHEN event_id % 89 = 0 THEN ''
       WHEN event_type = 'error' AND event_id % 2 = 0 THEN
         concat('[', CAST(date_trunc('second', ts) AS STRING), '] [',
                CASE WHEN user_id % 3 = 0 THEN 'warn' ELSE 'error' END,
                '] [pid ', 1000 + user_id, '] AH', 10000 + user_id % 4,
                ': cannot open /srv/app/data/', user_id, '.bin')
       WHEN event_type = 'error' THEN
         concat(replace(CAST(date_trunc('second', ts) AS STRING), '-', '/'), ' [',
                CASE WHEN user_id % 3 = 0 THEN 'warn' ELSE 'error' END, '] ',
                1000 + user_id, '#', user_id % 8, ': *', event_id,
                ' backend timed out (110: Connection timed out) peer 10.0.',
                user_id % 5, '.', user_id % 200, ':8080')
       ELSE
         concat('10.0.', user_id % 5, '.', user_id % 200, ' - - [',
                lpad(CAST(day(ts) AS STRING), 2, '0'), '/',
                substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(ts) - 2 AS INT), 3),
                '/', year(ts), ':', substr(CAST(date_trunc('second', ts) AS STRING), 12, 8),
                ' +0000] "', CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END, ' ',
                CASE event_type WHEN 'view' THEN concat('/items/', user_id)
                                WHEN 'click' THEN concat('/items/', user_id, '?k=', regexp_extract(props, '[0-9]+', 0))
                                WHEN 'signup' THEN '/accounts'
                                ELSE concat('/orders/', event_id) END,
                ' HTTP/1.1" ',
                CASE WHEN user_id % 17 = 0 THEN 503 WHEN user_id % 11 = 0 THEN 404 ELSE 200 END, ' ',
                CAST(floor(value * 100) AS BIGINT), ' "-" "',
                CASE user_id % 3 WHEN 0 THEN 'curl/8.4.0' WHEN 1 THEN 'Mozilla/5.0 (X11; Linux x86_64) Firefox/126.0'
                                 ELSE 'python-requests/2.31' END, '"') END AS body,
  concat('{"service.version": "1.', user_id % 4, '.0", "deployment.environment": "',
         CASE WHEN user_id % 2 = 0 THEN 'production' ELSE 'staging' END, '"}') AS resource_attributes,
  concat('{"log.type": "', CASE WHEN event_type = 'error' THEN 'error' ELSE 'access' END,
         '", "http.status_code": "', CASE WHEN user_id % 17 = 0 THEN 503 WHEN user_id % 11 = 0 THEN 404 ELSE 200 END, '"}') AS log_attributes,
  'fixture.events' AS scope_name,
  '1.0.0' AS scope_version
FROM events
"""

#: Error lines in the bracketed format with weekday, month name and no year.
WEEKDAY_ERRORS_SQL = """
SELECT
  event_id AS log_id,
  ts AS timestamp,
  concat('svc-', user_id % 4) AS service_name,
  concat('[', substr('SunMonTueWedThuFriSat', CAST(3 * {weekday} + 1 AS INT), 3), ' ',
         substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(ts) - 2 AS INT), 3), ' ',
         lpad(CAST(day(ts) AS STRING), 2, '0'), ' ',
         substr(CAST(date_trunc('second', ts) AS STRING), 12, 8), '.',
         lpad(CAST(event_id % 1000 AS STRING), 3, '0'), ' UTC] [',
         CASE user_id % 9 WHEN 0 THEN 'trace' WHEN 1 THEN 'debug' WHEN 2 THEN 'info'
                          WHEN 3 THEN 'notice' WHEN 4 THEN 'warn' WHEN 5 THEN 'crit'
                          WHEN 6 THEN 'emerg' ELSE 'error' END,
         '] [pid ', 1000 + user_id, '] AH', 10000 + user_id % 4, ': ', event_type, ' refused') AS body
FROM events
"""

SPARK_WEEKDAY = "(dayofweek(ts) - 1)"
ORACLE_WEEKDAY = "dayofweek(ts)"


def _events_sql(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    view = "timberline_events"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dealt:
        events = events.hint("rebalance", F.col("event_id"))
    events.createOrReplaceTempView(view)
    rows = spark.sql(sql.replace("FROM events", f"FROM {view}"))
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def event_logs(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Log table rows for every event; ``dealt`` evenly first, so that many tasks make them."""
    rows = _events_sql(spark, sf_dir, LOGS_SQL, dealt)
    return rows.withColumns(
        {
            "resource_attributes": json_to_bag(F.col("resource_attributes")),
            "log_attributes": json_to_bag(F.col("log_attributes")),
        }
    ).select(*LOG_COLUMNS)


def weekday_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_sql(spark, sf_dir, WEEKDAY_ERRORS_SQL.format(weekday=SPARK_WEEKDAY))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")
