"""Nested telemetry export documents to table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions.scalars import bag_of, nanos_to_ts, value_text
from timberline.schema import CORRUPT, LOG_COLUMNS, OTLP_SCHEMA

#: The document schema plus the place for text that is no document.
READ_SCHEMA = T.StructType([*OTLP_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Exported documents, one JSON object per line, with a fixed schema."""
    return spark.read.schema(READ_SCHEMA).json(path)


def parse_otlp(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column, e.g. the value of a message queue."""
    parsed = F.from_json(column, READ_SCHEMA, {"columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("doc")).select("doc.*")


def broken_documents(documents: DataFrame) -> DataFrame:
    """Text that did not parse, for quarantine."""
    return documents.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def flatten_otlp(documents: DataFrame) -> DataFrame:
    """One row per log record; resource and scope values apply to all records beneath.

    ``log_id`` is a hash of the whole record with its resource and scope, so a record
    that is sent again gets the same id.
    """
    per_resource = documents.select(F.explode("resourceLogs").alias("r"))
    per_scope = per_resource.select(
        F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeLogs").alias("s")
    )
    per_record = per_scope.select(
        "resource", F.col("s.scope").alias("scope"), F.explode("s.logRecords").alias("rec")
    )
    bags = per_record.select(
        "rec",
        "scope",
        bag_of(F.col("resource")).alias("resource_attributes"),
        bag_of(F.col("rec.attributes")).alias("log_attributes"),
        F.xxhash64("resource", "scope", "rec").alias("log_id"),
    )
    event_nanos = F.coalesce(
        F.nullif(F.col("rec.timeUnixNano"), F.lit("0")), F.col("rec.observedTimeUnixNano")
    )

    def resource(key: str):
        return F.try_element_at(F.col("resource_attributes"), F.lit(key))

    rows = bags.select(
        "log_id",
        nanos_to_ts(event_nanos).alias("timestamp"),
        resource("service.name").alias("service_name"),
        resource("service.instance.id").alias("service_instance_id"),
        F.col("rec.traceId").alias("trace_id"),
        F.col("rec.spanId").alias("span_id"),
        F.col("rec.severityNumber").alias("severity_number"),
        F.col("rec.severityText").alias("severity_text"),
        value_text(F.col("rec.body")).alias("body"),
        "resource_attributes",
        "log_attributes",
        F.col("scope.name").alias("scope_name"),
        F.col("scope.version").alias("scope_version"),
    )
    return rows.select(*LOG_COLUMNS)


def to_otlp(logs: DataFrame, batch: int = 500) -> DataFrame:
    """Log rows as export documents of about ``batch`` records each.

    Rows are dealt to documents by a hash of their id, so a busy service becomes many
    documents and none grows with the table.
    """
    count_per_service = logs.groupBy("service_name", "service_instance_id").agg(
        F.ceil(F.count(F.lit(1)) / batch).alias("_docs")
    )
    dealt = logs.alias("l").join(
        count_per_service.alias("c"),
        F.col("l.service_name").eqNullSafe(F.col("c.service_name"))
        & F.col("l.service_instance_id").eqNullSafe(F.col("c.service_instance_id")),
    ).select("l.*", F.pmod(F.xxhash64("l.timestamp", "l.log_id"), F.col("_docs")).alias("_doc"))

    def pairs(bag):
        return F.transform(
            F.map_entries(bag),
            lambda e: F.struct(
                e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")
            ),
        )

    nanos = (F.unix_micros("timestamp") * 1000).cast("string")
    record = F.struct(
        nanos.alias("timeUnixNano"),
        nanos.alias("observedTimeUnixNano"),
        F.col("severity_number").alias("severityNumber"),
        F.col("severity_text").alias("severityText"),
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.struct(F.col("body").alias("stringValue")).alias("body"),
        pairs(F.col("log_attributes")).alias("attributes"),
    )
    named = F.map_filter(
        F.map_from_arrays(
            F.array(F.lit("service.name"), F.lit("service.instance.id")),
            F.array("service_name", "service_instance_id"),
        ),
        lambda k, v: v.isNotNull(),
    )
    grouped = (
        dealt.withColumn("_rec", record)
        .withColumn("_res", F.concat(pairs(named), pairs(F.col("resource_attributes"))))
        .groupBy("_res", "scope_name", "scope_version", "_doc")
        .agg(F.collect_list("_rec").alias("records"))
    )
    scope = F.struct(F.col("scope_name").alias("name"), F.col("scope_version").alias("version"))
    scope_logs = F.array(F.struct(scope.alias("scope"), F.col("records").alias("logRecords")))
    resource_logs = F.array(
        F.struct(
            F.struct(F.col("_res").alias("attributes")).alias("resource"),
            scope_logs.alias("scopeLogs"),
        )
    )
    return grouped.select(resource_logs.alias("resourceLogs"))
