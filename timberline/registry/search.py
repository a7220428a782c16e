"""Full-text search by scan and through the term index."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from timberline.fixtures import conversations, documents, event_logs
from timberline.functions.text import MODES, match
from timberline.operators import attributes
from timberline.operators.search import (
    build_term_index,
    catch_up,
    days_behind,
    read_term_index,
    search_index,
    write_term_index,
)
from timberline.registry.base import on_logs, quoted, register
from timberline.sources import logs as table
from timberline.sources.logs import with_day
from timberline.sources.scratch import scratch_path
from timberline.streaming.ingest import append_batch, compact_day, write_stream

TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"

#: Query text per mode, for documents and for logs.
DOCUMENT_QUERIES = {
    "MATCH_ANY": "Token LICENSE",
    "MATCH_ALL": "the with que",
    "MATCH_PHRASE": "by the",
    "MATCH_PHRASE_PREFIX": "of th",
    "MATCH_PHRASE_EDGE": "n the w",
    "MATCH_REGEXP": "^[0-9]{3,5}$",
}
LOG_QUERIES = {
    "MATCH_ANY": "firefox refused timed",
    "MATCH_ALL": "GET curl 503",
    "MATCH_PHRASE": "timed out (110",
    "MATCH_PHRASE_PREFIX": "connection tim",
    "MATCH_PHRASE_EDGE": "quests",
    "MATCH_REGEXP": "^ah1000[13]$",
}


def mode_sql(mode: str, query: str, tokens: str) -> str:
    """Predicate over a token list, position by position."""
    if mode == "MATCH_REGEXP":
        return f"len(list_filter({tokens}, lambda x: regexp_matches(x, {quoted(query)}))) > 0"
    q = [t for t in "".join(c if c.isalnum() or c == "_" else " " for c in query.lower()).split()]
    items = "[" + ", ".join(quoted(t) for t in q) + "]"
    if mode == "MATCH_ANY":
        return f"list_has_any({tokens}, {items})"
    if mode == "MATCH_ALL":
        return f"list_has_all({tokens}, {items})"
    tests = []
    for i, t in enumerate(q):
        at = f"{tokens}[i + {i}]"
        first, final = i == 0, i == len(q) - 1
        if mode == "MATCH_PHRASE_EDGE" and len(q) == 1:
            tests.append(f"contains({at}, {quoted(t)})")
        elif mode == "MATCH_PHRASE_EDGE" and first:
            tests.append(f"suffix({at}, {quoted(t)})")
        elif mode in ("MATCH_PHRASE_PREFIX", "MATCH_PHRASE_EDGE") and final:
            tests.append(f"prefix({at}, {quoted(t)})")
        else:
            tests.append(f"{at} = {quoted(t)}")
    every = " AND ".join(tests)
    return (
        f"len(list_filter(range(1, len({tokens}) - {len(q)} + 2), "
        f"lambda i: {every})) > 0"
    )


def _document_sql(mode: str) -> str:
    return (
        f"WITH d AS (SELECT doc_id, n_chars, {TOKENS.format('text')} AS t FROM documents) "
        f"SELECT doc_id, n_chars FROM d WHERE {mode_sql(mode, DOCUMENT_QUERIES[mode], 't')}"
    )


def _log_sql(mode: str) -> str:
    return on_logs(
        f"SELECT log_id, body FROM l WHERE {mode_sql(mode, LOG_QUERIES[mode], 't')}",
        f"l AS (SELECT log_id, body, {TOKENS.format('body')} AS t FROM logs WHERE body IS NOT NULL)",
    )


def _search_documents(mode: str):
    def run(spark, sf):
        found = documents(spark, sf).where(match(F.col("text"), DOCUMENT_QUERIES[mode], mode))
        return found.select("doc_id", "n_chars")

    return run


def _search_logs(mode: str):
    def run(spark, sf):
        found = event_logs(spark, sf).where(match(F.col("body"), LOG_QUERIES[mode], mode))
        return found.select("log_id", "body")

    return run


def _through_index(mode: str):
    def run(spark, sf):
        docs = documents(spark, sf)
        built = build_term_index(docs, keys=["doc_id"], body="text")
        path = scratch_path(spark, "term-index")
        write_term_index(built, path)
        index = read_term_index(spark, path, built.schema)
        found = search_index(index, docs, DOCUMENT_QUERIES[mode], mode, keys=["doc_id"])
        return found.select("doc_id", "n_chars")

    return run


for _mode in MODES:
    _name = _mode.removeprefix("MATCH_").lower()
    register(f"search_documents_{_name}", _document_sql(_mode))(_search_documents(_mode))
    register(f"search_logs_{_name}", _log_sql(_mode))(_search_logs(_mode))
    register(f"index_search_{_name}", _document_sql(_mode))(_through_index(_mode))


@register(
    "search_conversations",
    f"WITH c AS (SELECT conv_id, turn, {TOKENS.format('text')} AS t FROM conversations) "
    f"SELECT conv_id, turn FROM c WHERE {mode_sql('MATCH_ANY', 'queries thanks les', 't')}",
)
def _conversations(spark, sf):
    found = conversations(spark, sf).where(match(F.col("text"), "queries thanks les", "no such mode"))
    return found.select("conv_id", "turn")


_INDEX_SUMMARY = """
SELECT term, count(*) AS records, sum(len(p))::BIGINT AS occurrences,
       sum(list_min(p))::BIGINT AS first_sum, sum(list_sum(p))::BIGINT AS position_sum
FROM (SELECT {key}, term, list(pos) AS p FROM (
        SELECT {key}, unnest(t) AS term, unnest(range(len(t))) AS pos FROM src) GROUP BY {key}, term)
GROUP BY term
"""


def _summary(index):
    positions = F.col("positions")
    return index.groupBy("term").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.size(positions)).alias("occurrences"),
        F.sum(F.get(positions, F.lit(0))).alias("first_sum"),
        F.sum(F.aggregate(positions, F.lit(0).cast("bigint"), lambda a, p: a + p)).alias("position_sum"),
    )


@register(
    "term_index_documents",
    f"WITH src AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)"
    + _INDEX_SUMMARY.format(key="doc_id"),
)
def _term_index_documents(spark, sf):
    return _summary(build_term_index(documents(spark, sf), keys=["doc_id"], body="text"))


@register(
    "term_index_logs",
    on_logs(
        _INDEX_SUMMARY.format(key="log_id"),
        f"src AS (SELECT log_id, {TOKENS.format('body')} AS t FROM logs WHERE body IS NOT NULL)",
    ),
)
def _term_index_logs(spark, sf):
    return _summary(build_term_index(with_day(event_logs(spark, sf))))


# --- an index that follows its table ----------------------------------------------------

_KEPT_FROM = date(2024, 1, 12)


def _followed_sql(mode: str, since: date | None = None) -> str:
    kept = f" AND day >= DATE '{since}'" if since else ""
    return on_logs(
        f"SELECT log_id, body FROM l WHERE {mode_sql(mode, LOG_QUERIES[mode], 't')}{kept}",
        f"l AS (SELECT log_id, body, CAST(timestamp AS DATE) AS day, {TOKENS.format('body')} AS t "
        "FROM logs WHERE body IS NOT NULL)",
    )


def _found_through(spark, target: str, index: str, mode: str):
    logs = table.read_logs(spark, target)
    schema = build_term_index(logs).schema
    found = search_index(read_term_index(spark, index, schema), logs, LOG_QUERIES[mode], mode)
    return found.select("log_id", "body")


@register("index_after_stream", _followed_sql("MATCH_PHRASE_PREFIX", _KEPT_FROM))
def _index_after_stream(spark, sf):
    """Loaded by a stream, appended to, compacted, and rid of its oldest days, index and all."""
    source, target, index, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "index", "check"))
    rows = event_logs(spark, sf)
    rows.where("log_id % 2 = 0").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    write_stream(stream, target, checkpoint, available_now=True, index=index).awaitTermination()
    append_batch(rows.where("log_id % 2 = 1"), target, "second", index=index)
    compact_day(spark, target, "2024-01-15", index=index)
    table.drop_expired(spark, target, date(2024, 1, 17), past=5, index=index)
    if days_behind(spark, target, index):
        raise RuntimeError("the index is behind its table")
    return _found_through(spark, target, index, "MATCH_PHRASE_PREFIX")


@register("index_catch_up", _followed_sql("MATCH_REGEXP"))
def _index_catch_up(spark, sf):
    """Half of the table comes without its postings; the days concerned are found and indexed."""
    target, index = (scratch_path(spark, n) for n in ("out", "index"))
    rows = event_logs(spark, sf)
    append_batch(rows.where("day(timestamp) % 2 = 0 OR log_id % 2 = 0"), target, "first", index=index)
    table.write_logs(rows.where("day(timestamp) % 2 = 1 AND log_id % 2 = 1"), target)
    catch_up(spark, target, index)
    return _found_through(spark, target, index, "MATCH_REGEXP")


@register(
    "term_lookup",
    f"WITH src AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), "
    "terms AS (SELECT term, count(DISTINCT doc_id) AS records FROM (SELECT doc_id, unnest(t) AS term FROM src) "
    "GROUP BY term) SELECT 'term' AS kind, term, records FROM terms WHERE prefix(term, 'th') "
    "UNION ALL SELECT 'reversed', term, records FROM terms WHERE suffix(term, 'ion') "
    "UNION ALL SELECT 'gram', term, records FROM terms WHERE contains(term, 'con')",
)
def _term_lookup(spark, sf):
    """The dictionary by beginning, end and trigram."""
    built = build_term_index(documents(spark, sf), keys=["doc_id"], body="text")
    path = scratch_path(spark, "term-index")
    write_term_index(built, path)
    terms = read_term_index(spark, path, built.schema).terms
    wanted = (
        ((F.col("kind") == "term") & F.col("key").startswith("th"))
        | ((F.col("kind") == "reversed") & F.col("key").startswith("noi"))
        | ((F.col("kind") == "gram") & (F.col("key") == "con"))
    )
    return terms.where(wanted).select("kind", "term", "records")


# --- attributes as columns --------------------------------------------------------------

_STATUS = "json_extract_string(log_attributes, '$.\"http.status_code\"')"


@register(
    "attribute_census",
    on_logs(
        "SELECT bag, key, count(*) AS records, count(*) / (SELECT count(*) FROM logs) AS share FROM ("
        "SELECT 'log_attributes' AS bag, unnest(json_keys(log_attributes)) AS key FROM logs UNION ALL "
        "SELECT 'resource_attributes', unnest(json_keys(resource_attributes)) FROM logs) GROUP BY bag, key"
    ),
)
def _attribute_census(spark, sf):
    return attributes.attribute_census(event_logs(spark, sf))


@register("attr_filter_promoted", on_logs(f"SELECT log_id, body FROM logs WHERE {_STATUS} = '503'"))
def _attr_filter_promoted(spark, sf):
    """A table of which one part was written before its common keys became columns."""
    target = scratch_path(spark, "out")
    rows = event_logs(spark, sf)
    append_batch(rows.where("log_id % 3 = 0"), target, "before")
    hot = attributes.hot_attributes(attributes.attribute_census(table.read_logs(spark, target)))
    attributes.promote(spark, target, hot)
    append_batch(rows.where("log_id % 3 = 1"), target, "after")
    table.write_logs(rows.where("log_id % 3 = 2"), target)
    compact_day(spark, target, "2024-01-15")
    found = attributes.logs_by_attribute(spark, target, "log_attributes", "http.status_code", "503")
    return found.select("log_id", "body")
