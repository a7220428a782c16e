"""Masking rules over logs, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.fixtures import documents, event_logs, pages
from timberline.functions import masks as M
from timberline.operators.masking import mask_report, masked_counts
from timberline.registry.base import on_logs, quoted, register

# The check engine has no lookaround, and its word boundary is ASCII. Rules that look
# around are restated: what must not match is marked first, and unmarked afterwards.
_PLAIN = {
    "timestamp_all": rf"\b(?:{M.DATE_TIME}|{M.COMMON_LOG}|{M.SYSLOG}|{M.EPOCH})\b",
    "pid": r"\b(?:pid|tid|PID|TID)\s+[0-9]+\b|\[pid [0-9]+\]|\b[0-9]+#[0-9]+\b",
    "file_path": r"(?:/[\w.-]+){3,}",
    "hex_address": r"\b0x[0-9a-fA-F]+\b",
    "semver": r"\bv?[0-9]+\.[0-9]+\.[0-9]+(?:-[a-zA-Z0-9.-]+)?(?:\+[a-zA-Z0-9.-]+)?\b",
    "number": r"\b[0-9]{3,}\b",
    "database_url": r"(?:postgres|mysql|mongodb(?:\+srv)?|redis)://(?:[^:]+:[^@]+@)?[\w.-]+"
    r"(?::[0-9]+)?(?:/[\w.-]+)?",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "mac_address": r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "uuid": r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b",
    "trace_id": r"\b[0-9a-fA-F]{32}\b|\b[0-9a-fA-F]{16}\b",
    "http_method": rf"\b(?:{M.METHODS})\b",
    "query_string": r"""\?[^\s"']+""",
    "user_agent_all": rf'(?i)"[^"]*(?:{M.AGENTS})[^"]*"',
    "bearer_token": r"(?i)bearer\s+[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.?[A-Za-z0-9_.+/=-]*",
    "api_key": r"""(?i)(?:api[_-]?key|token|secret|password)[\s:=]+["']?"""
    r"""[A-Za-z0-9+/_-]{16,64}["']?""",
    "jwt": r"\beyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b",
}
_H = "[0-9a-fA-F]{1,4}"
_IPV6 = (
    rf"\b(?:{_H}:){{1,6}}(?::{_H}){{1,6}}\b|\b(?:{_H}:){{1,7}}{_H}\b|"
    rf"\b(?:{_H}:){{1,7}}:\B|\B::(?:{_H}:){{0,6}}{_H}\b"
)


def rule_sql(rule_id: str, expr: str, token: str | None = None) -> str:
    """A rule over an SQL text expression."""
    token = M.RULE[rule_id].token if token is None else token

    def sub(source: str, pattern: str, by: str) -> str:
        return f"regexp_replace({source}, {quoted(pattern)}, {quoted(by)}, 'g')"

    if rule_id == "port":
        skip = sub(expr, r":([1-9][0-9]{0,4}\.[0-9])", ":\x01\\1")
        return f"replace({sub(skip, r':[1-9][0-9]{0,4}' + chr(92) + 'b', ':' + token)}, '\x01', '')"
    if rule_id == "http_numeric_id":
        skip = sub(expr, r"""/([0-9]{2,}[^0-9/?#\s"'])""", "/\x01\\1")
        return f"replace({sub(skip, r'/[0-9]{2,}', '/' + token)}, '\x01', '')"
    if rule_id == "ipv6":
        swapped = f"replace({expr}, '_', '\x01')"
        return f"replace({sub(swapped, _IPV6, token)}, '\x01', '_')"
    return sub(expr, _PLAIN[rule_id], token)


def chain_sql(expr: str, ids: tuple[str, ...] = M.DEFAULT_IDS) -> str:
    for rule_id in ids:
        expr = rule_sql(rule_id, expr)
    return expr


def count_sql(rule_id: str, expr: str) -> str:
    """Number of matches: how often a private character was put in."""
    marked = rule_sql(rule_id, expr, "\x02")
    return f"(length({marked}) - length(replace({marked}, '\x02', '')))"


def corpus(spark, sf):
    """Every text there is: log bodies, documents, page addresses and page sources."""

    def part(source, rows, item, text):
        return rows.select(
            F.lit(source).alias("source"), F.col(item).alias("item"), F.col(text).alias("text")
        )

    return (
        part("log", event_logs(spark, sf), "log_id", "body")
        .unionByName(part("document", documents(spark, sf), "doc_id", "text"))
        .unionByName(part("url", pages(spark, sf), "page_id", "url"))
        .unionByName(part("html", pages(spark, sf), "page_id", "html"))
    )


_CORPUS = """corpus AS (
  SELECT 'log' AS source, log_id AS item, body AS text FROM logs
  UNION ALL SELECT 'document', doc_id, text FROM documents
  UNION ALL SELECT 'url', page_id, url FROM pages
  UNION ALL SELECT 'html', page_id, html FROM pages)"""


def _rule_query(rule_id: str):
    def run(spark, sf):
        masked = M.apply_masks(F.col("text"), [rule_id])
        return corpus(spark, sf).select(
            "source", "item", F.md5(masked).alias("digest"), F.length(masked).alias("chars")
        )

    return run


for _rule in M.RULES:
    register(
        f"mask_{_rule.id}",
        on_logs(
            "SELECT source, item, md5(m) AS digest, length(m) AS chars FROM ("
            f"SELECT source, item, {rule_sql(_rule.id, 'text')} AS m FROM corpus)",
            _CORPUS,
        ),
    )(_rule_query(_rule.id))


@register("mask_default", on_logs(f"SELECT log_id, {chain_sql('body')} AS masked FROM logs"))
def _mask_default(spark, sf):
    return event_logs(spark, sf).select("log_id", M.apply_masks(F.col("body")).alias("masked"))


#: An order in which earlier rules take text from later ones.
CONFLICT = ("semver", "ipv4", "number", "http_numeric_id", "port", "query_string")


@register(
    "mask_order", on_logs(f"SELECT log_id, {chain_sql('body', CONFLICT)} AS masked FROM logs")
)
def _mask_order(spark, sf):
    chosen = M.select_masks(CONFLICT)
    return event_logs(spark, sf).select("log_id", M.apply_masks(F.col("body"), chosen).alias("masked"))


LABELS_SQL = ", ".join(
    f"CASE WHEN contains({{source}}, {quoted(M.RULE[i].token)}) THEN {quoted(M.RULE[i].label)} END"
    for i in M.DEFAULT_IDS
)


@register(
    "mask_labels",
    on_logs(
        f"SELECT log_id, concat_ws(', ', {LABELS_SQL.format(source='m')}) AS labels, "
        f"array_to_string(regexp_extract_all(m, '<[A-Z_0-9]+>'), ' ') AS tokens FROM masked",
        f"masked AS (SELECT log_id, {chain_sql('body')} AS m FROM logs WHERE body IS NOT NULL)",
    ),
)
def _mask_labels(spark, sf):
    logs = event_logs(spark, sf).where(F.col("body").isNotNull())
    masked = logs.select("log_id", M.apply_masks(F.col("body")).alias("m"))
    return masked.select(
        "log_id",
        F.array_join(M.mask_labels(F.col("m")), ", ").alias("labels"),
        F.array_join(M.template_tokens(F.col("m")), " ").alias("tokens"),
    )


def _report_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {M.CATEGORIES.index(r.category)} AS category_order, {quoted(r.category)} AS category, "
        f"{quoted(r.id)} AS rule, {quoted(r.label)} AS label, {quoted(r.token)} AS token, "
        f"{str(r.default).lower()} AS active, "
        f"count(*) FILTER (n > 0) AS rows, coalesce(sum(n), 0)::BIGINT AS matches "
        f"FROM (SELECT {count_sql(r.id, 'text')} AS n FROM corpus)"
        for r in M.RULES
    )
    return on_logs(rows, _CORPUS)


@register("mask_report", _report_sql())
def _mask_report(spark, sf):
    return mask_report(corpus(spark, sf), body="text")


#: Masked line as mining sees it: single spaces between tokens.
LINE_SQL = f"trim(regexp_replace({chain_sql('body')}, '\\s+', ' ', 'g'))"
LINES_CTE = (
    f"lines AS (SELECT log_id, timestamp, service_name, severity_text, body, {LINE_SQL} AS masked "
    "FROM logs WHERE body IS NOT NULL AND body <> '')"
)


@register(
    "masked_counts",
    on_logs(
        "SELECT masked, count(*) AS count, CAST(min(timestamp) AS VARCHAR) AS first_ts, "
        "CAST(max(timestamp) AS VARCHAR) AS last_ts FROM lines GROUP BY masked",
        LINES_CTE,
    ),
)
def _masked_counts(spark, sf):
    counts = masked_counts(event_logs(spark, sf))
    return counts.withColumns(
        {c: F.col(c).cast("string") for c in ("first_ts", "last_ts")}
    )
