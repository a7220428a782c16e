"""Queries and check SQL of the operators in this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import (
    conversations,
    decontaminate,
    html_text,
    multi_index,
    ngram_join,
    quality,
    secrets,
    sentencepieces,
    simhash,
    suffix_dedup,
    token_counts,
    url_filter,
    whitening,
)
from timberline.llm.batches import show_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            show_package(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), PIECES)


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


OP6_SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i)
  WHERE len(w) > 0
), docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - n + 2)) AS u(i)
), found AS (
  SELECT doc_id, i, p.n, item FROM places p JOIN windows USING (win)
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS u(k)
  GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items,
    sha256(array_to_string(list_sort(list_distinct(list(item))), ',')) AS items_sha256
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@register("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)

OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT p.*, (
    SELECT max_by(struct_pack(v := verdict, t := rhost || rpath), length(rhost || rpath)) FROM rules
    WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)) AS r
  FROM parts p
)
SELECT page_id, host, path, r.t AS rule, CASE WHEN r.v IS NOT NULL THEN r.v
  WHEN regexp_matches(host, 'casino|-bets|-pills|ads-track|adult-') THEN 'block' ELSE 'allow' END AS verdict
FROM best
"""


@register("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@register("op5_multi_index")
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def _spans_sql(rank: int, pattern: str, group: int, keep: str) -> str:
    """Places of a pattern, from the lengths of the matches and of the text between them."""
    return rf"""
  SELECT n, source, {rank} AS rank, b AS start, b + length(m) AS stop, v AS value FROM (
    SELECT n, source, m, v, CAST(sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (
      PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
    FROM (SELECT n, source, unnest(range(len(mm))) AS i, unnest(mm) AS m, unnest(vv) AS v,
        unnest(gg[1:len(mm)]) AS g
      FROM (SELECT n, source, regexp_extract_all(text, '{pattern}') AS mm,
          regexp_extract_all(text, '{pattern}', {group}) AS vv,
          string_split_regex(text, '{pattern}') AS gg FROM docs))
    WINDOW w AS (PARTITION BY n ORDER BY i ROWS UNBOUNDED PRECEDING))
  WHERE {keep}"""


_ASSIGN_SQL = (
    r"""(?:(?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
OP3_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), base AS ({_spans_sql(0, _ASSIGN_SQL, 1, "length(v) >= 12")}
  UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]+", 0, "length(v) >= 18")}
  UNION ALL {_spans_sql(2, "[0-9a-f]+", 0, "length(v) >= 16")}
), opaque AS ({_spans_sql(3, "[A-Za-z0-9+/_=-]{20,}", 0,
    "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')")}
), found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM opaque o WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.n = o.n AND b.start < o.stop AND o.start < b.stop)
), judged AS (
  SELECT f.*, documents, owners, owners < 3 AND (owners < 2 OR documents < 20) AS live FROM found f
  JOIN (SELECT value, count(DISTINCT found.source) AS owners, count(DISTINCT text) AS documents
        FROM found JOIN docs USING (n) GROUP BY value) USING (value)
), texts AS (
  SELECT n, rank, live, start, concat(documents, '/', owners) AS seen,
    concat_ws(':', ['assign', 'access', 'hex', 'owned'][rank + 1], start, stop) AS t
  FROM judged WHERE rank < 3 OR live
), per AS (
  SELECT n, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
    count(*) FILTER (rank = 2) AS n_hex,
    string_agg(t, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(t, ',' ORDER BY start, rank) AS spans,
    string_agg(seen, ',' ORDER BY start, rank) AS seen,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM texts GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(seen, '') AS seen, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN per USING (n)
"""


@register("op3_secrets", OP3_SQL)
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def number(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        F.array_join(
            F.transform("spans", lambda s: F.concat_ws("/", s["documents"].cast("string"), s["owners"].cast("string"))),
            ",",
        ).alias("seen"),
        "n_live",
        "n_copied",
    )


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3
    )


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 4) - 1], ' ')) AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i)
  WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles,
  least(w.doc_id, (SELECT min(b) FROM reach r WHERE r.a = w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id)
"""


@register("op1_ngram_jaccard", OP1_SQL)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


@register("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op11_conversations")
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))
