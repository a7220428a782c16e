"""Pattern mining and the questions that follow from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.fixtures import event_logs
from timberline.functions import templates as T
from timberline.operators import growing, matching
from timberline.operators import patterns as P
from timberline.operators.filters import non_empty_body
from timberline.operators.stats import labelled
from timberline.registry.base import SQL_START, START, on_logs, register
from timberline.registry.masks import LABELS_SQL, LINES_CTE
from timberline.sources.scratch import scratch_path
from timberline.streaming.live import stream_match

# --- mining -----------------------------------------------------------------------------
# The check SQL states the definition with plain counts and one recursion per bucket.

SKELETON_CTE = """skel AS (SELECT *, array_to_string(list_transform(string_split(masked, ' '),
  lambda t: CASE WHEN regexp_matches(regexp_replace(t, '<[A-Z_0-9]+>', '', 'g'), '[0-9]')
            THEN '<*>' ELSE t END), ' ') AS template FROM lines),
assigned AS (SELECT *, md5(concat_ws('|', len(string_split(template, ' ')), template)) AS pattern_id
  FROM skel)"""

MINED_CTE = """cell AS (
  SELECT template AS skeleton, unnest(range(len(string_split(masked, ' ')))) AS pos,
         unnest(string_split(masked, ' ')) AS token, unnest(string_split(template, ' ')) AS plain
  FROM skel),
params AS (
  SELECT skeleton, list(pos) AS params FROM (
    SELECT skeleton, pos FROM cell WHERE plain = '<*>' GROUP BY 1, 2 HAVING count(DISTINCT token) > 16)
  GROUP BY skeleton),
entered AS (
  SELECT skel.* EXCLUDE (template), CASE
    WHEN params IS NOT NULL
    THEN array_to_string(list_transform(range(len(string_split(masked, ' '))), lambda i:
         CASE WHEN list_contains(params, i) THEN '<*>' ELSE string_split(masked, ' ')[i + 1] END), ' ')
    ELSE masked END AS entry
  FROM skel LEFT JOIN params ON params.skeleton = skel.template),
weighed AS (
  SELECT entry, count(*) AS w, string_split(entry, ' ') AS t,
         concat_ws(' ', len(string_split(entry, ' ')), array_to_string(list_transform(
           string_split(entry, ' ')[1:least(3, len(string_split(entry, ' ')) - 1)],
           lambda x: CASE WHEN regexp_matches(regexp_replace(x, '<[A-Z_0-9]+>', '', 'g'), '[0-9]')
                     THEN '<*>' ELSE x END), ' ')) AS bucket
  FROM entered GROUP BY entry),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY w DESC, entry) AS i FROM weighed),
walk AS (
  SELECT DISTINCT bucket, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[][]) AS known
  FROM turns
  UNION ALL
  SELECT turns.bucket, turns.i,
         CASE WHEN coalesce(list_max(list_transform(range(len(known)), lambda x:
                len(list_filter(range(len(turns.t)), lambda p:
                  known[x + 1][p + 1] = turns.t[p + 1] AND turns.t[p + 1] <> '<*>')))), 0)
              / CAST(len(turns.t) AS DOUBLE) >= 0.5
         THEN known ELSE list_append(known, turns.t) END
  FROM walk JOIN turns ON turns.bucket = walk.bucket AND turns.i = walk.i + 1),
ends AS (SELECT bucket, arg_max(known, i) AS known FROM walk GROUP BY bucket),
joined AS (
  SELECT turns.bucket, turns.entry, turns.t,
         CASE WHEN list_contains(known, turns.t) THEN list_position(known, turns.t)
              ELSE 1000000 - list_max(list_transform(range(len(known)), lambda x:
                1000000 * len(list_filter(range(len(turns.t)), lambda p:
                  known[x + 1][p + 1] = turns.t[p + 1] AND turns.t[p + 1] <> '<*>'))
                + 999999 - x)) % 1000000 END AS leader
  FROM turns JOIN ends ON ends.bucket = turns.bucket),
agreed AS (
  SELECT bucket, leader, string_agg(token, ' ' ORDER BY pos) AS template FROM (
    SELECT bucket, leader, pos, CASE WHEN min(token) = max(token) THEN min(token) ELSE '<*>' END AS token
    FROM (SELECT bucket, leader, unnest(range(len(t))) AS pos, unnest(t) AS token FROM joined)
    GROUP BY bucket, leader, pos)
  GROUP BY bucket, leader),
found AS (
  SELECT joined.entry, agreed.template
  FROM joined JOIN agreed ON agreed.bucket = joined.bucket AND agreed.leader = joined.leader),
mined AS (
  SELECT entered.*, found.template,
         md5(concat_ws('|', len(string_split(template, ' ')), template)) AS pattern_id
  FROM entered JOIN found ON found.entry = entered.entry)"""


def mined_sql(select: str) -> str:
    return on_logs(select, LINES_CTE, SKELETON_CTE, MINED_CTE).replace(
        "WITH logs", "WITH RECURSIVE logs", 1
    )


def mined(spark, sf):
    logs = event_logs(spark, sf)
    return logs, P.mine_patterns(logs)


LIST_SQL = f"""
SELECT pattern_id, template, CAST(len(string_split(template, ' ')) AS INT) AS n_tokens,
       count(*) AS count, concat_ws(', ', {LABELS_SQL.format(source='template')}) AS mask_labels,
       CAST(min(timestamp) AS VARCHAR) AS first_ts, CAST(max(timestamp) AS VARCHAR) AS last_ts
FROM mined GROUP BY pattern_id, template HAVING count(*) >= 2
ORDER BY count DESC, pattern_id LIMIT 50
"""


def _listed(model):
    rows = P.list_patterns(model, min_count=2, limit=50)
    return rows.select(
        "pattern_id", "template", "n_tokens", "count",
        F.array_join("mask_labels", ", ").alias("mask_labels"),
        F.col("first_ts").cast("string").alias("first_ts"),
        F.col("last_ts").cast("string").alias("last_ts"),
    )


@register("pattern_list", mined_sql(LIST_SQL))
def pattern_list(spark, sf):
    return _listed(mined(spark, sf)[1])


@register(
    "pattern_coverage",
    on_logs(
        "SELECT count(*) AS lines, count(*) AS assigned, count(*) AS fitting, "
        "count(*)::BIGINT AS counted FROM lines",
        LINES_CTE,
    ),
)
def _coverage(spark, sf):
    """Every line has exactly one pattern, which fits it, and the counts add up."""
    logs, model = mined(spark, sf)
    assigned = P.assign_patterns(logs.hint("rebalance"), model)
    fits = T.template_matches(F.col("template"), T.masked_line(F.col("body"), model.masks))
    seen = assigned.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("pattern_id").alias("assigned"),
        F.count_if(fits).alias("fitting"),
    )
    counted = model.patterns.agg(F.sum("count")).scalar()
    return seen.withColumn("counted", counted)


PARTS = ("2024-01-08", "2024-01-19", "2024-02-28")


def _add_part(logs, path, part: int):
    at = F.col("timestamp")
    low, high = ("1970-01-01", *PARTS)[part : part + 2]
    rows = logs.where((at >= F.lit(low).cast("timestamp")) & (at < F.lit(high).cast("timestamp")))
    growing.add_lines(rows, path, f"part{part}")
    return rows


@register("pattern_list_growing", mined_sql(LIST_SQL))
def _growing(spark, sf):
    """Three ranges of days added one after the other, one of them twice under its name."""
    logs, path = event_logs(spark, sf), scratch_path(spark, "book")
    for part in (0, 1, 1, 2):
        _add_part(logs, path, part)
    return _listed(growing.mine_lines(spark, path))


@register(
    "pattern_succession",
    mined_sql("SELECT pattern_id AS old_id, count(*) AS count, 1 AS successors FROM mined GROUP BY 1").replace(
        LINES_CTE,
        LINES_CTE.replace("FROM logs", f"FROM (SELECT * FROM logs WHERE timestamp < TIMESTAMP '{PARTS[0]}') AS logs"),
    ),
)
def _succession(spark, sf):
    """Every pattern of the first days has one successor, and its lines are all dealt to new ones."""
    logs, path = event_logs(spark, sf), scratch_path(spark, "book")
    _add_part(logs, path, 0)
    old = growing.mine_lines(spark, path)
    lines = growing.read_lines(spark, path).where(F.col("day") < PARTS[0])
    for part in (1, 2):
        _add_part(logs, path, part)
    moved = growing.succession(old, growing.mine_lines(spark, path), lines)
    return moved.groupBy("old_id").agg(
        F.sum("count").alias("count"), F.count_if("main").cast("int").alias("successors")
    )


SERIES_SQL = """
SELECT pattern_id, strftime(time_bucket(INTERVAL '{width}', timestamp, TIMESTAMP '1970-01-01'),
       '%Y-%m-%dT%H:%M:%SZ') AS ts, count(*) AS count
FROM {source} GROUP BY 1, 2
"""
SAMPLES_SQL = """
SELECT pattern_id, rank, CAST(timestamp AS VARCHAR) AS timestamp, service_name, severity_text, body,
       total_matched
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pattern_id
               ORDER BY timestamp DESC, log_id DESC) AS INT) AS rank,
             count(*) OVER (PARTITION BY pattern_id) AS total_matched FROM {source})
WHERE rank <= 10
"""


@register("pattern_series", mined_sql(SERIES_SQL.format(width="1 hour", source="mined")))
def _series(spark, sf):
    logs, model = mined(spark, sf)
    return labelled(P.pattern_series(P.assign_patterns(logs, model), "1h"))


@register("pattern_samples", mined_sql(SAMPLES_SQL.format(source="mined")))
def _samples(spark, sf):
    logs, model = mined(spark, sf)
    samples = P.pattern_samples(P.assign_patterns(logs, model), 10)
    return samples.withColumn("timestamp", F.col("timestamp").cast("string"))


# --- the same operators over skeletons, which the check engine can state ----------------

def by_skeleton(spark, sf):
    lines = non_empty_body(event_logs(spark, sf)).withColumn("masked", T.masked_line(F.col("body")))
    named = lines.withColumn("template", T.skeleton(F.col("masked")))
    return named.withColumn("pattern_id", T.template_id(F.col("template")))


@register(
    "skeleton_list",
    on_logs(
        "SELECT pattern_id, template, count(*) AS count FROM assigned GROUP BY 1, 2 "
        "HAVING count(*) >= 2 ORDER BY count DESC, pattern_id LIMIT 50",
        LINES_CTE, SKELETON_CTE,
    ),
)
def _skeleton_list(spark, sf):
    counts = by_skeleton(spark, sf).groupBy("pattern_id", "template").count()
    return P.list_patterns(counts, min_count=2, limit=50)


@register(
    "skeleton_series",
    on_logs(SERIES_SQL.format(width="15 minutes", source="assigned"), LINES_CTE, SKELETON_CTE),
)
def _skeleton_series(spark, sf):
    return labelled(P.pattern_series(by_skeleton(spark, sf), "15m"))


@register(
    "skeleton_samples", on_logs(SAMPLES_SQL.format(source="assigned"), LINES_CTE, SKELETON_CTE)
)
def _skeleton_samples(spark, sf):
    samples = P.pattern_samples(by_skeleton(spark, sf), 10)
    return samples.withColumn("timestamp", F.col("timestamp").cast("string"))


@register(
    "template_similarity",
    on_logs(
        """
SELECT log_id, round(len(list_filter(range(len(a)), lambda i: a[i + 1] = b[i + 1] AND a[i + 1] <> '<*>'))
       / CAST(len(a) AS DOUBLE), 6) AS similarity
FROM (SELECT log_id, string_split(masked, ' ') AS a, string_split(template, ' ') AS b FROM assigned)
""",
        LINES_CTE, SKELETON_CTE,
    ),
)
def _similarity(spark, sf):
    rows = by_skeleton(spark, sf)
    similarity = T.template_similarity(
        T.line_tokens(F.col("masked")), T.line_tokens(F.col("template"))
    )
    return rows.select("log_id", F.round(similarity, 6).alias("similarity"))


# --- position templates, and matching lines against them --------------------------------

POSITION_CTE = """tok AS (SELECT *, string_split(masked, ' ') AS t FROM lines),
placed AS (SELECT *, concat_ws(' ', len(t), array_to_string(list_transform(t[1:least(3, len(t) - 1)],
  lambda x: CASE WHEN regexp_matches(regexp_replace(x, '<[A-Z_0-9]+>', '', 'g'), '[0-9]')
            THEN '<*>' ELSE x END), ' ')) AS bucket FROM tok),
cells AS (SELECT bucket, unnest(range(len(t))) AS pos, unnest(t) AS token FROM placed),
sums AS (SELECT bucket, pos, token, count(*) AS c FROM cells GROUP BY 1, 2, 3),
tops AS (SELECT *, sum(c) OVER (PARTITION BY bucket, pos) AS n,
         row_number() OVER (PARTITION BY bucket, pos ORDER BY c DESC, token DESC) AS r FROM sums),
position_templates AS (SELECT bucket, string_agg(CASE WHEN c >= 0.5 * n THEN token ELSE '<*>' END, ' '
         ORDER BY pos) AS template, CAST(max(n) AS BIGINT) AS count
  FROM tops WHERE r = 1 GROUP BY bucket)"""


@register(
    "position_templates",
    on_logs("SELECT bucket, template, count FROM position_templates", LINES_CTE, POSITION_CTE),
)
def _position_templates(spark, sf):
    return P.position_templates(event_logs(spark, sf))


MATCH_SQL = on_logs(
    """
SELECT log_id, pattern_id, template FROM (
  SELECT k.log_id, p.pattern_id, p.template,
         row_number() OVER (PARTITION BY k.log_id ORDER BY p.wild, p.pattern_id) AS r
  FROM tok k LEFT JOIN known p ON p.n = len(k.t) AND len(list_filter(range(p.n),
       lambda i: p.tt[i + 1] <> '<*>' AND p.tt[i + 1] <> k.t[i + 1])) = 0)
WHERE r = 1
""",
        LINES_CTE, POSITION_CTE,
        """known AS (SELECT DISTINCT template, string_split(template, ' ') AS tt,
  len(string_split(template, ' ')) AS n,
  len(list_filter(string_split(template, ' '), lambda x: x = '<*>')) AS wild,
  md5(concat_ws('|', len(string_split(template, ' ')), template)) AS pattern_id
  FROM position_templates)""",
    )


def position_patterns(logs):
    return P.position_templates(logs).select(
        T.template_id(F.col("template")).alias("pattern_id"), "template"
    )


@register("match_patterns", MATCH_SQL)
def _match_patterns(spark, sf):
    logs = event_logs(spark, sf)
    return P.match_patterns(logs, position_patterns(logs)).select(
        "log_id", "pattern_id", "template"
    )


@register("stream_match", MATCH_SQL)
def _stream_match(spark, sf):
    """The same, line by line as they arrive."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    logs = event_logs(spark, sf)
    logs.write.parquet(source)
    stream = spark.readStream.schema(logs.schema).parquet(source)
    stream_match(
        stream, position_patterns(logs), target, checkpoint, available_now=True
    ).awaitTermination()
    return spark.read.parquet(target).select("log_id", "pattern_id", "template")


# Templates of the days before START, one for each distinct line and position, against all logs. A line
# is fitted by itself with one position open, so the check needs no comparison of all pairs.
MANY_SQL = on_logs(
    f"""
SELECT v.log_id, min(k.pattern_id) AS pattern_id,
       arg_min(k.template, k.pattern_id) AS template
FROM variants v LEFT JOIN known k ON k.template = v.template GROUP BY v.log_id
""",
    LINES_CTE,
    f"""cut AS (SELECT log_id, string_split(masked, ' ') AS t FROM lines),
places AS (SELECT log_id, t, unnest(range(1, len(t) + 1)) AS i FROM cut),
variants AS (SELECT log_id, array_to_string(list_concat(t[1:i - 1], ['<*>'], t[i + 1:]), ' ') AS template
  FROM places),
known AS (SELECT DISTINCT v.template,
    md5(concat_ws('|', len(string_split(v.template, ' ')), v.template)) AS pattern_id
  FROM variants v JOIN logs l USING (log_id) WHERE l.timestamp < {SQL_START})""",
)


def open_templates(logs):
    """Every distinct masked line with each of its positions open in turn."""
    tokens = T.line_tokens(T.masked_line(F.col("body")))
    lines = non_empty_body(logs).select(tokens.alias("t")).distinct()
    opened = lines.select("t", F.posexplode("t").alias("i", "token")).select(
        F.array_join(F.transform("t", lambda x, at: F.when(at == F.col("i"), T.WILD).otherwise(x)), " ").alias(
            "template"
        )
    )
    return opened.distinct().select(T.template_id(F.col("template")).alias("pattern_id"), "template")


@register("match_patterns_many", MANY_SQL)
def _match_many(spark, sf):
    """Some patterns for every line, so the tree has nearly as many leaves as there are tokens."""
    logs = event_logs(spark, sf)
    earlier = open_templates(logs.where(F.col("timestamp") < F.to_timestamp(F.lit(START))))
    return matching.match_many(logs, earlier).select("log_id", "pattern_id", "template")
