"""Log patterns: templates of masked lines with stable, content-derived ids.

Mining masks every line once and counts equal ones; what follows runs on these counts, in three
distributed steps, and ships no raw lines to Python:

1. *Profiles*. A line's skeleton has the wildcard for every token with a digit. Positions with
   more than a few distinct values are parameters: a 64-bit sketch of hash slots per
   (skeleton, position), which combines before the shuffle, settles those with many, and the
   values of the others are counted.
2. *Entries*. Lines with their parameters generalised are counted.
3. *Templates*. Entries are placed in buckets by length and leading tokens, and join leaders by
   similarity inside each bucket. A bucket larger than one task takes is settled in rounds: the
   heaviest open entries are decided, and all others compared with the new leaders in parallel,
   until none is open. The size of a round changes the speed and not the result. A template
   keeps the tokens all members of a leader agree on.

Each step depends on the set of lines only, not on their order or partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.masks import mask_labels, select_masks
from timberline.functions.scalars import bucket_window
from timberline.functions.templates import (
    WILD,
    generalise,
    line_tokens,
    masked_line,
    skeleton,
    template_id,
    token_count,
    wild_positions,
)
from timberline.operators import clustering
from timberline.operators.filters import non_empty_body
from timberline.operators.masking import masked_counts
from timberline.operators.paging import newest_first
from timberline.settings import MiningConfig
from timberline.sources.scratch import materialize

# Executors get the function itself and need no copy of this package.
cloudpickle.register_pickle_by_value(clustering)

SLOTS = 64
MAX_SAMPLES = 20


@dataclass(frozen=True)
class PatternModel:
    """Result of mining: the patterns and what leads a line to its pattern.

    profiles  skeleton -> parameter positions
    entries   entry text -> pattern
    patterns  one row per pattern with counts, labels and first and last time
    """

    masks: tuple[str, ...]
    config: MiningConfig
    profiles: DataFrame
    entries: DataFrame
    patterns: DataFrame

    def save(self, path: str) -> None:
        for name in ("profiles", "entries", "patterns"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, masks: Iterable[str], config: MiningConfig
    ) -> PatternModel:
        frames = {n: spark.read.parquet(f"{path}/{n}") for n in ("profiles", "entries", "patterns")}
        return cls(tuple(masks), config, **frames)


def skeleton_profiles(lines: DataFrame, config: MiningConfig) -> DataFrame:
    """Parameter positions of every skeleton that has any: ``skeleton, params``."""
    values = F.zip_with(
        line_tokens(F.col("masked")),
        line_tokens(F.col("skeleton")),
        lambda token, plain: F.when(plain == WILD, token),
    )
    at = lines.select("skeleton", F.posexplode(values).alias("pos", "token")).where(
        F.col("token").isNotNull()
    )
    slot = F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)
    sketches = materialize(
        at.groupBy("skeleton", "pos").agg(F.bit_or(bit).alias("slots"), F.count("*").alias("n")),
        "sketches",
    )
    filled = F.bit_count("slots")
    many = sketches.where(filled > config.literal_values)
    few = sketches.where((filled <= config.literal_values) & (F.col("n") > config.literal_values))
    counted = (
        at.join(few.select("skeleton", "pos"), ["skeleton", "pos"])
        .groupBy("skeleton", "pos")
        .agg(F.count_distinct("token").alias("values"))
        .where(F.col("values") > config.literal_values)
    )
    params = many.select("skeleton", "pos").union(counted.select("skeleton", "pos"))
    return params.groupBy("skeleton").agg(F.sort_array(F.collect_list("pos")).alias("params"))


def _with_entry(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``entry``, the generalised line."""
    known = lines.join(profiles, "skeleton", "left")
    entry = F.when(
        F.col("params").isNotNull(), generalise(F.col("masked"), F.col("params"))
    ).otherwise(F.col("masked"))
    return known.withColumn("entry", entry).drop("params", "skeleton", "masked")


def _prefix(entry: Column, k: int) -> Column:
    """Leading tokens that select the bucket, digit-bearing ones as wildcards."""
    tokens = line_tokens(skeleton(entry))
    return F.slice(tokens, F.lit(1), F.least(F.lit(k), F.size(tokens) - 1))


def place_in_buckets(entries: DataFrame, config: MiningConfig) -> DataFrame:
    """Adds ``n`` and ``bucket``: token count and leading tokens, with few branches per node.

    A node keeps its ``max_children - 1`` heaviest branches (ties by token) and sends the
    others to the wildcard branch.
    """
    k = config.prefix_tokens
    placed = entries.withColumns(
        {
            "n": token_count(F.col("source")),
            "lead": _prefix(F.col("source"), k),
        }
    )
    path = F.array(F.col("n").cast("string"))
    if k == 0:
        return placed.withColumn("bucket", F.array_join(path, " ")).drop("lead")
    room = config.max_children - 1
    if _widest_node(placed, k) <= room:
        return placed.withColumn(
            "bucket", F.array_join(F.concat(path, F.col("lead")), " ")
        ).drop("lead")

    placed = placed.withColumn("bucket", F.array_join(path, " "))
    for level in range(k):
        branch = F.get("lead", F.lit(level))
        sums = (
            placed.where(branch != WILD)
            .groupBy("bucket", branch.alias("token"))
            .agg(F.sum("weight").alias("w"))
        )
        heaviest = W.partitionBy("bucket").orderBy(F.col("w").desc(), "token")
        kept = (
            sums.withColumn("rank", F.row_number().over(heaviest))
            .where(F.col("rank") <= room)
            .select("bucket", "token", F.lit(True).alias("kept"))
        )
        step = placed.withColumn("token", branch).join(kept, ["bucket", "token"], "left")
        token = F.when(F.col("kept"), F.col("token")).when(F.col("token").isNotNull(), F.lit(WILD))
        placed = step.withColumn("bucket", F.concat_ws(" ", "bucket", token)).drop("token", "kept")
    return placed.drop("lead")


def _widest_node(placed: DataFrame, k: int) -> int:
    """Most branches under any node while none is limited; one number to the driver."""
    levels = placed.select(
        "n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("level"), "lead"
    ).where(F.size("lead") >= F.col("level"))
    nodes = levels.select(
        "n",
        F.slice("lead", F.lit(1), F.col("level") - 1).alias("parent"),
        F.get("lead", F.col("level") - 1).alias("token"),
        "level",
    ).where(F.col("token") != WILD)
    branches = nodes.distinct().groupBy("n", "level", "parent").count()
    return branches.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _leaders(placed: DataFrame, config: MiningConfig) -> DataFrame:
    """``bucket, source, leader`` for every entry; entries come as ``bucket, n, source, weight``."""
    room = F.greatest(
        F.lit(2), F.least(F.lit(config.slice_size), F.floor(F.lit(config.slice_tokens) / F.col("n")))
    )
    placed = materialize(placed.select("bucket", "n", "source", "weight"), "placed")
    sizes = placed.groupBy("bucket", "n").agg(F.count(F.lit(1)).alias("size"))
    large = materialize(
        sizes.where(F.col("size") > room).select(
            "bucket", room.cast("int").alias("room"), F.ceil(F.col("size") / room).alias("slices")
        ),
        "large",
    )
    small = placed.join(large, "bucket", "left_anti").groupBy("bucket").applyInPandas(
        clustering.bucket_clusterer(config.sim_th), clustering.MEMBER_SCHEMA
    )
    state = placed.join(large.select("bucket"), "bucket", "left_semi").select(
        "bucket", "n", "source", "weight", F.lit(True).alias("open"), F.lit(0).alias("same"),
        F.lit(None).cast("string").alias("leader"),
    )
    heaviest = W.partitionBy("bucket").orderBy(F.col("weight").desc(), "source")
    dealt = F.pmod(F.xxhash64("source"), F.col("slices"))
    while not large.isEmpty():
        state = materialize(state, "forms")
        if state.where("open").isEmpty():
            break
        heads = (
            state.where("open")
            .withColumn("rank", F.row_number().over(heaviest))
            .where(F.col("rank") <= config.slice_size)
            .join(large, "bucket")
            .where(F.col("rank") <= F.col("room"))
            .select("bucket", "source", "weight")
            .groupBy("bucket")
            .applyInPandas(clustering.head_chooser(config.sim_th), clustering.LEADER_SCHEMA)
        )
        heads = materialize(heads, "leaders").join(large, "bucket").withColumn(
            "slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))
        )
        forms = state.join(large, "bucket").withColumn("slice", dealt)
        state = (
            forms.groupBy("bucket", "slice")
            .cogroup(heads.select("bucket", "slice", "source", "turn").groupBy("bucket", "slice"))
            .applyInPandas(clustering.comparer(config.sim_th), clustering.STATE_SCHEMA)
        )
    return small.union(state.select("bucket", "source", "leader"))


def _cluster(placed: DataFrame, config: MiningConfig) -> DataFrame:
    """``source, template`` for every entry: the tokens that all entries of a leader share."""
    led = materialize(_leaders(placed, config), "clusters")
    agreed = (
        led.select("bucket", "leader", F.posexplode(line_tokens(F.col("source"))).alias("pos", "token"))
        .groupBy("bucket", "leader", "pos")
        .agg(F.min("token").alias("low"), F.max("token").alias("high"))
        .withColumn("token", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(WILD))
        .groupBy("bucket", "leader")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("tokens"))
        .select("bucket", "leader", F.array_join("tokens.token", " ").alias("template"))
    )
    return led.join(agreed, ["bucket", "leader"]).select("source", "template")


def mine_patterns(
    logs: DataFrame,
    masks: Iterable[str] | None = None,
    config: MiningConfig = MiningConfig(),
) -> PatternModel:
    """Mine the templates of all non-empty bodies; no row is left out.

    The logs are read and masked once; see :func:`mine_counts` for the rest.
    """
    chosen = select_masks(masks)
    return mine_counts(materialize(masked_counts(logs, chosen), "lines"), chosen, config)


def mine_counts(
    lines: DataFrame,
    masks: Iterable[str] | None = None,
    config: MiningConfig = MiningConfig(),
) -> PatternModel:
    """The model of counted lines: ``masked, count, first_ts, last_ts``.

    A line may come in several rows, so counts of parts of a table are mined as their union. Small
    results are kept as tables in the shared checkpoint folder. The counts are read three times: for
    sketches, for the values of positions with few, and for the entries.
    """
    chosen = select_masks(masks)
    lines = lines.withColumn("skeleton", skeleton(F.col("masked")))
    profiles = materialize(skeleton_profiles(lines, config), "profiles")
    counted = _with_entry(lines, profiles).groupBy("entry").agg(
        F.sum("count").alias("weight"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    entries = materialize(counted.withColumnRenamed("entry", "source"), "entries")
    placed = place_in_buckets(entries.select("source", "weight"), config)
    mapped = entries.join(_cluster(placed, config), "source").withColumn(
        "pattern_id", template_id(F.col("template"))
    )
    lookup = materialize(
        mapped.select(
            F.col("source").alias("entry"), "pattern_id", "template", "weight", "first_ts", "last_ts"
        ),
        "lookup",
    )
    patterns = lookup.groupBy("pattern_id", "template").agg(
        F.sum("weight").alias("count"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    named = patterns.select(
        "pattern_id",
        "template",
        token_count(F.col("template")).alias("n_tokens"),
        "count",
        mask_labels(F.col("template"), chosen).alias("mask_labels"),
        "first_ts",
        "last_ts",
    )
    return PatternModel(
        chosen, config, profiles, lookup.select("entry", "pattern_id", "template"),
        materialize(named, "patterns"),
    )


def assign_patterns(logs: DataFrame, model: PatternModel) -> DataFrame:
    """Non-empty logs with ``pattern_id`` and ``template``.

    For the mined logs every line has a pattern. Lines of other logs that lead to no
    known entry have none; see :func:`match_patterns` for those. Both joins are map-side
    while profiles and entries are below the broadcast threshold.
    """
    lines = non_empty_body(logs).withColumn(
        "masked", masked_line(F.col("body"), model.masks)
    ).withColumn("skeleton", skeleton(F.col("masked")))
    return _with_entry(lines, model.profiles).join(model.entries, "entry", "left").drop("entry")


@dataclass(frozen=True)
class PatternIndex:
    """Saved patterns made ready for matching.

    ``cells`` has a row per length and first token (the wildcard among them) with the patterns by
    their second token, so a line looks at four short lists.
    """

    cells: DataFrame


def index_patterns(patterns: DataFrame) -> PatternIndex:
    """Index patterns given by ``pattern_id`` and ``template``."""
    tokens = line_tokens(F.col("template"))
    known = patterns.select("pattern_id", "template").distinct().select(
        F.size(tokens).alias("n"),
        F.get(tokens, F.lit(0)).alias("first"),
        F.coalesce(F.get(tokens, F.lit(1)), F.lit("")).alias("second"),
        F.struct(
            F.size(wild_positions(F.col("template"))).alias("wild"),
            "pattern_id",
            "template",
            tokens.alias("tokens"),
        ).alias("pattern"),
    )
    lists = known.groupBy("n", "first", "second").agg(F.collect_list("pattern").alias("patterns"))
    cells = lists.groupBy("n", "first").agg(
        F.map_from_entries(F.collect_list(F.struct("second", "patterns"))).alias("cell")
    )
    return PatternIndex(materialize(cells, "cells"))


def match_patterns(
    logs: DataFrame,
    patterns: DataFrame | PatternIndex,
    masks: Iterable[str] | None = None,
) -> DataFrame:
    """New logs with the saved pattern that fits each, if any; fewest wildcards win.

    Stateless: two joins with the index, map-side while it is below the broadcast threshold, and a
    test of the patterns in the line's cells. Works on a stream as it does on a table.
    """
    chosen = select_masks(masks)
    index = patterns if isinstance(patterns, PatternIndex) else index_patterns(patterns)
    lines = non_empty_body(logs).withColumn(
        "_tokens", line_tokens(masked_line(F.col("body"), chosen))
    )
    own = F.col("_tokens")
    first = F.get(own, F.lit(0))
    named = index.cells.where(F.col("first") != WILD)
    open_ = index.cells.where(F.col("first") == WILD)
    joined = lines.join(
        named.select(F.col("n").alias("_n1"), "first", F.col("cell").alias("_named")),
        (F.size(own) == F.col("_n1")) & (first == F.col("first")),
        "left",
    ).join(
        open_.select(F.col("n").alias("_n2"), F.col("cell").alias("_open")),
        F.size(own) == F.col("_n2"),
        "left",
    )
    second = F.coalesce(F.get(own, F.lit(1)), F.lit(""))
    lists = [F.try_element_at(c, t) for c in ("_named", "_open") for t in (second, F.lit(WILD))]
    near = F.flatten(F.array_compact(F.array(*lists)))
    fitting = F.filter(
        near,
        lambda p: F.forall(
            F.zip_with(p["tokens"], own, lambda x, y: (x == WILD) | (x == y)), lambda fits: fits
        ),
    )
    best = F.array_min(
        F.transform(fitting, lambda p: F.struct(p["wild"], p["pattern_id"], p["template"]))
    )
    return joined.select(*logs.columns, best.alias("_best")).select(
        *logs.columns,
        F.col("_best.pattern_id").alias("pattern_id"),
        F.col("_best.template").alias("template"),
    )


def list_patterns(model_or_patterns, min_count: int = 2, limit: int = 50) -> DataFrame:
    """The largest patterns of at least ``min_count`` lines."""
    if not 0 <= limit <= 500:
        raise ValueError("limit must be between 0 and 500")
    patterns = getattr(model_or_patterns, "patterns", model_or_patterns)
    return (
        patterns.where(F.col("count") >= min_count)
        .orderBy(F.col("count").desc(), "pattern_id")
        .limit(limit)
    )


def pattern_series(
    assigned: DataFrame, width: str = "1h", pattern_id: str | None = None
) -> DataFrame:
    """Lines per pattern and time bucket; all patterns at once unless one is named."""
    if pattern_id is not None:
        assigned = assigned.where(F.col("pattern_id") == pattern_id)
    counts = assigned.groupBy("pattern_id", bucket_window("timestamp", width).alias("w")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.select("pattern_id", F.col("w.start").alias("bucket_start"), "count")


def pattern_samples(
    assigned: DataFrame,
    n: int = 10,
    pattern_id: str | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """The newest ``n`` lines of each pattern with the pattern's total.

    The rank filter is applied inside each task before rows are shuffled, so a pattern
    with a third of all lines moves only ``n`` per task. Totals come from a count of
    their own, or from ``totals`` (``pattern_id, count``) where they are known, as they
    are in a model for the logs it was mined from.
    """
    if not 0 <= n <= MAX_SAMPLES:
        raise ValueError(f"n must be between 0 and {MAX_SAMPLES}")
    if pattern_id is not None:
        assigned = assigned.where(F.col("pattern_id") == pattern_id)
    if totals is None:
        totals = assigned.groupBy("pattern_id").count()
    totals = totals.select("pattern_id", F.col("count").alias("total_matched"))
    newest = W.partitionBy("pattern_id").orderBy(*newest_first())
    picked = (
        assigned.select("pattern_id", "timestamp", "log_id", "service_name", "severity_text", "body")
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= n)
    )
    return picked.join(totals, "pattern_id").select(
        "pattern_id", "rank", "timestamp", "service_name", "severity_text", "body", "total_matched"
    )


def position_templates(
    logs: DataFrame,
    masks: Iterable[str] | None = None,
    share: float = 0.5,
    config: MiningConfig = MiningConfig(),
) -> DataFrame:
    """One template per bucket: a token stays where it holds at least ``share`` of the lines.

    A built-in alternative to mining; counting happens before every shuffle.
    """
    lines = non_empty_body(logs).select(masked_line(F.col("body"), select_masks(masks)).alias("masked"))
    k = config.prefix_tokens
    tokens = line_tokens(F.col("masked"))
    lead = F.array_join(_prefix(F.col("masked"), k), " ")
    # The bucket is settled before the tokens are exploded, once per line.
    placed = lines.select(F.concat_ws(" ", F.size(tokens), lead).alias("bucket"), "masked")
    bucketed = placed.select("bucket", F.posexplode(tokens).alias("pos", "token"))
    per_token = bucketed.groupBy("bucket", "pos", "token").agg(F.count(F.lit(1)).alias("c"))
    per_position = per_token.groupBy("bucket", "pos").agg(
        F.max(F.struct("c", "token")).alias("top"), F.sum("c").alias("lines")
    )
    kept = F.when(F.col("top.c") >= share * F.col("lines"), F.col("top.token")).otherwise(WILD)
    grouped = per_position.groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("pos", kept.alias("token")))).alias("tokens"),
        F.max("lines").alias("count"),
    )
    return grouped.select(
        "bucket", F.array_join(F.col("tokens.token"), " ").alias("template"), "count"
    )
