"""Matching lines against very many saved patterns, by prefix trees over all token positions.

A line goes down its tree once, by its own tokens and the wildcards, so what it costs follows the
nodes it meets and not the number of patterns that begin alike. Patterns are divided into blocks of a
bounded size by their number of tokens (and by hash within one number, where those alone exceed it).

* One block is sent to the workers: a column over the logs, no shuffle, on a stream as on a table.
* More blocks never pass the driver. The different masked lines are written once. Patterns with their
  wildcards at the same places are many (a shape): their lines, opened at these places, are joined by
  text. All others are dealt by block, the lines of its lengths in slices beside them, and each task
  builds the tree of its block. The best of all is joined back to the logs.

Both give the same rows, those of :func:`timberline.operators.patterns.match_patterns`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions.masks import select_masks
from timberline.functions.templates import generalise, masked_line, token_count, wild_positions
from timberline.operators import prefix_tree
from timberline.operators.filters import non_empty_body
from timberline.sources.scratch import materialize

# Executors get the functions themselves and need no copy of this package.
cloudpickle.register_pickle_by_value(prefix_tree)

#: Bound of one block in a worker: what a token takes in nodes and dictionary at most, and the texts.
TOKEN_BYTES = 160
BLOCK_BYTES = 256 << 20
#: Shapes of one number of tokens that are joined by text at most, and the patterns one of them has at least.
SHAPES = 32
SHAPE_PATTERNS = 1_000
#: Different lines one task takes down the tree of a block.
SLICE_LINES = 200_000
BEST_DDL = "__masked string, __best struct<wild: int, pattern_id: string, template: string>"


@dataclass(frozen=True)
class Block:
    """Patterns of ``low`` to ``high`` tokens; of one number of tokens, share ``part`` of ``parts``."""

    low: int
    high: int
    part: int = 0
    parts: int = 1

    def holds(self, n: Column, template: Column | None = None) -> Column:
        inside = n.between(self.low, self.high)
        if template is None or self.parts == 1:
            return inside
        return inside & (F.pmod(F.xxhash64(template), F.lit(self.parts)) == self.part)


@dataclass
class TreeIndex:
    """Saved patterns, written as a table, and the blocks they are dealt in.

    Of several blocks, also the large ``shapes`` (``n, places``) and the blocks of the patterns that have none
    of these.
    """

    patterns: DataFrame
    blocks: list[Block]
    shapes: DataFrame | None = None
    others: list[Block] = field(default_factory=list)
    _sent: dict = field(default_factory=dict, repr=False)

    def best(self, block: Block, masked: Column) -> Column:
        """The pattern of the block that fits a masked line best: (wild, pattern_id, template) or null."""
        kind = T.StructType([f for f in self.patterns.schema if f.name != "n"])
        if block not in self._sent:
            self.release()
            rows = self.patterns.where(block.holds(F.col("n"), F.col("template"))).drop("n")
            # Binary order of the ids is that of the engine; the table of a block is bounded.
            table = rows.orderBy("wild", "pattern_id", "template").toArrow().combine_chunks()
            values = [
                column.chunk(0) if column.num_chunks else pa.array([], column.type)
                for column in table.columns
            ]
            tree = prefix_tree.build(values[2])
            self._sent[block] = self.patterns.sparkSession.sparkContext.broadcast((tree, values))
        sent = self._sent[block]
        names = kind.names

        @F.arrow_udf(kind)
        def walked(lines: pa.Array) -> pa.Array:
            tree, values = sent.value
            at = prefix_tree.best_of(tree, lines)
            return pa.StructArray.from_arrays(
                [v.take(at) for v in values], names=names, mask=at.is_null()
            )

        return walked(masked)

    def release(self) -> None:
        """Take the block last sent from the workers; it is sent anew where a task still asks for it."""
        for sent in self._sent.values():
            sent.unpersist()
        self._sent.clear()


def index_trees(patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> TreeIndex:
    """Index patterns given by ``pattern_id`` and ``template``; other columns are left aside.

    Rows without an id or a template are none. Equal templates under several ids keep the least id.
    What the driver collects here is two sizes for each number of tokens.
    """
    known = patterns.select("pattern_id", "template").where(
        F.col("pattern_id").isNotNull() & F.col("template").isNotNull()
    ).groupBy("template").agg(F.min("pattern_id").alias("pattern_id"))
    table = materialize(
        known.select(
            F.size(wild_positions(F.col("template"))).alias("wild"), "pattern_id", "template",
            token_count(F.col("template")).alias("n"),
        ),
        "templates",
    )
    size = F.col("n").cast("long") * TOKEN_BYTES + F.octet_length("template")
    sizes = table.groupBy("n").agg(F.sum(size).alias("size")).orderBy("n").collect()
    blocks = _blocks(sizes, block_bytes)
    if len(blocks) <= 1:
        return TreeIndex(table, blocks)
    most = W.partitionBy("n").orderBy(F.col("patterns").desc(), "places")
    shapes = materialize(
        _placed(table)
        .groupBy("n", "places")
        .agg(F.count(F.lit(1)).alias("patterns"))
        .where(F.col("patterns") >= SHAPE_PATTERNS)
        .withColumn("rank", F.row_number().over(most))
        .where(F.col("rank") <= SHAPES)
        .select("n", "places"),
        "shapes",
    )
    others = _placed(table).join(shapes, ["n", "places"], "left_anti")
    left = others.groupBy("n").agg(F.sum(size).alias("size")).orderBy("n").collect()
    return TreeIndex(table, blocks, shapes, _blocks(left, block_bytes))


def _blocks(sizes: Iterable, block_bytes: int) -> list[Block]:
    """Blocks of patterns given by number of tokens and size of all that have it, in order."""
    blocks: list[Block] = []
    room = 0
    for n, bytes_ in sizes:
        if bytes_ > block_bytes:
            parts = -(-bytes_ // block_bytes)
            blocks += [Block(n, n, part, parts) for part in range(parts)]
            room = 0
        elif bytes_ <= room:
            blocks[-1] = Block(blocks[-1].low, n)
            room -= bytes_
        else:
            blocks.append(Block(n, n))
            room = block_bytes - bytes_
    return blocks


def _placed(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("places", wild_positions(F.col("template")))


def _found_by_shape(index: TreeIndex, texts: DataFrame) -> DataFrame:
    """``__masked, __best`` of the patterns of the large shapes: lines opened at their places, joined by text."""
    known = _placed(index.patterns).join(index.shapes, ["n", "places"], "left_semi")
    opened = texts.join(index.shapes, "n").select(
        "__masked", generalise(F.col("__masked"), F.col("places")).alias("template")
    )
    best = F.struct("wild", "pattern_id", "template").alias("__best")
    return opened.join(known.select("wild", "pattern_id", "template"), "template").select("__masked", best)


def _found_by_block(index: TreeIndex, texts: DataFrame) -> DataFrame:
    """``__masked, __best`` of the patterns of no large shape, by the trees of their blocks."""
    spark = texts.sparkSession
    ranges = sorted({(b.low, b.high, b.parts) for b in index.others})
    dealt = spark.createDataFrame(ranges, "low int, high int, parts int")
    inside = F.col("n").between(F.col("low"), F.col("high"))
    lines = texts.join(dealt, inside).drop("n", "high")
    slices = materialize(
        lines.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / SLICE_LINES).cast("int").alias("slices")), "slices"
    )

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    lines = lines.join(slices, "low").select(
        "low", "__masked", each("parts").alias("part"),
        F.pmod(F.xxhash64("__masked"), F.col("slices")).cast("int").alias("slice"),
    )
    others = _placed(index.patterns).join(index.shapes, ["n", "places"], "left_anti").drop("places")
    patterns = others.join(dealt, inside).join(slices, "low").select(
        "low", "wild", "pattern_id", "template", each("slices").alias("slice"),
        F.pmod(F.xxhash64("template"), F.col("parts")).cast("int").alias("part"),
    )
    key = ["low", "part", "slice"]
    own = patterns.select(*[F.col(k).alias(f"_{k}") for k in key], "wild", "pattern_id", "template")
    both = own.groupBy(*[f"_{k}" for k in key]).cogroup(lines.groupBy(*key))
    return both.applyInArrow(prefix_tree.best_rows, BEST_DDL)


def match_many(
    logs: DataFrame,
    patterns: DataFrame | TreeIndex,
    masks: Iterable[str] | None = None,
) -> DataFrame:
    """New logs with the saved pattern that fits each, if any; fewest wildcards win, then the least id.

    Records without a body are left out. Without patterns every line goes without one. Repeated
    records are matched each. A stream is taken as it is where the patterns are one block, otherwise
    batch by batch (:func:`timberline.streaming.live.stream_match`).
    """
    chosen = select_masks(masks)
    index = patterns if isinstance(patterns, TreeIndex) else index_trees(patterns)
    columns = [F.col(_quoted(c)) for c in logs.columns]
    masked = F.coalesce(masked_line(F.col("body"), chosen), F.lit(""))
    lines = non_empty_body(logs)
    if len(index.blocks) <= 1:
        block = index.blocks[0] if index.blocks else Block(0, 0)
        best = lines.select(*columns, index.best(block, masked).alias("__best"))
    else:
        if logs.isStreaming:
            raise ValueError("patterns of several blocks are matched batch by batch")
        named = lines.select(*columns, masked.alias("__masked"))
        texts = materialize(
            named.select("__masked").distinct().withColumn("n", token_count(F.col("__masked"))), "masked"
        )
        found = _found_by_shape(index, texts)
        if index.others:
            found = found.union(_found_by_block(index, texts))
        least = materialize(found.groupBy("__masked").agg(F.min("__best").alias("__best")), "found")
        best = named.join(least, "__masked", "left")
    return best.select(
        *columns,
        F.col("__best.pattern_id").alias("pattern_id"),
        F.col("__best.template").alias("template"),
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
