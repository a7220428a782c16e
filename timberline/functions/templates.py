"""Expressions over masked lines and templates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.masks import apply_masks

WILD = "<*>"

# A whole token with a digit outside its mask tokens. Mask tokens are taken whole and
# never given back, so the 6 of <IPV6_ADDRESS> is not seen as a digit.
DIGIT_TOKEN = r"(?<!\S)(?:[^\s0-9<]++|<[A-Z_0-9]++>|<)*+[0-9]\S*+"


def masked_line(body: Column, ids: Iterable[str] | None = None) -> Column:
    """Masked body with single spaces between its tokens."""
    return F.trim(F.regexp_replace(apply_masks(body, ids), r"\s+", " "))


def skeleton(masked: Column) -> Column:
    """Masked line with every digit-bearing token replaced by the wildcard."""
    return F.regexp_replace(masked, DIGIT_TOKEN, WILD)


def line_tokens(line: Column) -> Column:
    return F.split(line, " ")


def token_count(line: Column) -> Column:
    """Number of tokens. Never null: as a join key it needs no null test, which would
    evaluate the line a second time."""
    return F.coalesce(F.size(line_tokens(line)), F.lit(0))


def generalise(line: Column, wild_positions: Column) -> Column:
    """Line with the wildcard at the given token positions; never null, see above."""
    replaced = F.transform(
        line_tokens(line),
        lambda t, i: F.when(F.array_contains(wild_positions, i), F.lit(WILD)).otherwise(t),
    )
    return F.coalesce(F.array_join(replaced, " "), F.lit(""))


def wild_positions(template: Column) -> Column:
    """Positions of the wildcard in a template."""
    marked = F.transform(
        line_tokens(template), lambda t, i: F.when(t == WILD, i)
    )
    return F.array_compact(marked)


def template_similarity(a: Column, b: Column) -> Column:
    """Share of positions at which two token arrays hold the same literal."""
    same = F.filter(
        F.zip_with(a, b, lambda x, y: (x == y) & (x != WILD)), lambda hit: hit
    )
    return F.when(F.size(a) == F.size(b), F.size(same) / F.size(a)).otherwise(F.lit(0.0))


def template_matches(template: Column, line: Column) -> Column:
    """Whether every literal of the template stands in the line at its place."""
    t, x = line_tokens(template), line_tokens(line)
    return (F.size(t) == F.size(x)) & F.forall(
        F.zip_with(t, x, lambda a, b: (a == WILD) | (a == b)), lambda ok: F.coalesce(ok, F.lit(False))
    )


def template_id(template: Column) -> Column:
    """Identifier derived from the content of a template."""
    return F.md5(F.concat_ws("|", F.size(line_tokens(template)).cast("string"), template))
