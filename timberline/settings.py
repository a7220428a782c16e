"""Parameters of pattern mining; passed to each call, never kept globally."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MiningConfig:
    """How lines are grouped into templates.

    sim_th        share of equal positions a line needs to join a template, to two places
    depth         tree depth; ``depth - 3`` leading tokens select the bucket
    max_children  most branches a tree node keeps, the wildcard branch included
    literal_values a digit-bearing position stays literal while it has at most this many
                  distinct values
    slice_size    most forms one clustering task handles at a time; no matter of results
    slice_tokens  most tokens it handles at a time; long lines make smaller slices
    """

    sim_th: float = 0.5
    depth: int = 6
    max_children: int = 100
    literal_values: int = 16
    slice_size: int = 4000
    slice_tokens: int = 1_000_000

    def __post_init__(self) -> None:
        if not 0.1 <= self.sim_th <= 1.0:
            raise ValueError("sim_th must be between 0.1 and 1.0")
        object.__setattr__(self, "sim_th", round(self.sim_th, 2))
        if not 3 <= self.depth <= 10:
            raise ValueError("depth must be between 3 and 10")
        if self.max_children < 2:
            raise ValueError("max_children must be at least 2")
        if not 1 <= self.literal_values <= 63:
            raise ValueError("literal_values must be between 1 and 63")
        if self.slice_size < 2:
            raise ValueError("slice_size must be at least 2")
        if self.slice_tokens < 2:
            raise ValueError("slice_tokens must be at least 2")

    @property
    def prefix_tokens(self) -> int:
        return self.depth - 3
