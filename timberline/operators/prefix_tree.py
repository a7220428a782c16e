"""Templates packed into arrays as one prefix tree, walked by many lines at once.

Nodes are numbered level by level, so the keys ``node * width + token`` of all edges are sorted as they
are made and the edge at place ``i`` leads to node ``len(lengths) + i``: no pointers are kept. The
wildcard is token 0; the first nodes are the roots, one for each number of tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WILD = "<*>"
#: Pairs of a line and a node that are looked at together.
FRONTIER = 500_000


def split_tokens(lines: pa.Array, known: dict[str, int], grow: bool = False):
    """Start, number and token ids (-1 where unknown) of each line's tokens."""
    lists = pc.split_pattern(lines.cast(pa.large_string()), " ")
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if grow:
        for word in words:
            known.setdefault(word, len(known))
    ids = np.array([known.get(word, -1) for word in words], np.int64)
    places = coded.indices.to_numpy(zero_copy_only=False)
    base = offsets[0] if len(offsets) else 0
    return offsets[:-1] - base, np.diff(offsets), ids[places] if len(words) else ids


def build(templates: pa.Array) -> dict:
    """The tree of templates that come in order of preference; plain arrays and one dictionary."""
    known = {WILD: 0}
    starts, sizes, tokens = split_tokens(templates, known, grow=True)
    width = len(known)
    lengths = np.unique(sizes)
    rank = np.arange(len(sizes), dtype=np.int64)
    node = np.searchsorted(lengths, sizes)
    levels, ends, depth, nodes = [], [], 0, len(lengths)
    while len(rank):
        done = sizes[rank] == depth
        ends.append((node[done], rank[done]))
        rank, node = rank[~done], node[~done]
        keys, inverse = np.unique(node * width + tokens[starts[rank] + depth], return_inverse=True)
        levels.append(keys)
        node = nodes + inverse
        nodes += len(keys)
        depth += 1
    edges = np.concatenate([*levels, np.empty(0, np.int64)])
    wild = np.full(nodes, -1, np.int64)
    open_ = np.flatnonzero(edges % width == 0)
    wild[edges[open_] // width] = len(lengths) + open_
    best = np.full(nodes, len(sizes), np.int64)
    for at, ranks in ends:
        np.minimum.at(best, at, ranks)
    return {
        "known": known, "width": width, "lengths": lengths, "edges": edges, "wild": wild, "best": best,
        "none": len(sizes),
    }


def walk(tree: dict, starts: np.ndarray, sizes: np.ndarray, tokens: np.ndarray):
    """The best template of each line (``none`` where no one fits) and the number of nodes it came by.

    All lines go down one level at a time, by their own token and by the wildcard. Where that makes
    too many pairs at once, the lines are taken in halves; a single line meets a node at most once.
    """
    lengths, edges, wild = tree["lengths"], tree["edges"], tree["wild"]
    best = np.full(len(sizes), tree["none"], np.int64)
    visits = np.zeros(len(sizes), np.int64)
    if not len(lengths):
        return best, visits
    root = np.minimum(np.searchsorted(lengths, sizes), len(lengths) - 1)
    line = np.flatnonzero(lengths[root] == sizes)
    node, depth = root[line], 0
    while len(line):
        if len(line) > FRONTIER and len(sizes) > 1:
            half = len(sizes) // 2
            parts = [walk(tree, starts[s], sizes[s], tokens) for s in (slice(half), slice(half, None))]
            return tuple(np.concatenate(p) for p in zip(*parts))
        visits += np.bincount(line, minlength=len(sizes))
        done = sizes[line] == depth
        np.minimum.at(best, line[done], tree["best"][node[done]])
        line, node = line[~done], node[~done]
        token = tokens[starts[line] + depth]
        key = node * tree["width"] + token
        place = np.searchsorted(edges, key)
        hit = (token > 0) & (place < len(edges))
        hit[hit] = edges[place[hit]] == key[hit]
        open_ = wild[node] >= 0
        line = np.concatenate([line[hit], line[open_]])
        node = np.concatenate([len(lengths) + place[hit], wild[node[open_]]])
        depth += 1
    return best, visits


def best_of(tree: dict, lines: pa.Array, slice_rows: int = 2_000) -> pa.Array:
    """Place of the best template of each line, null where none fits; equal lines are walked once."""
    coded = lines.dictionary_encode()
    found = []
    for at in range(0, len(coded.dictionary), slice_rows):
        found.append(walk(tree, *split_tokens(coded.dictionary.slice(at, slice_rows), tree["known"]))[0])
    ranks = np.concatenate([*found, np.empty(0, np.int64)])
    return pa.array(ranks, mask=ranks == tree["none"]).take(coded.indices)


def best_rows(patterns: pa.Table, lines: pa.Table) -> pa.Table:
    """The lines of a slice that a pattern of a block fits, with the best one."""
    order = [(name, "ascending") for name in ("wild", "pattern_id", "template")]
    place = pc.sort_indices(patterns, order)
    columns = [patterns[name].take(place).combine_chunks() for name, _ in order]
    masked = lines["__masked"].combine_chunks()
    at = best_of(build(columns[2]), masked)
    found = at.is_valid()
    best = pa.StructArray.from_arrays(
        [c.take(at.filter(found)) for c in columns], names=[name for name, _ in order]
    )
    return pa.table({"__masked": masked.filter(found), "__best": best})
