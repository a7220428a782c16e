"""Single-process statement of pattern mining, for comparison on small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WILD = "<*>"


def has_digit(token: str) -> bool:
    return re.search("[0-9]", re.sub(r"<[A-Z_0-9]+>", "", token)) is not None


def skeleton(line: str) -> str:
    return " ".join(WILD if has_digit(t) else t for t in line.split(" "))


def led(entries: list[tuple[str, int]], sim_th: float) -> dict[str, str]:
    """Entry -> template: leaders in order, every other entry with the leader it is most alike."""
    order = [text.split(" ") for text, _ in sorted(entries, key=lambda e: (-e[1], e[0]))]

    def same(a: list[str], b: list[str]) -> int:
        return sum(1 for x, y in zip(a, b) if x == y != WILD)

    leaders: list[list[str]] = []
    for row in order:
        if all(same(row, x) / len(row) < sim_th for x in leaders):
            leaders.append(row)
    members: dict[int, list[list[str]]] = defaultdict(list)
    for row in order:
        if row in leaders:
            members[leaders.index(row)].append(row)
        else:
            members[max(range(len(leaders)), key=lambda i: (same(row, leaders[i]), -i))].append(row)
    out = {}
    for rows in members.values():
        template = " ".join(c[0] if len(set(c)) == 1 else WILD for c in zip(*rows))
        out.update({" ".join(r): template for r in rows})
    return out


def mine(lines: list[str], config) -> dict[str, str]:
    """Masked line -> template."""
    values = defaultdict(set)
    for line in lines:
        plain = skeleton(line)
        for pos, (token, p) in enumerate(zip(line.split(" "), plain.split(" "))):
            if p == WILD:
                values[plain, pos].add(token)
    params = defaultdict(set)
    for (plain, pos), seen in values.items():
        if len(seen) > config.literal_values:
            params[plain].add(pos)

    entry_of = {}
    for line in set(lines):
        wild = params.get(skeleton(line), set())
        tokens = line.split(" ")
        entry_of[line] = " ".join(WILD if i in wild else t for i, t in enumerate(tokens))
    weights = Counter(entry_of[line] for line in lines)

    lead = {}
    for entry in weights:
        tokens = skeleton(entry).split(" ")
        lead[entry] = tokens[: min(config.prefix_tokens, len(tokens) - 1)]
    bucket = {e: [str(len(e.split(" ")))] for e in weights}
    for level in range(config.prefix_tokens):
        sums = defaultdict(Counter)
        for e, w in weights.items():
            if level < len(lead[e]) and lead[e][level] != WILD:
                sums[tuple(bucket[e])][lead[e][level]] += w
        kept = {
            node: {t for t, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: config.max_children - 1]}
            for node, c in sums.items()
        }
        step = {}
        for e in weights:
            if level < len(lead[e]):
                t = lead[e][level]
                step[e] = [*bucket[e], t if t in kept.get(tuple(bucket[e]), set()) else WILD]
        bucket.update(step)

    groups = defaultdict(list)
    for e, w in weights.items():
        groups[tuple(bucket[e])].append((e, w))
    template = {e: t for members in groups.values() for e, t in led(members, config.sim_th).items()}
    return {line: template[entry_of[line]] for line in entry_of}
