"""URL rules by a bit-parallel wildcard automaton (operator 4).

All rules become glob patterns over one canonical form of the URL, ``.host/path``. Their states
are packed next to each other into 64-bit words, and one Shift-And step per character moves every
pattern of every URL of a batch: ``D' = ((D << 1) & B[c]) | (D & S[c])``, where ``B`` holds the
positions a character may step into and ``S`` those it may stay in (the wildcards). Rules are few
and travel with the closure; URLs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: States per block of URLs handled at once, to bound memory whatever the length of a URL.
BLOCK_CELLS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: What no rule speaks about: hosts with one of these words are blocked, the rest is allowed.
#: ``*`` stands for anything without a slash, ``**`` for anything, ``?`` for one character
#: other than a slash; the pattern covers the whole of ``.host/path``.
BLOCKED_GLOBS = ("*casino**", "*-bets**", "*-pills**", "*ads-track**", "*adult-**")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def glob_tokens(glob: str) -> list[tuple[str, str]]:
    """``("char", c)``, ``("one", "")``, ``("run", "")`` and ``("any", "")`` in order."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(("any", ""))
            i += 1
        elif glob[i] == "*":
            out.append(("run", ""))
        elif glob[i] == "?":
            out.append(("one", ""))
        else:
            out.append(("char", glob[i]))
        i += 1
    return out


def rule_tokens(rule: Rule) -> list[tuple[str, str]]:
    literal = [("char", c) for c in f".{rule.host}{rule.path}"]
    return [("run", ""), *literal, ("any", "")]


class WildcardAutomaton:
    """Which of some patterns cover each of some texts."""

    def __init__(self, patterns: Sequence[list[tuple[str, str]]]):
        letters = {c for p in patterns for kind, c in p if kind == "char"} | {"/"}
        self.codes = np.array(sorted(map(ord, letters)), np.uint32)
        row = {chr(c): i + 1 for i, c in enumerate(self.codes)}  # row 0: any other character
        states = sum(1 + sum(kind in ("char", "one") for kind, _ in p) for p in patterns)
        self.words = max(1, -(-states // 64))
        step = np.zeros((len(row) + 1, self.words), np.uint64)
        stay = np.zeros_like(step)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for pattern in patterns:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for kind, c in pattern:
                if kind in ("char", "one"):
                    at += 1
                word, bit = at // 64, np.uint64(1 << at % 64)
                if kind == "char":
                    step[row[c], word] |= bit
                elif kind == "one":
                    step[:, word] |= bit
                    step[row["/"], word] &= ~bit
                elif kind == "any":
                    stay[:, word] |= bit
                else:
                    slash = stay[row["/"], word] & bit
                    stay[:, word] |= bit
                    if not slash:
                        stay[row["/"], word] &= ~bit
            self.final.append((at // 64, np.uint64(1 << at % 64)))
            at += 1
        self.step, self.stay = step, stay

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean, texts by patterns."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = np.argsort([len(t) for t in texts], kind="stable")
        i = 0
        while i < len(order):  # texts of similar length share a block
            n = len(texts[order[i]])
            most = max(1, BLOCK_CELLS // max(1, 2 * n * self.words))
            block = [k for k in order[i : i + most] if len(texts[k]) <= max(64, 2 * n)]
            out[block] = self._block([texts[k] for k in block])
            i += len(block)
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        width = int(lengths.max(initial=0))
        rows = np.zeros((len(texts), width), np.intp)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
        rows[np.arange(width) < lengths[:, None]] = np.where(
            self.codes[place] == flat, place + 1, 0
        )
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        for k in range(width):
            live = lengths > k
            shifted = state << np.uint64(1)
            shifted[:, 1:] |= state[:, :-1] >> np.uint64(63)
            c = rows[:, k]
            moved = (shifted & self.step[c]) | (state & self.stay[c])
            state[live] = moved[live]
        return np.stack([(state[:, w] & bit) != 0 for w, bit in self.final], axis=1)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    blocked: Sequence[str] = BLOCKED_GLOBS,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``(key, host, path, rule, verdict)`` per row.

    ``rule`` is the longest rule that fits (of equally long ones a blocking one, then the first
    by text), null if none does; its verdict holds, else a blocked glob blocks and anything else
    is allowed. A null URL or one without ``://`` has an empty host and path, which no rule fits
    and which is allowed. Rows with a null or repeated key are rows like any other.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    patterns = [*map(rule_tokens, ranked), *map(glob_tokens, blocked)]
    columns = pages.select(
        F.col(key).cast("long").alias(key),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    names = [key, "host", "path", "rule", "verdict"]

    def run(batches):
        automaton = WildcardAutomaton(patterns)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fit = automaton.matches([f".{h}{p}" for h, p in zip(hosts, paths)])
            fit[[not h for h in hosts], : len(ranked)] = False
            of_rule = fit[:, : len(ranked)]
            first = of_rule.argmax(axis=1) if ranked else np.zeros(len(hosts), int)
            known = of_rule.any(axis=1)
            other = fit[:, len(ranked) :].any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([ranked[f].text if k else None for f, k in zip(first, known)], pa.string()),
                    pa.array(
                        [
                            ranked[f].verdict if k else "block" if o else "allow"
                            for f, k, o in zip(first, known, other)
                        ],
                        pa.string(),
                    ),
                ],
                names=names,
            )

    return columns.mapInArrow(
        run, f"{key} bigint, host string, path string, rule string, verdict string"
    )
