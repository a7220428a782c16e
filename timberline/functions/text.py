"""Word tokens of a body and the six full-text predicates over them.

Only the token regex needs the tokens themselves. The other five are stated as one pattern
over the lower-cased body: a query token between edges, or several with nothing but
separators between them. Plain ``contains`` tests go first, so the pattern is tried on
likely rows alone, and all of it stays inside generated code. Query tokens hold letters,
digits and underscores only, so they are safe inside a pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain ranges come first in these: they settle nearly every character without a look at
# its Unicode properties.
SEPARATOR = r"[^a-z0-9_\p{L}\p{N}]"
HAN = r"(?=[\u2E80-\uFAFF\x{16000}-\x{3FFFF}])(\p{IsHan})"
JOINING = r"[a-z0-9_[\p{L}\p{N}&&[^\p{IsHan}]]]"

_DRIVER_TOKEN = regex.compile(r"\p{Han}|(?:(?!\p{Han})[\p{L}\p{N}_])+")


def tokens(body: Column) -> Column:
    """Lower-cased word tokens in order.

    A token is a run of letters, digits and underscores; Han characters are tokens of
    their own.
    """
    spread = F.regexp_replace(F.lower(body), HAN, " $1 ")
    return F.filter(F.split(spread, SEPARATOR + "+"), lambda t: t != "")


def term_positions(body: Column) -> Column:
    """``array<struct<term, positions>>``: each distinct token once, with its places in order; none of no body.

    Tokens are sorted with their places, and a run of equal ones becomes an entry, so a long body
    takes no more than a sort. Sorted and cut arrays are bound to lambda variables; written out in a
    nested expression they would be made anew for every element.
    """

    def entries(pairs: Column, starts: Column) -> Column:
        def entry(start: Column, i: Column) -> Column:
            following = F.coalesce(F.get(starts, i + 1), F.size(pairs))
            places = F.transform(F.slice(pairs, start + 1, following - start), lambda p: p["pos"])
            return F.struct(F.get(pairs, start)["term"].alias("term"), places.alias("positions"))

        return F.transform(starts, entry)

    def runs(pairs: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(pairs, i)["term"] != F.get(pairs, i - 1)["term"])
        starts = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), first)
        return F.get(F.transform(F.array(starts), lambda s: entries(pairs, s)), F.lit(0))

    pairs = F.sort_array(F.transform(tokens(body), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    # an empty array has no runs; a sequence from 0 to -1 would have two
    filled = F.filter(F.array(pairs), lambda p: F.size(p) > 0)
    return F.flatten(F.transform(filled, runs))


def query_tokens(query: str) -> list[str]:
    """The tokens of a search text, taken on the driver by the same rule."""
    return _DRIVER_TOKEN.findall(query.lower())


def _is_han(token: str) -> bool:
    return regex.fullmatch(r"\p{Han}", token) is not None


def _token_pattern(token: str, left: bool = True, right: bool = True) -> str:
    """The token, with an edge of the body's token on the sides asked for."""
    if _is_han(token):
        return token
    return (f"(?<!{JOINING})" if left else "") + token + (f"(?!{JOINING})" if right else "")


def _contains_all(lowered: Column, needles: list[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.contains(lowered, F.lit(n)) for n in dict.fromkeys(needles)]
    )


def match_any(body: Column, query: str) -> Column:
    """At least one query token is a token of the body."""
    q = list(dict.fromkeys(query_tokens(query)))
    if not q:
        return F.lit(False)
    lowered = F.lower(body)
    likely = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(t)) for t in q])
    return likely & F.rlike(lowered, F.lit("|".join(_token_pattern(t) for t in q)))


def match_all(body: Column, query: str) -> Column:
    """Every query token is a token of the body."""
    q = list(dict.fromkeys(query_tokens(query)))
    if not q:
        return F.lit(False)
    lowered = F.lower(body)
    exact = [F.rlike(lowered, F.lit(_token_pattern(t))) for t in q]
    return reduce(lambda a, b: a & b, exact, _contains_all(lowered, q))


def _phrase(body: Column, query: str, open_start: bool, open_end: bool) -> Column:
    q = query_tokens(query)
    if not q:
        return F.lit(False)
    lowered = F.lower(body)
    final = len(q) - 1
    parts = [
        _token_pattern(t, left=i > 0 or not open_start, right=i < final or not open_end)
        for i, t in enumerate(q)
    ]
    # A token ends at an edge, so an empty gap is only possible next to a Han character.
    pattern = (SEPARATOR + "*+").join(parts)
    return _contains_all(lowered, q) & F.rlike(lowered, F.lit(pattern))


def match_phrase(body: Column, query: str) -> Column:
    """The query tokens stand next to each other in order."""
    return _phrase(body, query, open_start=False, open_end=False)


def match_phrase_prefix(body: Column, query: str) -> Column:
    """As a phrase, but the last query token may be the start of a token."""
    return _phrase(body, query, open_start=False, open_end=True)


def match_phrase_edge(body: Column, query: str) -> Column:
    """As a phrase, but the first may be the end and the last the start of a token.

    A single query token may stand anywhere inside a token.
    """
    return _phrase(body, query, open_start=True, open_end=True)


def match_regexp(body: Column, pattern: str) -> Column:
    """Some single token matches the pattern, which is used as given."""
    return F.exists(tokens(body), lambda t: F.rlike(t, F.lit(pattern)))


MODES: dict[str, Callable[[Column, str], Column]] = {
    "MATCH_ANY": match_any,
    "MATCH_ALL": match_all,
    "MATCH_PHRASE": match_phrase,
    "MATCH_PHRASE_PREFIX": match_phrase_prefix,
    "MATCH_PHRASE_EDGE": match_phrase_edge,
    "MATCH_REGEXP": match_regexp,
}
DEFAULT_MODE = "MATCH_ANY"


def match(body: Column, query: str, mode: str = DEFAULT_MODE) -> Column:
    """Predicate for a mode by name; unknown names mean any-term, no text means true."""
    if not query:
        return F.lit(True)
    return MODES.get(mode, match_any)(body, query)

