"""Byte-pair encoding by a table over prefixes instead of a run of merges.

For every prefix of a word the table holds the last token of the prefix's encoding and how many
tokens it has. A token ``t`` ends the prefix exactly if ``t`` encodes to itself and the token
before it, ``s``, is *compatible*: ``s + t`` encodes to ``[s, t]``. Only one token per prefix
satisfies this, so the table is filled left to right from the vocabulary entries that end at
each position (found by one Aho-Corasick automaton) and ids are read off backwards.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

#: Entries kept in a memo before it is emptied; a matter of memory, not of results.
MEMO = 400_000


class PrefixTable:
    """``rank(left, right)`` is the order in which two neighbours merge, None if they never do."""

    def __init__(self, vocabulary: dict[str, int], rank: Callable[[str, str], int | None]):
        self.vocabulary = vocabulary
        self.rank = rank
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary:
            if len(piece) > 1 and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The encoding as the merges define it; only short strings come here."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                order = self.rank(parts[i], parts[i + 1])
                if order is not None and (best is None or order < best):
                    best, at = order, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[pair] = self.merged(left + right) == [left, right]
        return known

    def last_tokens(self, word: str) -> list[str]:
        """Last token of each prefix.

        Exactly one token satisfies the test, so where no longer one does it is the character, which
        the automaton need not report; the same holds for a character outside the vocabulary.
        """
        last: list[str] = [""] * len(word)
        fits, seen = self.fits, 0
        for end, (piece, size) in self.automaton.iter(word):
            if last[end]:
                continue
            start = end - size
            if start < 0:
                last[end] = piece
                continue
            while seen <= start:  # behind the matches; what is still open there stands alone
                if not last[seen]:
                    last[seen] = word[seen]
                seen += 1
            before = last[start]
            fit = fits.get((before, piece))
            if fit or (fit is None and self.compatible(before, piece)):
                last[end] = piece
        for i in range(seen, len(word)):
            if not last[i]:
                last[i] = word[i]
        return last

    def counts(self, word: str) -> list[int]:
        """Number of tokens of each prefix."""
        out: list[int] = []
        for end, token in enumerate(self.last_tokens(word)):
            start = end - len(token)
            out.append(1 + (out[start] if start >= 0 else 0))
        return out

    def tokens(self, word: str) -> list[str]:
        """Tokens of a word, read backwards from the table."""
        last = self.last_tokens(word)
        out, end = [], len(word) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]
