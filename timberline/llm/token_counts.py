"""Exact token counts at every prefix of a text (operator 2).

A byte-level BPE file is read as it is. Texts are cut into words by the tokenizer's own pattern;
within a word a table over prefixes (:mod:`timberline.llm.prefix_bpe`) gives the count at every
byte, so counts of whole texts, of every prefix and the longest prefix within a budget come from
one pass, with nothing encoded again. Character classes of the pattern follow the tokenizers
library, whose Unicode tables may be older than those of ``regex``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from timberline.llm.batches import held, map_texts
from timberline.llm.prefix_bpe import PrefixTable

#: Fixed value: the pattern that byte-level BPE files of this kind split texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose count is kept before the memo is emptied.
MEMO = 500_000
#: One character for each class that is stable in every Unicode table.
STAND_IN = {"letter": "a", "number": "0", "space": "\t", "other": "#"}


def byte_letters() -> list[str]:
    """The letter that byte-level BPE files write for each byte.

    Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        if b in printable:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class PrefixCounter(dict):
    """Counts tokens; as a dict, word -> number of tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (
            model["type"] != "BPE"
            or spec["normalizer"] is not None
            or pre["type"] != "ByteLevel"
            or pre["add_prefix_space"]
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError("expected a byte-level BPE file without normaliser")
        byte_of = {letter: chr(b) for b, letter in enumerate(byte_letters())}
        special = [t["content"] for t in spec["added_tokens"]]
        plain = {
            "".join(byte_of[c] for c in piece): i
            for piece, i in model["vocab"].items()
            if piece not in special
        }
        order: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            order["".join(byte_of[c] for c in left), "".join(byte_of[c] for c in right)] = i
        self.table = PrefixTable(plain, lambda a, b: order.get((a, b)))
        self.words = regex.compile(PATTERN).findall
        self.spans = regex.compile(PATTERN).finditer
        self.blank = regex.compile(r"\s").match
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.has_special = bool(special)
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.usual = set(map(chr, range(128)))
        self.odd: dict[int, str] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = len(self.table.tokens(word.encode().decode("latin-1")))
        if len(word) <= 64:
            self[word] = n
        return n

    def _class(self, c: str) -> str:
        if len(self.pieces("a" + c)) == 1:
            return "letter"
        if len(self.pieces("0" + c)) == 1:
            return "number"
        return "other" if len(self.pieces("#" + c)) == 1 else "space"

    def _shape(self, text: str) -> str:
        """The text as the pattern should see it; same length, mostly the same text."""
        if not text.isascii():
            for c in set(text) - self.usual:
                kind = self._class(c)
                own = (
                    "letter" if regex.match(r"\p{L}", c)
                    else "number" if regex.match(r"\p{N}", c)
                    else "space" if regex.match(r"\s", c)
                    else "other"
                )
                if kind != own:
                    self.odd[ord(c)] = STAND_IN[kind]
                self.usual.add(c)
            if self.odd:
                return text.translate(self.odd)
        return text

    def _stretches(self, text: str):
        """Start, end and whether special, of what lies between and of special strings."""
        at = 0
        if self.has_special:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield at, m.start(), False
                yield m.start(), m.end(), True
                at = m.end()
        if at < len(text):
            yield at, len(text), False

    def count(self, text: str) -> int:
        total = 0
        for start, end, special in self._stretches(text):
            if special:
                total += 1
                continue
            part = text if end - start == len(text) else text[start:end]
            shape = self._shape(part)
            if shape is part:
                total += sum(map(self.__getitem__, self.words(part)))
            else:
                total += sum(self[part[m.start() : m.end()]] for m in self.spans(shape))
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to the length, each as encoded on its own.

        Three kinds of prefixes are cut into other words than the text itself: those that end in
        white space (all of it is one word then), within ``'re`` and its like, and within a
        special string.
        """
        out = np.zeros(len(text) + 1, np.int64)
        total, plain_from, plain_total = 0, 0, 0
        for start, end, special in self._stretches(text):
            if special:
                for i in range(start + 1, end):
                    out[i] = plain_total + self.count(text[plain_from:i])
                total += 1
                out[end] = plain_total = total
                plain_from = end
                continue
            part = text[start:end]
            shape = self._shape(part)
            run = None  # where the white space before the position begins, and tokens before it
            for m in self.spans(shape):
                a, b = m.span()
                counts = self._char_counts(part[a:b])
                out[start + a + 1 : start + b + 1] = [total + n for n in counts[1:]]
                if self.blank(shape, a):
                    run = run or (a, total)
                    if self.blank(shape, b - 1):
                        upto = b
                    else:
                        upto = a + 1
                    ends = self._char_counts(part[run[0] : upto])
                    for i in range(a + 1, upto + 1):
                        out[start + i] = run[1] + ends[i - run[0]]
                if not self.blank(shape, b - 1):
                    run = None
                if b - a == 3 and part[a:b] in ("'re", "'ve", "'ll"):
                    out[start + a + 2] = total + self["'"] + self[part[a + 1]]
                total += counts[-1]
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])

    def _char_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, by characters, from 0 characters on."""
        counts = self.table.counts(word.encode().decode("latin-1"))
        if word.isascii():
            return [0, *counts]
        out, at = [0], 0
        for c in word:
            at += len(c.encode())
            out.append(counts[at - 1])
        return out


def counter(path: str) -> PrefixCounter:
    """The counter of a path, loaded once per worker."""
    return held(f"counter {path}", lambda: PrefixCounter(path))


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` per row.

    Null and empty texts have no bytes and no tokens. Rows with a null or repeated key are rows
    like any other.
    """

    def make():
        own = counter(path)

        def work(texts: list[str]) -> list[pa.Array]:
            n = [own.count(t) for t in texts]
            return [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            ]

        return work

    return map_texts(docs, key, text, make, "n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, counts)``: tokens of every prefix by characters, from none to all of them."""

    def make():
        own = counter(path)
        return lambda texts: [
            pa.array([own.prefix_counts(t).tolist() for t in texts], pa.list_(pa.int32()))
        ]

    return map_texts(docs, key, text, make, "counts array<int>")


def truncate(
    docs: DataFrame, path: str, budget: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, text, n_tokens)``: the longest prefix of at most ``budget`` tokens, and its count."""

    def make():
        own = counter(path)

        def work(texts: list[str]) -> list[pa.Array]:
            kept, counts = [], []
            for t in texts:
                table = own.prefix_counts(t)
                n = int(np.flatnonzero(table <= budget)[-1])
                kept.append(t[:n])
                counts.append(int(table[n]))
            return [pa.array(kept, pa.string()), pa.array(counts, pa.int64())]

        return work

    return map_texts(docs, key, text, make, "text string, n_tokens bigint")
