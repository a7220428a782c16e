"""SentencePiece encoding and decoding by a merge-type prefix table (operator 8).

No piece of such a model holds a word mark after another character, or a line break next to
anything, so a text falls into segments that encode on their own. Each distinct segment is encoded
once per task by :class:`~timberline.llm.prefix_bpe.PrefixTable`; characters without a piece fall
back to bytes. The model is read, never trained, from a path given by the caller.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.llm.batches import held, map_texts, slices
from timberline.llm.prefix_bpe import PrefixTable

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Segments kept encoded; beyond, those not met again for half as many go.
MEMO = 250_000


class PieceModel(dict):
    """Encoder of a BPE model with byte fallback; as a dict, segment -> (number of ids, ids as text, text)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (
            proto.trainer_spec.model_type != 2
            or not proto.trainer_spec.byte_fallback
            or proto.trainer_spec.treat_whitespace_as_suffix
            or spec.precompiled_charsmap
            or spec.remove_extra_whitespaces
            or not spec.add_dummy_prefix
            or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}
        ):
            raise ValueError("expected a BPE model with byte fallback and no normalisation")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) or "\n" in p[1:] or p[:1] == "\n" != p for p in self.ids):
            raise ValueError("pieces cross words or lines")
        self.bytes = {
            int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE
        }
        scores = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.table = PrefixTable(self.ids, lambda a, b: scores.get(a + b))
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.written = {p: str(i) for p, i in self.ids.items()}
        self.older: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, segment: str) -> tuple[int, str, str]:
        value = self.older.pop(segment, None)
        if value is None:
            tokens = self.table.tokens(segment)
            try:
                shown = ",".join([self.written[t] for t in tokens])
                value = (len(tokens), shown, segment.replace(MARK, " "))
            except KeyError:  # a character without a piece
                value = self._with_bytes(tokens)
        if len(segment) <= 64:
            if len(self) >= MEMO // 2:
                self.older = dict(self)
                self.clear()
            self[segment] = value
        return value

    def _with_bytes(self, tokens: list[str]) -> tuple[int, str, str]:
        ids: list[int] = []
        for token in tokens:
            if token in self.ids:
                ids.append(self.ids[token])
            else:
                ids.extend(self.bytes[b] for b in token.encode())
        return len(ids), ",".join(map(str, ids)), self._surface(ids)

    def segments(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for s in self.segments(text) for i in self[s][1].split(",")]

    def _surface(self, ids: list[int]) -> str:
        """Text of ids: bytes are joined before they are read as UTF-8, bad ones become U+FFFD."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if i not in self.hidden:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids without the word mark that encoding puts in front."""
        shown = [i for i in ids if i not in self.hidden]
        text = self._surface(shown)
        return text[1:] if shown and self.pieces[shown[0]].startswith(MARK) else text

    def both(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids as text, decoded text."""
        found = [self[s] for s in self.segments(text)]
        surface = "".join([f[2] for f in found])
        return (
            sum([f[0] for f in found]),
            ",".join([f[1] for f in found]),
            surface[1:] if surface.startswith(" ") else surface,
        )


def _utf8(held: bytearray) -> str:
    """Read bytes as UTF-8; each byte that is no part of a character becomes one U+FFFD."""
    out, i, data = [], 0, bytes(held)
    while i < len(data):
        for n in range(1, 5):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def model(path: str) -> PieceModel:
    """The model of a path, loaded once per worker."""
    return held(f"pieces {path}", lambda: PieceModel(path))


def _columns(path: str, shape: Callable[[PieceModel, list[str]], list[pa.Array]]):
    def make():
        encoder = model(path)
        return lambda texts: shape(encoder, texts)

    return make


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` per row, in the library's numbering, without begin or end ids.

    A null or empty text has no ids. Rows with a null or repeated key are rows like any other.
    """
    return map_texts(
        docs,
        key,
        text,
        _columns(path, lambda m, texts: [pa.array(map(m.encode, texts), pa.list_(pa.int32()))]),
        "ids array<int>",
    )


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of rows of ids; null or no ids give the empty text."""

    def run(batches):
        decoder = model(path)
        for batch in slices(batches):
            texts = [decoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=[key, "text"]
            )

    return rows.select(key, ids).mapInArrow(run, f"{key} bigint, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` per row.

    The hashes are of the ids in decimal, joined by commas, and of the decoded text in UTF-8;
    both are of nothing for a null or empty text.
    """

    def shape(m: PieceModel, texts: list[str]) -> list[pa.Array]:
        counts, ids, decoded = [], [], []
        for t in texts:
            n, listed, back = m.both(t)
            counts.append(n)
            ids.append(hashlib.sha256(listed.encode()).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]

    return map_texts(
        docs,
        key,
        text,
        _columns(path, shape),
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
