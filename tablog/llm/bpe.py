"""Byte-level BPE by a sentencepiece model made from a vocabulary of ranks."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tablog.llm.columns import named, whole_text
from tablog.llm.words import chunks, text_bytes

# Pre-tokens remembered by a task; past that, it starts anew.
REMEMBERED = 400_000
# Pre-tokens of a text handled at once.
BLOCK = 200_000


def byte_letters() -> list[str]:
    """A visible character for every byte: itself if printable, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, an integer or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialized_model(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """A sentencepiece BPE model of the vocabulary, and the rank of each of its pieces.

    Pieces are the tokens' bytes as letters, scored by negative rank; the
    normaliser is the identity.  The last piece, unknown, has rank -1; the
    256 byte tokens keep it from ever being used.
    """
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = [
        _field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(ranks[token])) + _field(3, 1)
        for token in tokens
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(35, 0)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    model = b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, normalizer)
    return model, np.array([ranks[token] for token in tokens] + [-1], np.int32)


class Encoder(dict):
    """Ids of pre-tokens, as the bytes of an int32 array; filled as they come up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.letters = ranks, byte_letters()
        self.pattern = regex.compile(pattern)
        model, self.rank_of = serialized_model(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)

    def learn(self, parts: list[str], block: list[str]) -> None:
        if len(self) >= REMEMBERED:
            self.clear()
            parts = list(set(block))
        unknown = []
        for part in parts:
            data = part.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self[part] = np.int32(rank).tobytes()
            else:
                unknown.append((part, "".join([self.letters[b] for b in data])))
        found = self.model.encode([mapped for _, mapped in unknown], num_threads=1)
        for (part, _), pieces in zip(unknown, found):
            self[part] = self.rank_of[pieces].tobytes()

    def ids(self, text: str) -> np.ndarray:
        parts = (found.group() for found in self.pattern.finditer(text))
        blocks = []
        while block := list(islice(parts, BLOCK)):
            if unseen := [part for part in set(block) if part not in self]:
                self.learn(unseen, block)
            blocks.append(b"".join([self[part] for part in block]))
        return np.frombuffer(b"".join(blocks), np.int32)


Batches = Iterator[pa.RecordBatch]


def _encoding(ranks_path: str, pattern: str, id_column: str) -> Callable[[Batches], Batches]:
    """Batches of ids and texts become batches of ids and token ids."""

    def run(batches: Batches) -> Batches:
        encoder = Encoder(read_ranks(ranks_path), pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in chunks(sizes):
                texts = text_bytes(batch.column(1)[a:b])
                ids = [encoder.ids(text.decode("utf-8", "replace")) for text in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = np.concatenate([*ids, np.empty(0, np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], [id_column, "ids"])

    return run


def _decoding(ranks_path: str, names: list[str], ids_column: str) -> Callable[[Batches], Batches]:
    """Batches of the columns ``names`` get ``decoded`` as their last."""
    at = names.index(ids_column)

    def run(batches: Batches) -> Batches:
        letter_byte = {letter: b for b, letter in enumerate(byte_letters())}
        model, ranks = serialized_model(read_ranks(ranks_path))
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = [b""] * (int(ranks.max(initial=-1)) + 1)
        for i, rank in enumerate(ranks[:-1].tolist()):
            tokens[rank] = bytes(letter_byte[c] for c in pieces.id_to_piece(i))
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        begin = np.cumsum(size) - size
        for batch in batches:
            lists = batch.column(at)
            counts = [len(x) if x.is_valid else 0 for x in lists]
            for a, b in chunks([4 * n for n in counts]):
                ids = lists[a:b].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
                    raise ValueError("an id is not in the vocabulary")
                lengths = size[ids]
                ends = np.cumsum(lengths)
                take = np.repeat(begin[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
                view = memoryview(flat[take])
                edges = np.concatenate([[0], ends])[np.cumsum([0, *counts[a:b]])].tolist()
                decoded = pa.array([bytes(view[x:y]) for x, y in zip(edges[:-1], edges[1:])], pa.binary())
                columns = [column[a:b] for column in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, decoded], [*names, "decoded"])

    return run


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id column and ``ids``, the token ids of the whole text, special tokens being plain text.

    Each match of ``pattern`` is encoded separately.  The vocabulary file must
    be readable on every executor (it is installed there with its package).
    A null text is empty and has no ids; bytes that aren't UTF-8 become U+FFFD.
    """
    rows = docs.select(named(id_column), whole_text(text_column).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_encoding(ranks_path, pattern, id_column), f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the tokens in a row.

    A null list of ids gives no bytes; an id outside the vocabulary is an error.
    """
    kept = [field for field in encoded.schema if field.name != "decoded"]
    names = [field.name for field in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    rows = encoded.select(*[named(name) for name in names])
    return rows.mapInArrow(_decoding(ranks_path, names, ids_column), f"{schema}, decoded binary")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """What :func:`decode` makes of :func:`encode`, with one Python worker a task instead of two."""
    encoding = _encoding(ranks_path, pattern, id_column)
    decoding = _decoding(ranks_path, [id_column, "ids"], "ids")
    rows = docs.select(named(id_column), whole_text(text_column).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, ids array<int>, decoded binary"
    return rows.mapInArrow(lambda batches: decoding(encoding(batches)), schema)
