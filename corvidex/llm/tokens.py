"""Token ids of whole corpora by a public byte-level BPE vocabulary.

The vocabulary's rank file becomes a sentencepiece BPE model, written byte by
byte here: piece i is the i-th byte string, each byte shown as one printable
character, with score -i, and normalisation off. Merging by best score is then
merging by lowest rank, so the model gives the vocabulary's own ids. A text is
cut into pre-tokens first, as the vocabulary requires, and pre-tokens, not
texts, are encoded; what a worker has seen it looks up.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame

from corvidex.session import ship

#: Folder of the public vocabulary files; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the public pre-tokenisation pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers before it starts anew, and the longest one it remembers.
CACHE_TOKENS, CACHE_CHARS = 400_000, 64
#: Texts handed to a worker at once; bounds its memory where texts are long.
BATCH_BYTES = 8 << 20


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in the order of their ranks from 0."""
    pairs = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                pairs.append((int(rank), base64.b64decode(token)))
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0..n-1")
    return [t for _, t in pairs]


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_TO_LETTER = byte_letters()
_TO_BYTE = {ord(c): b for b, c in _TO_LETTER.items()}


def to_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_LETTER)


def from_letters(text: str) -> bytes:
    return text.translate(_TO_BYTE).encode("latin-1")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """One protobuf field: int as varint, float as 32 bit, text and messages by length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto (BPE, identity normalisation) for ``tokens`` in rank order.

    Ids are ranks. A piece of type UNKNOWN is required and comes last; it holds
    a blank, which no byte's character is, so that no text can contain it.
    """
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, to_letters(t)) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, "no piece") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def load_model(name: str, tokenizer_dir: str = TOKENIZER_DIR) -> bytes:
    """The serialised model of a rank file ``name``.tiktoken; made on the driver, a megabyte."""
    return serialise_model(read_ranks(os.path.join(tokenizer_dir, f"{name}.tiktoken")))


class Encoder:
    """Encodes and decodes with one serialised model; remembers pre-tokens."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.ids = _Memory(self._ids)
        self.counts = _Memory(lambda t: len(self._ids(t)) // 4)

    def _ids(self, token: str) -> bytes:
        return np.asarray(self.model.encode(to_letters(token.encode())), np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids; none for null and empty text."""
        return np.frombuffer(b"".join(map(self.ids.__getitem__, self.split(text or ""))), np.int32)

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.split(text or "")))

    def decode(self, ids) -> str:
        """The text of ``ids``; the inverse of ``encode``."""
        return from_letters("".join(self.model.id_to_piece([int(i) for i in ids]))).decode("utf-8", "replace")


class _Memory(dict):
    """Results by pre-token, of bounded size; long pre-tokens are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        value = self.make(token)
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_TOKENS:
                self.clear()
            self[token] = value
        return value


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(model) -> Encoder:
    """The encoder of a broadcast model, made once in a worker process."""
    if model.value is None:
        raise ValueError("no model")
    key = hash(model.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model.value)
    return _ENCODERS[key]


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most BATCH_BYTES of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > BATCH_BYTES and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield batch.slice(start)


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>): every row's text as ids, without special tokens.

    Null and empty texts give the empty list; blanks are text and give ids. One
    row out per row in, repeated rows included, null ids included; other columns
    are not read. Strings of special tokens in a text are ordinary text. No
    shuffle: a scan, an Arrow batch at a time.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(load_model(tokenizer, tokenizer_dir))
    rows = docs.select(docs[f"`{id_col}`"].alias(id_col), docs[f"`{text_col}`"].alias("text_to_encode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(model)
        for whole in batches:
            for batch in text_slices(whole, "text_to_encode"):
                parts = [b"".join(map(enc.ids.__getitem__, enc.split(t or ""))) for t in batch.column("text_to_encode").to_pylist()]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), ids], names=[id_col, "ids"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(
    encoded: DataFrame,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    tokenizer: str = "byte_bpe_50k",
    tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """(``id_col``, text): the inverse of ``encode_corpus``; null and empty lists give the empty text."""
    ship(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(load_model(tokenizer, tokenizer_dir))
    rows = encoded.select(encoded[f"`{id_col}`"].alias(id_col), encoded[f"`{ids_col}`"].alias("ids_to_decode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(model)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column("ids_to_decode").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, text string")
