"""Byte-level BPE by sentencepiece, with a model written directly from a rank file.

The model's pieces are the vocabulary's byte strings, each byte mapped to one printable character;
a piece's score is its negative rank, so sentencepiece merges the pair of the lowest rank first, as
byte-level BPE does. The normaliser is the identity, without dummy prefix or white space handling.
Pre-tokens are encoded one by one; one that is in the vocabulary as a whole is its own id, as in
tiktoken. Decoding maps each id's piece back to its bytes.

Edge cases: a null text is empty and has no ids. Very long texts are encoded in slices of
pre-tokens. Repeated rows repeat. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm import pretokens
from codeloom.llm.common import rows_of, tidied


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a serialised message: bytes and messages, integers, 32-bit floats."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1 where it is printable, else from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(x) for x, _ in sorted(pairs, key=lambda p: int(p[1]))]


def model(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: ids are ranks, the unknown piece comes last."""
    at = byte_characters()
    out = bytearray()
    for rank, p in enumerate(pieces):
        out += _field(1, _field(1, "".join(at[b] for b in p).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    trainer += b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.rank = {p: k for k, p in enumerate(self.pieces)}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model(self.pieces))
        self.map = dict(enumerate(byte_characters()))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.encoder = pretokens.Encoder(self.encode)

    def encode(self, text: str) -> list[int]:
        """The ids of a text's pre-tokens, one after the other."""
        out: list[int] = []
        for p in self.split(text):
            raw = p.encode("utf-8", "surrogatepass")
            rank = self.rank.get(raw)
            if rank is None:
                out += self.sp.encode(raw.decode("latin-1").translate(self.map))
            else:
                out.append(rank)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


@tidied
def _digests(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.binary()] * with_ids
    for b in rows_of(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = c.encoder.ids(text or "")
            data = c.decode(ids)
            row = (doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest())
            rows.append(row + ((ids.astype(np.int32), data) if with_ids else ()))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of the ids and of the decoded bytes (, ids, decoded)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(partial(_digests, path=path, with_ids=with_ids), schema)
