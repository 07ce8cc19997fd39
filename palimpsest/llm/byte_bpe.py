"""Byte-level BPE by a sentencepiece model that is serialised here from a vocabulary of ranks.

Each byte b becomes the character U+0100 + b, so every token is a string of such characters. The
model holds them as pieces with score -rank under the identity normalisation, which makes
sentencepiece merge the pair of lowest rank first, leftmost on ties: the order of the byte-level
library. A text is cut by the vocabulary's pattern; each pre-token is encoded by itself. A
pre-token that is a token takes its id at once, as the library does. Decoding maps ids back to bytes.

At scale: one pass without a shuffle. A worker holds the vocabulary and a bounded cache of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import base
from palimpsest.llm.base import slices

#: Characters of pre-tokens that a worker remembers; beyond that it starts afresh.
CACHE = 3_000_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _mapped(token: bytes) -> str:
    return "".join(map(_CHARS.__getitem__, token))


_CHARS = [chr(0x100 + b) for b in range(256)]


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model (its protocol-buffer form) in which each token's id is its rank."""
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must count up from 0")
    out = [_field(1, _field(1, _mapped(t).encode()) + _field(2, float(-r)) + _field(3, 1)) for t, r in pieces]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Codec:
    """Encodes to ids as little-endian 32-bit bytes and decodes those."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.vocab = ranks, sorted(ranks, key=ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.cut = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """New pre-tokens of all texts go to the model in one call, as a call costs far more than a token."""
        cut, cache = [self.cut(t) for t in texts], self.cache
        seen = set().union(*cut)
        if self.held > CACHE:
            cache.clear()
            self.held = 0
        hard = []
        for t in [t for t in seen if t not in cache]:
            self.held += len(t) + 8
            raw = t.encode()
            if (r := self.ranks.get(raw)) is not None:
                cache[t] = r.to_bytes(4, "little")
            else:
                hard.append((t, _mapped(raw)))
        if hard:
            for (t, _), ids in zip(hard, self.model.encode([m for _, m in hard], out_type=int, num_threads=1), strict=True):
                cache[t] = struct.pack(f"<{len(ids)}I", *ids)
        return (b"".join(map(cache.__getitem__, tokens)) for tokens in cut)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, memoryview(ids).cast("I")))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), decoded (binary) of each row. A null text counts as empty; special
    tokens are never made. ``path`` names a file of ranks that every executor's installation has."""
    return docs.select("doc_id", "text").mapInArrow(base.tidied(_Encode(path, pattern, False)), f"doc_id {base.id_type(docs)}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; ids don't leave the worker."""
    return docs.select("doc_id", "text").mapInArrow(base.tidied(_Encode(path, pattern, True)), f"doc_id {base.id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Encode:
    def __init__(self, path: str, pattern: str, digest: bool):
        self.path, self.pattern, self.digest = path, pattern, digest

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(self.path, self.pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch, 1):
                ids = list(codec.encode_all([t or "" for t in part.column(1).to_pylist()]))
                if self.digest:
                    cols = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([sha(x) for x in ids], pa.string()), "decoded_sha256": pa.array([sha(codec.decode(x)) for x in ids], pa.string())}
                else:
                    cols = {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([codec.decode(x) for x in ids], pa.binary())}
                yield pa.RecordBatch.from_arrays([part.column(0), *cols.values()], ["doc_id", *cols])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLE: dict[str, str] = {}
