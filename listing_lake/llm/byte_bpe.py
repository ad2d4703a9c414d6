"""Byte-level BPE ids by a sentencepiece model made from a rank vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from listing_lake.llm.common import pack


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of their ranks, which have no gap."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def model_of(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: the unknown piece, then every token with its bytes as characters, scored by its negative rank.

    The normaliser is the identity: no map, no dummy prefix, blanks neither removed nor escaped.
    """
    to_character = byte_characters()
    piece = lambda name, score, kind: _field(1, _field(1, name.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind))
    pieces = [piece("<unk>", 0.0, 2)]
    pieces += [piece("".join(map(to_character.__getitem__, token)), -float(rank), 1) for rank, token in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(
        _field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes texts to ids and ids to bytes, by the ranks of a vocabulary file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str, entries: int = 300_000, longest: int = 64):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(self.tokens))
        self.find = regex.compile(pattern).findall
        # A pre-token never reaches from one of these pieces into the next.
        self.segments = regex.compile(r"\s*\S+|\s+").findall
        self.to_character = {b: c for b, c in enumerate(byte_characters())}
        # A pre-token that is itself a token needs no merges.
        self.whole = {token: [rank] for rank, token in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}
        self.entries, self.longest = entries, longest

    def _code(self, segments: list[str]) -> list[bytes]:
        """Packed ids of each segment."""
        parts, todo, places = [], [], []
        for segment in segments:
            found = []
            for pre_token in self.find(segment):
                raw = pre_token.encode()
                ids = self.whole.get(raw)
                if ids is None:
                    places.append((len(parts), len(found)))
                    todo.append(raw.decode("latin-1").translate(self.to_character))
                found.append(ids)
            parts.append(found)
        for (i, j), ids in zip(places, self.model.encode(todo, out_type=int, num_threads=1) if todo else ()):
            parts[i][j] = [x - 1 for x in ids]
        return [np.array([x for ids in found for x in ids], "<u4").tobytes() for found in parts]

    def encode(self, value: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        known, segments = self.known, self.segments(value)
        try:
            return b"".join([known[s] for s in segments])
        except KeyError:
            new = list(dict.fromkeys(s for s in segments if s not in known))
        fresh = dict(zip(new, self._code(new)))
        out = b"".join([known[s] if s in known else fresh[s] for s in segments])
        if len(known) + len(fresh) > self.entries:
            known.clear()
        known.update((s, ids) for s, ids in fresh.items() if len(s) <= self.longest)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_content(content: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Adds the ids of each summary, and what they decode to.

    `vocabulary` is a rank file that every executor can read, `pattern` splits a text into the pre-tokens that are encoded
    apart; no special tokens. Adds `n_tokens`, `ids` (little-endian unsigned 32-bit integers) and `decoded` (bytes), row by
    row in Arrow batches. A null or empty summary has no ids; texts are encoded whole, whatever their length; repeated rows are
    encoded each; no rows give no rows.
    """
    packed, others = pack(content, "n_tokens", "ids", "decoded")
    return _in_batches(packed, vocabulary, pattern, _whole).select("content_id", "summary", *others, "n_tokens", "ids", "decoded")


def digest_content(content: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """As `encode_content`, with SHA-256 digests `ids_sha256` and `decoded_sha256` in place of the ids and the bytes."""
    packed, _ = pack(content)
    return _in_batches(packed.select("content_id", "summary"), vocabulary, pattern, _digests).select(
        "content_id", "n_tokens", "ids_sha256", "decoded_sha256")


_whole = ("binary", ("ids", "decoded"), lambda value: value)
_digests = ("string", ("ids_sha256", "decoded_sha256"), lambda value: hashlib.sha256(value).hexdigest())


def _in_batches(packed: DataFrame, vocabulary: str, pattern: str, form) -> DataFrame:
    kind, names, shape = form
    keep = [c for c in packed.columns if kind == "binary" or c != "summary"]
    out = StructType([packed.schema[c] for c in keep]).add("n_tokens", "long").add(names[0], kind).add(names[1], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(vocabulary, pattern)
        arrow = pa.binary() if kind == "binary" else pa.string()
        for batch in batches:
            sizes, first, second = [], [], []
            for value in batch.column("summary").to_pylist():
                ids = coder.encode(value)
                sizes.append(len(ids) // 4)
                first.append(shape(ids))
                second.append(shape(coder.decode(ids)))
            columns = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(first, arrow), pa.array(second, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", *names])

    return packed.mapInArrow(run, out)
