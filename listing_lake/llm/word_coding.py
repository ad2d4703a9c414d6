"""Subword ids of texts, word by word, with each distinct word of a batch coded once."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


# The pattern of a tokenizer that codes runs of letters apart, and ASCII bytes by kind: 1 for letters, 2 for marks.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KINDS = np.array([1 if chr(b).isalpha() else 2 if 32 < b < 127 and not chr(b).isdigit() and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As `split_words`, the words as an Arrow array."""
    split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = split.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    blank = pc.index(names, "").as_py()
    if blank >= 0:
        # Blanks at the ends of a text leave empty strings.
        real = codes != blank
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        codes = codes[real]
    return names, codes, starts


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the batch, the number of each word in order, and where each text's words begin (one more than texts)."""
    names, codes, starts = _split(texts)
    return names.to_pylist(), codes, starts


def split_marks(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words without the mark they end in after a letter, and that mark's code (0: none); words of ASCII letters in lower case."""
    names = names.cast(pa.large_string())
    sizes = pc.binary_length(names).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pc.cast(names, pa.large_binary()).to_pylist()) if names.offset else names.buffers()[2] or b"", np.uint8)
    long = np.flatnonzero(sizes > 1)
    marks = np.zeros(len(names), np.uint8)
    last = data[ends[long] - 1]
    marks[long] = np.where((KINDS[last] == 2) & (KINDS[data[ends[long] - 2]] == 1), last, 0)
    stems = pc.if_else(pa.array(marks > 0), pc.utf8_slice_codeunits(names, 0, -1), names)
    return pc.if_else(pc.ascii_is_alpha(stems), pc.ascii_lower(stems), stems), marks


def lowers_and_cuts(model) -> bool:
    """Whether the ids of a word are those of its parts by `split_marks`: the tokenizer lower-cases, then codes runs of letters apart."""
    rules = json.loads(model.to_str())
    normaliser, cutter = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    return (normaliser.get("normalizers") or [normaliser])[-1].get("type") == "Lowercase" and (cutter.get("pretokenizers") or [cutter])[0] == {
        "type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True}


def _taken(table: np.ndarray, begins: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and where each word's ids begin; those of name k lie from `begins[k]` on."""
    of_word = np.diff(begins)[codes]
    ends = np.cumsum(of_word)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(begins[codes] - (ends - of_word), of_word)
    return table[at], np.concatenate([[0], ends])


def gather(pieces: list[bytes], codes: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and where each word's ids begin (one more than words)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // np.dtype(dtype).itemsize
    return _taken(np.frombuffer(b"".join(pieces), dtype), np.concatenate([[0], np.cumsum(lengths)]), codes)


class WordCoder:
    """Ids of words as packed integers; remembers a bounded number of short words.

    With `by_parts`, `code` looks words up and codes them by the parts of `split_marks`.
    """

    def __init__(
        self, encode: Callable[[list[str]], list[list[int]]], dtype=np.uint16, entries: int = 400_000, longest: int = 64, by_parts: bool = False,
    ):
        self.encode, self.dtype, self.entries, self.longest, self.by_parts = encode, dtype, entries, longest, by_parts
        self.known: dict[str, bytes] = {}

    def pieces(self, names: list[str]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, names))
        if None in found:
            missing = [k for k, ids in enumerate(found) if ids is None]
            new, code = [names[k] for k in missing], np.dtype(self.dtype).char
            fresh = [array(code, ids).tobytes() for ids in self.encode(new)]
            for k, ids in zip(missing, fresh):
                found[k] = ids
            if len(known) + len(fresh) > self.entries:
                known.clear()
            known.update((w, ids) for w, ids in zip(new, fresh) if len(w) <= self.longest)
        return found

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin (one more than texts)."""
        names, codes, starts = _split(texts)
        if self.by_parts:
            ids, begins = _taken(*self._of_parts(names), codes)
        else:
            ids, begins = gather(self.pieces(names.to_pylist()), codes, self.dtype)
        return ids, begins[starts]

    def _of_parts(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all names one after the other, and where each begins (one more than names)."""
        stems, marks = split_marks(names)
        coded = stems.dictionary_encode()
        used = np.unique(marks[marks > 0])
        pieces = self.pieces(coded.dictionary.to_pylist())
        first = len(pieces)
        parts = np.empty((len(names), 2), np.int64)
        parts[:, 0] = coded.indices.to_numpy(zero_copy_only=False)
        parts[:, 1] = first + np.searchsorted(used, marks, side="right")
        ids, begins = gather([*pieces, b"", *self.pieces(list(map(chr, used.tolist())))], parts.reshape(-1), self.dtype)
        return ids, begins[::2]


_CODERS: dict = {}


def tokenizer_coder(path: str, before: str = "", ordinary: bool = False) -> tuple[WordCoder, int]:
    """A coder of a tokenizer file and the size of its vocabulary; a reused Python worker keeps the words it has seen.

    `before` is put in front of each word; `ordinary` treats the strings of special tokens as plain text.
    """
    if (path, before, ordinary) not in _CODERS:
        import os

        # Workers share the cores among themselves.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = ordinary
        coder = WordCoder(
            lambda words: [e.ids for e in model.encode_batch_fast([before + w for w in words], add_special_tokens=False)], entries=700_000,
            by_parts=not before and lowers_and_cuts(model))
        _CODERS[path, before, ordinary] = coder, model.get_vocab_size()
    return _CODERS[path, before, ordinary]
