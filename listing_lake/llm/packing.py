"""Vector bin packing of content rows into training sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from listing_lake.llm.common import text

END_ID = 2


class _Packer:
    """Places examples of one task under limits on tokens, segments and loss-bearing tokens.

    An example is (row, ids, first loss-bearing token). What is left of it is one item; items of equal (tokens, loss) are one
    class, so that a choice looks at the classes only; where every token bears loss, it is the longest class that fits, looked up by length.
    """

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first_id: int):
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.next_id = first_id
        self.items: dict[tuple[int, int], list] = {}
        self.tokens = 0
        # Classes in slots, where each lies, and their tokens and loss; a class that goes leaves its slot to the last one.
        self._keys: list[tuple[int, int]] = []
        self._slots: dict[tuple[int, int], int] = {}
        self._sizes = np.zeros((2, 64))
        # Classes by length, and how many have tokens without loss.
        self._lengths: list[int] = []
        self._mixed = 0

    def _loss(self, example, start: int, length: int) -> int:
        prompt = example[2]
        return max(0, start + length - max(prompt, start))

    def _fitting(self, example, start: int, room: int, loss_room: int) -> int:
        """Longest piece from `start` within the room."""
        left = len(example[1]) - start
        return max(0, min(left, room, max(0, example[2] - start) + loss_room))

    def _add(self, example, start: int) -> None:
        left = len(example[1]) - start
        if left:
            key = (left, self._loss(example, start, left))
            if key not in self.items:
                self.items[key], self._slots[key] = [], len(self._keys)
                if len(self._keys) == self._sizes.shape[1]:
                    self._sizes = np.hstack([self._sizes, np.zeros_like(self._sizes)])
                self._sizes[:, len(self._keys)] = key
                self._keys.append(key)
                self._mixed += key[0] != key[1]
                insort(self._lengths, left)
            self.items[key].append((example, start))

    def _take(self, key):
        of_class = self.items[key]
        item = of_class.pop()
        if not of_class:
            del self.items[key]
            slot, moved = self._slots.pop(key), self._keys.pop()
            if moved != key:
                self._keys[slot], self._slots[moved], self._sizes[:, slot] = moved, slot, moved
            self._mixed -= key[0] != key[1]
            del self._lengths[bisect_right(self._lengths, key[0]) - 1]
        return item

    def add(self, example) -> list:
        """Takes an example; pieces as long as a whole sequence leave at once."""
        start, out = 0, []
        self.tokens += len(example[1])
        while len(example[1]) - start >= self.capacity and self._loss(example, start, self.capacity) <= self.max_loss:
            out.append((example, start, self.capacity, self.next_id, 0))
            self.next_id += 1
            start += self.capacity
            self.tokens -= self.capacity
        self._add(example, start)
        return out

    def _best(self, room: int, loss_room: int, fits: bool):
        """The class with the greatest dot product of its demand and the room, among those that fit or among those a piece of which fits."""
        if not self._mixed:
            # Of equal demands the product grows with the length.
            at = bisect_right(self._lengths, min(room, loss_room)) if fits else len(self._lengths) if loss_room else 0
            return (self._lengths[at - 1],) * 2 if at else None
        tokens, loss = self._sizes[:, :len(self._keys)]
        # Any piece is one segment, which adds the same to every product.
        value = tokens * (room / self.capacity**2) + loss * (loss_room / self.max_loss**2)
        if fits:
            value = np.where((tokens <= room) & (loss <= loss_room), value, -1.0)
        elif not loss_room:
            value = np.where(tokens > loss, value, -1.0)
        best = int(np.argmax(value)) if len(value) else None
        return self._keys[best] if best is not None and value[best] >= 0 else None

    def pack(self, last: bool) -> list:
        """Fills sequences while there are tokens for whole ones; at the end also the rest, by falling powers of two."""
        out = []
        while self.tokens >= self.capacity or last and self.tokens:
            target = min(self.capacity, 1 << (self.tokens.bit_length() - 1))
            room, segments, loss_room, offset = target, self.max_segments, self.max_loss, 0
            while room and segments and self.items:
                key = self._best(room, loss_room, fits=True) or self._best(room, loss_room, fits=False)
                if key is None:
                    break
                example, start = self._take(key)
                length = self._fitting(example, start, room, loss_room)
                out.append((example, start, length, self.next_id, offset))
                room, segments, offset = room - length, segments - 1, offset + length
                loss_room -= self._loss(example, start, length)
                self.tokens -= length
                self._add(example, start + length)
            self.next_id += 1
        return out


def with_prompts(content: DataFrame) -> DataFrame:
    """The rows with the first of several lines as `title` and the lines after it as `summary`; a text of one line has no prompt.

    The line end between them is no word, so the ids of both are those of the text.
    """
    whole, end = text(), F.instr(text(), "\n")
    return content.withColumns({"title": F.substr(whole, F.lit(1), end - 1), "summary": F.when(end > 0, F.substr(whole, end + 1)).otherwise(whole)})


def pack_content(
    content: DataFrame, tokenizer: str, capacity: int = 4096, max_segments: int = 256, max_loss: int = 4096, buffer_tokens: int = 1 << 21,
) -> DataFrame:
    """Packs content rows as instruction examples into sequences of at most `capacity` tokens.

    An example is the ids of `title` (the prompt, without loss; may be missing as a column), the ids of `summary` and the end
    id, which bear loss. `tokenizer` is a path that every executor can read; its ids are below 65,536 and do not depend on
    neighbouring words. Each task reads its rows in order into a buffer of about `buffer_tokens` and fills one sequence after the
    other: the class of pieces with the greatest dot product of (tokens, segments, loss-bearing tokens) and the room left goes
    in; when none fits, one is cut to fill the room, after the loss limit one with tokens of its prompt left. What remains goes
    on to the next buffer. The last tokens of a task form sequences of falling powers of two, which need no padding. The limits hold
    at once; a sequence that meets the segment limit first, or the loss limit when no prompt is left, is padded.

    Sequence ids are unique, in ranges of the task's number, and a task that runs again on the same input gives the same pieces; nothing is
    shuffled. Returns a row per piece: `content_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`,
    `n_loss`. A null or empty row is its end id only, repeated rows are packed each, longer texts are cut, no rows give no pieces.
    """
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    has_title = any(c.lower() == "title" for c in content.columns)
    title = F.coalesce(F.col("title").cast("string"), F.lit("")) if has_title else F.lit("")
    rows = content.select("content_id", title.alias("title"), F.coalesce(F.col("summary").cast("string"), F.lit("")).alias("summary"))
    id_field = rows.schema["content_id"]
    schema = StructType([
        StructField("content_id", id_field.dataType), StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids_crc32", LongType()), StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()),
        StructField("offset", LongType()), StructField("n_loss", IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from listing_lake.llm.word_coding import tokenizer_coder

        coder, _ = tokenizer_coder(tokenizer)
        packer = _Packer(capacity, max_segments, max_loss, TaskContext.get().partitionId() << 36)
        out_type = None

        def emit(pieces):
            cut = [example[1][start:start + length] for example, start, length, _, _ in pieces]
            return pa.RecordBatch.from_arrays([
                pa.array([p[0][0] for p in pieces], out_type),
                pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in cut], pa.int64()),
                pa.array([len(p[0][1]) for p in pieces], pa.int64()),
                pa.array([p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([packer._loss(p[0], p[1], p[2]) for p in pieces], pa.int32()),
            ], names=schema.names)

        for batch in batches:
            out_type = batch.column(0).type
            prompts, prompt_at = coder.code(batch.column(1))
            ids, at = coder.code(batch.column(2))
            pieces = []
            for k, row in enumerate(batch.column(0).to_pylist()):
                prompt = prompts[prompt_at[k]:prompt_at[k + 1]]
                whole = np.concatenate([prompt, ids[at[k]:at[k + 1]], np.array([END_ID], np.uint16)])
                pieces += packer.add((row, whole, len(prompt)))
                if packer.tokens >= buffer_tokens:
                    pieces += packer.pack(last=False)
            if pieces:
                yield emit(pieces)
        if packer.tokens:
            yield emit(packer.pack(last=True))

    return rows.mapInArrow(run, schema)
