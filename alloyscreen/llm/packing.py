"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each task packs its pieces as they come, with a bounded number of open sequences: a bitset with one bit for each amount of free
space tells the fullest sequence that still has room, in one machine operation on a long integer. A piece that fits nowhere
opens a sequence; when more are open than the bound, the fullest closes. Nothing but one task's open sequences is held."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen.llm.arrays import slices
from alloyscreen.llm.chunk_tokens import encoder
from alloyscreen.llm.folders import written

#: Sequences that a task may have open.
OPEN = 512
#: Tokens that one packing task gets, about 32,000 sequences: its open sequences then weigh little.
TASK_TOKENS = 1 << 26


class BestFit:
    """Bounded-space online best fit. ``place`` returns the sequence's number and the offset in it."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.bits, self.opened, self.count = 0, 0, 0
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        roomy = self.bits >> length
        if roomy:
            space = length + (roomy & -roomy).bit_length() - 1
            number, used = self.free[space].pop()
            self.opened -= 1
            if not self.free[space]:
                self.bits ^= 1 << space
        else:
            number, used = self.count, 0
            self.count += 1
        space = self.capacity - used - length
        if space:
            self.free[space].append((number, used + length))
            self.bits |= 1 << space
            self.opened += 1
            if self.opened > self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.free[fullest].pop(0)
                self.opened -= 1
                if not self.free[fullest]:
                    self.bits ^= 1 << fullest
        return number, used


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every whole text (null: empty) encoded without special tokens, then
    ``end_id``; only longer documents are cut, into pieces of ``capacity`` tokens, of which the last may be shorter."""
    own = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    def run(batches):
        coder = encoder(path)
        for batch in slices(batches, "text"):
            ids, lengths = coder.ids(batch.column("text"))
            at = np.cumsum(lengths) - lengths
            found = []
            for doc, s, n in zip(batch.column("doc_id").to_pylist(), at.tolist(), lengths.tolist(), strict=True):
                whole = np.append(ids[s : s + n], np.uint32(end_id)).astype("<u4")
                for k, i in enumerate(range(0, n + 1, capacity)):
                    part = whole[i : i + capacity]
                    found.append((doc, k, i, len(part), zlib.crc32(part)))
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], _PIECE)

    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, most: int = OPEN, task_tokens: int = TASK_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset: pieces of a sequence follow one another without gap from 0.

    Texts stay where they are read; only the narrow pieces are written to the shared folder and dealt to packing tasks,
    in an order that the hash of id and piece gives, which mixes long and short ones. Sequence numbers are unique, not dense.
    An empty text has one piece, the end id alone. Null ids and repeated rows are packed like any other row; other columns
    are not looked at; an empty table gives no piece."""
    table = written(pieces(docs, path, capacity, end_id, id_column, text_column), "pieces")
    tokens = table.agg(F.sum("length")).first()[0] or 0
    tasks = -(-tokens // task_tokens) or 1

    def run(batches):
        from pyspark import TaskContext

        task, bins = TaskContext.get().partitionId(), BestFit(capacity, most)
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([(task << 40) + p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                [*_PIECE, "sequence_id", "offset"],
            )

    mixed = table.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    return mixed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
