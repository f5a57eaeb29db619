"""Token files: segments of concatenated ids whose document boundaries are Elias-Fano coded.

A file set is a folder of Parquet files written and read by Spark, so that it can lie in any store. Each row is a segment:
``part`` and ``segment`` (their order is that of the documents), ``first_id`` and ``last_id`` (the least and greatest known id), ``doc_ids`` (64-bit little-endian) and ``doc_known`` (a bit
each, for null ids), ``n_docs``, ``n_ids``, ``before`` (ids of the part's earlier segments), ``ids`` (16 bits an id where all are below 65,536, else 32) and the boundaries: ``low_bits``, ``low``
(that many bits of each document's end), ``high`` (the rest in unary: bit ``(end >> low_bits) + k`` is set for document k) and
``samples`` (32-bit place of every 64th set bit of ``high``). An end costs about 2 + log2(ids per document) bits."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloyscreen.llm.arrays import slices
from alloyscreen.llm.chunk_tokens import encoder

_SAMPLE = 64
#: Ids and documents after which a segment ends; a longer document has one to itself.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 14
SCHEMA = (
    "part int, segment int, first_id long, last_id long, doc_ids binary, doc_known binary, n_docs int, n_ids long, before long, ids binary, low_bits int, low binary, high binary, samples binary"
)


class EliasFano:
    """Non-decreasing numbers in near-minimal space with ``select``."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self._low = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little")[: count * low_bits].reshape(count, low_bits)
        self._high = np.frombuffer(high, np.uint8)
        self._samples = np.frombuffer(samples, "<u4")

    @staticmethod
    def parts(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """low_bits, low, high and samples for ``ends``."""
        n, top = len(ends), int(ends[-1]) if len(ends) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((ends[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        places = (ends >> bits) + np.arange(n)
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x.reshape(-1), bitorder="little").tobytes()
        return bits, pack(low), pack(high), places[::_SAMPLE].astype("<u4").tobytes()

    def select(self, k: int) -> int:
        """The number at place ``k``: from the nearest sample on, set bits are counted byte by byte."""
        at, left = int(self._samples[k // _SAMPLE]), k % _SAMPLE
        byte, first = at // 8, at % 8
        while True:
            bits = np.flatnonzero(np.unpackbits(self._high[byte : byte + 1], bitorder="little")[first:])
            if left < len(bits):
                place = byte * 8 + first + int(bits[left])
                break
            left, byte, first = left - len(bits), byte + 1, 0
        low = int((self._low[k].astype(np.int64) << np.arange(self.low_bits)).sum())
        return ((place - k) << self.low_bits) + low

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.count]
        low = (self._low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return ((places - np.arange(self.count)) << self.low_bits) + low


def segment(part: int, number: int, before: int, doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> tuple:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = [d for d in doc_ids if d is not None]
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (
        part, number, min(named, default=None), max(named, default=None), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known, bitorder="little").tobytes(), len(doc_ids), len(ids), before,
        bytes([2 if narrow else 4]) + ids.astype("<u2" if narrow else "<u4").tobytes(), *EliasFano.parts(ends),
    )


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes every whole text (null: empty) without special tokens, appends ``end_id`` and writes the documents in
    ascending order of their integer id (nulls first, repeated ids by the hash of their text) as segments under ``folder``.

    One shuffle, by ranges of ids. Every part is written by one task, whose number is the part; a task that runs again
    writes the same. Extra columns are not looked at, an empty table gives an empty file set."""
    own = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    order = ["doc_id", F.xxhash64("text")]

    def run(batches):
        from pyspark import TaskContext

        coder, part, number, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        names, chunks, ends, size = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def close():
            rows = [segment(part, number, before, names, np.concatenate(chunks), np.array(ends, np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)

        for batch in slices(batches, "text"):
            ids, lengths = coder.ids(batch.column("text"))
            at = np.cumsum(lengths) - lengths
            for doc, s, n in zip(batch.column("doc_id").to_pylist(), at.tolist(), lengths.tolist(), strict=True):
                if names and (size + n > SEGMENT_IDS or len(names) >= SEGMENT_DOCS):
                    yield close()
                    names, chunks, ends, size, number, before = [], [], [], 0, number + 1, before + size
                names.append(doc)
                chunks += [ids[s : s + n], end]
                size += n + 1
                ends.append(size)
        if names:
            yield close()

    sorted_docs = own.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_docs.mapInArrow(run, SCHEMA).write.parquet(folder)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document of a file set.

    No segment is shuffled: each holds its start in its part, and the parts' starts, one number for each writing task, go
    through the driver."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    begin = np.cumsum([0, *[n for _, n in totals]]).tolist()
    begins = spark.createDataFrame([(part, at) for (part, _), at in zip(totals, begin, strict=False)], "part int, begin long")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['ids'][0]}", offset=1).astype("<u4")
                bounds = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                ends = bounds.all()
                begin = np.concatenate(([0], ends[:-1]))
                known = np.unpackbits(np.frombuffer(row["doc_known"], np.uint8), bitorder="little")[: row["n_docs"]] == 0
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=known), pa.array(begin + row["begin"] + row["before"]), pa.array(ends - begin), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.join(F.broadcast(begins), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document(spark: SparkSession, folder: str, doc_id: int) -> list[int]:
    """The ids of one document (of repeated ids the first), by the select structure of its segment; none if it is not there.

    Only segments whose range of ids holds it are read, where they lie; its ids alone come back."""

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known = np.unpackbits(np.frombuffer(row["doc_known"], np.uint8), bitorder="little")[: row["n_docs"]] == 1
                found = np.flatnonzero((np.frombuffer(row["doc_ids"], "<i8") == doc_id) & known)
                if len(found):
                    k = int(found[0])
                    bounds = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                    ids = np.frombuffer(row["ids"], f"<u{row['ids'][0]}", offset=1)[bounds.select(k - 1) if k else 0 : bounds.select(k)]
                    yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "segment": pa.array([row["segment"]], pa.int32()), "found": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    held = spark.read.schema(SCHEMA).parquet(folder).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    first = held.mapInArrow(pick, "part int, segment int, found array<bigint>").orderBy("part", "segment").first()
    return first["found"] if first else []
