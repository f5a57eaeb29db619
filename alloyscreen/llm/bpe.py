"""Byte-level BPE as a tree reduction over the halves of a text.

The ids of two neighbouring texts are joined by encoding anew a window around their border only. Which tokens outside the window
stay is provable: wherever a character that is no white space meets a blank or line break, every match of the pattern ends (no
alternative holds white space after anything else), whatever stands around. So tokens before the last such seam of the left
half and after the first such seam of the right half are those of the joined text. The window grows until it has both seams,
at worst to the whole of both halves. The join is associative, so any split gives the same ids."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from alloyscreen.llm.arrays import slices

_SEAM = re.compile(r"\S(?=[ \n])")
#: Characters of a text that is encoded at once, and tokens that are decoded at once.
LEAF = 1024


class TreeCodec:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.leaf = leaf

    def _drop(self, ids: list[int], n: int, step: int) -> int:
        """How many tokens from the end (step -1) or start (1) of ``ids`` make up ``n`` bytes."""
        k, at = 0, -1 if step < 0 else 0
        while n > 0:
            n -= len(self.bytes_of[ids[at]])
            at += step
            k += 1
        if n:
            raise AssertionError("a seam inside a token")
        return k

    def _left_seam(self, text: str, lo: int, mid: int) -> int:
        """The start of the window: the last seam of the left half."""
        width = 64
        while True:
            start = max(lo, mid - width)
            last = None
            for last in _SEAM.finditer(text, start, mid):  # noqa: B007
                pass
            if last is not None and last.end() < mid:
                return last.end()
            if start == lo:
                return lo
            width *= 2

    def _right_seam(self, text: str, mid: int, hi: int) -> int:
        """The end of the window: the first seam of the right half. The seam lies between two characters of that half."""
        width = 64
        while True:
            end = min(hi, mid + width)
            first = _SEAM.search(text, mid, end)
            if first is not None and first.end() < end:
                return first.end()
            if end == hi:
                return hi
            width *= 2

    def joined(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._left_seam(text, lo, mid), self._right_seam(text, mid, hi)
        window = self.plain.encode_ordinary(text[start:end])
        kept = len(left) - self._drop(left, len(text[start:mid].encode()), -1)
        gone = self._drop(right, len(text[mid:end].encode()), 1)
        return left[:kept] + window + right[gone:]

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.plain.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.joined(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def decode(self, ids: list[int], lo: int = 0, hi: int | None = None) -> bytes:
        """The bytes of the ids, concatenated up the tree."""
        hi = len(ids) if hi is None else hi
        if hi - lo <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids[lo:hi]])
        mid = (lo + hi) // 2
        return self.decode(ids, lo, mid) + self.decode(ids, mid, hi)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, leaf: int) -> TreeCodec:
    return TreeCodec(path, pattern, leaf)


def _own(df: DataFrame, id_column: str, column: str, name: str) -> tuple[DataFrame, str]:
    own = df.selectExpr(f"`{id_column}` AS doc_id", f"`{column}` AS {name}")
    return own, own.schema["doc_id"].dataType.simpleString()


def encoded(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, without special tokens. Each row is coded within its task; nothing
    is shuffled. A null text counts as empty and has no ids. Null ids and repeated rows keep their own row each; other
    columns are not looked at."""
    own, kind = _own(docs, id_column, text_column, "text")

    def run(batches):
        tree = codec(path, pattern, leaf)
        for batch in slices(batches, "text"):
            ids = [tree.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return own.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(coded: DataFrame, path: str, pattern: str, leaf: int = LEAF, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and data (binary) of every list of ids; null ids give no bytes."""
    own, kind = _own(coded, id_column, ids_column, "ids")

    def run(batches):
        tree = codec(path, pattern, leaf)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                data = [tree.decode(ids) if ids else b"" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return own.mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes
    that decoding those ids gives). Encoding and decoding share one pass, so that ids don't travel. Rows as in ``encoded``."""
    own, kind = _own(docs, id_column, text_column, "text")

    def run(batches):
        tree = codec(path, pattern, leaf)
        for batch in slices(batches, "text"):
            n, coded, data = [], [], []
            for text in batch.column("text").to_pylist():
                ids = tree.encode(text) if text else []
                n.append(len(ids))
                coded.append(hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
                data.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(data)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
