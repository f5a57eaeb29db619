"""Helpers for operators that work on whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``most`` bytes of ``column``; a longer value has a slice to itself."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        lengths = np.diff(np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1])
        part = np.cumsum(lengths, dtype=np.int64) // most
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()]
        for i, j in zip(starts, [*starts[1:], len(values)], strict=True):
            yield batch.slice(i, j - i)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


_rng = np.random.Generator(np.random.PCG64(20260))
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        factors = np.full(max(n, 1 << 20), base, np.uint64)
        factors[0] = 1
        _powers[name] = np.multiply.accumulate(factors)
    return _powers[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without space and the controls 9 to 13) of all texts, A-Z lowered if ``lower``,
    and the offsets of each text's words. A null text has no words.

    The bytes of all texts are hashed together: prefix sums of byte * step ** position give the hash of any range."""
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    size = len(raw)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < size)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[raw] * _power("up", _STEP, size), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _power("down", _BACK, size + 1)[starts])
    return hashes, np.searchsorted(starts, offsets)


_MIX = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text its sorted distinct shingles of ``width`` words; a text with fewer words has one of all its words."""
    n = len(hashes)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            rolled += hashes[j : n - width + 1 + j] * _MIX[j]
        rolled = mixed(rolled)
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= width:
            out.append(np.unique(rolled[s : e - width + 1]))
        elif e > s:
            out.append(mixed((hashes[s:e] * _MIX[: e - s]).sum(dtype=np.uint64, keepdims=True) + _MIX[width + e - s]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
