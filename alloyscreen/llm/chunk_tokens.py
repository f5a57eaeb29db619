"""Tokens of texts through the ``tokenizers`` library, each distinct piece of text encoded once per batch at most.

The tokenizer's pre-tokens never cross white space, so a text's ids are those of its runs between ASCII white space, one
after another. Arrow finds the distinct runs of a batch, the library encodes those that the worker has not met, and numpy puts
the ids together. ``encoder(path)`` checks the premise on the tokenizer's own description."""

from __future__ import annotations

import functools
import json
import os
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from alloyscreen.llm.arrays import gather

#: Entries that a worker remembers for sure, of runs and of pieces each; up to twice as many in all. Only time depends on it.
REMEMBERED = 400_000
_LATIN_END = "ɐ"


class Recent(dict):
    """A dictionary of two generations. When the young one is full it becomes the old one, which is forgotten; what is asked for meanwhile
    moves to the young one, so that frequent entries stay."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is not None:
            self[key] = found
        return found


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        splits = json.dumps(told["pre_tokenizer"])
        if "\\\\s" not in splits or '"Removed"' not in splits or told["post_processor"] or told["truncation"] or told["padding"]:
            raise ValueError("a tokenizer that drops white space and treats what lies between it alone is needed")
        self.lowers = '"Lowercase"' in json.dumps(told["normalizer"])
        self.known, self.parts = Recent(REMEMBERED), Recent(REMEMBERED)

    def _parts(self, run: str) -> tuple[str, ...]:
        """Pieces with the ids of ``run``: a Latin letter ends its pre-token before ASCII punctuation, and lower case
        comes to the same after the tokenizer's own lowering. Runs that may hold special strings stay as they are."""
        if "<" in run or max(run) >= _LATIN_END:
            return (run,)
        if self.lowers:
            run = run.lower()
        core = run.rstrip(string.punctuation)
        return (core, run[len(core) :]) if core and len(core) < len(run) and core[-1].isalpha() else (run,)

    def _encode(self, runs: list[str]) -> list[bytes]:
        self.known.turn()
        self.parts.turn()
        self.known[""] = b""
        blobs = list(map(self.known.__getitem__, runs))
        missing = [i for i, b in enumerate(blobs) if b is None]
        split = [self._parts(runs[i]) for i in missing]
        new = list({p for ps in split for p in ps if self.parts[p] is None})
        for i in range(0, len(new), 4096):
            own = new[i : i + 4096]
            for p, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                self.parts[p] = array("I", e.ids).tobytes()
        for i, ps in zip(missing, split, strict=True):
            blobs[i] = self.known[runs[i]] = b"".join([self.parts[p] for p in ps])
        return blobs

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) without special tokens of the tokenizer's own, and each text's number of ids."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = np.asarray(lists.offsets, np.int64)
        coded = lists.flatten().dictionary_encode()
        blobs = self._encode(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        at = np.asarray(coded.indices, np.int64)
        lengths = sizes[at]
        ids = gather(flat, (np.cumsum(sizes) - sizes)[at], lengths)
        totals = np.concatenate(([0], np.cumsum(lengths)))
        ends = ends - ends[0]
        return ids, totals[ends[1:]] - totals[ends[:-1]]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
