"""Token counts by whole tokens: most pre-tokens are one token, which a proof made beforehand shows; the rest is merged."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from alloyscreen.llm.arrays import slices
from alloyscreen.llm.chunk_tokens import REMEMBERED

#: Up to here all versions of Unicode agree on letters, numbers and white space.
_LATIN_END = "ɐ"
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_IRREGULAR = rf"\A | \z|{_SPACES} | {_SPACES}"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary of a byte-level tokenizer: printable Latin-1 stands for
    itself, the other bytes take the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str, pattern: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and, as the library itself shows by encoding them alone, one token.
    Bounded by the vocabulary."""
    tokenizer, letters, split = _tokenizer(path), byte_letters(), regex.compile(pattern)
    special = {t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    found = []
    for word in tokenizer.get_vocab():
        if word in special or any(c not in letters for c in word):
            continue
        try:
            text = bytes(letters[c] for c in word).decode()
        except UnicodeDecodeError:
            continue
        if max(text) < _LATIN_END and (m := split.match(text)) and m.end() == len(text):
            found.append(text)
    coded = tokenizer.encode_batch(found, add_special_tokens=False)
    return frozenset(t for t, e in zip(found, coded, strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens: pre-tokens that are whole tokens count one, the others are merged by the library, once each while
    they are remembered. Pieces with characters beyond Latin, or with special strings, go to the library as they are."""

    def __init__(self, path: str, pattern: str, whole: frozenset[str]):
        self.tokenizer, self.split, self.whole = _tokenizer(path), regex.compile(pattern).findall, whole
        told = json.loads(self.tokenizer.to_str())
        if told["normalizer"] or told["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": told["pre_tokenizer"].get("trim_offsets"), "use_regex": True}:
            raise ValueError("a byte-level tokenizer without normalisation is needed")
        self.special = [t["content"] for t in told["added_tokens"]]
        self.known: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece, encoded alone."""
        if len(self.merged) > REMEMBERED:
            self.merged = {}
        out, later, missing = [0] * len(pieces), [], {}
        for i, piece in enumerate(pieces):
            if not piece:
                continue
            if max(piece) >= _LATIN_END or any(s in piece for s in self.special):
                later.append(i)
                continue
            tokens = 0
            for p in self.split(piece):
                if p in self.whole:
                    tokens += 1
                elif (n := self.merged.get(p)) is not None:
                    tokens += n
                else:
                    missing.setdefault(p, []).append(i)
            out[i] = tokens
        for p, n in zip(missing, self._library(list(missing)), strict=True):
            self.merged[p] = n
            for i in missing[p]:
                out[i] += n
        for i, n in zip(later, self._library([pieces[i] for i in later]), strict=True):
            out[i] = n
        return out

    def remembered(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, pieces
        self.known.update(zip(new, self.count(new), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Where every space stands alone between characters that are no white space, each space begins a pre-token and
        the text falls into pieces of which Arrow finds the distinct ones. Other texts are split as a whole."""
        texts = texts.fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR))
        out = np.zeros(len(texts), np.int64)
        if odd.any():
            out[odd] = self.count(texts.filter(pa.array(odd)).to_pylist())
        even = texts.filter(pa.array(~odd))
        if len(even):
            lists = pc.split_pattern(even, " ")
            ends = np.asarray(lists.offsets, np.int64)
            ends = ends - ends[0]
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            each = self.remembered([" " + p for p in coded.dictionary.to_pylist()])[np.asarray(coded.indices, np.int64)]
            each[ends[:-1]] = self.remembered(flat.take(pa.array(ends[:-1])).to_pylist())
            totals = np.concatenate(([0], np.cumsum(each)))
            out[~odd] = totals[ends[1:]] - totals[ends[:-1]]
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str, pattern: str, whole: frozenset[str]) -> Counter:
    return Counter(path, pattern, whole)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, as the ``tokenizers`` library counts them without added tokens.

    One pass without shuffle. A null text counts as empty: no bytes, no tokens. Null ids and repeated rows keep their
    own row each; other columns are not looked at; an empty table gives an empty result."""
    proof = docs.sparkSession.sparkContext.broadcast(whole_tokens(path, pattern))

    def count(batches):
        counter = _counter(path, pattern, proof.value)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(pc.binary_length(texts.fill_null("")), pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    own = docs.selectExpr(f"`{id_column}` AS doc_id", f"`{text_column}` AS text")
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
