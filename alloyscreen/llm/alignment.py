"""Two tokenizers side by side: which tokens of one end where tokens of the other end, and how often corpus-wide.

Inside a task all work is on Arrow arrays: token lists are flattened with the index of their document, byte lengths become ends by
cumulative sums within a document, a hash join on (document, end) finds the common ends, and ``group_by`` counts the id pairs of each
document. Spark adds these counts up and brings the sums back to the documents."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alloyscreen.llm.arrays import gather, slices
from alloyscreen.llm.folders import written
from alloyscreen.llm.token_counts import byte_letters

#: Stretches of text that a worker remembers the tokens of; beyond it, it starts anew. Only time depends on it.
REMEMBERED = 1_000_000
#: Tokens of A that are joined at a time, so that the join's table stays in the processor's cache.
TOKENS = 120_000
#: Id pairs that make up at least this share of all links go to every task: at most as many pairs as the number says.
FREQUENT = 1 << 17
_BLANK = "▁"
_OUT = "place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:bigint>>"


#: Bytes of blanks, line feeds, tabs, printable ASCII and the letters from U+00C0 to U+023F.
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
_NOTHING = pa.scalar("", pa.large_string())


def _joined(first, second) -> pa.LargeStringArray:
    return pc.binary_join_element_wise(first, second, _NOTHING)


class _Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, table: dict[int, bytes]):
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self._start = np.cumsum(self.size) - self.size
        self._flat = np.frombuffer(b"".join(parts), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self._flat, self._start[ids], self.size[ids])


class _Lists:
    """Lists of ids one after another, to which more are added."""

    def __init__(self):
        self.flat, self.size, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat, self.size = np.concatenate((self.flat, ids)), np.concatenate((self.size, sizes))


class Aligner:
    """Token ids of texts by a byte-level BPE tokenizer (A) and a BPE piece model with byte fallback (B).

    Neither joins anything across the place before a blank that follows a character other than white space: A splits there, and no
    piece of B has a blank after another character. So texts are cut there and each distinct stretch is encoded once while it is
    remembered. The premises are checked on the tokenizers themselves."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        told = json.loads(self.a.to_str())
        before = told["pre_tokenizer"] or {}
        if told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or told["truncation"] or told["padding"]:
            raise ValueError("A: a byte-level tokenizer without normalisation is needed")
        letters = byte_letters()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces) or self.b.encode(" a  b ", out_type=str) != self._by_stretch(" a  b "):
            raise ValueError("B: pieces that begin with their blanks, and a model that keeps all blanks, are needed")
        self.bytes = (
            _Bytes({i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in letters for c in t)}),
            _Bytes({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)}),
        )
        self.lone = self.b.piece_to_id(_BLANK)
        self.ranked = self._ranked(told, letters, pattern)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lists, self.same = (_Lists(), _Lists()), np.zeros(0, bool)

    def _by_stretch(self, text: str) -> list[str]:
        """The pieces of ``text``, put together from those of its stretches."""
        at = [i for i in range(1, len(text)) if text[i] == " " and text[i - 1] != " "]
        full = [(" " + text)[i:j] for i, j in zip([0, *[i + 1 for i in at]], [*[i + 1 for i in at], len(text) + 1], strict=True)]
        return [p for s in full for p in (self.b.encode(s[1:], out_type=str) if s != " " else [_BLANK])]

    def _ranked(self, told: dict, letters: dict[str, int], pattern: str):
        """The merges of A by rank of the merged bytes, as ``tiktoken`` does them; None unless that gives the same tokens.

        It does if the ids of merged tokens rise with their merges and each token, merged by itself, comes to itself: merges
        inside the bytes of a token, while none has crossed its ends, are those that it has by itself, so that two neighbours whose
        bytes are a token's are the very pair that its merge names."""
        import tiktoken

        vocabulary = told["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        words = [w for w in vocabulary if all(c in letters for c in w)]
        alone = all(len(t := self.a.model.tokenize(w)) == 1 and t[0].value == w for w in words)
        if not alone or made != sorted(set(made)) or len(made) + 256 != len(words) or (made and max(vocabulary[c] for c in letters) >= made[0]):
            return None
        return tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks={bytes(letters[c] for c in w): vocabulary[w] for w in words}, special_tokens={})

    def _encode_a(self, new: list[str], told: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of all stretches and the number of each. Those of plain characters, about which all versions of Unicode agree, that end in no white
        space are merged by rank in one text; the others one by one."""
        plain = np.minimum.reduceat(_PLAIN[told], ends[:-1]) & (told[ends[1:] - 1] > 0x20) if self.ranked else np.zeros(len(new), bool)
        sizes, parts = np.zeros(len(new), np.int64), []
        if plain.any():
            ids = np.array(self.ranked.encode_ordinary("".join(itertools.compress(new, plain))), np.int32)
            upto = np.searchsorted(np.cumsum(self.bytes[0].size[ids]), np.cumsum(np.diff(ends)[plain]), side="right")
            sizes[plain] = np.diff(np.concatenate(([0], upto)))
            parts.append(ids)
        rest = list(itertools.compress(new, ~plain))
        if rest:
            coded = [e.ids for i in range(0, len(rest), 4096) for e in self.a.encode_batch_fast(rest[i : i + 4096], add_special_tokens=False)]
            sizes[~plain] = [len(c) for c in coded]
            parts.append(np.array([t for c in coded for t in c], np.int32))
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        at = np.cumsum(sizes[order]) - sizes[order]
        start = np.zeros(len(new), np.int64)
        start[order] = at
        return gather(np.concatenate(parts), start, sizes), sizes

    def _encode_b(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        b = [ids for i in range(0, len(new), 4096) for ids in self.b.encode([s[1:] for s in new[i : i + 4096]], num_threads=1)]
        if " " in new:  # B adds a blank only to a text that is not empty
            b[new.index(" ")] = [self.lone]
        sizes = np.fromiter(map(len, b), np.int64, len(b))
        return np.fromiter(itertools.chain.from_iterable(b), np.int32, int(sizes.sum())), sizes

    def places(self, stretches: list[str]) -> np.ndarray:
        """Where the ids of each stretch lie in ``lists``; ``same`` tells whether both give back its bytes. Each begins with a blank."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [s for s in stretches if s not in self.known]
        if new:
            texts = pa.array(new, pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(new) + 1]
            told = np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]]
            same = np.ones(len(new), bool)
            for kind, lists, (ids, sizes) in zip(self.bytes, self.lists, (self._encode_a(new, told, ends), self._encode_b(new)), strict=True):
                upto = np.concatenate(([0], np.cumsum(sizes)))
                back = np.concatenate(([0], np.cumsum(kind.size[ids])))[upto]
                if not (np.array_equal(back, ends) and np.array_equal(kind.of(ids), told)):
                    same &= [kind.of(ids[i:j]).tobytes() == s.encode() for i, j, s in zip(upto[:-1], upto[1:], new, strict=True)]
                lists.add(ids, sizes)
            self.same = np.concatenate((self.same, same))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))

    def ids(self, texts: pa.Array) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The ids of A and of B of all texts, a list each; empty for a text that is null, empty or not given back by both."""
        spaced = _joined(pa.scalar(" ", pa.large_string()), texts.fill_null("").cast(pa.large_string()))
        cut, per_text = stretches(spaced)
        coded = cut.dictionary_encode()
        at = self.places(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        row = np.repeat(np.arange(len(texts)), per_text)
        good = np.asarray(pc.binary_length(spaced)) > 1
        good[row[~self.same[at]]] = False
        at, row = at[good[row]], row[good[row]]
        out = []
        for lists in self.lists:
            sizes = lists.size[at]
            counts = np.bincount(row, weights=sizes, minlength=len(texts)).astype(np.int64)
            out.append(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts)))), pa.array(gather(lists.flat, lists.start[at], sizes))))
        return out[0], out[1]


def stretches(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The texts cut before each blank that follows a character which surely is no white space, and the number of stretches of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    before = lambda n: np.concatenate((np.zeros(n, np.uint8), raw))[: len(raw)]
    one, two, three = before(1), before(2), before(3)
    tail = lambda x: (x & 0xC0) == 0x80
    solid = ((one > 0x20) & (one < 0x7F)) | (tail(one) & (two >= 0xC3) & (two <= 0xDF)) | (tail(one) & tail(two) & (three >= 0xE4) & (three <= 0xEC))
    first = (raw == 0x20) & solid
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(first)
    bounds = pa.py_buffer(np.concatenate((starts, [len(raw)])).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(np.ascontiguousarray(raw))), np.diff(np.searchsorted(starts, offsets))


def _stretches_of(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of documents with about ``most`` tokens; a longer document has one to itself."""
    ends = np.cumsum(sizes)
    starts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist()]
    return list(zip(starts, [*starts[1:], len(sizes)], strict=True))


def _ended(lists: pa.LargeListArray, sizes: np.ndarray, name: str) -> pa.Table:
    """doc, doc_end (the document above, the token's end in its bytes below), at (the end in the bytes of all) and id of each token, in order."""
    parent, ids = pc.list_parent_indices(lists), pc.list_flatten(lists)
    at = np.concatenate(([0], np.asarray(pc.cumulative_sum(pc.take(pa.array(sizes), ids)))))
    offsets = np.asarray(lists.offsets)
    base = pc.take(pa.array(at[offsets[:-1] - offsets[0]]), parent)
    at = pa.array(at[1:])
    return pa.table({"doc": parent, "doc_end": pc.add(pc.shift_left(parent, pa.scalar(40, pa.int64())), pc.subtract(at, base)), "at": at, name: ids})


def _texts_of(a: pa.Table, b: pa.Table, common: np.ndarray, n_docs: int) -> list[str]:
    """Per document its groups as text, ``a1,a2|b1;a3|b2,b3``; ``common`` holds the ends of the links in the bytes of all."""
    ka, kb = np.asarray(a["at"]), np.asarray(b["at"])
    shared = np.zeros(1 + (int(ka[-1]) if len(ka) else 0), bool)
    shared[common] = True
    last_a, last_b = shared[ka], shared[kb]
    at_a, at_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to the end of each group
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(ka)) + np.concatenate(([0], at_b))[group_a]
    place_b = np.arange(len(kb)) + at_a[group_b]
    n = len(ka) + len(kb)
    ids, mark = np.zeros(n, np.int32), np.zeros(n, np.int8)
    ids[place_a], ids[place_b] = np.asarray(a["a"]), np.asarray(b["b"])
    mark[place_a], mark[place_b] = last_a, 2 * last_b
    ends = np.cumsum(np.bincount(np.asarray(a["doc"]), minlength=n_docs) + np.bincount(np.asarray(b["doc"]), minlength=n_docs))
    mark[ends[ends > 0] - 1] = 3
    marks = pc.take(pa.array([",", "|", ";", ""], pa.large_string()), pa.array(mark))
    told = _joined(pc.cast(pa.array(ids), pa.large_string()), marks)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), told), _NOTHING).to_pylist()


def align(a_lists: pa.LargeListArray, b_lists: pa.LargeListArray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
    """Per document n_a, n_b, n_links, groups_sha256 and pairs, the linked id pairs with their counts. ``a_sizes`` and ``b_sizes``: bytes by id."""
    n = len(a_lists)
    a, b = _ended(a_lists, a_sizes, "a"), _ended(b_lists, b_sizes, "b")
    links = a.join(b.select(["doc_end", "b"]), keys="doc_end", join_type="inner", use_threads=False)
    pairs = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    doc = np.asarray(pairs["doc"])
    order = np.argsort(doc, kind="stable")
    column = lambda c: pa.array(np.asarray(pairs[c])[order], pa.int64() if c == "count_all" else pa.int32())
    bounds = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
    held = pa.StructArray.from_arrays([column("a"), column("b"), column("count_all")], ["a", "b", "n"])
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in _texts_of(a, b, np.asarray(links["at"]), n)]
    return {
        "n_a": np.diff(np.asarray(a_lists.offsets)), "n_b": np.diff(np.asarray(b_lists.offsets)), "n_links": np.bincount(np.asarray(links["doc"]), minlength=n).astype(np.int64),
        "groups_sha256": pa.array(digests, pa.string()), "pairs": pa.ListArray.from_arrays(pa.array(bounds), held),
    }


@functools.lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    return Aligner(a_path, b_path, pattern)


def links(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """place (a number of the row), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs: the id pairs linked in the text, with counts."""

    def run(batches):
        tool = _aligner(a_path, b_path, pattern)
        for batch in slices(batches, "text"):
            a, b = tool.ids(batch.column("text"))
            for i, j in _stretches_of(np.diff(np.asarray(a.offsets)), TOKENS):
                found = align(a.slice(i, j - i), b.slice(i, j - i), *[t.size for t in tool.bytes])
                count = pa.array(found["n_links"])  # a group ends with each link
                yield pa.RecordBatch.from_arrays(
                    [batch.column("place").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(found["n_a"]), pa.array(found["n_b"]), count, count, found["groups_sha256"], found["pairs"]],
                    ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
                )

    own = docs.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    return own.mapInArrow(run, _OUT)


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, count (links corpus-wide) and best (whether b has no pair that counts more)."""
    counts = found.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    most = F.max("count").over(Window.partitionBy("b"))  # a row per id of A at most
    return counts.select("a", "b", "count", (F.col("count") == most).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, frequent: int = FREQUENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of ``docs``.

    Links are the ends that tokens of both share; n_best counts those whose id pair is among the most frequent of its B id, count_sum
    adds up the counts of their pairs. A null or empty text, and one that the tokens do not give back byte for byte, has no tokens: zeros and an empty
    digest. Repeated rows and null ids keep their own row each; other columns are not looked at.

    Pairs with at least 1 / ``frequent`` of all links, at most ``frequent`` of them, are broadcast. Each other pair has fewer links than
    that share, so the join that brings its count back has no large key."""
    found = written(links(docs, a_path, b_path, pattern, id_column, text_column), "links")
    counts = written(pair_counts(found), "pair-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.where(F.col("count") * frequent >= total)
    pairs = found.select("place", F.explode("pairs").alias("p")).select("place", "p.a", "p.b", "p.n")
    gained = lambda df: df.groupBy("place").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    frequent_part = gained(pairs.join(F.broadcast(often), ["a", "b"]))
    rare = pairs.join(F.broadcast(often.select("a", "b")), ["a", "b"], "left_anti").join(counts.where(F.col("count") * frequent < total), ["a", "b"])
    sums = frequent_part.unionByName(gained(rare)).groupBy("place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("pairs").join(sums, "place", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
