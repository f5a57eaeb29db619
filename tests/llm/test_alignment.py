"""Alignment of two tokenizers against whole texts through their libraries, on nulls, empty and long texts, repeated rows and clashing names."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from alloyscreen.llm import alignment
from alloyscreen.llm.token_counts import byte_letters

PATHS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two  spaces\t tab \n\n", "The quick brown fox; jumps.", "The quick brown fox; jumps.", "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, "日本語 テキスト。 ok\n\nfine　 wide",
    "Ünïcode é́ combining à b", "It's we'll 'RE don't!!  ", "tail ", "▁ piece blank", "a  b  c　  d", "\x00 nul \x1c \x85 nel", "emoji 👩‍👩‍👧 🇩🇪 end", "word " * 4000, "ﬁ Ａ ①", "﻿bom",
]
SCHEMA = "doc_id long, text string, place long, a int, b int, n long, count long, best string, pairs string, doc int"


def brute(docs):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters, names = byte_letters(), {i: t for t, i in a.get_vocab().items()}
    told, counts = [], collections.Counter()
    for d, t in docs:
        t = t or ""
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xs = [bytes(letters[c] for c in names[i]) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            told.append((d, 0, 0, [], ""))
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 100 else _sums(parts)
        ex, ey = ends(xs), ends(ys)
        both = sorted(set(ex) & set(ey))
        pairs = [(x[ex.index(e)], y[ey.index(e)]) for e in both] if len(both) < 200 else list(zip(*[[i for i, e in zip(ids, es) if e in set_] for ids, es, set_ in ((x, ex, set(both)), (y, ey, set(both)))]))
        groups, low = [], 0
        gx, gy = _cut(x, ex, both), _cut(y, ey, both)
        groups = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in zip(gx, gy, strict=True))
        counts.update(pairs)
        told.append((d, len(x), len(y), pairs, hashlib.sha256(groups.encode()).hexdigest()))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted(((d, n, k, len(p), len(p), sum(counts[q] == best[q[1]] for q in p), sum(counts[q] for q in p), h) for d, n, k, p, h in told), key=str)


def _sums(parts):
    out, total = [], 0
    for p in parts:
        total += len(p)
        out.append(total)
    return out


def _cut(ids, ends, both):
    out, own, stops = [], [], set(both)
    for i, e in zip(ids, ends, strict=True):
        own.append(i)
        if e in stops:
            out.append(own)
            own = []
    return out


def table(spark, docs):
    return spark.createDataFrame([(*d, 1, 2, 3, 4, 5, "x", "y", 6) for d in docs], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    pick = random.Random(3)
    odd = [" ", "  ", "\n", " ", "　", "é", "語", "a", "The", "<0x0A>", "▁", "'s", "12", "!?", "́", "👩"]
    more = ["".join(pick.choices(odd, k=pick.randint(1, 30))) for _ in range(300)]
    rows = [(i if i != 4 else None, t) for i, t in enumerate([*TEXTS, *more])]
    return [*rows, rows[5], rows[16]]


@pytest.mark.parametrize("frequent", [1, 40, 1 << 17])
def test_equals_the_libraries(spark, docs, frequent):
    got = alignment.aligned(table(spark, docs), *PATHS, tokenizers.PATTERN, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_stretches_give_back_the_texts():
    texts = pa.array([" a b", " ", " é  語 x　 y", " z"], pa.large_string()).slice(1, 3)
    cut, counts = alignment.stretches(texts)
    assert cut.to_pylist() == [" ", " é", "  語", " x　 y", " z"] and counts.tolist() == [1, 3, 1]


def test_real_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    assert sorted(map(tuple, alignment.aligned(table(spark, rows), *PATHS, tokenizers.PATTERN).collect()), key=str) == brute(rows)


def test_merges_by_rank_are_the_tokenizers_own():
    tool = alignment._aligner(*PATHS, tokenizers.PATTERN)
    assert tool.ranked is not None
    pick = random.Random(9)
    parts = ["aaa", "ab", "The", "é", "ÀÉÎ", "'s", "'", "''", "1", "22", ".", "--", "\n", "\t", "x\ny", "=", "don't", "ing", "ZZ", "ſ", "ø"]
    new = list({" " + "".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(4000)})
    texts = pa.array(new, pa.large_string())
    ends, told = (np.frombuffer(texts.buffers()[i], kind) for i, kind in ((1, np.int64), (2, np.uint8)))
    ids, sizes = tool._encode_a(new, told[: ends[len(new)]], ends[: len(new) + 1])
    upto = np.concatenate(([0], np.cumsum(sizes)))
    assert [ids[i:j].tolist() for i, j in zip(upto[:-1], upto[1:])] == [tool.a.encode(s, add_special_tokens=False).ids for s in new]


def test_runs_of_documents(monkeypatch, spark, docs):
    monkeypatch.setattr(alignment, "TOKENS", 7)
    tool = alignment._aligner(*PATHS, tokenizers.PATTERN)
    a, b = tool.ids(pa.array([t for _, t in docs]))
    sizes = [t.size for t in tool.bytes]
    whole = alignment.align(a, b, *sizes)
    parts = [alignment.align(a.slice(i, j - i), b.slice(i, j - i), *sizes) for i, j in alignment._stretches_of(np.diff(np.asarray(a.offsets)), 7)]
    assert [h for p in parts for h in p["groups_sha256"].to_pylist()] == whole["groups_sha256"].to_pylist()
    norm = lambda ps: [sorted((x["a"], x["b"], x["n"]) for x in p) for p in ps]
    assert norm(p for q in parts for p in q["pairs"].to_pylist()) == norm(whole["pairs"].to_pylist())


def test_empty_table(spark):
    assert alignment.aligned(table(spark, []), *PATHS, tokenizers.PATTERN).collect() == []
