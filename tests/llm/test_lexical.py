"""Ranked search against scoring every document by itself, on nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from alloyscreen.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n long, bag string, m int, h long, item_id long, score long, members string, rank int, term int, share int, number int"
ITEMS = "item_id long, text string, doc_id long, score int, item string"


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, most=20):
    bags = [(d, collections.Counter(cut(t))) for d, t in docs]
    held = sum(1 for _, b in bags if b)
    length = sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for d, b in bags:
            if not b:
                continue
            m = 100 - 25 + (25 * sum(b.values()) * held) // length
            score = sum(math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t in cut(text) if b[t])
            scored += [(-score, d is None, d, score)] if score > 0 else []
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=str)


def table(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "x", 2, 3, 4, 5, "y", 6, 7, 8, 9) for d in docs], SCHEMA), spark.createDataFrame([(*i, 1, 2, "z") for i in items], ITEMS)


@pytest.fixture(scope="module")
def case():
    pick = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "日本", "A1", "a1", "É"]
    docs = [(i, " ".join(pick.choices(words, k=pick.choice([1, 3, 12, 40]))) + ".") for i in range(300)]
    docs += [(900 - i, docs[7][1]) for i in range(150)] + [(None, docs[7][1]), (4, None), (5, ""), (6, " .\n-"), (None, "w1 w2"), (7, "W3 " * 20000), docs[9], docs[9]]
    items = [(1, "w1 w2 w3 w3 É"), (1, "w1 w2 w3 w3 É"), (1, "w40"), (2, docs[7][1]), (None, "A1, a1! été"), (3, None), (4, "absent words"), (5, ""), (6, "日本 w5")]
    return docs, items


def test_equals_scoring_every_document(spark, case):
    docs, items = case
    got = lexical.ranked(*table(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_several_passes_and_small_slices(spark, case, monkeypatch):
    docs, items = case
    monkeypatch.setattr(lexical, "CELLS", 64)
    got = lexical.ranked(*table(spark, docs, items), most=3, pass_chars=40, pass_items=2).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 3)


def test_classes_hold_equal_bags(spark, case):
    docs, items = case
    frame, _ = table(spark, docs, items)
    found = lexical.bags(frame, ["w1", "w2", "w3"], "doc_id", "text").selectExpr("*", "75 + n AS m")
    rows = lexical.classes(found, 20).collect()
    keys = [(r.m, tuple(map(tuple, r.bag))) for r in rows]
    assert len(set(keys)) == len(keys) and all(len(r.members) <= 20 for r in rows)
    assert all([tuple(m) for m in r.members] == sorted(((bool(m[0]), m[1]) for m in r.members), key=lambda m: (m[0], m[1] or 0)) for r in rows)


def test_terms_of_sliced_arrays():
    texts = pa.array(["a b", None, "C-d É", "", "x"]).slice(1, 4)
    flat, offsets = lexical.terms(texts)
    assert flat.to_pylist() == ["c", "d", "É", "x"] and offsets.tolist() == [0, 0, 3, 3, 4]


def test_scores_stay_whole_numbers():
    postings = lexical.Postings([["a"] * 9], ["a"], {0: 1_000_003})
    got = postings.scores(np.array([75]), np.array([0, 1]), np.array([0]), np.array([3]))
    assert got.tolist() == [[9 * 1_000_003 * (3_000_000_000 // (3000 + 12 * 75))]]


def test_empty_tables(spark, case):
    docs, items = case
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert lexical.ranked(*table(spark, d, i)).collect() == []
