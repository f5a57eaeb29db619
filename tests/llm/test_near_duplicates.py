"""Sketches, tiles and components of the near-duplicate search against all pairs."""

import itertools

import numpy as np
import pytest

from alloyscreen.llm import near_duplicates


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def texts():
    """Families: chains of copies that each differ a little from the last, copies around the threshold, and strangers that share most words."""
    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(0, 5000)}"
    out, base = {}, [word() for _ in range(150)]
    for _ in range(12):
        own = [word() for _ in range(int(rng.integers(60, 250)))]
        for _ in range(10):
            own = list(own)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(0, len(own)))] = word()
            out[len(out)] = " ".join(own)
    for k in range(40):
        own = list(base)
        for i in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            own[i] = word()
        out[len(out)] = " ".join(own)
    for _ in range(15):
        out[len(out)] = out[int(rng.integers(0, 120))]
    return out


@pytest.mark.parametrize("tile", [1024, 5])
def test_components_equal_all_pairs(spark, texts, monkeypatch, tile):
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(rows).collect()}
    assert got == brute(texts)


def test_pairs_below_the_threshold_make_no_rows(spark, monkeypatch):
    """Copies of one text with a few words changed share keys; most pairs lie just below the threshold."""
    rng = np.random.default_rng(3)
    base, texts = [f"w{k}" for k in range(200)], {}
    for i in range(120):
        own = list(base)
        for k in rng.choice(200, 3 + i % 2, replace=False):
            own[k] = f"x{i}y{k}"
        texts[i] = " ".join(own)
    real, rows = near_duplicates.written, {}

    def counted(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_duplicates, "written", counted)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == brute(texts)
    pairs = {name: n for name, n in rows.items() if "pairs" in name or "links" in name}
    assert sum(pairs.values()) < 3 * len(texts), pairs


def test_texts_may_be_shuffled(spark, texts, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HELD_IDS", 0)
    rows = spark.createDataFrame(list(texts.items())[:60], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(rows).collect()}
    assert got == brute(dict(list(texts.items())[:60]))


def test_sketches_follow_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.85, 0.95):
        shared = int(round(2000 * similarity / (1 + similarity) * 2 / 2))
        pool = rng.integers(0, 1 << 62, 2 * 2000, dtype=np.uint64)
        a, b = pool[:1000], np.concatenate([pool[: shared // 1][: int(1000 * 2 * similarity / (1 + similarity))], pool[3000 : 4000 - int(1000 * 2 * similarity / (1 + similarity))]])
        x, y = (near_duplicates.sketch(np.unique(s)).view(np.uint64)[None] for s in (a, b))
        found = near_duplicates.unlike(x, y)[0]
        assert abs(found - near_duplicates.SKETCH * 0.75 * (1 - similarity)) < 5 * (near_duplicates.SKETCH * 0.25) ** 0.5
        assert (found <= near_duplicates.most_unlike(85)) == (similarity >= 0.85)
