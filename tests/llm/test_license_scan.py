"""License spans against a walk over the words, on nulls, empty and long texts, ties, repeated rows and clashing names."""

import re

import pytest

from alloyscreen.llm import license_scan

MIT = license_scan.NOTICES[0][0]
APACHE = license_scan.NOTICES[1][0]
TEXTS = [
    None, "", " . ", "MIT", "Released under the MIT License.", "Licensed under CC BY-NC 4.0. Again: cc by nc, CC-BY-NC", "Licensed under the Apache License, Version 2.0", MIT,
    MIT.replace("of charge,", "of any charge at all,").replace("merge, ", ""), " ".join(MIT.split()[:20]), "x " * 5000 + APACHE, "cc by nc " * 3000, "under the mit licenseé under the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "under the\nMIT\n\nlicense, under the Apache License version 2", "日本語 under the mit license 日本語",
]
SCHEMA = "doc_id long, text string, place string, template int, h long, ws string, label string, size int"


def rows(*texts):
    return [(i if i != 3 else None, t, "p", 1, 2, "w", "l", 3) for i, t in enumerate(texts)]


def brute(text):
    ws = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    at = [p[0] for p in places]
    return len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({p[1] for p in places}))


@pytest.fixture(scope="module")
def found(spark):
    table = spark.createDataFrame([*rows(*TEXTS), rows(*TEXTS)[7]], SCHEMA)
    return license_scan.licenses(table).collect()


def test_phrases_equal_a_walk_over_the_words(found):
    key = lambda t: tuple(str(x) for x in t)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=key)
    want = sorted(((i if i != 3 else None, *brute(t)) for i, t in [*enumerate(TEXTS), (7, TEXTS[7])]), key=key)
    assert got == want


def test_notices_with_changed_words_are_found(found):
    by_id = {r.doc_id: r for r in found}
    assert by_id[7].labels == "mit" and by_id[7].score == 1.0 and by_id[7].base_labels == ""
    assert by_id[8].labels == "mit" and 0.9 < by_id[8].score < 1.0
    assert by_id[9].labels == "" and by_id[9].score == 0.0
    assert by_id[10].labels == "apache-2" and by_id[13].labels == "gpl"
    assert by_id[11].n_base == 3000 and by_id[11].last_word == 8997
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


def test_span_places(spark):
    table = spark.createDataFrame(rows("one two three " + MIT.replace("of charge,", "of any charge at all,")), SCHEMA)
    span = license_scan.spans(table).where("label = 'mit' AND NOT phrase").orderBy("covered", ascending=False).first()
    assert (span.start, span.end) == (3, 3 + len(re.findall(license_scan.WORD, MIT.lower())) + 3)


def test_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    frame = license_scan.licenses(empty)
    assert frame.count() == 0 and frame.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") <= 1
