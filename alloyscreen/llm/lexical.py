"""Ranked search by bags: documents with the same counts of the items' terms and the same length factor are one class.

Texts are read once and reduced to their bag: the items' terms in them with counts. Equal bags, found by a hash and verified as whole
values, form classes; a class is scored once, and its documents follow from its members in ascending id."""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alloyscreen.llm.arrays import slices
from alloyscreen.llm.folders import written

#: Characters and items searched for in one pass over the documents; more items take more passes. Only time and memory depend on them.
PASS_CHARS, PASS_ITEMS = 4 << 20, 4096
#: Shares into which the members of a class, and the candidates of an item, are cut before they meet.
SHARES = 16
#: Cells of the table of scores that a task fills at a time.
CELLS = 1 << 22
_NO_ITEMS = "item_id long, rank int, doc_id long, score long"

_byte = np.arange(256, dtype=np.uint8)
_TERM = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
_TERM[(_byte < 48) | ((_byte > 57) & (_byte < 65)) | ((_byte > 90) & (_byte < 97)) | ((_byte > 122) & (_byte < 128))] = 32


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after another, and the offsets of each text's. Terms are runs of digits, letters A-Z (lowered), a-z
    and characters beyond ASCII; a null text has none."""
    texts = texts.fill_null("").cast(pa.string())
    offsets = np.asarray(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_TERM[raw]))
    lists = pc.ascii_split_whitespace(plain)
    flat, ends = lists.flatten(), np.asarray(lists.offsets, np.int64)
    solid = np.asarray(pc.binary_length(flat)) > 0
    counted = np.concatenate(([0], np.cumsum(solid)))
    return flat.filter(pa.array(solid)), counted[ends - ends[0]]


def bags(docs: DataFrame, vocabulary: list[str], id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (terms of the whole text) and bag, the terms of ``vocabulary`` (by place there) with their counts, ascending."""
    known = pa.array(vocabulary, pa.string())

    def run(batches):
        for batch in slices(batches, "text"):
            flat, offsets = terms(batch.column("text"))
            at = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            key, tf = np.unique((row * len(vocabulary) + at)[at >= 0], return_counts=True)
            row, term = np.divmod(key, max(len(vocabulary), 1))
            pair = pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(tf, pa.int64())], ["term", "tf"])
            bag = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32()), pair)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), bag], ["doc_id", "n", "bag"])

    own = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, bag array<struct<term:int,tf:bigint>>")


def _first(df: DataFrame, keys: list[str], share: Column, order: list, most: int) -> DataFrame:
    """The ``most`` first rows of each key by ``order``: first within each input partition and share of a key, then within the key."""
    number = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    df = df.withColumn("share", share).withColumn("number", number([*keys, "share"])).where(F.col("number") <= most)
    return df.withColumn("number", number(keys)).where(F.col("number") <= most).drop("share", "number")


def classes(found: DataFrame, most: int) -> DataFrame:
    """h, m, bag and members of each class: up to ``most`` (unknown, doc_id), ascending, null ids last. Documents without any of the terms are in none.

    h decides where rows meet; m and bag are compared as a whole."""
    own = found.where(F.size("bag") > 0).select(F.xxhash64("m", "bag").alias("h"), "m", "bag", F.col("doc_id").isNull().alias("unknown"), "doc_id")
    kept = _first(own, ["h", "m", "bag"], F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)), ["unknown", "doc_id"], most)
    return kept.groupBy("h", "m", "bag").agg(F.array_sort(F.collect_list(F.struct("unknown", "doc_id"))).alias("members"))


class Postings:
    """Items by term: for each term the items that hold it, and how often."""

    def __init__(self, items: list[list[str]], vocabulary: list[str], weights: dict[int, int]):
        place = {t: i for i, t in enumerate(vocabulary)}
        held = sorted((place[t], i, n) for i, ts in enumerate(items) for t, n in Counter(ts).items())
        term, self.item, self.times = (np.array(x, np.int64) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        self.n_items = len(items)
        self.first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.weight = np.array([weights.get(i, 0) for i in range(len(vocabulary))], np.int64)

    def scores(self, m: np.ndarray, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Score of each class (row) for each item (column)."""
        row = np.repeat(np.arange(len(m)), np.diff(offsets))
        value = self.weight[term] * ((1000000000 * tf) // (1000 * tf + 12 * m[row]))
        out = np.zeros(len(m) * self.n_items, np.int64)
        size = self.first[term + 1] - self.first[term]
        ends = np.cumsum(size)
        for i, j in _runs(size, CELLS):
            at = np.arange(ends[j - 1] - (ends[i] - size[i])) + np.repeat(self.first[term[i:j]] - (ends[i:j] - size[i:j] - (ends[i] - size[i])), size[i:j])
            np.add.at(out, np.repeat(row[i:j] * self.n_items, size[i:j]) + self.item[at], np.repeat(value[i:j], size[i:j]) * self.times[at])
        return out.reshape(len(m), self.n_items)


def _runs(size: np.ndarray, most: int):
    """Stretches whose sizes sum to about ``most``."""
    part = np.cumsum(size) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()] if len(size) else []
    return zip(starts, [*starts[1:], len(size)], strict=True) if starts else ()


class Best:
    """The ``most`` best classes of each item so far, by score, then by their first member."""

    def __init__(self, n_items: int, most: int):
        self.most, self.floor = most, np.ones(n_items, np.int64)
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting, self.limit = 0, 2 * n_items * most

    def add(self, scores: np.ndarray, members: pa.Array) -> None:
        row, item = np.nonzero(scores >= self.floor)
        self.kept.append((item, scores[row, item], members.take(pa.array(row))))
        self.waiting += len(row)
        if self.waiting > self.limit:
            self.cut()

    def cut(self) -> None:
        if not self.kept:
            return
        item, score = (np.concatenate([k[i] for k in self.kept]) for i in (0, 1))
        members = pa.concat_arrays([k[2] for k in self.kept])
        first = pc.list_element(members, 0)
        unknown, doc = (first.field(i).fill_null(none).to_numpy(zero_copy_only=False) for i, none in ((0, False), (1, 0)))
        order = np.lexsort((doc, unknown, -score, item))
        item = item[order]
        number = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, number = (x[number < self.most] for x in (order, item, number))
        score = score[order]
        last = number == self.most - 1
        self.floor[item[last]] = score[last]
        self.kept, self.waiting = [(item, score, members.take(pa.array(order)))], len(item)


_MEMBERS = pa.list_(pa.struct([("unknown", pa.bool_()), ("doc_id", pa.int64())]))


def _candidates(classed: DataFrame, postings: Postings, most: int) -> DataFrame:
    """item, score and members of the best classes that each task has met, ``most`` an item."""

    def run(batches):
        best = Best(postings.n_items, most)
        rows = max(1, CELLS // max(postings.n_items, 1))
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                bag, m = part.column("bag"), part.column("m").to_numpy()
                offsets = np.asarray(bag.offsets, np.int64)
                pairs = bag.flatten()
                term, tf = (np.asarray(pairs.field(k)).astype(np.int64) for k in (0, 1))
                best.add(postings.scores(m, offsets - offsets[0], term, tf), part.column("members").cast(_MEMBERS))
        best.cut()
        for item, score, members in best.kept:
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), members], ["item", "score", "members"])

    return classed.select("m", "bag", "members").mapInArrow(run, "item int, score long, members array<struct<unknown:boolean,doc_id:bigint>>")


def _pass(docs: DataFrame, items: DataFrame, most: int, id_column: str, text_column: str) -> DataFrame | None:
    """The result for a bounded set of items (item_id, text)."""
    spark = docs.sparkSession
    rows = items.collect()
    own = [terms(pa.array([r["text"]], pa.string()))[0].to_pylist() for r in rows]
    vocabulary = sorted({t for ts in own for t in ts})
    found = written(bags(docs, vocabulary, id_column, text_column), "bags")
    held, length = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not held:
        return None
    counts = found.select(F.explode("bag").alias("b")).groupBy("b.term").agg(F.count("*").alias("df"))
    weights = counts.select("term", F.floor(1000 * F.log((2.0 * held + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    postings = Postings(own, vocabulary, dict(weights.collect()))  # as many as the vocabulary of a pass at most
    classed = written(classes(found.withColumn("m", F.expr(f"75 + (25L * n * {held}L) div {length}L")), most), "classes")
    best = _candidates(classed, postings, most)
    first = F.col("members")[0]
    best = _first(best, ["item"], F.pmod(F.xxhash64("score", "members"), F.lit(SHARES)), [F.desc("score"), first["unknown"], first["doc_id"]], most)
    ranked = best.select("item", "score", F.explode("members").alias("d")).select("item", "score", "d.unknown", "d.doc_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "unknown", "doc_id"))).where(F.col("rank") <= most)
    kind = items.schema["item_id"].dataType.simpleString()
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(
    docs: DataFrame, items: DataFrame, most: int = 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", pass_chars: int = PASS_CHARS, pass_items: int = PASS_ITEMS
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` best documents of each item with a score above 0, equal scores by ascending doc_id, null ids last.

    Equal item rows (id and text) are one item; different texts under one id are items of their own. A null text has no terms, an item
    without terms no result. Each document row counts by itself, repeated ones too; other columns are not looked at. Members of a class
    beyond the ``most`` first cannot be in a result, nor can classes beyond the ``most`` best of an item. Items are searched in passes of bounded
    size, each over all documents."""
    asked = items.select(F.col(f"`{item_column}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct()
    chars, count = asked.agg(F.sum(F.char_length("text")), F.count("*")).first()
    passes = max(-(-(chars or 0) // pass_chars), -(-count // pass_items), 1)
    parts = [asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) for i in range(passes)]
    found = [r for r in (_pass(docs, p, most, id_column, text_column) for p in parts) if r is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], _NO_ITEMS.replace("item_id long", f"item_id {asked.schema['item_id'].dataType.simpleString()}"))
    return functools.reduce(DataFrame.unionByName, found)


def oracle(most: int = 20) -> str:
    """The same in SQL for DuckDB, every document scored by itself."""
    cut = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH item AS (SELECT row_number() OVER () AS item, item_id, {cut} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item, t, count(*) AS times FROM (SELECT item, unnest(ts) AS t FROM item) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS place, doc_id, {cut} AS ts FROM documents),
size AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
tf AS (SELECT place, t, count(*) AS tf FROM (SELECT place, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY t),
factor AS (SELECT place, doc_id, 100 - 25 + ((25 * len(ts) * n) // l) AS m FROM d, size),
scored AS (
  SELECT item, place, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN factor USING (place) GROUP BY ALL),
numbered AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN factor USING (place) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM numbered JOIN item USING (item) WHERE rank <= {most}"""
