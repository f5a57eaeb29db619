"""Near-duplicate documents by a multi-index join of MinHash signatures.

A signature has ``chunks`` times 8 components of 32 bits. Two signatures that differ in at most 2 * chunks - 1 components have, by the
pigeonhole principle, a chunk with at most one differing component; so every chunk is indexed with each of its components left out
in turn, which enumerates the allowed errors, and all pairs within that distance share a key. Documents of similarity s share one
but for (1 - s^8 - 8 s^7 (1 - s))^chunks: at 0.85 and 12 chunks 3 in a million, at 0.9 1 in 10^9.

The documents of a key are a bucket. Its least document is measured against the others, which joins nearly all that belong together. Only
what lies in different components of a bucket afterwards is compared pair by pair, in tiles of bounded size: on sketches of 256 bytes first;
pairs whose sketches allow a link are measured within the tile, so that only links leave it, fewer than a tile has ids. Every link is
confirmed on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen.llm.arrays import mixed, shingles, slices, word_hashes
from alloyscreen.llm.components import components
from alloyscreen.llm.folders import written
from alloyscreen.operators.hot_joins import hot_join

_CHUNK = 8
_rng = np.random.Generator(np.random.PCG64(85))
_MULTIPLIERS = _rng.integers(0, 1 << 63, 64 * _CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, 64 * _CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Components of a sketch (two bits each), and ids on a side of a tile. Only time depends on them, but for one link in some 50 million.
SKETCH, TILE = 1024, 1024
#: Shingles on a side of a tile, about: 16 MB.
TILE_SHINGLES = 1 << 21
#: Ids of documents with a possible partner that are sent to every task; with more of them, texts are shuffled to meet them.
HELD_IDS = 1 << 21
_SKETCH = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRINTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def signature(shingle_set: np.ndarray, size: int) -> np.ndarray:
    """The least of each of ``size`` permutations of the set, in 32 bits."""
    least = np.full(size, ~np.uint64(0), np.uint64)
    for i in range(0, len(shingle_set), 2048):
        np.minimum(least, (shingle_set[None, i : i + 2048] * _MULTIPLIERS[:size, None]).min(axis=1), out=least)
    return least >> np.uint64(32)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each row of ``signatures`` the keys of its chunks, each component left out in turn."""
    size = signatures.shape[1]
    terms = mixed(signatures + _SALTS[:size]).reshape(len(signatures), -1, _CHUNK)
    keys = terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms
    return mixed(keys.reshape(len(signatures), size) ^ _SALTS[None, :size])


def _fingerprint(s: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> int:
    return int(mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64)) if len(s) else 0


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """Two bits of the least of each of ``SKETCH`` permutations of the set, four to a byte."""
    low = np.zeros(SKETCH, np.uint8)
    for i in range(0, SKETCH, 256):
        factors = _SKETCH[i : i + 256, None]
        least = np.full(len(factors), ~np.uint64(0), np.uint64)
        for k in range(0, len(shingle_set), 2048):
            np.minimum(least, (shingle_set[None, k : k + 2048] * factors).min(axis=1), out=least)
        low[i : i + 256] = (mixed(least) & np.uint64(3)).astype(np.uint8)
    return (low.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)


def most_unlike(percent: int) -> int:
    """Components in which the sketches of two sets of that similarity differ at most, but for one pair in some 50 million."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(SKETCH * (1 - p) + 5.5 * (SKETCH * p * (1 - p)) ** 0.5) + 1


def unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many components the sketches (rows of 64-bit numbers) differ."""
    z = x ^ y
    return np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _linked(key: int, block: np.ndarray, ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, keys: list, percent: int) -> list[tuple[int, int]]:
    """The links of a tile between components, without those between components that its links have joined. A pair is measured if its
    sizes and sketches allow a link and this is the first bucket that it shares."""
    found, most, joined = [], most_unlike(percent), {}

    def top(root: int) -> int:
        while root in joined:
            root = joined[root]
        return root

    n, buckets, whose = np.array([len(s) for s in sets]), [set(k) for k in keys], roots.tolist()
    rows = max(1, (1 << 20) // max(1, len(ids)))
    for i in range(0, len(ids), rows):
        a = np.arange(i, min(i + rows, len(ids)))
        may = (a[:, None] < np.arange(len(ids))[None, :]) & (roots[a][:, None] != roots[None, :])
        may &= 100 * np.minimum(n[a][:, None], n[None, :]) >= percent * np.maximum(n[a][:, None], n[None, :])
        if block.any() and not block.all():  # a tile of two blocks: its inner pairs are those of other tiles
            may &= block[a][:, None] != block[None, :]
        at_a, at_b = np.nonzero(may)
        at_a += i
        for k in range(0, len(at_a), 1 << 16):
            x, y = at_a[k : k + (1 << 16)], at_b[k : k + (1 << 16)]
            near = unlike(sketches[x], sketches[y]) <= most
            for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                one, two = top(whose[p]), top(whose[q])
                if one != two and min(buckets[p] & buckets[q]) == key:
                    shared = _shared(sets[p], sets[q])
                    if 100 * shared >= percent * (len(sets[p]) + len(sets[q]) - shared):
                        found.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
                        joined[max(one, two)] = min(one, two)
    return found


def _buckets(keyed: DataFrame) -> DataFrame:
    """key, id and leader (the least id) of the buckets of several ids; of buckets with the same ids one."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = written(keyed.join(several, "key"), "shared")
    prints = shared.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("q"), F.min("id").alias("leader"))
    kept = prints.groupBy("n", "p", "q", "leader").agg(F.min("key").alias("key"))
    return written(shared.join(kept.select("key", "leader"), "key"), "buckets")


def _open_links(buckets: DataFrame, root: DataFrame, size: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) that join the different components which share a bucket; None if there is no such bucket.

    A bucket is compared in tiles of about ``TILE`` ids and ``TILE_SHINGLES`` shingles on a side. A pair is measured in one bucket only."""
    placed = buckets.join(size.join(root, "id", "left"), "id").withColumn("root", F.coalesce("root", "id"))
    blocks = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    several = placed.groupBy("key").agg(blocks.alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "blocks")
    rest = written(placed.select("key", "id", "root").join(several, "key"), "open")
    if rest.isEmpty():
        return None
    held = rest.groupBy("id").agg(F.collect_list("key").alias("keys"))  # a bucket per key of the id at most

    def draw(batches):
        for batch in batches:
            held = batch.column("shingles")
            flat, ends = held.flatten().to_numpy().view(np.uint64), np.diff(np.asarray(held.offsets)).cumsum()
            own = np.split(flat, ends[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), held, pa.array([sketch(s).tobytes() for s in own], pa.binary())], ["id", "shingles", "sketch"])

    drawn = sets.join(held.select(F.col("id").alias("node")), "node", "left_semi").mapInArrow(draw, "id long, shingles array<long>, sketch binary")
    rows = rest.join(drawn.join(held, "id"), "id")
    block = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    tiles = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("second"), "id", "root", "shingles", "sketch", "keys")
    dealt = tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches):
        waiting: list[pa.RecordBatch] = []

        def done():
            whole = pa.Table.from_batches(waiting)
            place = np.stack([whole[c].to_numpy() for c in ("key", "lo", "hi")])
            first = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)])
            ids, roots, second = (whole[c].to_numpy() for c in ("id", "root", "second"))
            sets = [s for part in whole["shingles"].chunks for s in np.split(part.flatten().to_numpy().view(np.uint64), np.diff(np.asarray(part.offsets)).cumsum()[:-1])]
            sketches = np.frombuffer(b"".join(whole["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
            keys, found = whole["keys"].to_pylist(), []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                found += _linked(int(place[0, i]), second[i:j].astype(bool), ids[i:j], roots[i:j], sets[i:j], sketches[i:j], keys[i:j], percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            # a tile that goes on in the next batch waits for its end
            place = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")])
            if not batch.num_rows:
                continue
            if waiting and any(waiting[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("key", "lo", "hi")):
                yield done()
                waiting = []
            change = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0))
            if len(change):
                waiting.append(batch.slice(0, int(change[-1]) + 1))
                yield done()
                waiting = [batch.slice(int(change[-1]) + 1)]
            else:
                waiting.append(batch)
        if waiting:
            yield done()

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, chunks: int = 12, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept (doc_id = component_id).

    A-Z are lowered, words are runs without space and the controls 9 to 13, a document's set are its distinct shingles of ``width``
    words (all its words if fewer). Two documents are linked if 100 * intersection >= ``percent`` * union.

    Documents with equal sets form a class, of which one takes part in the search; the members get its component back. So no
    pair of copies is ever made. Texts are read twice; only the sets of documents that may have a partner travel. A text without words, or
    null, has no shingles and is linked with nothing: its component is itself. Rows without id count as copies but never
    name a component; one whose component has no id has a null component and is kept. Repeated rows keep a row each."""
    own = docs.selectExpr(f"CAST(`{id_column}` AS long) AS doc_id", f"`{text_column}` AS text").withColumn("node", F.xxhash64("doc_id", "text"))
    # with fewer shingles than this, an unequal set is below the threshold
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 40

    def sign(batches):
        for batch in slices(batches, "text"):
            sets = shingles(*word_hashes(batch.column("text")), width)
            sizes = np.array([len(s) for s in sets])
            prints = [pa.array(np.array([_fingerprint(s, salt) for s in sets], np.uint64).astype(np.int64)) for salt in _PRINTS]
            wide = np.flatnonzero(sizes >= least)
            keys = chunk_keys(np.stack([signature(sets[i], chunks * _CHUNK) for i in wide])) if len(wide) else np.zeros((0, 0), np.uint64)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[wide + 1] = chunks * _CHUNK
            lists = pa.ListArray.from_arrays(np.cumsum(ends, dtype=np.int32), pa.array(keys.reshape(-1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(sizes, pa.int64()), *prints, lists], ["doc_id", "node", "n", "print", "print_2", "keys"])

    signed = written(own.mapInArrow(sign, "doc_id long, node long, n long, print long, print_2 long, keys array<long>"), "signatures")
    classes = written(signed.where("n > 0").groupBy("n", "print", "print_2").agg(F.min("doc_id").alias("low"), F.min("node").alias("node")), "classes")
    members = signed.select("node", "keys").join(classes.select("node"), "node", "left_semi").select(F.explode("keys").alias("key"), F.col("node").alias("id"))

    def collect(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array([not (n in seen or seen.add(n)) for n in batch.column("node").to_pylist()], pa.bool_()))
            sets = shingles(*word_hashes(batch.column("text")), width)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "shingles"])

    # every bucket's least id is measured against the others; then what is left between different components
    buckets = _buckets(members)
    wanted = written(buckets.select(F.col("id").alias("node")).distinct(), "wanted")
    if wanted.count() <= HELD_IDS:  # its size is known: texts stay where they are read
        wanted = F.broadcast(wanted)
    sets = written(own.select("node", "text").join(wanted, "node", "left_semi").mapInArrow(collect, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough. Many pairs may share ``a``."""
        with_a = hot_join(pairs, sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), ["a"], "inner")
        both = with_a.join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
        shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
        return written(shared.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b"), "links")

    size = classes.select(F.col("node").alias("id"), "n")
    star = buckets.where("id <> leader").select("leader", "id").distinct()
    sized = star.join(size, "id").join(size.select(F.col("id").alias("leader"), F.col("n").alias("m")), "leader")
    first = linked(sized.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(F.col("leader").alias("a"), F.col("id").alias("b")))
    root = components(first)
    more = _open_links(buckets, root, size, sets, percent)
    if more is not None:
        root = components(first.unionByName(written(more, "open-links")))
    named = classes.join(root.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = named.join(names, "root").select("n", "print", "print_2", "component_id")
    out = signed.select("doc_id", "n", "print", "print_2").join(of_class, ["n", "print", "print_2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()),
    )
