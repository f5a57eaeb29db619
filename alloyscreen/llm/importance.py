"""Quality by importance resampling: how much likelier a text is under a model of good texts than under one of all texts.

Both models are counts of hashed one- and two-word sequences. A text's weight is its mean likelihood ratio per feature, raised to a power (the
temperature): the plain product over all features follows a text's length and drowns the noise. Adding Gumbel noise to the logarithm of the weight and
keeping the greatest is sampling without replacement in proportion to the weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen.llm.arrays import mixed, slices, word_hashes
from alloyscreen.llm.folders import written

BUCKETS = 10_000
#: Features by which the target model is drawn towards the raw one, and the factors of the mean log ratio that are tried.
SHRINKAGE = 10_000.0
TEMPERATURES = (1.0, 3.0, 10.0, 20.0, 50.0, 100.0, 200.0)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and of every two words of a text, and the number of the text each belongs to."""
    hashes, offsets = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = of[1:] == of[:-1]
    pairs = mixed(hashes[:-1] * _PAIR + hashes[1:])[inside]
    found = np.concatenate([hashes, pairs]) % np.uint64(buckets)
    return found.astype(np.int64), np.concatenate([of, of[1:][inside]])


def log_ratio(target: np.ndarray, raw: np.ndarray, weight: float = SHRINKAGE) -> np.ndarray:
    """The logarithm of target / raw probability for each bucket. The target model is drawn towards the raw one, as if ``weight`` features had
    been drawn from it: a bucket that the target texts say nothing about counts neither way."""
    p = (raw + 1.0) / (raw.sum() + len(raw))
    return np.log((target + weight * p) / (target.sum() + weight)) - np.log(p)


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, share of good rows among the labelled ones, and the factor of a text's mean log ratio in its key."""

    ratio: np.ndarray
    share: float
    temperature: float


def _known_labels(labels: DataFrame, most_labels: int) -> list:
    """doc_id, good and half of at most ``most_labels`` labelled ids. An id is good if all its rows are (quality 1, not toxic)."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.min("good").alias("good"), (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2))).cast("int").alias("half"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()


def _ids(column: pa.Array) -> np.ndarray:
    """The ids as numbers; unknown ones match none (ids are compared only where known)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def mean_ratio(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of features and mean log ratio of each text; 0 for a text without features."""
    found, of = features(texts, len(ratio))
    n = np.bincount(of, minlength=len(texts)).astype(np.int64)
    return n, np.bincount(of, ratio[found], minlength=len(texts)) / np.maximum(n, 1)


def fitted(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, most_labels: int = 20_000, buckets: int = BUCKETS) -> Model:
    """The models and the temperature.

    The raw counts are those of all documents. The target counts are those of good documents among at most ``most_labels`` labelled ids, chosen by the
    hash of the id: the only bound here, a parameter. Tasks hand on three counts per bucket. The temperature is the one of ``TEMPERATURES`` that
    best tells good from bad labelled documents by the keys drawn for them, each judged by a target model of the other half of the labels."""
    rows = _known_labels(labels, most_labels)
    known_share = sum(r["good"] for r in rows) / len(rows) if rows else 1.0
    sent = docs.sparkSession.sparkContext.broadcast([np.array(sorted(r["doc_id"] for r in rows if r["good"] and r["half"] == h), np.int64) for h in (0, 1)])

    def count(batches):
        raw, halves = np.zeros(buckets, np.int64), np.zeros((2, buckets), np.int64)
        for batch in slices(batches, "text"):
            found, of = features(batch.column("text"), buckets)
            raw += np.bincount(found, minlength=buckets)
            ids, valid = _ids(batch.column("doc_id")), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for h in (0, 1):
                own = valid & np.isin(ids, sent.value[h])
                halves[h] += np.bincount(found[own[of]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), *[pa.array(h[used]) for h in halves]], ["bucket", "raw", "first", "second"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = own.mapInArrow(count, "bucket long, raw long, first long, second long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "first", "second")]).collect()
    raw, halves = np.zeros(buckets), np.zeros((2, buckets))
    for r in counts:
        raw[r["bucket"]], halves[0][r["bucket"]], halves[1][r["bucket"]] = r["raw"], r["first"], r["second"]
    temperature = _temperature(docs, rows, [log_ratio(halves[1 - h], raw) for h in (0, 1)], known_share if share is None else share, seed)
    return Model(log_ratio(halves.sum(axis=0), raw), known_share, temperature)


def _noise(seed: int):
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _temperature(docs: DataFrame, rows: list, ratios: list[np.ndarray], share: float, seed: int) -> float:
    good = np.array([r["good"] for r in rows], bool)
    if not len(rows) or good.all() or not good.any():
        return TEMPERATURES[0]
    order = np.argsort([r["doc_id"] for r in rows])
    told = docs.sparkSession.sparkContext.broadcast((np.array([r["doc_id"] for r in rows], np.int64)[order], good[order], np.array([r["half"] for r in rows])[order], ratios))

    def judge(batches):
        known, good, half, ratios = told.value
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(_ids(batch.column("doc_id")), known) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
            for part in slices(iter([batch]), "text"):
                at = np.searchsorted(known, _ids(part.column("doc_id")))
                values = np.stack([mean_ratio(part.column("text"), r)[1] for r in ratios])
                yield pa.RecordBatch.from_arrays([pa.array(values[half[at], np.arange(len(at))]), part.column("noise"), pa.array(good[at])], ["value", "noise", "good"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _noise(seed + 1).alias("noise"))
    # as many rows as labelled documents; of ids that more rows share, the first so many
    found = own.mapInArrow(judge, "value double, noise double, good boolean").orderBy("noise").limit(4 * len(rows)).toPandas()
    if found.empty:
        return TEMPERATURES[0]
    is_good, best = found["good"].to_numpy(bool), []
    for t in TEMPERATURES:
        keys = t * found["value"].to_numpy() + found["noise"].to_numpy()
        kept = keys >= np.quantile(keys, max(0.0, 1 - share))
        best.append(kept[is_good].mean() - kept[~is_good].mean() if is_good.any() and not is_good.all() else 0.0)
    return TEMPERATURES[int(np.argmax(best))]


def greatest(values: DataFrame, column: str, k: int, direct: int = 10_000) -> float | None:
    """The k-th greatest value of a column, found by narrowing a range by counts; only at most ``direct`` values reach the driver."""
    if k <= 0:
        return None
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return low
    above = 0
    while True:
        inside = values.where(F.col(column).between(low, high))
        if n <= direct or low == high:
            found = sorted((r[0] for r in inside.select(column).orderBy(F.desc(column)).limit(min(direct, k - above)).collect()), reverse=True)
            return found[k - above - 1] if low < high else low
        part = F.least(F.lit(4095), F.floor((F.col(column) - low) / (high - low) * 4096))
        ranges = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("part")).collect()
        for r in ranges:
            if above + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            above += r["n"]


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, most_labels: int = 20_000, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, log_weight, sample_key and kept: the ``share`` of documents with the greatest keys (by default the share of good rows among
    the labelled ones). ``log_weight`` is the mean of log(target / raw) over a text's features, so that it does not grow with its length;
    ``sample_key`` is that times the fitted temperature plus Gumbel noise drawn from the hash of ``seed``, id and text.

    A null text counts as empty: no features, weight 0. Rows equal in id and text draw the same noise and are kept together; equal keys at the
    border are all kept. Null ids are rows like any other and have no label; an id with labels that contradict each other is not good. Without
    labelled rows both models agree. Only doc_id and text, and doc_id, quality and toxic of the labels, are looked at."""
    model = fitted(docs, labels, share, seed, most_labels, buckets)
    share = model.share if share is None else share
    sent = docs.sparkSession.sparkContext.broadcast(model.ratio)

    def score(batches):
        for batch in slices(batches, "text"):
            n, mean = mean_ratio(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("noise"), pa.array(n), pa.array(mean)], ["doc_id", "noise", "n_features", "log_weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _noise(seed).alias("noise"))
    scored = own.mapInArrow(score, "doc_id long, noise double, n_features long, log_weight double")
    scored = written(scored.select("doc_id", "n_features", "log_weight", (F.col("log_weight") * model.temperature + F.col("noise")).alias("sample_key")), "importance")
    border = greatest(scored, "sample_key", round(share * scored.count()))
    return scored.withColumn("kept", F.lit(False) if border is None else F.col("sample_key") >= border)
