"""Training, calibration and use of the synthesizability classifier with Spark ML."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloyscreen.functions.basics import clip
from alloyscreen.functions.ensemble import with_decision
from alloyscreen.operators import aggregates, cleaning, features as feature_ops, isotonic, mapping, metrics, novelty, sampling
from alloyscreen.session import materialize

LABEL = "synthesizable"

# Forest and boosting parameters.
FOREST = {"numTrees": 400, "maxDepth": 30, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}
BOOSTING = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05}

#: Points of a block, and points that a task cuts into blocks at a time, when clusters are fitted.
BLOCK, STRETCH = 32, 1 << 20


def classifier(kind: str = "random_forest", seed: int = 42, **settings):
    common = {"featuresCol": "features", "labelCol": LABEL, "weightCol": "class_weight", "seed": seed}
    if kind == "random_forest":
        return RandomForestClassifier(**common, **{**FOREST, "maxMemoryInMB": 1024, "cacheNodeIds": False, **settings})
    if kind == "gradient_boosting":
        return GBTClassifier(**common, **{**BOOSTING, **settings})
    raise ValueError(f"unsupported model kind: {kind}")


def _scaled_names(columns: list[str]) -> list[str]:
    return [f"_x_{c}" for c in columns]


@dataclass
class ScreeningModel:
    """Everything that scoring needs. Tables in it are as small as the training set, which the scan limits."""

    features: list[str]
    scale: dict[str, tuple[float, float]]
    medians: dict[str, float]
    model: PipelineModel
    calibration: str
    calibrator: DataFrame | LogisticRegressionModel | None
    threshold: float
    curve: DataFrame
    train: DataFrame
    metrics: dict
    distance: novelty.Novelty | None = None

    def save(self, path: str) -> None:
        self.model.write().save(f"{path}/model")
        if isinstance(self.calibrator, DataFrame):
            self.calibrator.write.parquet(f"{path}/calibrator")
        elif self.calibrator is not None:
            self.calibrator.write().save(f"{path}/calibrator")
        self.curve.write.parquet(f"{path}/curve")
        self.train.write.parquet(f"{path}/train")
        settings = {
            "features": self.features, "scale": self.scale, "medians": self.medians, "calibration": self.calibration,
            "threshold": self.threshold, "metrics": self.metrics,
        }
        spark = self.train.sparkSession
        spark.createDataFrame([(json.dumps(settings),)], "settings string").write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScreeningModel:
        s = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
        kinds = {"isotonic": spark.read.parquet, "platt": LogisticRegressionModel.load}
        calibrator = kinds[s["calibration"]](f"{path}/calibrator") if s["calibration"] in kinds else None
        return cls(
            s["features"], {k: tuple(v) for k, v in s["scale"].items()}, s["medians"], PipelineModel.load(f"{path}/model"),
            s["calibration"], calibrator, s["threshold"], spark.read.parquet(f"{path}/curve"),
            spark.read.parquet(f"{path}/train"), s["metrics"],
        )


def _raw_probability(model: PipelineModel, scaled: DataFrame) -> DataFrame:
    drop = ["features", "rawPrediction", "probability", "prediction"]
    return model.transform(scaled).withColumn("_raw", vector_to_array("probability")[1]).drop(*drop)


def _calibrated(df: DataFrame, calibration: str, calibrator) -> DataFrame:
    """Adds ``synthesizability_probability`` from ``_raw``."""
    if calibrator is None:
        return df.withColumn("synthesizability_probability", F.col("_raw"))
    if calibration == "platt":
        out = calibrator.transform(VectorAssembler(inputCols=["_raw"], outputCol="_raw_vector").transform(df))
        out = out.withColumn("synthesizability_probability", vector_to_array("probability")[1])
        return out.drop("_raw_vector", "rawPrediction", "probability", "prediction")
    out = isotonic.calibrated(df, calibrator, "_raw", "synthesizability_probability")
    return out.withColumn("synthesizability_probability", clip(F.col("synthesizability_probability"), 0.0, 1.0))


def fit_isotonic(df: DataFrame) -> DataFrame:
    return materialize(isotonic.fit_isotonic(df, "_raw", LABEL))


def fit_platt(df: DataFrame) -> LogisticRegressionModel:
    vector = VectorAssembler(inputCols=["_raw"], outputCol="_raw_vector").transform(df)
    return LogisticRegression(featuresCol="_raw_vector", labelCol=LABEL).fit(vector.select("_raw_vector", LABEL))


def fit(
    table: DataFrame,
    features: list[str],
    kind: str = "random_forest",
    calibration: str = "isotonic",
    test_fraction: float = 0.2,
    seed: int = 42,
    **settings,
) -> ScreeningModel:
    """Split, rebalance, scale, fit, calibrate, choose the threshold, evaluate on the test rows."""
    data = materialize(table.select("material_id", LABEL, *[F.col(f).cast("double").alias(f) for f in features]))
    if len(sampling.class_counts(data, LABEL)) < 2:
        raise ValueError("training data hold a single class")
    split = sampling.stratified_split(data, LABEL, test_fraction)
    test, rest = split.filter("is_test"), split.filter("NOT is_test").drop("is_test")
    inner = sampling.stratified_split(rest, LABEL, 0.2, part=1, name="is_calibration")
    held, kept = inner.filter("is_calibration"), inner.filter("NOT is_calibration").drop("is_calibration")
    train = materialize(sampling.with_class_weight(sampling.rebalance(kept, LABEL), LABEL))

    medians = cleaning.medians(train, features)
    train = cleaning.median_impute(train, features, medians)
    scale = novelty.scaling(train, features)

    def prepare(df: DataFrame) -> DataFrame:
        return novelty.scaled(cleaning.median_impute(df, features, medians), scale)

    stages = [VectorAssembler(inputCols=_scaled_names(features), outputCol="features"), classifier(kind, seed, **settings)]
    model = Pipeline(stages=stages).fit(novelty.scaled(train, scale))
    held_scored = materialize(_raw_probability(model, prepare(held)).select(LABEL, "_raw"))
    if len(sampling.class_counts(held_scored, LABEL)) < 2:
        calibration, calibrator = "none", None
    else:
        calibrator = fit_platt(held_scored) if calibration == "platt" else fit_isotonic(held_scored)
    chosen = metrics.best_threshold(
        _calibrated(held_scored, calibration, calibrator), LABEL, "synthesizability_probability"
    ).first()["decision_threshold"]

    judged = _calibrated(_raw_probability(model, prepare(test)), calibration, calibrator)
    judged = materialize(with_decision(judged.select("material_id", LABEL, "synthesizability_probability"), chosen))
    quality = metrics.confusion_metrics(judged, LABEL, "synthesizability_prediction").first().asDict()
    quality.update(metrics.calibration_metrics(judged, LABEL, "synthesizability_probability").first().asDict())
    curve = materialize(metrics.reliability_curve(judged, LABEL, "synthesizability_probability"))
    held_train = train.select("material_id", *features)
    distance = novelty.fit_novelty(held_train, features)
    return ScreeningModel(features, scale, medians, model, calibration, calibrator, chosen, curve, held_train, quality, distance)


def recalibrate(fitted: ScreeningModel, table: DataFrame, method: str) -> ScreeningModel:
    """The same classifier with a new calibration, fitted on labelled rows."""
    if method not in ("isotonic", "platt"):
        raise ValueError(f"unknown calibration method: {method}")
    prepared = novelty.scaled(cleaning.median_impute(table, fitted.features, fitted.medians), fitted.scale)
    scored = materialize(_raw_probability(fitted.model, prepared).select(LABEL, "_raw"))
    calibrator = fit_platt(scored) if method == "platt" else fit_isotonic(scored)
    return replace(fitted, calibration=method, calibrator=calibrator)


def raw_scores(materials: DataFrame, fitted: ScreeningModel) -> DataFrame:
    """Every row with the features that the classifier saw and ``_raw``, its probability before any calibration."""
    known = mapping.copy_aliases(materials)
    filled = mapping.add_absent(known, fitted.features, fitted.medians).drop(*[f"{f}_imputed" for f in fitted.features])
    filled = cleaning.median_impute(filled, fitted.features, fitted.medians)
    return _raw_probability(fitted.model, novelty.scaled(filled, fitted.scale))


def score_batch(materials: DataFrame, fitted: ScreeningModel, key: str = "material_id", with_distance: bool = True, passed: bool = False) -> DataFrame:
    """Prediction, probability, confidence, calibration status and distance to the training data for every row. Rows that have ``passed`` through
    ``raw_scores`` do not pass through the classifier again."""
    scored = materials if passed else raw_scores(materials, fitted)
    scored = _calibrated(scored, fitted.calibration, fitted.calibrator)
    scored = scored.drop("_raw", *_scaled_names(fitted.features))
    scored = with_decision(scored, fitted.threshold)
    scored = metrics.with_calibration_status(scored, fitted.curve)
    if with_distance:
        scored = novelty.with_fitted_novelty(scored, fitted.distance or novelty.fit_novelty(fitted.train, fitted.features))
    return scored


def train(materials: DataFrame, n_materials: int = 1000, tertiary: bool | None = False, **settings) -> ScreeningModel:
    """Training scan, features, label and fit."""
    features, raw = feature_ops.training_dataset(materials, n_materials)
    table = materialize(feature_ops.training_table(features, raw))
    return fit(table, feature_ops.feature_set(table, tertiary), **settings)


def cross_validate(table: DataFrame, features: list[str], folds: int = 5, kind: str = "random_forest", **settings) -> dict:
    """Mean and deviation of the accuracy over hash-assigned folds. Medians for nulls and the scaling are fitted inside each fold."""
    smallest = min(sampling.class_counts(table, LABEL).values())
    folds = min(folds, smallest)
    if folds < 2:
        return {"cv_mean": None, "cv_std": None}
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    data = materialize(table.select(LABEL, (sampling.id_bucket() % folds).alias("fold"), F.lit(1.0).alias("class_weight"), *numbers))
    filled = [f"_filled_{f}" for f in features]
    pipeline = Pipeline(
        stages=[
            Imputer(inputCols=features, outputCols=filled, strategy="median", relativeError=0.0),
            VectorAssembler(inputCols=filled, outputCol="_assembled"),
            StandardScaler(inputCol="_assembled", outputCol="features", withMean=True),
            classifier(kind, **settings),
        ]
    )
    judge = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, foldCol="fold",
        parallelism=2,
    ).fit(data)
    return {"cv_mean": float(search.avgMetrics[0]), "cv_std": float(search.stdMetrics[0])}


def fold_spread(mean: float, std: float) -> dict:
    """Coefficient of variation of fold results with its grade."""
    variation = std / mean if mean else None
    grade = None if variation is None else "high" if variation < 0.1 else "moderate" if variation < 0.2 else "low"
    return {"coefficient_of_variation": variation, "stability": grade}


def compare_modes(table: DataFrame, **settings) -> DataFrame:
    """Test and cross-validation metrics with and without composition features, their difference from the run without, and how many
    rows have a third component."""
    spark = table.sparkSession
    coverage = aggregates.tertiary_coverage(table).first()
    rows = []
    for mode, tertiary in (("binary-only", False), ("tertiary-enabled", True)):
        columns = feature_ops.feature_set(table, tertiary)
        m = fit(table, columns, **settings).metrics
        folds = cross_validate(table, columns, **settings)
        rows.append((mode, len(columns), ", ".join(columns), m["accuracy"], m["precision"], m["recall"], m["f1_score"], folds["cv_mean"], folds["cv_std"]))
    base = rows[0]
    rows = [(*r, coverage["tertiary_rows"], coverage["tertiary_fraction"], r[6] - base[6], r[3] - base[3]) for r in rows]
    return spark.createDataFrame(
        rows,
        "mode string, feature_count int, feature_columns string, accuracy double, precision double, recall double, f1_score double, cv_mean double, "
        "cv_std double, tertiary_rows long, tertiary_fraction double, delta_vs_binary_f1 double, delta_vs_binary_accuracy double",
    )


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standard-scaled columns (in place) with their vector; rows with nulls are filled with the mean, which is 0."""
    fitted = feature_ops.fit_scaler(df, columns)
    scaled = feature_ops.scale(df, columns, fitted).fillna(0.0, subset=columns)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(scaled)


def with_pca(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Standard-scaled columns projected onto ``k`` components, as ``pca_1`` ... ``pca_k``. A component points where its greatest
    loading is positive, so that it does not depend on the solver."""
    data = _assembled(df, columns)
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(data)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    values = vector_to_array("_pca")
    return model.transform(data).withColumns({f"pca_{i + 1}": values[i] * signs[i] for i in range(k)}).drop("features", "_pca")


def pca_reconstruction(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Mean squared error of the rank-``k`` reconstruction and the explained variance."""
    data = _assembled(df, columns)
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(data)
    loadings = model.pc.toArray()
    parts = [sum((F.col(c) * float(loadings[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(k)]
    error = F.lit(0.0)
    for i, c in enumerate(columns):
        rebuilt = sum((parts[j] * float(loadings[i, j]) for j in range(k)), F.lit(0.0))
        error = error + (F.col(c) - rebuilt) * (F.col(c) - rebuilt)
    explained = float(sum(model.explainedVariance.toArray()))
    return data.agg((F.avg(error) / len(columns)).alias("reconstruction_mse")).withColumn("explained_variance", F.lit(explained))


def _blocks(points: DataFrame, columns: list[str]) -> DataFrame:
    """The points in blocks that lie near each other: their number, per column the least, the greatest, the sum and the values (as bytes), and the
    sum of the squared distances to the mean. Every task cuts its points in stretches: each column cuts the parts of the ones before into equal parts."""
    names = ["n", "apart", *[f"{of}{m}" for of in ("low", "high", "sum", "held") for m in range(len(columns))]]

    def cut(x: np.ndarray) -> pa.RecordBatch:
        size = x.shape[1]
        parts, order, block = max(1, round((size / BLOCK) ** (1 / len(x)))), np.arange(size), np.zeros(size, np.int64)
        for values in x:
            order = order[np.lexsort((values[order], block))]
            sizes = np.bincount(block)
            place = np.arange(size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            block = block * parts + place * parts // np.repeat(sizes, sizes)
        x, first = x[:, order], np.flatnonzero(np.diff(block, prepend=-1))
        n = np.diff(first, append=size)
        with np.errstate(invalid="ignore"):
            total = np.add.reduceat(x, first, axis=1)
            apart = np.add.reduceat(((x - np.repeat(total / n, n, axis=1)) ** 2).sum(axis=0), first)
        ends = np.append(first, size) * 8
        held = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))]) for v in x]
        each = [*np.minimum.reduceat(x, first, axis=1), *np.maximum.reduceat(x, first, axis=1), *total]
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(apart), *[pa.array(v) for v in each], *held], names)

    def blocks(batches):
        kept, rows = [], 0
        for batch in batches:
            kept.append(np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).reshape(len(columns), -1))
            rows += batch.num_rows
            if rows >= STRETCH:
                yield cut(np.concatenate(kept, axis=1))
                kept, rows = [], 0
        if rows:
            yield cut(np.concatenate(kept, axis=1))

    types = ["long", "double", *["double"] * (3 * len(columns)), *["binary"] * len(columns)]
    return points.select(*columns).mapInArrow(blocks, ", ".join(f"{c} {t}" for c, t in zip(names, types, strict=True)))


def _bytes(column: pa.Array) -> np.ndarray:
    """The doubles of all values of a binary column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[column.offset] : ends[column.offset + len(column)]].view(np.float64)


def _lloyd(points: DataFrame, columns: list[str], first: list[np.ndarray], rounds: int = 20, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of k-means fits from their first centres. One pass over the points moves the centres of all fits; a fit ends as
    ``KMeans`` ends it: after ``rounds``, or when no centre moves by more than ``tol``. An empty cluster keeps its centre, the
    cost is that of the last pass. A block of points that is nearer to one centre than to the others with all of its bounds counts as a whole;
    the points of the other blocks are measured one by one."""
    centres, costs, moving = [c.copy() for c in first], [0.0] * len(first), list(range(len(first)))
    dims = range(len(columns))
    blocks = _blocks(points, columns).persist(StorageLevel.MEMORY_AND_DISK)

    def moved(asked: list) -> list:
        numbers = [*[f"x{m}" for m in dims], "n", "cost"]
        names = ["fit", "cluster", *numbers]

        def sums(batches):
            totals = {i: np.zeros((len(c), len(columns) + 2)) for i, c in asked}
            for batch in batches:
                n, apart = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "apart"))
                low, high, total = (np.array([batch.column(f"{of}{m}").to_numpy(zero_copy_only=False) for m in dims]) for of in ("low", "high", "sum"))
                x, begin = [_bytes(batch.column(f"held{m}")) for m in dims], np.cumsum(n) - n
                for i, c in asked:
                    with np.errstate(invalid="ignore", over="ignore"):
                        close = np.array([sum(np.maximum(np.maximum(low[m] - p[m], p[m] - high[m]), 0.0) ** 2 for m in dims) for p in c])
                        far = np.array([sum(np.maximum(np.abs(low[m] - p[m]), np.abs(high[m] - p[m])) ** 2 for m in dims) for p in c])
                        own = far.argmin(axis=0)
                        least = far[own, np.arange(len(n))]
                        close[own, np.arange(len(n))] = np.inf
                        whole = (least * (1 + 1e-9) < close.min(axis=0)) & np.isfinite(least)
                    near = own[whole]
                    away = sum((total[m][whole] / n[whole] - c[near, m]) ** 2 for m in dims)
                    for m, weights in enumerate([*total[:, whole], n[whole], apart[whole] + n[whole] * away]):
                        totals[i][:, m] += np.bincount(near, weights, len(c))
                    size, start = n[~whole], begin[~whole]
                    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                    points = [v[at] for v in x]
                    least, near = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
                    for j in range(len(c)):
                        apart_j = sum((points[m] - c[j, m]) ** 2 for m in dims)
                        near[apart_j < least] = j
                        np.minimum(least, apart_j, out=least)
                    for m, weights in enumerate([*points, np.ones(len(at)), least]):
                        totals[i][:, m] += np.bincount(near, weights, len(c))
            rows = [(i, j, *t) for i, sums_of in totals.items() for j, t in enumerate(sums_of.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n < 2 else pa.float64()) for n, v in enumerate(zip(*rows))], names)

        parts = blocks.mapInArrow(sums, "fit int, cluster int, " + ", ".join(f"{c} double" for c in numbers))
        # a row per centre
        return parts.groupBy("fit", "cluster").agg(*[F.sum(c).alias(c) for c in numbers]).collect()

    try:
        for _ in range(rounds):
            if not moving:
                break
            found = moved([(i, centres[i]) for i in moving])
            still = set()
            for i in moving:
                costs[i] = 0.0
            for row in found:
                i, j = row["fit"], row["cluster"]
                costs[i] += row["cost"]
                if row["n"]:
                    centre = np.array([row[f"x{m}"] for m in dims]) / row["n"]
                    if ((centre - centres[i][j]) ** 2).sum() > tol * tol:
                        still.add(i)
                    centres[i][j] = centre
            moving = sorted(still)
    finally:
        blocks.unpersist()
    return list(zip(centres, costs, strict=True))


def _nearest(columns: list[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre; of equally near ones the first."""
    apart = F.array(*[sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres])
    return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")


def with_best_clusters(df: DataFrame, columns: list[str], ks=range(2, 8), seed: int = 42, starts: int = 10) -> DataFrame:
    """Cluster of each row for the number of clusters with the best silhouette, on the two main components. For each number the best
    of ``starts`` fits by its cost is judged."""
    axes = ["pca_1", "pca_2"]
    projected = materialize(with_pca(df, columns).select(*df.columns, *axes))
    data = VectorAssembler(inputCols=axes, outputCol="features").transform(projected)
    points = data.select("features", *axes).persist(StorageLevel.MEMORY_AND_DISK)
    asked = [(k, seed + i) for k in ks for i in range(starts)]
    judge = ClusteringEvaluator()
    best = None
    try:
        # without rounds a fit is its start alone; starts wait for many small jobs each, four at a time fill the gaps. A selection is no cached
        # table to KMeans, which then holds the vectors themselves while it passes over them
        vectors = points.select("features")
        with ThreadPoolExecutor(4) as pool:
            first = list(pool.map(lambda a: np.array(KMeans(k=a[0], seed=a[1], maxIter=0).fit(vectors).clusterCenters()), asked))
        fits = _lloyd(points.select(*axes), axes, first)
        for k in ks:
            centres, _ = min((fit for (size, _), fit in zip(asked, fits, strict=True) if size == k), key=lambda fit: fit[1])
            quality = judge.evaluate(points.withColumn("prediction", _nearest(axes, centres)))
            if best is None or quality > best[0]:
                best = (quality, k, centres)
    finally:
        points.unpersist()
    quality, k, centres = best
    out = projected.withColumn("cluster", _nearest(axes, centres))
    return out.withColumns({"cluster_count": F.lit(k), "silhouette": F.lit(quality)})


def property_regressors(df: DataFrame, columns: list[str], targets: list[str], trees: int = 50, seed: int = 42) -> DataFrame:
    """Each target predicted from the other columns by a forest; squared error per target and of the rebuilt table."""
    fitted = feature_ops.fit_scaler(df, columns)
    data = materialize(feature_ops.scale(df.select(*columns), columns, fitted).fillna(0.0))

    def error(target: str) -> float:
        inputs = [c for c in columns if c != target]
        assembler = VectorAssembler(inputCols=inputs, outputCol="features")
        # a row keeps its node in each tree, so that a level does not pass through the levels above it again
        forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=10, maxMemoryInMB=1024, cacheNodeIds=True, seed=seed)
        model = forest.fit(assembler.transform(data))
        predicted = model.transform(assembler.transform(data))
        return predicted.agg(F.avg((F.col("prediction") - F.col(target)) ** 2).alias("mse")).first()["mse"]

    # the driver works between the levels of a forest; four forests at a time fill the gaps
    with ThreadPoolExecutor(4) as pool:
        rows = list(zip(targets, pool.map(error, targets), strict=True))
    rows.append(("all columns", sum(m for _, m in rows) / len(columns)))
    return df.sparkSession.createDataFrame(rows, "target string, mse double")
