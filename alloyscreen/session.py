"""Session helpers: a local session for tests and benches, and the shared folder for durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "alloyscreen", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return tuned(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def tuned(spark: SparkSession) -> SparkSession:
    """Settings that the long projections of this library need. HotSpot does not compile methods beyond 8000 bytes of
    bytecode; with this limit Spark splits such a stage into small methods instead of running one interpreted one."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a fresh temporary folder. On a cluster a
    machine-local folder would be lost with its machine, so the missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="alloyscreen-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end; any store that Spark writes to will do."""
    place, store = _place(spark, f"{path.rstrip('/')}/_SUCCESS")
    return store.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    place, store = _place(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()] if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the copy, so that lost executors cannot change it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Gives every core a share of an input that has fewer partitions than there are cores. Tables of the size this is
    built for have far more partitions than cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
