"""Materials laid out by element pair, so that a scan of some pairs reads the folders of these pairs alone.

A material lies in the folder of each of its pairs. A scan keeps it in the first of the pairs asked for, which the row itself shows, so
that no row has to meet its copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions.composition import pair_key
from alloyscreen.sources import scans

#: Files over which the rows of a pair are spread in each partition of the input at most.
FILES_PER_PAIR = 64


def _key(pair: Column) -> Column:
    return pair_key(pair["element_1"], pair["element_2"])


def write_pairs(materials: DataFrame, path: str, pairs: list[tuple[str, str]] | None = None, files_per_pair: int = FILES_PER_PAIR) -> None:
    """Writes the materials that hold a pair to ``path``. Rows of a pair are dealt over tasks by their id, so that a pair that most
    materials hold is not one task's work; inside a file they are sorted by hull energy, for the file's statistics to tell."""
    tagged = materials.withColumn("pair", F.explode(F.transform(scans.matching_pairs(pairs or refdata.ALLOY_PAIRS), _key)))
    dealt = tagged.repartition("pair", F.pmod(F.xxhash64("material_id"), F.lit(files_per_pair)))
    dealt.sortWithinPartitions("pair", "energy_above_hull").write.mode("error").partitionBy("pair").parquet(path)


def stored_pair_scan(
    spark: SparkSession, path: str, pairs: list[tuple[str, str]], energy_above_hull_max: float = 0.05, nsites_max: int = 10
) -> DataFrame:
    """``scans.pair_scan`` of a store, for pairs that it was written with; ids are unique in the materials."""
    names = [f"{a}-{b}" for a, b in pairs]
    rows = spark.read.parquet(path)
    kept = rows.filter(F.col("pair").isin(names) & (F.col("energy_above_hull") <= energy_above_hull_max) & (F.col("nsites") <= nsites_max))
    own = F.element_at(scans.matching_pairs(pairs), 1)
    first = kept.withColumn("_own", own).filter(_key(F.col("_own")) == F.col("pair"))
    columns = [c for c in rows.columns if c not in ("pair", "element_1", "element_2")]
    tagged = first.select(*columns, "_own.element_1", "_own.element_2", F.lit("binary").alias("alloy_type"))
    return scans.summarised(tagged, ("element_1", "element_2", "alloy_type"))
