"""New candidates: all binary and ternary compositions on a grid over the elements that a materials table uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions import composition
from alloyscreen.operators import aggregates


def observed_elements(materials: DataFrame) -> DataFrame:
    """Known elements of the table, as one row with a sorted array (at most the rows of the element table)."""
    names = F.array(*[F.col(f"element_{i}") for i in composition.SLOTS])
    seen = materials.select(F.explode(names).alias("symbol")).filter(F.col("symbol").isNotNull()).distinct()
    known = seen.join(F.broadcast(refdata.alloy_elements(materials.sparkSession).select("symbol")), "symbol")
    return known.agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def satisfies(df: DataFrame, limits: dict[str, tuple[float, float]]) -> Column:
    """Every limited column that exists lies within its range."""
    kept = F.lit(True)
    for name, (low, high) in limits.items():
        if name in df.columns:
            kept = kept & F.col(name).between(low, high)
    return kept


def _after(symbols: str, element: str) -> Column:
    return F.filter(F.col(symbols), lambda s: s > F.col(element))


def binary_grid(elements: DataFrame, step: int = 5) -> DataFrame:
    pairs = elements.withColumn("element_1", F.explode("symbols")).withColumn("element_2", F.explode(_after("symbols", "element_1")))
    percent = F.explode(F.sequence(F.lit(5), F.lit(95), F.lit(step)))
    grid = pairs.select("element_1", "element_2", percent.alias("_p"))
    return grid.select(
        F.lit("binary").alias("alloy_type"), "element_1", "element_2", F.lit(None).cast("string").alias("element_3"),
        (F.col("_p") / 100).alias("composition_1"), ((F.lit(100) - F.col("_p")) / 100).alias("composition_2"),
        F.lit(0.0).alias("composition_3"),
    )


def ternary_grid(elements: DataFrame, step: int = 5) -> DataFrame:
    triples = (
        elements.withColumn("element_1", F.explode("symbols"))
        .withColumn("element_2", F.explode(_after("symbols", "element_1")))
        .withColumn("element_3", F.explode(_after("symbols", "element_2")))
    )
    first = F.explode(F.sequence(F.lit(5), F.lit(90), F.lit(step)))
    grid = triples.select("element_1", "element_2", "element_3", first.alias("_p"))
    grid = grid.withColumn("_q", F.explode(F.sequence(F.lit(5), F.lit(95) - F.col("_p"), F.lit(step))))
    return grid.select(
        F.lit("ternary").alias("alloy_type"), "element_1", "element_2", "element_3",
        (F.col("_p") / 100).alias("composition_1"), (F.col("_q") / 100).alias("composition_2"),
        ((F.lit(100) - F.col("_p") - F.col("_q")) / 100).alias("composition_3"),
    )


def candidate_grid(
    materials: DataFrame, step: int = 5, limits: dict[str, tuple[float, float]] | None = None, ternary: bool = True
) -> DataFrame:
    """Candidates with formula and mixed properties that satisfy ``limits``."""
    elements = observed_elements(materials)
    grid = binary_grid(elements, step)
    if ternary:
        grid = grid.unionByName(ternary_grid(elements, step))
    out = grid.transform(aggregates.rule_of_mixtures)
    out = out.withColumn("formula", composition.slots_formula(out)).withColumn("is_generated", F.lit(True))
    return out.filter(satisfies(out, limits or {}))
