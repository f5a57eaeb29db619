"""CSV, JSON and parquet sinks. Files are written by the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloyscreen import schema
from alloyscreen.functions import composition, methods, safety
from alloyscreen.functions.basics import column_or
from alloyscreen.operators import ranking
from alloyscreen.session import finished, folders
from alloyscreen.sources.scans import conform


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


# Column names of the laboratory file, the results file, the shortlist and the intake package.
LAB_COLUMNS = [
    "ID", "Formula", "Comp (at%)", "Comp (wt%)", "Feedstock(g/100g)", "Stability", "E_hull", "SynthProb", "MLConf",
    "Method", "Temp°C", "Atm", "SuccessProb", "EstCost", "EstTime(h)", "Priority", "InDist", "NNDistance", "Notes",
]
RESULT_COLUMNS = [
    "formula", "at%", "wt%", "feedstock_g_per_100g", "thermodynamic_stability_score", "thermodynamic_stability_category",
    "ensemble_probability", "ensemble_confidence", "ensemble_prediction", "energy_above_hull", "formation_energy_per_atom",
    "density", "melting_point", "band_gap", "electronegativity", "atomic_radius", "nsites", "element_1", "element_2",
    "element_3", "composition_1", "composition_2", "composition_3",
]
SHORTLIST_COLUMNS = [
    "formula", "element_1", "element_2", "composition_1", "composition_2", "ensemble_probability", "ensemble_confidence",
    "safety_rating", "safety_check_passed", "requires_human_override", "safety_reason", "composite_priority_score",
]
INTAKE_COLUMNS = [
    "formula", "element_1", "element_2", "element_3", "composition_1", "composition_2", "composition_3",
    "ensemble_probability", "ensemble_confidence", "safety_rating", "safety_check_passed", "requires_human_override",
    "final_priority_score", "estimated_net_benefit", "energy_above_hull", "band_gap", "density",
]
INTAKE_NOTES = [
    "Generated candidates are computationally screened only.",
    "Experimental or measurement context is needed for full validation.",
]


def lab_projection(df: DataFrame) -> DataFrame:
    """The nineteen laboratory columns. Ids fall back from ``id`` over ``material_id`` to ``formula``."""
    costed = methods.with_cost_benefit(df)
    detailed = methods.with_method_details(costed)
    known = F.col("method_key").isNotNull()

    def rounded(name: str):
        return F.bround(F.coalesce(column_or(df, name, 0.0).cast("double"), F.lit(0.0)), 4)

    ids = [F.col(c).cast("string") for c in ("id", "material_id", "formula") if c in df.columns]
    columns = {
        "ID": F.coalesce(*ids) if ids else F.concat(F.lit("material_"), F.monotonically_increasing_id() + 1),
        "Formula": column_or(df, "formula", "Unknown"),
        "Comp (at%)": composition.atomic_percent_text(df),
        "Comp (wt%)": column_or(df, "wt%", "N/A"),
        "Feedstock(g/100g)": column_or(df, "feedstock_g_per_100g", "N/A"),
        "Stability": column_or(df, "thermodynamic_stability_category", "unknown"),
        "E_hull": rounded("energy_above_hull"),
        "SynthProb": rounded("ensemble_probability"),
        "MLConf": rounded("ensemble_confidence"),
        "Method": F.col("recommended_method"),
        "Temp°C": F.when(known, F.col("temperature_range")).otherwise("Unknown"),
        "Atm": F.when(known, F.col("atmosphere")).otherwise("Unknown"),
        "SuccessProb": F.col("success_probability"),
        "EstCost": F.coalesce(F.col("estimated_cost_usd"), F.lit(0.0)),
        "EstTime(h)": F.coalesce(F.col("total_time_hours"), F.lit(0.0)),
        "Priority": column_or(df, "synthesis_priority_rank", "N/A").cast("string"),
        "InDist": column_or(df, "in_distribution", "unknown"),
        "NNDistance": rounded("nn_distance"),
        "Notes": safety.lab_notes(df),
    }
    return detailed.select(*[v.alias(k) for k, v in columns.items()])


def write_lab_csv(df: DataFrame, path: str) -> None:
    write_csv(lab_projection(df), path)


def results_projection(df: DataFrame) -> DataFrame:
    out = df.withColumn("at%", composition.atomic_percent_text(df))
    return out.select(*[F.col(f"`{c}`") for c in RESULT_COLUMNS if c in out.columns])


def write_results_csv(df: DataFrame, path: str) -> None:
    write_csv(results_projection(df), path)


def shortlist_projection(df: DataFrame, size: int = 20) -> DataFrame:
    best = ranking.shortlist(df, size)
    return composition.with_neutral_cells(best.select(*[c for c in SHORTLIST_COLUMNS if c in best.columns]))


def write_shortlist_csv(df: DataFrame, path: str, size: int = 20) -> None:
    write_csv(shortlist_projection(df, size), path)


def intake_projection(pool: DataFrame, size: int = 100) -> DataFrame:
    """Best rows of a pool in the intake columns; absent columns are null."""
    best = pool.orderBy(*ranking.final_order()).limit(size)
    text = ("formula", "element_1", "element_2", "element_3")
    columns = [
        F.col(c) if c in pool.columns else F.lit(None).cast("string" if c in text else "double").alias(c) for c in INTAKE_COLUMNS
    ]
    return composition.with_neutral_cells(best.select(*columns))


def intake_manifest(package: DataFrame, confidence: float = 0.60, source: str = "unknown") -> DataFrame:
    return package.agg(F.count(F.lit(1)).alias("candidate_count")).select(
        F.current_timestamp().alias("exported_at_utc"),
        F.lit(source).alias("data_source_mode"),
        "candidate_count",
        F.array(*[F.lit(c) for c in package.columns]).alias("columns"),
        F.lit(confidence).alias("confidence_threshold"),
        F.array(*[F.lit(n) for n in INTAKE_NOTES]).alias("notes"),
    )


def write_intake_package(pool: DataFrame, path: str, size: int = 100, confidence: float = 0.60) -> None:
    package = intake_projection(pool, size)
    write_csv(package, f"{path}/candidates")
    intake_manifest(package, confidence).write.mode("error").json(f"{path}/manifest")


def append_outcomes(outcomes: DataFrame, path: str, batch: str | None = None) -> str:
    """Adds a batch of outcomes to the log and returns the batch's name; the log itself is not rewritten.

    A batch has a folder of its own. One that is there to its end is not added again, one whose writing was cut off is
    written anew, so that a repeated call adds nothing. Without a name the batch is named by its rows: the same rows are the same
    batch. If the outcomes have an ``outcome_id``, ids that other batches of the log hold are left out, and of equal ids in
    the batch one row stays; null ids are always added."""
    spark = outcomes.sparkSession
    if batch is None:
        rows = F.xxhash64(*[F.col(f"`{c}`") for c in outcomes.columns])
        told = outcomes.agg(F.count(F.lit(1)), F.coalesce(F.sum(rows.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(rows, F.lit(1))), F.lit(0))).first()
        batch = "-".join(str(x) for x in told).replace("--", "-n")
    folder = f"{path.rstrip('/')}/batch={batch}"
    if finished(spark, folder):
        return batch
    stamped = outcomes if "attempted_date" in outcomes.columns else outcomes.withColumn("attempted_date", F.current_timestamp())
    own = conform(stamped, schema.OUTCOME_SCHEMA)
    if "outcome_id" in outcomes.columns:
        own = conform(stamped, T.StructType([T.StructField("outcome_id", T.LongType()), *schema.OUTCOME_SCHEMA.fields]))
        named = own.filter("outcome_id IS NOT NULL").dropDuplicates(["outcome_id"])
        others = [f for f in folders(spark, path) if f.startswith("batch=") and f != f"batch={batch}" and finished(spark, f"{path.rstrip('/')}/{f}")]
        if others:
            # of the log, only the ids are read
            log = spark.read.schema("outcome_id long").parquet(*[f"{path.rstrip('/')}/{f}" for f in others])
            named = named.join(log.filter("outcome_id IS NOT NULL"), "outcome_id", "left_anti")
        own = named.unionByName(own.filter("outcome_id IS NULL"))
    own.write.mode("overwrite").parquet(folder)
    return batch
