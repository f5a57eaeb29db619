"""Registry and the shared fragments: Spark frames on one side, SQL common table expressions on the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.plans import screening
from alloyscreen.sources import driver_tables as tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return function

    return register


# ---- Spark side ------------------------------------------------------------------------------------------------


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.materials(spark, sf_dir)


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_elements(tables.with_formula(raw(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.score(full(spark, sf_dir))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.outcomes(spark, sf_dir)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the last bits of sums and exponentials do not matter."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles})


# ---- SQL side --------------------------------------------------------------------------------------------------


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(quoted(v) for v in value) + "]"
    if isinstance(value, float):
        return "CAST('Infinity' AS DOUBLE)" if value == float("inf") else f"CAST({value!r} AS DOUBLE)"
    return str(value)


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}_rows({columns})"


def r(expression: str, alias: str, digits: int = 9) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) AS {alias}"


def formula_sql(n: int = 3) -> str:
    parts = [
        f"CASE WHEN element_{i} IS NOT NULL AND composition_{i} > 0 THEN concat(element_{i}, format('{{:.3f}}', composition_{i})) ELSE '' END"
        for i in range(1, n + 1)
    ]
    return "concat(" + ", ".join(parts) + ")"


def by_hull_sql(a: str, b: str, c: str, hull: str = "energy_above_hull") -> str:
    return f"CASE WHEN {hull} <= 0.025 THEN {a} WHEN {hull} <= 0.1 THEN {b} ELSE {c} END"


STABILITY_SCORE_SQL = """
    least(CASE WHEN band_gap BETWEEN 0.5 AND 4.0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(9.0 AS DOUBLE) END,
      CAST((CASE WHEN energy_above_hull <= 0.025 THEN 0.9 WHEN energy_above_hull <= 0.1 THEN 0.6 ELSE 0.2 END) AS DOUBLE)
      * CAST((CASE WHEN formation_energy_per_atom < -10 OR formation_energy_per_atom > 2 THEN 0.8 ELSE 1.0 END) AS DOUBLE)
      * CAST((CASE WHEN density < 1 OR density > 30 THEN 0.7 ELSE 1.0 END) AS DOUBLE)
      * CAST((CASE WHEN band_gap BETWEEN 0.5 AND 4.0 THEN 1.1 ELSE 1.0 END) AS DOUBLE))"""

RULE_SCORE_SQL = """CAST(
      (CASE WHEN energy_above_hull <= 0.1 THEN 2.0 ELSE 0 END) + (CASE WHEN formation_energy_per_atom BETWEEN -4 AND 1 THEN 1.5 ELSE 0 END)
      + (CASE WHEN nsites <= 20 THEN 1.0 ELSE 0 END) + (CASE WHEN density BETWEEN 2 AND 25 THEN 1.0 ELSE 0 END)
      + (CASE WHEN band_gap <= 8 THEN 1.5 ELSE 0 END) + (CASE WHEN electronegativity BETWEEN 0.7 AND 2.8 THEN 1.0 ELSE 0 END)
      + (CASE WHEN atomic_radius BETWEEN 0.8 AND 2.5 THEN 1.0 ELSE 0 END) AS DOUBLE)"""

PRIORITY_SQL = """
    (CAST(1 AS DOUBLE) - least(greatest(energy_above_hull, 0), 1)) * CAST(0.4 AS DOUBLE) + {p} * CAST(0.3 AS DOUBLE)
    + least(greatest(energy_above_hull, 0), CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE) * CAST(0.2 AS DOUBLE)
    + CAST(1 AS DOUBLE) / (1 + nsites / CAST(10 AS DOUBLE)) * CAST(0.1 AS DOUBLE)"""

NUMBER_OF = {s: z for z, s in enumerate(refdata.ATOMIC_WEIGHTS, start=1)}

# Name -> (names it needs, text). Texts are put in front of an oracle only when it mentions them.
CTES: dict[str, str] = {
    "weights": values("w", "atomic_number, symbol, atomic_weight", [(z, s, w) for z, (s, w) in enumerate(refdata.ATOMIC_WEIGHTS.items(), 1)]),
    "alloy_elements": values(
        "e", "symbol, atomic_number, electronegativity, atomic_radius, melting_point, boiling_point, density",
        [(x[0], NUMBER_OF[x[0]], *x[1:]) for x in refdata.ALLOY_ELEMENTS],
    ),
    "solution_elements": values("h", "symbol, radius, chi, valence, structure", refdata.SOLUTION_ELEMENTS),
    "methods": values(
        "m",
        "method_order, method_key, method_name, description, temperature_min, temperature_max, temperature_typical, atmosphere, "
        "equipment_needed, prep_time_hours, synthesis_time_hours, cooling_time_hours, success_probability, estimated_cost_usd, "
        "precursors, best_for, limitations, reference",
        [(i, *m) for i, m in enumerate(refdata.METHODS, 1)],
    ),
    "pairs": values("p", "pair_index, pair_1, pair_2", [(i, a, b) for i, (a, b) in enumerate(refdata.ALLOY_PAIRS)]),
    "materials": "SELECT l_orderkey AS order_id, " + ", ".join(f"{e} AS {c}" for c, e in tables.MATERIAL_COLUMNS.items()) + " FROM lineitem",
    "full_materials": f"SELECT *, {formula_sql()} AS formula, list_filter([element_1, element_2, element_3], lambda e: e IS NOT NULL) AS elements FROM materials",
    "std": "SELECT * REPLACE (coalesce(band_gap, CAST(0 AS DOUBLE)) AS band_gap, CAST(nsites AS DOUBLE) AS nsites) FROM full_materials",
    "stab": f"""SELECT *, {STABILITY_SCORE_SQL} AS thermodynamic_stability_score,
      {by_hull_sql("'highly_stable'", "'marginal'", "'unstable'")} AS thermodynamic_stability_category FROM std""",
    "ruled": f"""SELECT *, CAST(1 AS DOUBLE) / (1 + exp((rule_score - 5) * -2)) AS rule_probability
      FROM (SELECT *, {RULE_SCORE_SQL} AS rule_score FROM stab)""",
    "ens": """SELECT *, CASE WHEN ensemble_probability >= 0.5 THEN 1 ELSE 0 END AS ensemble_prediction,
      least(greatest(abs(ensemble_probability - 0.5) * 2 * (1 - abs(synthesizability_probability - rule_probability) * CAST(0.35 AS DOUBLE)), 0), 1) AS ensemble_confidence
      FROM (SELECT *, ml_weight * synthesizability_probability + (1 - ml_weight) * rule_probability AS ensemble_probability
      FROM (SELECT *, CASE WHEN in_distribution = 'in-dist' THEN CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) - CAST(0.1 AS DOUBLE) END AS ml_weight FROM ruled))""",
    "prio": f"SELECT *, {PRIORITY_SQL.format(p='ensemble_probability')} AS synthesis_priority_score FROM ens",
    "outcomes": "SELECT o.*, f.formula FROM (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in tables.OUTCOME_COLUMNS.items())
    + " FROM events) o LEFT JOIN (SELECT order_id, arg_min(formula, material_id) AS formula FROM full_materials GROUP BY order_id) f ON o.outcome_id = f.order_id",
    "method_scores": """SELECT p.material_id, m.method_order, m.method_key,
      CAST(CASE m.method_key
        WHEN 'arc_melting' THEN (CASE WHEN band_gap < 2 THEN 3.0 ELSE 0 END) + (CASE WHEN density > 6 THEN 1.0 ELSE 0 END)
        WHEN 'induction_melting' THEN (CASE WHEN band_gap < 2 THEN 2.5 ELSE 0 END)
        WHEN 'resistance_furnace' THEN (CASE WHEN thermodynamic_stability_score > 0.6 THEN 2.0 ELSE 0 END) + (CASE WHEN band_gap > 1.5 THEN 1.5 ELSE 0 END)
        WHEN 'vacuum_arc_melting' THEN (CASE WHEN band_gap < 2 THEN 2.5 ELSE 0 END) + (CASE WHEN thermodynamic_stability_score < 0.7 THEN 1.0 ELSE 0 END)
        WHEN 'plasma_arc_melting' THEN 0.0
        WHEN 'solid_state_reaction' THEN (CASE WHEN thermodynamic_stability_score > 0.7 THEN 3.0 ELSE 0 END) + (CASE WHEN ensemble_probability > 0.7 THEN 1.5 ELSE 0 END) + 1.0
        WHEN 'chemical_vapor_deposition' THEN (CASE WHEN thermodynamic_stability_score < 0.6 THEN 2.0 ELSE 0 END) + (CASE WHEN band_gap > 1 THEN 1.5 ELSE 0 END)
        ELSE (CASE WHEN thermodynamic_stability_score < 0.6 THEN 2.5 ELSE 0 END) + (CASE WHEN band_gap < 2 THEN 1.0 ELSE 0 END) END AS DOUBLE)
      * m.success_probability / (m.estimated_cost_usd / 100) AS method_score
      FROM prio p CROSS JOIN methods m""",
    "best_method": """SELECT material_id, method_key, method_score FROM (SELECT *, row_number() OVER (PARTITION BY material_id
      ORDER BY round(method_score, 12) DESC, method_order) AS k FROM method_scores) WHERE k = 1""",
    "costed": """SELECT *, expected_value - expected_cost AS net_benefit, expected_value / expected_cost AS benefit_cost_ratio
      FROM (SELECT *, total_cost / adjusted AS expected_cost, base_value * thermodynamic_stability_score * ensemble_probability * adjusted AS expected_value
      FROM (SELECT p.*, b.method_key, b.method_score, m.method_name,
        least(greatest(m.success_probability * p.thermodynamic_stability_score * p.ensemble_probability * CAST(1.1 AS DOUBLE), CAST(0.1 AS DOUBLE)), CAST(0.95 AS DOUBLE)) AS adjusted,
        50 * m.prep_time_hours + 75 * m.synthesis_time_hours + 25 * m.cooling_time_hours + CAST(0.4 AS DOUBLE) * m.estimated_cost_usd AS total_cost,
        CAST(CASE WHEN p.band_gap > 2.5 THEN 50000 WHEN p.band_gap > 1.5 THEN 30000 WHEN p.band_gap < 0.5 THEN 20000 ELSE 15000 END AS DOUBLE) AS base_value
        FROM prio p JOIN best_method b ON p.material_id = b.material_id JOIN methods m ON m.method_key = b.method_key))""",
    "weighed": """SELECT *, mass_1 / mass_total * 100 AS weight_percent_1, mass_2 / mass_total * 100 AS weight_percent_2, mass_3 / mass_total * 100 AS weight_percent_3
      FROM (SELECT *, coalesce(mass_1, 0) + coalesce(mass_2, 0) + coalesce(mass_3, 0) AS mass_total FROM (
      SELECT f.*, CASE WHEN f.element_1 IS NOT NULL AND f.composition_1 > 0 THEN f.composition_1 * coalesce(w1.atomic_weight, 1) END AS mass_1,
        CASE WHEN f.element_2 IS NOT NULL AND f.composition_2 > 0 THEN f.composition_2 * coalesce(w2.atomic_weight, 1) END AS mass_2,
        CASE WHEN f.element_3 IS NOT NULL AND f.composition_3 > 0 THEN f.composition_3 * coalesce(w3.atomic_weight, 1) END AS mass_3
      FROM full_materials f LEFT JOIN weights w1 ON f.element_1 = w1.symbol LEFT JOIN weights w2 ON f.element_2 = w2.symbol
      LEFT JOIN weights w3 ON f.element_3 = w3.symbol))""",
    "gated": """SELECT *, list_filter(elements, lambda e: list_contains(['Be','Hg','Cd','Pb','As','Tl','Sb','Bi','Po','Ra','Rn','Th','U','Pu'], e)) AS hazards FROM prio""",
    "classed": """SELECT *, CASE WHEN len(hazards) = 0 AND ensemble_probability >= 0.8 AND thermodynamic_stability_category = 'highly_stable' AND in_distribution = 'in-dist' THEN 'safe'
      WHEN ensemble_probability >= 0.8 THEN 'human_review' ELSE 'unsafe' END AS safety_class FROM gated""",
    # Second route: stable rows only, fixed weights.
    "route_gated": """SELECT *, list_filter(elements, lambda e: list_contains(['Be','Hg','Cd','Pb','As','Tl','Sb','Bi','Po','Ra','Rn','Th','U','Pu'], e)) AS hazards
      FROM (SELECT *, abs(ensemble_probability - 0.5) * 2 AS ensemble_confidence, CASE WHEN ensemble_probability >= 0.5 THEN 1 ELSE 0 END AS ensemble_prediction
      FROM (SELECT *, CAST(1 AS DOUBLE) / (1 + exp((rule_score - 5) * -2)) AS rule_probability,
        synthesizability_probability * CAST(0.7 AS DOUBLE) + (CAST(1 AS DOUBLE) / (1 + exp((rule_score - 5) * -2))) * (1 - CAST(0.7 AS DOUBLE)) AS ensemble_probability
      FROM (SELECT *, """ + RULE_SCORE_SQL + " AS rule_score, " + STABILITY_SCORE_SQL + " AS thermodynamic_stability_score, "
    + by_hull_sql("'highly_stable'", "'marginal'", "'unstable'") + """ AS thermodynamic_stability_category
      FROM full_materials WHERE energy_above_hull <= 0.1 AND formation_energy_per_atom BETWEEN -10 AND 2)))""",
    "route": """SELECT *, synthesis_priority_score * CAST(0.6 AS DOUBLE) + composite_priority_score * CAST(0.4 AS DOUBLE) AS final_priority_score
      FROM (SELECT *, ensemble_confidence * CAST(0.5 AS DOUBLE) + ensemble_probability * CAST(0.3 AS DOUBLE) + safety_rating * CAST(0.2 AS DOUBLE) AS composite_priority_score, """
    + PRIORITY_SQL.format(p="ensemble_probability") + """ AS synthesis_priority_score
      FROM (SELECT *, CAST(CASE WHEN safety_class = 'safe' THEN 1.0 WHEN safety_class = 'human_review' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS safety_rating,
        safety_class = 'safe' AS safety_check_passed, safety_class = 'human_review' AS requires_human_override
      FROM (SELECT *, CASE WHEN len(hazards) = 0 AND ensemble_probability >= 0.8 AND thermodynamic_stability_category = 'highly_stable' AND in_distribution = 'in-dist' THEN 'safe'
        WHEN ensemble_probability >= 0.8 THEN 'human_review' ELSE 'unsafe' END AS safety_class FROM route_gated)))""",
    "route_cost": """SELECT *, value * success AS expected_value, CASE WHEN success > 0 THEN total_cost / success END AS expected_cost
      FROM (SELECT *, CAST(CASE method WHEN 'arc_melting' THEN 508 WHEN 'solid_state' THEN 1148 ELSE 3372 END AS DOUBLE) AS total_cost,
        CASE method WHEN 'arc_melting' THEN least(CAST(0.9 AS DOUBLE), s * q * CAST(1.2 AS DOUBLE)) WHEN 'solid_state' THEN least(CAST(0.8 AS DOUBLE), s * q * CAST(1.1 AS DOUBLE)) ELSE least(CAST(0.6 AS DOUBLE), s * q) END AS success,
        CAST(CASE WHEN band_gap > 1.5 THEN 10000 ELSE 5000 END AS DOUBLE) * s * q AS value
      FROM (SELECT *, CASE WHEN band_gap < 2 THEN 'arc_melting' WHEN s > 0.7 THEN 'solid_state' ELSE 'cvd' END AS method
      FROM (SELECT *, least(greatest(1 - energy_above_hull / CAST(0.5 AS DOUBLE), 0), 1) AS s, synthesizability_probability AS q FROM {source})))""",
    "pair_rows": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY pair_index) AS d
      FROM (SELECT f.*, p.*, row_number() OVER (PARTITION BY pair_index ORDER BY material_id) AS k
      FROM full_materials f JOIN pairs p ON list_contains(f.elements, p.pair_1) AND list_contains(f.elements, p.pair_2)
      WHERE energy_above_hull <= 0.5 AND nsites <= 10) WHERE k <= {limit}) WHERE d = 1""",
}
CTES["route_costed"] = CTES.pop("route_cost").format(source="route")
CTES["simple_costed"] = CTES["route_costed"].replace("FROM route)", "FROM full_materials)")
PAIR_ROWS = CTES.pop("pair_rows")
CTES["train_rows"] = PAIR_ROWS.format(limit=66)
CTES["dataset_rows"] = PAIR_ROWS.format(limit=33)
CTES["pair_all"] = PAIR_ROWS.replace("<= 0.5 AND", "<= 0.05 AND").replace("k <= {limit}", "true")
CTES["pair_train_all"] = PAIR_ROWS.replace("k <= {limit}", "true")
CTES["pair_train_50"] = PAIR_ROWS.format(limit=50)
# Classifier features of a set of pair rows: element means, three largest fractions, means for nulls.
FEATURES = """SELECT material_id, composition_1, composition_2, composition_3, density, electronegativity, atomic_radius,
      coalesce(band_gap, avg(band_gap) OVER ()) AS band_gap, energy_above_hull, formation_energy_per_atom, CAST(nsites AS INT) AS nsites
      FROM (SELECT t.material_id, t.density, t.band_gap, t.energy_above_hull, t.formation_energy_per_atom, t.nsites,
        coalesce((SELECT avg(e.electronegativity) FROM alloy_elements e WHERE list_contains(t.elements, e.symbol)), 0) AS electronegativity,
        coalesce((SELECT avg(e.atomic_radius) FROM alloy_elements e WHERE list_contains(t.elements, e.symbol)), 0) AS atomic_radius,
        c[1] / total AS composition_1, c[2] / total AS composition_2, coalesce(c[3], 0) / total AS composition_3
      FROM (SELECT *, list_sort(list_filter([composition_1, composition_2, composition_3], lambda x: x > 0), 'DESC') AS c,
        composition_1 + composition_2 + composition_3 AS total FROM {source}) t)"""
CTES["train_features"] = FEATURES.format(source="train_rows")
CTES["dataset_features"] = FEATURES.format(source="dataset_rows")
CTES["pair_features"] = FEATURES.format(source="pair_train_all")
CTES["alloy_raw"] = """SELECT material_id, formula AS formula_pretty, element_1 AS elem_1, element_2 AS elem_2, element_3 AS elem_3,
      composition_1 AS comp_1, composition_2 AS comp_2, composition_3 AS comp_3, formation_energy_per_atom AS formation_energy,
      energy_above_hull AS e_above_hull, energy_above_hull + 1 AS stability_energy,
      CASE WHEN band_gap IS NULL THEN 'n/a' WHEN nsites = 9 THEN NULL ELSE CAST(nsites * 3 AS VARCHAR) END AS bandgap, nsites AS num_sites,
      CASE WHEN nsites <> 7 THEN density END AS mass_density, electronegativity AS electronegativity_avg, atomic_radius AS atomic_radius_avg FROM full_materials"""


def aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials under other column names: two names for the hull energy, the gap as text with unreadable entries."""
    return full(spark, sf_dir).select(
        "material_id", F.col("formula").alias("formula_pretty"),
        *[F.col(f"element_{i}").alias(f"elem_{i}") for i in (1, 2, 3)],
        *[F.col(f"composition_{i}").alias(f"comp_{i}") for i in (1, 2, 3)],
        F.col("formation_energy_per_atom").alias("formation_energy"),
        F.col("energy_above_hull").alias("e_above_hull"),
        (F.col("energy_above_hull") + 1).alias("stability_energy"),
        F.when(F.col("band_gap").isNull(), "n/a").when(F.col("nsites") != 9, (F.col("nsites") * 3).cast("string")).alias("bandgap"),
        F.col("nsites").alias("num_sites"),
        F.when(F.col("nsites") != 7, F.col("density")).alias("mass_density"),
        F.col("electronegativity").alias("electronegativity_avg"),
        F.col("atomic_radius").alias("atomic_radius_avg"),
    )


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None


def with_ctes(sql: str) -> str:
    """``sql`` preceded by the fragments it needs, in order of dependence."""
    needed: dict[str, str] = {}

    def add(text: str, own: str | None = None) -> None:
        for name, body in CTES.items():
            if name != own and name not in needed and _mentions(text, name):
                add(body, name)
                needed[name] = body

    add(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in needed.items()) + "\n" + sql
