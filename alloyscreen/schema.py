"""Canonical materials schema, column aliases and value rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, aliases, defaults and ranges of the materials data model.

CANONICAL_TYPES = {
    "formation_energy_per_atom": "double",
    "energy_above_hull": "double",
    "band_gap": "double",
    "nsites": "int",
    "density": "double",
    "electronegativity": "double",
    "atomic_radius": "double",
    "composition_1": "double",
    "composition_2": "double",
    "composition_3": "double",
    "element_1": "string",
    "element_2": "string",
    "element_3": "string",
    "formula": "string",
    "melting_point": "double",
}

# The first alias present in a table wins.
ALIASES = {
    "formation_energy_per_atom": [
        "formation_energy_per_atom", "formation_energy", "energy_per_atom", "e_form", "formation_energy_atom",
        "energy_formation_per_atom", "formation_energy_ev_atom", "energy_per_atom_ev",
    ],
    "energy_above_hull": [
        "energy_above_hull", "e_above_hull", "hull_energy", "stability_energy", "energy_hull", "above_hull",
        "energy_above_convex_hull", "energy_above_hull_ev_atom", "stability_energy_ev_atom",
    ],
    "band_gap": [
        "band_gap", "bandgap", "gap", "electronic_gap", "band_gap_eV", "electronic_band_gap", "optical_gap",
        "band_gap_ev",
    ],
    "nsites": ["nsites", "num_sites", "sites", "unit_cell_sites", "n_sites", "number_of_sites", "total_sites"],
    "density": [
        "density", "mass_density", "material_density", "bulk_density", "density_g_cm3", "density_g_per_cm3",
    ],
    "electronegativity": [
        "electronegativity", "avg_electronegativity", "electronegativity_avg", "electronegativity_average",
        "pauling_electronegativity", "electronegativity_pauling",
    ],
    "atomic_radius": [
        "atomic_radius", "avg_atomic_radius", "atomic_radius_avg", "atomic_radius_average", "covalent_radius",
        "atomic_size", "atomic_radius_angstrom",
    ],
    "composition_1": [
        "composition_1", "comp_1", "composition1", "atomic_fraction_1", "element1_fraction", "fraction_1",
    ],
    "composition_2": [
        "composition_2", "comp_2", "composition2", "atomic_fraction_2", "element2_fraction", "fraction_2",
    ],
    "composition_3": [
        "composition_3", "comp_3", "composition3", "atomic_fraction_3", "element3_fraction", "fraction_3",
    ],
    "element_1": ["element_1", "elem_1", "element1", "first_element", "primary_element"],
    "element_2": ["element_2", "elem_2", "element2", "second_element", "secondary_element"],
    "element_3": ["element_3", "elem_3", "element3", "third_element", "tertiary_element"],
    "formula": ["formula", "chemical_formula", "formula_pretty", "composition_formula"],
    "melting_point": ["melting_point", "melting_temp", "mp", "melting_temperature"],
}

CLASSIFIER_FIELDS = [
    "formation_energy_per_atom", "energy_above_hull", "band_gap", "nsites", "density", "electronegativity",
    "atomic_radius",
]
SCREENING_FIELDS = [*CLASSIFIER_FIELDS, "composition_1", "composition_2", "element_1", "element_2", "formula"]
GENERATOR_FIELDS = [
    "composition_1", "composition_2", "formation_energy_per_atom", "density", "electronegativity", "atomic_radius",
]
COMPOSITION_FIELDS = ["composition_1", "composition_2", "composition_3"]

# A present but null or unreadable classifier field gets this value.
NULL_DEFAULTS = {
    "formation_energy_per_atom": 0.1,
    "energy_above_hull": 0.1,
    "band_gap": 0.0,
    "nsites": 4.0,
    "density": 7.8,
    "electronegativity": 1.8,
    "atomic_radius": 1.3,
}

# A field that is absent altogether gets this value.
ABSENT_DEFAULTS = {
    "formation_energy_per_atom": -1.5,
    "energy_above_hull": 0.08,
    "band_gap": 0.5,
    "nsites": 6,
    "density": 7.0,
    "electronegativity": 1.8,
    "atomic_radius": 1.4,
    "composition_1": 0.5,
    "composition_2": 0.5,
    "composition_3": 0.0,
    "element_1": "Al",
    "element_2": "Ti",
    "element_3": None,
    "formula": None,
    "melting_point": 1500.0,
}

VALUE_RANGES = {
    "composition_1": (0.0, 1.0),
    "composition_2": (0.0, 1.0),
    "melting_point": (0.0, 10000.0),
    "boiling_point": (0.0, 10000.0),
    "density": (0.0, 100.0),
    "electronegativity": (0.0, 4.0),
    "atomic_radius": (0.0, 5.0),
    "formation_energy_per_atom": (-10.0, 5.0),
    "energy_above_hull": (0.0, 10.0),
    "band_gap": (0.0, 20.0),
    "total_magnetization": (-10.0, 10.0),
    "nsites": (1.0, 500.0),
    "volume": (0.0, 10000.0),
}

MATERIALS_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("material_id", "formula", "alloy_type")]
    + [T.StructField(f"element_{i}", T.StringType()) for i in (1, 2, 3)]
    + [T.StructField(f"composition_{i}", T.DoubleType()) for i in (1, 2, 3)]
    + [T.StructField("elements", T.ArrayType(T.StringType()))]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "melting_point", "boiling_point", "density", "electronegativity", "electronegativity_difference",
            "atomic_radius", "formation_energy_per_atom", "energy_above_hull", "band_gap", "total_magnetization",
            "volume", "atomic_density",
        )
    ]
    + [T.StructField("nsites", T.IntegerType())]
)

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("formula", T.StringType()),
        T.StructField("attempted_date", T.TimestampType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("ml_pred", T.DoubleType()),
        T.StructField("llm_pred", T.DoubleType()),
        T.StructField("e_hull", T.DoubleType()),
        T.StructField("notes", T.StringType()),
    ]
)

OUTCOME_SUCCESS = "Successful"
OUTCOME_POSITIVE = ["Successful", "Partial success"]
