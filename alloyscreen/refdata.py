"""Reference tables: elements, synthesis methods, stability thresholds, laboratory policy.

Every table here has a fixed number of rows (at most 118), so a broadcast of one of them cannot grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Atomic weights in g/mol, in order of atomic number.
ATOMIC_WEIGHTS = {
    "H": 1.008, "He": 4.003, "Li": 6.941, "Be": 9.012, "B": 10.811, "C": 12.011,
    "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180, "Na": 22.990, "Mg": 24.305,
    "Al": 26.982, "Si": 28.086, "P": 30.974, "S": 32.065, "Cl": 35.453, "Ar": 39.948,
    "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996,
    "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.409,
    "Ga": 69.723, "Ge": 72.640, "As": 74.922, "Se": 78.960, "Br": 79.904, "Kr": 83.798,
    "Rb": 85.468, "Sr": 87.620, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.940,
    "Tc": 98.000, "Ru": 101.070, "Rh": 102.906, "Pd": 106.420, "Ag": 107.868, "Cd": 112.411,
    "In": 114.818, "Sn": 118.710, "Sb": 121.760, "Te": 127.600, "I": 126.904, "Xe": 131.293,
    "Cs": 132.905, "Ba": 137.327, "La": 138.906, "Ce": 140.116, "Pr": 140.908, "Nd": 144.240,
    "Pm": 145.000, "Sm": 150.360, "Eu": 151.964, "Gd": 157.250, "Tb": 158.925, "Dy": 162.500,
    "Ho": 164.930, "Er": 167.259, "Tm": 168.934, "Yb": 173.040, "Lu": 174.967, "Hf": 178.490,
    "Ta": 180.948, "W": 183.840, "Re": 186.207, "Os": 190.230, "Ir": 192.217, "Pt": 195.078,
    "Au": 196.967, "Hg": 200.590, "Tl": 204.383, "Pb": 207.200, "Bi": 208.980, "Po": 210.000,
    "At": 210.000, "Rn": 222.000, "Fr": 223.000, "Ra": 226.000, "Ac": 227.000, "Th": 232.038,
    "Pa": 231.036, "U": 238.029, "Np": 237.000, "Pu": 244.000, "Am": 243.000, "Cm": 247.000,
    "Bk": 247.000, "Cf": 251.000, "Es": 252.000, "Fm": 257.000, "Md": 258.000, "No": 259.000,
    "Lr": 262.000, "Rf": 261.000, "Db": 262.000, "Sg": 266.000, "Bh": 264.000, "Hs": 269.000,
    "Mt": 268.000, "Ds": 271.000, "Rg": 272.000, "Cn": 285.000, "Nh": 284.000, "Fl": 289.000,
    "Mc": 288.000, "Lv": 292.000, "Ts": 294.000, "Og": 294.000,
}
UNKNOWN_WEIGHT = 1.0

# Atomic radius, electronegativity, valence and crystal structure for the solid-solution rules.
SOLUTION_ELEMENTS = [
    ("Al", 1.43, 1.61, 3, "FCC"),
    ("Ti", 1.47, 1.54, 4, "HCP"),
    ("V", 1.34, 1.63, 5, "BCC"),
    ("Cr", 1.28, 1.66, 6, "BCC"),
    ("Mn", 1.27, 1.55, 7, "BCC"),
    ("Fe", 1.26, 1.83, 2, "BCC"),
    ("Co", 1.25, 1.88, 2, "HCP"),
    ("Ni", 1.25, 1.91, 2, "FCC"),
    ("Cu", 1.28, 1.90, 1, "FCC"),
    ("Zn", 1.37, 1.65, 2, "HCP"),
]

# The alloy elements with electronegativity (Pauling), atomic radius (angstrom), melting point (K),
# boiling point (K) and density (g/cm3), from public handbooks.
ALLOY_ELEMENTS = [
    ("Al", 1.61, 1.25, 933.47, 2792.0, 2.70),
    ("Ti", 1.54, 1.40, 1941.0, 3560.0, 4.507),
    ("V", 1.63, 1.35, 2183.0, 3680.0, 6.11),
    ("Cr", 1.66, 1.40, 2180.0, 2944.0, 7.14),
    ("Mn", 1.55, 1.40, 1519.0, 2334.0, 7.47),
    ("Fe", 1.83, 1.40, 1811.0, 3134.0, 7.874),
    ("Co", 1.88, 1.35, 1768.0, 3200.0, 8.90),
    ("Ni", 1.91, 1.35, 1728.0, 3186.0, 8.908),
    ("Cu", 1.90, 1.35, 1357.77, 2835.0, 8.92),
    ("Zn", 1.65, 1.35, 692.68, 1180.0, 7.14),
    ("Zr", 1.33, 1.55, 2128.0, 4682.0, 6.511),
    ("Nb", 1.60, 1.45, 2750.0, 5017.0, 8.57),
    ("Mo", 2.16, 1.45, 2896.0, 4912.0, 10.28),
    ("Tc", 1.90, 1.35, 2430.0, 4538.0, 11.5),
    ("Ru", 2.20, 1.30, 2607.0, 4423.0, 12.37),
    ("Rh", 2.28, 1.35, 2237.0, 3968.0, 12.45),
    ("Pd", 2.20, 1.40, 1828.05, 3236.0, 12.023),
    ("Ag", 1.93, 1.60, 1234.93, 2435.0, 10.49),
    ("Cd", 1.69, 1.55, 594.22, 1040.0, 8.65),
    ("Hf", 1.30, 1.55, 2506.0, 4876.0, 13.31),
    ("Ta", 1.50, 1.45, 3290.0, 5731.0, 16.65),
    ("W", 2.36, 1.35, 3695.0, 5828.0, 19.25),
    ("Re", 1.90, 1.35, 3459.0, 5869.0, 21.02),
    ("Os", 2.20, 1.30, 3306.0, 5285.0, 22.61),
    ("Ir", 2.20, 1.35, 2739.0, 4701.0, 22.65),
    ("Pt", 2.28, 1.35, 2041.4, 4098.0, 21.09),
    ("Au", 2.54, 1.35, 1337.33, 3129.0, 19.30),
    ("Hg", 2.00, 1.50, 234.32, 629.88, 13.534),
    ("Mg", 1.31, 1.50, 923.0, 1363.0, 1.738),
    ("Ca", 1.00, 1.80, 1115.0, 1757.0, 1.55),
    ("Sr", 0.95, 2.00, 1050.0, 1655.0, 2.63),
    ("Ba", 0.89, 2.15, 1000.0, 2143.0, 3.51),
    ("Sc", 1.36, 1.60, 1814.0, 3103.0, 2.985),
    ("Y", 1.22, 1.80, 1799.0, 3609.0, 4.472),
    ("La", 1.10, 1.95, 1193.0, 3743.0, 6.146),
    ("Ce", 1.12, 1.85, 1068.0, 3633.0, 6.689),
    ("Pr", 1.13, 1.85, 1208.0, 3563.0, 6.64),
    ("Nd", 1.14, 1.85, 1297.0, 3373.0, 6.80),
    ("Sm", 1.17, 1.85, 1345.0, 2076.0, 7.353),
    ("Eu", 1.20, 1.85, 1099.0, 1800.0, 5.244),
    ("Gd", 1.20, 1.80, 1585.0, 3523.0, 7.901),
    ("Tb", 1.10, 1.75, 1629.0, 3503.0, 8.219),
    ("Dy", 1.22, 1.75, 1680.0, 2840.0, 8.551),
    ("Ho", 1.23, 1.75, 1734.0, 2993.0, 8.795),
    ("Er", 1.24, 1.75, 1802.0, 3141.0, 9.066),
    ("Tm", 1.25, 1.75, 1818.0, 2223.0, 9.321),
    ("Yb", 1.10, 1.75, 1097.0, 1469.0, 6.57),
    ("Lu", 1.27, 1.75, 1925.0, 3675.0, 9.841),
]

# Element pairs of the default binary alloy systems.
ALLOY_PAIRS = [
    ("Al", "Ti"), ("Al", "V"), ("Al", "Cr"), ("Al", "Fe"), ("Al", "Ni"), ("Al", "Cu"),
    ("Ti", "V"), ("Ti", "Cr"), ("Ti", "Fe"), ("Ti", "Ni"),
    ("V", "Cr"), ("Fe", "Co"), ("Fe", "Ni"), ("Co", "Ni"), ("Ni", "Cu"),
]

# Synthesis methods. Columns: key, name, description, lowest / highest / typical temperature in °C,
# atmosphere, equipment, preparation / synthesis / cooling hours, success probability, cost in USD, precursors,
# uses, limits, source. Their order decides ties.
METHODS = [
    ("arc_melting", "Arc Melting", "High-temperature melting using electric arc for metallic alloys",
     1500, 3000, 2200, "Ar", ["Arc Melter"], 2.0, 0.75, 1.0, 0.85, 150.0,
     ["Pure elements", "Master alloy"],
     ["Conductive metals", "High-melting alloys", "Simple binary/ternary systems"],
     ["Requires conductive samples", "Limited to metallic systems"],
     "Standard metallurgical practice for alloy synthesis"),
    ("induction_melting", "Induction Melting", "Electromagnetic induction heating for rapid melting",
     800, 2000, 1600, "Ar", ["Induction Furnace"], 1.5, 1.0, 2.0, 0.80, 200.0,
     ["Elemental powders", "Pre-alloyed ingots"],
     ["Magnetic materials", "Rapid heating required", "Medium-melting alloys"],
     ["Requires induction-compatible crucibles", "Electromagnetic interference"],
     "Widely used for ferrous and non-ferrous alloys"),
    ("resistance_furnace", "Resistance Furnace", "Joule heating in controlled atmosphere furnace",
     200, 1800, 1200, "Ar/H2", ["Resistance Furnace", "Controlled Atmosphere"], 3.0, 8.0, 12.0, 0.75, 300.0,
     ["Oxide powders", "Carbonate precursors"],
     ["Ceramic materials", "Oxide synthesis", "Long annealing times"],
     ["Slow heating/cooling", "Limited to furnace-compatible materials"],
     "Standard solid-state synthesis method"),
    ("vacuum_arc_melting", "Vacuum Arc Melting", "Arc melting under vacuum for reactive materials",
     1500, 2800, 2400, "Vacuum", ["Vacuum Arc Melter", "Vacuum Chamber"], 4.0, 1.5, 3.0, 0.70, 400.0,
     ["Pure elements", "Reactive metals"],
     ["Reactive metals", "High-purity alloys", "Titanium alloys"],
     ["Expensive equipment", "Complex vacuum system maintenance"],
     "Essential for reactive and refractory metals"),
    ("plasma_arc_melting", "Plasma Arc Melting", "Plasma torch melting for ultra-high temperatures",
     2000, 5000, 3500, "Ar/N2", ["Plasma Arc Furnace"], 5.0, 2.0, 4.0, 0.65, 600.0,
     ["Refractory metals", "High-melting compounds"],
     ["Ultra-high melting materials", "Refractory alloys", "Specialty applications"],
     ["Very expensive", "High energy consumption", "Limited availability"],
     "Used for aerospace and nuclear materials"),
    ("solid_state_reaction", "Solid State Reaction", "High-temperature reaction of solid precursors",
     600, 1400, 1000, "Air/Ar", ["Muffle Furnace"], 2.0, 24.0, 8.0, 0.90, 50.0,
     ["Oxide powders", "Mixed powders"],
     ["Ceramic compounds", "Long reaction times needed", "Cost-effective synthesis"],
     ["Slow process", "May require multiple heating cycles"],
     "Classic method for ceramic and inorganic synthesis"),
    ("chemical_vapor_deposition", "Chemical Vapor Deposition", "Gas-phase synthesis for thin films and coatings",
     300, 1200, 800, "Various gases", ["CVD Reactor", "Gas Handling System"], 6.0, 4.0, 2.0, 0.60, 500.0,
     ["Metal halides", "Organometallics", "Hydrides"],
     ["Thin films", "Coatings", "Complex compositions"],
     ["Complex precursors", "Expensive gases", "Thin film morphology"],
     "Essential for semiconductor and coating industries"),
    ("mechanical_alloying", "Mechanical Alloying", "High-energy ball milling for alloy formation",
     25, 200, 25, "Ar/Inert", ["Ball Mill", "Glove Box"], 1.0, 20.0, 1.0, 0.75, 100.0,
     ["Elemental powders", "Intermetallic compounds"],
     ["Amorphous alloys", "Nanocrystalline materials", "Difficult alloy systems"],
     ["Contamination risk", "Long milling times", "Powder handling"],
     "Standard for producing amorphous and nanostructured alloys"),
]
METHOD_DDL = (
    "method_key string, method_name string, description string, temperature_min int, temperature_max int, "
    "temperature_typical int, atmosphere string, equipment_needed array<string>, prep_time_hours double, "
    "synthesis_time_hours double, cooling_time_hours double, success_probability double, "
    "estimated_cost_usd double, precursors array<string>, best_for array<string>, limitations array<string>, "
    "reference string"
)

# Laboratory equipment by category.
EQUIPMENT = {
    "Basic Lab Equipment": ["Muffle Furnace", "Ball Mill", "Glove Box"],
    "Melting Equipment": ["Arc Melter", "Induction Furnace", "Resistance Furnace"],
    "Advanced Equipment": ["Vacuum Arc Melter", "Plasma Arc Furnace", "Vacuum Chamber"],
    "Specialized Equipment": ["CVD Reactor", "Gas Handling System", "Controlled Atmosphere"],
}

# Stability classes by upper limit of the energy above hull (eV/atom).
STABILITY_CLASSES = [
    ("highly_stable", 0.025, "Highly stable - experimentally likely", 0.9),
    ("marginal", 0.1, "Marginally stable - possible with care", 0.6),
    ("risky", float("inf"), "Unstable - high risk, not recommended", 0.2),
]

# Laboratory safety policy.
HAZARD_POLICY = {
    "blacklist_elements": ["Be", "Hg", "Cd", "Pb", "As", "Tl", "Sb", "Bi", "Po", "Ra", "Rn", "Th", "U", "Pu"],
    "radioactive_elements": ["Po", "Ra", "Rn", "Th", "U", "Pu"],
    "ensemble_probability_min": 0.8,
    "relaxed_probability_min": 0.5,
    "thermodynamic_stability_required": "highly_stable",
    "in_distribution_required": True,
    "human_override_allowed": True,
}

# Ensemble weights and live thresholds.
ENSEMBLE_POLICY = {
    "ml_weight": 0.7, "in_dist_bonus": 0.15, "out_dist_penalty": -0.10, "ml_weight_min": 0.55, "ml_weight_max": 0.9,
}
LIVE_GATE = {"min_probability": 0.8, "max_energy_above_hull": 0.15, "require_in_distribution": True}


def atomic_weights(spark: SparkSession) -> DataFrame:
    rows = [(z, s, w) for z, (s, w) in enumerate(ATOMIC_WEIGHTS.items(), start=1)]
    return spark.createDataFrame(rows, "atomic_number int, symbol string, atomic_weight double")


def alloy_elements(spark: SparkSession) -> DataFrame:
    number = {s: z for z, s in enumerate(ATOMIC_WEIGHTS, start=1)}
    rows = [(r[0], number[r[0]], ATOMIC_WEIGHTS[r[0]], *r[1:]) for r in ALLOY_ELEMENTS]
    return spark.createDataFrame(
        rows,
        "symbol string, atomic_number int, atomic_mass double, electronegativity double, atomic_radius double, "
        "melting_point double, boiling_point double, density double",
    )


def solution_elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SOLUTION_ELEMENTS, "symbol string, radius double, chi double, valence int, structure string"
    )


def synthesis_methods(spark: SparkSession) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(METHODS, start=1)]
    return spark.createDataFrame(rows, f"method_order int, {METHOD_DDL}")


def stability_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STABILITY_CLASSES, "category string, threshold_used double, description string, synthesis_confidence double"
    )


def equipment_list(spark: SparkSession) -> DataFrame:
    rows = [(c, e) for c, items in EQUIPMENT.items() for e in items]
    return spark.createDataFrame(rows, "category string, equipment string")
