import math

import pytest
from pyspark.sql import functions as F

from alloyscreen import refdata
from alloyscreen.functions import composition, ensemble, methods, safety, stability


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def row_of(spark, **values):
    kinds = {str: "string", float: "double", int: "int", type(None): "double", list: "array<string>"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


@pytest.mark.parametrize("hull, expected", [(0.0, "highly_stable"), (0.025, "highly_stable"), (0.05, "marginal"), (0.1, "marginal"), (0.11, "risky")])
def test_stability_category(spark, hull, expected):
    assert one(row_of(spark, h=hull), stability.stability_category(F.col("h"))) == expected


def test_stability_info_of_an_unstable_row(spark):
    info = one(row_of(spark, h=0.4), stability.stability_info(F.col("h")))
    assert info["synthesis_confidence"] == 0.2 and math.isinf(info["threshold_used"])


def test_stability_score(spark):
    score = lambda **v: stability.with_stability(row_of(spark, **v)).first()
    assert score(energy_above_hull=0.01)["thermodynamic_stability_score"] >= 0.8
    bad = score(energy_above_hull=0.5)
    assert (bad["thermodynamic_stability_category"], bad["stability_color"]) == ("unstable", "red")
    near = lambda **v: score(energy_above_hull=0.05, **v)["thermodynamic_stability_score"]
    assert near(band_gap=2.0) > near(band_gap=0.0)
    assert near(formation_energy_per_atom=-15.0) < near(formation_energy_per_atom=-1.0)
    assert score(energy_above_hull=0.01, band_gap=1.0)["thermodynamic_stability_score"] == pytest.approx(0.99)
    # A null inside an existing column is no penalty and no bonus.
    assert near(density=None) == near()


GOOD = dict(energy_above_hull=0.01, formation_energy_per_atom=-2.0, nsites=4, density=7.0, band_gap=0.5, electronegativity=1.8, atomic_radius=1.4)
BAD = dict(energy_above_hull=0.6, formation_energy_per_atom=3.0, nsites=50, density=40.0, band_gap=9.0, electronegativity=3.5, atomic_radius=3.0)


def test_rules(spark):
    good, bad = (stability.with_rules(row_of(spark, **r), reasons=True).first() for r in (GOOD, BAD))
    assert good["rule_score"] == 9.0 and good["rule_prediction"] == 1 and bad["rule_prediction"] == 0 and bad["rule_score"] < 5
    assert good["rule_probability"] == pytest.approx(1 / (1 + math.exp(-8)))
    assert good["rule_reasons"][0] == "Low energy above hull (0.010 eV/atom) indicates stability"
    assert bad["rule_reasons"][2] == "Unit cell size (50 sites) is very large" and len(bad["rule_reasons"]) == 7


def test_labels(spark):
    df = spark.createDataFrame([(0.025,), (0.05,), (0.1,), (None,)], "energy_above_hull double")
    assert [r["synthesizable"] for r in stability.label_stability(df).collect()] == [1, 0]
    assert [r["synthesizable"] for r in stability.label_proxy(df).collect()] == [1, 1, 1, 0]


def test_precursors(spark):
    names = lambda **v: [p["method"] for p in one(row_of(spark, **v), stability.precursor_routes(row_of(spark, **v)))]
    assert names(energy_above_hull=0.0, band_gap=0.0) == ["Solid State Reaction", "Arc Melting", "Chemical Vapor Deposition"]
    assert names(energy_above_hull=0.5, band_gap=3.0) == ["Chemical Vapor Deposition"]


def test_weight_percent(spark):
    two = composition.with_composition_text(row_of(spark, element_1="Al", element_2="Ti", composition_1=0.5, composition_2=0.5)).first()
    assert two["total_weight_percent"] == pytest.approx(100) and two["weight_percent_1"] == pytest.approx(26.982 / (26.982 + 47.867) * 100)
    assert two["wt%"] == "Al: 36.0%; Ti: 64.0%" and two["feedstock_g_per_100g"] == "36.0g Al, 64.0g Ti"
    three = composition.with_weight_percent(row_of(
        spark, element_1="Al", element_2="Ti", element_3="Xx", composition_1=0.3, composition_2=0.3, composition_3=0.4)).first()
    assert three["total_weight_percent"] == pytest.approx(100)
    none = composition.with_composition_text(row_of(spark, x=1)).first()
    assert none["total_weight_percent"] == 0 and none["feedstock_g_per_100g"] == "No elements found"


def test_formula_text(spark):
    df = row_of(spark, x=1)
    arrays = lambda e, f: one(df, composition.formula_text(F.array(*map(F.lit, e)), F.array(*map(F.lit, f))))
    assert arrays(["Al", "Ti"], [0.5, 0.5]) == "Al0.500Ti0.500"
    assert arrays(["Al", "Ti"], [1.0]) == "Invalid"
    assert one(row_of(spark, element_1="Al", composition_1=0.25), composition.slots_formula(row_of(spark, element_1="Al", composition_1=0.25))) == "Al0.250"


def top(df):
    row = composition.with_top_fractions(df).first()
    return [row[f"composition_{i}"] for i in (1, 2, 3)]


@pytest.mark.parametrize("formula, expected", [
    ("Al2Cu", (2 / 3, 1 / 3, 0)), ("AlTiAl", (2 / 3, 1 / 3, 0)), ("Al.5Co.5", (0.5, 0.5, 0)), ("CCoHO2", (0.4, 0.2, 0.2)), ("Fe0.2Ni0.3Co0.4V0.1", (0.4, 0.3, 0.2)), ("Xx2", (1 / 3, 1 / 3, 1 / 3)), ("(", (1 / 3, 1 / 3, 1 / 3)),
])
def test_top_fractions(spark, formula, expected):
    df = row_of(spark, formula=formula, elements=["Al", "Fe", "V"])
    assert top(df) == pytest.approx(expected)


@pytest.mark.parametrize("formula, expected", [
    ("Ba(FeAs)2", (0.4, 0.4, 0.2)), ("Ca(OH)2", (0.4, 0.4, 0.2)), ("Fe2(SO4)3", (12 / 17, 3 / 17, 2 / 17)), ("(NH4)2SO4", (8 / 15, 4 / 15, 2 / 15)),
    ("K4[Fe(CN)6]", (6 / 17, 6 / 17, 4 / 17)), ("{[(Al2)2]2Ti}0.5", (8 / 9, 1 / 9, 0)), ("(Fe0.5Co.5)2O", (1 / 3, 1 / 3, 1 / 3)), ("Al(TiAl)", (2 / 3, 1 / 3, 0)), ("(Al)0Ti", (1, 0, 0)),
    ("((Al2)3(Ti)2)1.5Cu", (9 / 13, 3 / 13, 1 / 13)),
])
def test_bracketed_fractions(spark, formula, expected):
    assert top(row_of(spark, formula=formula, elements=["Al", "Fe", "V"])) == pytest.approx(expected)


@pytest.mark.parametrize("formula", ["Ca(OH", "CaOH)2", "(Al]2", "Al()2", "[(Al]2)3", ")Al(", "Al(2Ti)", "Al (Ti)", "(Xx)2", "(Al)0"])
def test_unreadable_brackets_give_equal_shares(spark, formula):
    assert top(row_of(spark, formula=formula, elements=["Al", "Fe", "V"])) == pytest.approx((1 / 3, 1 / 3, 1 / 3))


def test_brackets_beside_flat_formulas(spark):
    df = spark.createDataFrame([(1, "Ba(FeAs)2"), (2, "Al2Cu"), (3, None), (4, "Ca(OH)2")], "id int, formula string")
    got = {r.id: r.n for r in composition.with_formula_amounts(df, "formula", "n").collect()}
    assert got == {1: [1.0, 2.0, 2.0], 2: [2.0, 1.0], 3: None, 4: [1.0, 2.0, 2.0]}


@pytest.mark.parametrize("formula, expected", [
    ("Ba(FeAs)2", [1.0, 2.0, 2.0]), ("Al.5Ti5.Al", [1.5, 5.0]), ("{[(Al2)2]2Ti}0.5", [4.0, 0.5]), ("Fe7(NiO3)4[H(N2)3]1.5", [7.0, 4.0, 12.0, 1.5, 9.0]),
    ("(" * 40 + "Al" + ")2" * 40, [2.0**40]), ("(Al]2", None), ("(Al", None), ("Al)2", None),
])
def test_formula_amounts(formula, expected):
    assert composition.formula_amounts(formula) == expected


def test_formulas_are_not_folded_in_expressions(spark, capsys):
    df = spark.createDataFrame([(1, "Ba(FeAs)2"), (2, "Al2.5CuAl"), (3, "Xx2"), (4, ""), (5, None), (6, "(Al]2")], "id int, formula string")
    out = composition.with_formula_amounts(df, "formula", "n")
    assert {r.id: r.n for r in out.collect()} == {1: [1.0, 2.0, 2.0], 2: [3.5, 1.0], 3: None, 4: None, 5: None, 6: None}
    out.explain("formatted")
    assert "lambda" not in capsys.readouterr().out


def test_top_fractions_without_anything(spark):
    df = row_of(spark, x=1)
    assert top(df) == [0.0, 0.0, 0.0]
    four = row_of(spark, elements=["A", "B", "C", "D"])
    assert top(four) == [0.25, 0.25, 0.25]


def test_composition_limits(spark):
    df = row_of(spark, composition_1=0.99, composition_2=0.01)
    assert composition.with_clamped_binary(df).first()[:2] == pytest.approx((0.95, 0.05))
    with pytest.raises(ValueError):
        composition.with_clamped_binary(df, 0.5, 0.5)
    shares = one(df, composition.normalized_fractions(F.array(F.lit(0.9), F.lit(0.9), F.lit(0.1))))
    assert sum(shares) == pytest.approx(1)


@pytest.mark.parametrize("text, expected", [("=1+1", "'=1+1"), (" \t@x", "' \t@x"), ("-a", "'-a"), ("a=b", "a=b"), ("", ""), (None, None)])
def test_neutral_cells(spark, text, expected):
    df = spark.createDataFrame([(text, 1)], "a string, n int")
    assert composition.with_neutral_cells(df).first() == (expected, 1)


def test_ensemble(spark):
    row = lambda place: ensemble.with_ensemble(row_of(
        spark, synthesizability_probability=0.9, rule_probability=0.5, **({"in_distribution": place} if place else {}))).first()
    assert row("in-dist")["ensemble_probability"] == pytest.approx(0.85 * 0.9 + 0.15 * 0.5)
    assert row("out-dist")["ensemble_probability"] == pytest.approx(0.6 * 0.9 + 0.4 * 0.5)
    assert row(None)["ensemble_probability"] == pytest.approx(0.7 * 0.9 + 0.3 * 0.5)
    assert row(None)["ensemble_confidence"] == pytest.approx(2 * 0.28 * (1 - 0.35 * 0.4))


SAFE = dict(element_1="Al", element_2="Ti", ensemble_probability=0.9, thermodynamic_stability_category="highly_stable", in_distribution="in-dist")


def gate(spark, override=False, safe_mode=True, **changes):
    return safety.with_safety_check(row_of(spark, **{**SAFE, **changes}), safe_mode, override).first()


def test_safety_gate(spark):
    assert gate(spark)["safety_reason"] == "Safe for export"
    lead = gate(spark, element_2="Pb")
    assert not lead["safety_check_passed"] and lead["safety_reason"] == "Contains hazardous elements: Pb"
    eased = gate(spark, override=True, element_2="Pb")
    assert eased["safety_check_passed"] and eased["safety_warnings"] == "Human override approved for hazardous elements: Pb"
    # An override never rescues a low probability, and a missing one fails.
    assert not gate(spark, override=True, ensemble_probability=0.79)["safety_check_passed"]
    assert not gate(spark, override=True, ensemble_probability=None)["safety_check_passed"]
    assert gate(spark, safe_mode=False, ensemble_probability=0.6, thermodynamic_stability_category="marginal")["safety_check_passed"]
    assert not gate(spark, safe_mode=False, thermodynamic_stability_category="unstable")["safety_check_passed"]
    assert gate(spark, safe_mode=False, in_distribution="out-dist")["safety_warnings"].startswith("Out-of-distribution")
    assert not gate(spark, in_distribution="out-dist")["safety_check_passed"]


def test_safety_classes_and_rating(spark):
    kind = lambda **v: safety.with_safety_rating(row_of(spark, **{**SAFE, **v})).first()["safety_rating"]
    assert (kind(), kind(element_1="Cd"), kind(ensemble_probability=0.1)) == (1.0, 0.5, 0.0)
    closed = {**refdata.HAZARD_POLICY, "human_override_allowed": False}
    assert safety.with_safety_class(row_of(spark, **{**SAFE, "element_1": "Cd"}), policy=closed).first()["safety_class"] == "unsafe"


def test_notes(spark):
    df = row_of(spark, thermodynamic_stability_category="marginal", in_distribution="out-dist")
    assert one(df, safety.lab_notes(df)) == "Marginally stable - proceed with care; Out-of-distribution - predictions less reliable"
    assert one(row_of(spark, x=1), safety.lab_notes(row_of(spark, x=1))) == "No special notes"


def test_methods(spark):
    df = row_of(spark, energy_above_hull=0.01, band_gap=0.0, density=8.0, ensemble_probability=0.9, thermodynamic_stability_score=0.9)
    best = methods.with_cost_benefit(df).first()
    assert best["method_key"] == "solid_state_reaction" and best["total_cost"] == pytest.approx(2120)
    assert best["success_probability"] == pytest.approx(0.9 * 0.9 * 0.9 * 1.1)
    none = methods.with_cost_benefit(df, []).first()
    assert none["method_key"] is None and none["net_benefit"] == 0 and none["recommended_method"] == "No suitable method available"
    assert methods.with_best_method(df, ["Arc Melter"]).first()["method_key"] == "arc_melting"
    assert methods.method_scores(df, keep=("density",)).count() == 8
    assert methods.method_scores(df, [], keep=("density",)).count() == 0


def test_first_method_wins_ties(spark):
    # Nothing suits: both vacuum and plasma score zero, so the earlier one is taken.
    df = row_of(spark, energy_above_hull=0.01, band_gap=3.0, density=1.0, formation_energy_per_atom=0.0)
    equipment = ["Vacuum Arc Melter", "Vacuum Chamber", "Plasma Arc Furnace"]
    assert methods.with_best_method(df, equipment).first()["method_key"] == "vacuum_arc_melting"


def test_simple_cost(spark):
    row = methods.with_simple_cost_benefit(row_of(spark, energy_above_hull=0.0, band_gap=3.0, synthesizability_probability=1.0)).first()
    assert (row["simple_method"], row["simple_total_cost"], row["simple_success_probability"]) == ("solid_state", 1148.0, 0.8)
    zero = methods.with_simple_cost_benefit(row_of(spark, energy_above_hull=0.9, band_gap=0.0)).first()
    assert zero["simple_expected_cost"] is None


def test_method_table(spark):
    from alloyscreen.sources import scans

    rows = scans.method_table(spark).collect()
    assert len(rows) == 8 and rows[0]["temperature_range"] == "2200°C (1500-3000°C)" and rows[2]["total_time_hours"] == 23
