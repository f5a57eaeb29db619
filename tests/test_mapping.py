import pytest
from pyspark.sql import functions as F

from alloyscreen import schema
from alloyscreen.operators import cleaning, mapping, quality


@pytest.fixture
def aliased(spark):
    rows = [(0.1, 0.02, "1.5", 4, 7.0, 1.8, 1.3), (0.2, 0.3, "n/a", 8, float("nan"), 1.7, 1.4)]
    return spark.createDataFrame(
        rows, "formation_energy double, e_above_hull double, bandgap string, num_sites int, mass_density double, "
        "electronegativity_avg double, atomic_radius_avg double")


def test_rename_takes_the_first_alias_and_leaves_the_others(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "gap double, bandgap double, Density double")
    assert mapping.rename_to_canonical(df).columns == ["gap", "band_gap", "Density"]


def test_rename_required_touches_only_required_fields(aliased):
    out = mapping.rename_required(aliased, ["density", "energy_above_hull", "melting_point"])
    assert "density" in out.columns and "energy_above_hull" in out.columns and "bandgap" in out.columns


def test_copy_keeps_the_source_and_fills_unreadable_values(aliased):
    out = mapping.copy_aliases(aliased)
    assert set(aliased.columns) < set(out.columns)
    second = out.collect()[1]
    assert second["band_gap"] == 0.0 and second["density"] == 7.8 and second["nsites"] == 8.0


def test_partial_aliases_get_defaults(spark):
    df = spark.createDataFrame([(0.5, 8.0, 0.03)], "comp_1 double, density double, energy_hull double")
    row = mapping.copy_aliases(df).first()
    assert (row["energy_above_hull"], row["density"], row["electronegativity"]) == (0.03, 8.0, 1.8)


def test_absent_columns_are_marked(spark):
    row = mapping.add_absent(spark.createDataFrame([(1,)], "x int"), ["density", "element_1"]).first()
    assert row["density"] == 7.0 and row["density_imputed"] and row["element_1"] == "Al"


def test_training_medians_replace_fixed_defaults(spark):
    assert mapping.add_absent(spark.createDataFrame([(1,)], "x int"), ["density"], {"density": 5.5}).first()["density"] == 5.5


def test_standardize_keeps_text_and_types_numbers(spark):
    df = spark.createDataFrame([("Al0.5Ti0.5", "x", "3")], "chemical_formula string, e_form string, sites string")
    row = mapping.standardize(df, ["formula", "formation_energy_per_atom", "nsites"]).first()
    assert (row["formula"], row["formation_energy_per_atom"], row["nsites"]) == ("Al0.5Ti0.5", 0.0, 3)


def test_standardize_of_an_empty_table_is_empty(aliased):
    assert mapping.standardize(aliased.limit(0), schema.CLASSIFIER_FIELDS).count() == 0


def test_safe_column(spark):
    df = spark.createDataFrame([(2.0,)], "density double")
    assert df.select(mapping.safe_column(df, "density").alias("a"), mapping.safe_column(df, "volume", 9.0).alias("b")).first() == (2.0, 9.0)


def test_quality_counts_every_row(aliased):
    report = {r["field"]: r for r in quality.quality_report(mapping.rename_to_canonical(aliased)).collect()}
    assert report["band_gap"]["unreadable_count"] == 1 and not report["band_gap"]["passed"]
    assert report["formula"]["present"] is False and report["nsites"]["passed"]


def test_quality_of_an_empty_table(aliased):
    report = quality.quality_report(mapping.rename_to_canonical(aliased).limit(0)).collect()
    assert len(report) == 15 and all(r["row_count"] == 0 for r in report)


def test_validity_and_profile(aliased):
    named = mapping.rename_to_canonical(aliased).drop("nsites")
    row = quality.field_validity(named).first()
    assert not row["all_fields_present"] and row["missing_fields"] == "nsites" and row["invalid_fields"] == "band_gap"
    assert {r["field"]: r["max_value"] for r in quality.profile(named).collect()}["energy_above_hull"] == 0.3


def test_schema_clean_fills_with_the_mean_before_limits(spark):
    df = spark.createDataFrame([(0.2, "a"), (None, "b"), (0.6, "c")], "composition_1 double, other string")
    assert [r[0] for r in cleaning.schema_clean(df).collect()] == pytest.approx([0.2, 0.4, 0.6])
    wide = spark.createDataFrame([(-1.0,), (None,), (4.0,)], "composition_1 double")
    assert [r[0] for r in cleaning.schema_clean(wide).collect()] == [0.0, 1.0, 1.0]
    assert cleaning.schema_clean(df, {}).collect() == df.collect()


def test_imputation(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (6.0,)], "x double")
    assert [r[0] for r in cleaning.mean_impute(df, ["x"]).collect()] == [1.0, 3.0, 2.0, 6.0]
    assert cleaning.medians(df, ["x"]) == {"x": 2.0}
    assert [r[0] for r in cleaning.median_impute(df, ["x"], {"x": 2.0}).collect()][1] == 2.0
    assert [r[0] for r in cleaning.median_impute(df, ["x"], {}).collect()][1] == 3.0
    assert cleaning.drop_incomplete(df, ["x"]).count() == 3


def test_nan_becomes_null_and_missing_total(spark):
    df = cleaning.nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, y string"))
    assert df.filter(F.col("x").isNull()).count() == 1
    assert quality.missing_total(df).first()[0] == 2


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "material_id string, n int")
    assert sorted(cleaning.dedupe(df, "material_id", [F.col("n")]).collect()) == [("a", 1), ("b", 3)]


def test_sanity_checks(spark):
    df = spark.createDataFrame(
        [(60.0, -0.1, 1.2, 0.5, 0.5, 0.0), (5.0, 0.1, 0.5, 0.97, 0.03, 0.0), (5.0, 0.1, 0.5, 0.5, 0.4, 0.2)],
        "density double, energy_above_hull double, synthesizability_probability double, composition_1 double, "
        "composition_2 double, composition_3 double")
    got = {r["check"]: r["violations"] for r in quality.sanity_checks(df).collect()}
    assert list(got.values()) == [1, 1, 1, 1, 1, 1]
