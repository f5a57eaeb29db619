"""Compositions: slots, weight percent, formulas and composition texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from alloyscreen import refdata
from alloyscreen.functions.basics import clip, column_or, fixed_text, joined, texts, with_computed

SLOTS = (1, 2, 3)
FRACTION_MIN, FRACTION_MAX = 0.05, 0.95


def slot_element(df: DataFrame, i: int) -> Column:
    """The element of slot ``i``, null when the slot is unused (no element, or no positive fraction)."""
    element = column_or(df, f"element_{i}", None).cast("string")
    fraction = column_or(df, f"composition_{i}", 0.0)
    return F.when((element != "") & (fraction > 0), element)


def slots(df: DataFrame) -> Column:
    """Used slots as ``array<struct<element, fraction>>``."""
    return texts(
        *[
            F.when(
                slot_element(df, i).isNotNull(),
                F.struct(
                    slot_element(df, i).alias("element"),
                    column_or(df, f"composition_{i}", 0.0).cast("double").alias("fraction"),
                ),
            )
            for i in SLOTS
        ]
    )


def element_array(df: DataFrame) -> Column:
    """Distinct non-empty elements of the three slots, whatever their fractions."""
    names = [column_or(df, f"element_{i}", None).cast("string") for i in SLOTS]
    # Removes nulls and repetitions in one compiled step.
    return F.array_except(F.array(*[F.when(n != "", n) for n in names]), F.array(F.lit(None).cast("string")))


def with_weight_percent(df: DataFrame) -> DataFrame:
    """Weight percent per slot from three lookups in the fixed table of atomic weights (no shuffle)."""
    weights = refdata.atomic_weights(df.sparkSession).select("symbol", "atomic_weight")
    out = df
    for i in SLOTS:
        table = F.broadcast(weights.select(F.col("symbol").alias(f"_symbol_{i}"), F.col("atomic_weight").alias(f"_weight_{i}")))
        used = slot_element(df, i)
        out = out.withColumn(f"_used_{i}", used).join(table, F.col(f"_used_{i}") == F.col(f"_symbol_{i}"), "left")
        out = out.withColumn(
            f"_mass_{i}",
            F.when(
                F.col(f"_used_{i}").isNotNull(),
                column_or(df, f"composition_{i}", 0.0) * F.coalesce(F.col(f"_weight_{i}"), F.lit(refdata.UNKNOWN_WEIGHT)),
            ),
        )
    total = sum((F.coalesce(F.col(f"_mass_{i}"), F.lit(0.0)) for i in SLOTS), F.lit(0.0))
    out = out.withColumn("_mass_total", total)
    out = out.withColumns(
        {f"weight_percent_{i}": F.try_divide(F.col(f"_mass_{i}"), F.col("_mass_total")) * 100 for i in SLOTS}
    )
    shares = [F.coalesce(F.col(f"weight_percent_{i}"), F.lit(0.0)) for i in SLOTS]
    out = out.withColumn("total_weight_percent", sum(shares[1:], shares[0]))
    return out.drop("_mass_total", *[f"_{n}_{i}" for i in SLOTS for n in ("symbol", "weight", "used", "mass")])


def with_composition_text(df: DataFrame) -> DataFrame:
    """``wt%`` and ``feedstock_g_per_100g`` texts from the weight percents."""
    have = df if "weight_percent_1" in df.columns else with_weight_percent(df)
    share = {i: fixed_text(F.col(f"weight_percent_{i}"), 1) for i in SLOTS}
    used = {i: F.col(f"weight_percent_{i}").isNotNull() for i in SLOTS}
    percent = joined(
        "; ",
        *[F.when(used[i], F.concat(column_or(df, f"element_{i}", None), F.lit(": "), share[i], F.lit("%"))) for i in SLOTS]
    )
    grams = joined(
        ", ", *[F.when(used[i], F.concat(share[i], F.lit("g "), column_or(df, f"element_{i}", None))) for i in SLOTS]
    )
    return have.withColumns(
        {
            "wt%": percent,
            "feedstock_g_per_100g": F.when(grams == "", F.lit("No elements found")).otherwise(grams),
        }
    )


def atomic_percent_text(df: DataFrame) -> Column:
    parts = [
        F.when(
            slot_element(df, i).isNotNull(),
            F.concat(
                slot_element(df, i),
                F.lit(": "),
                fixed_text(column_or(df, f"composition_{i}", 0.0).cast("double") * 100, 1),
                F.lit("%"),
            ),
        )
        for i in SLOTS
    ]
    return joined("; ", *parts)


def formula_text(elements: Column, fractions: Column) -> Column:
    """``Al0.500Ti0.500``; ``Invalid`` when the arrays differ in length."""
    parts = F.zip_with(elements, fractions, lambda e, x: F.concat(e, fixed_text(x, 3)))
    return F.when(F.size(elements) == F.size(fractions), F.array_join(parts, "")).otherwise(F.lit("Invalid"))


def slots_formula(df: DataFrame) -> Column:
    """Formula text of the used slots."""
    parts = [
        F.when(slot_element(df, i).isNotNull(), F.concat(slot_element(df, i), fixed_text(column_or(df, f"composition_{i}", 0.0), 3)))
        for i in SLOTS
    ]
    return joined("", *parts)


_AMOUNT = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)?"
FORMULA_TERM = r"([A-Z][a-z]?|[()\[\]{}])([0-9]*\.?[0-9]*)"
FORMULA_SHAPE = r"^(?:(?:" + "|".join(refdata.ATOMIC_WEIGHTS) + r")(?![a-z])" + _AMOUNT + r"|[(\[{](?![)\]}])|[)\]}]" + _AMOUNT + r")+$"
_TERM = re.compile(FORMULA_TERM)
_PARTNER = {")": "(", "]": "[", "}": "{"}


def _number(text: str) -> float:
    """The amount behind a symbol; 1 without one."""
    return float(text) if text and text != "." else 1.0


def formula_amounts(formula: str) -> list[float] | None:
    """Amounts of the distinct elements of a formula of ``FORMULA_SHAPE``, in the order of their first mention, each multiplied by the
    amounts behind all brackets around it; None when a bracket has no partner of its kind.

    The terms are gone through from the last to the first: a closing bracket pushes its amount times that of the brackets
    around it, its opening bracket takes it off again."""
    held, found = [("", 1.0)], []
    for symbol, number in reversed(_TERM.findall(formula)):
        kind, factor = held[-1]
        if symbol in _PARTNER:
            held.append((_PARTNER[symbol], factor * _number(number)))
        elif symbol in ("(", "[", "{"):
            if kind != symbol:
                return None
            held.pop()
        else:
            found.append((symbol, factor * _number(number)))
    if len(held) > 1:
        return None
    amounts: dict[str, float] = {}
    for symbol, n in reversed(found):
        amounts[symbol] = amounts.get(symbol, 0.0) + n
    return list(amounts.values())


@F.arrow_udf(ArrayType(DoubleType()))
def _amounts(formulas: pa.Array) -> pa.Array:
    return pa.array([None if f is None else formula_amounts(f) for f in formulas.to_pylist()], pa.list_(pa.float64()))


def with_formula_amounts(df: DataFrame, formula: str, name: str) -> DataFrame:
    """Amounts of the distinct elements of a formula as an array of doubles, in the order of their first mention; null when
    it cannot be read. Groups in round, square or curly brackets may be nested and followed by an amount."""
    text = F.col(formula)
    # folding arrays in expressions copies its state for each term; only the formula goes to Python, in batches
    return df.withColumn(name, _amounts(F.when(text.rlike(FORMULA_SHAPE), text)))


def with_top_fractions(df: DataFrame, formula_columns=("formula", "formula_pretty", "composition")) -> DataFrame:
    """Three largest atomic fractions of the first readable formula, else equal shares of ``elements``, else zeros."""
    out, choices = df, []
    for formula in (c for c in formula_columns if c in df.columns):
        out = with_formula_amounts(out, formula, f"_amounts_{formula}")
        total = F.aggregate(f"_amounts_{formula}", F.lit(0.0), lambda acc, x: acc + x)
        choices.append(F.when(total > 0, F.col(f"_amounts_{formula}")))
    if "elements" in df.columns:
        choices.append(F.when(F.size("elements") > 0, F.array_repeat(F.lit(1.0), F.size("elements"))))
    out = with_computed(out, {"_parts": F.sort_array(F.coalesce(*choices, F.array(F.lit(0.0))), asc=False)})
    out = with_computed(out, {"_whole": F.aggregate("_parts", F.lit(0.0), lambda acc, x: acc + x)})
    share = [F.coalesce(F.try_divide(F.try_element_at("_parts", F.lit(i)), F.col("_whole")), F.lit(0.0)) for i in SLOTS]
    out = out.withColumns({f"composition_{i}": x for i, x in zip(SLOTS, share)})
    return out.drop("_parts", "_whole", *[f"_amounts_{c}" for c in formula_columns])


def with_clamped_binary(df: DataFrame, low: float = FRACTION_MIN, high: float = FRACTION_MAX) -> DataFrame:
    """First fraction limited to [low, high], the second as its complement."""
    if low >= high:
        raise ValueError(f"composition bounds need low < high, got {low} and {high}")
    return df.withColumn("composition_1", clip(F.col("composition_1"), low, high)).withColumn(
        "composition_2", F.lit(1.0) - F.col("composition_1")
    )


def normalized_fractions(fractions: Column, low: float = FRACTION_MIN, high: float = FRACTION_MAX) -> Column:
    """Each fraction limited to [low, high], then divided by their sum."""
    limited = F.transform(fractions, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))
    total = F.aggregate(limited, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(limited, lambda x: F.try_divide(x, total))


def with_slots_from_elements(df: DataFrame) -> DataFrame:
    return df.withColumns({f"element_{i}": F.try_element_at(F.col("elements"), F.lit(i)) for i in (1, 2)})


def pair_key(first: Column, second: Column) -> Column:
    return F.concat_ws("-", first, second)


def neutral_cell(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def with_neutral_cells(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({n: neutral_cell(F.col(f"`{n}`")) for n in text})


def with_interactions(df: DataFrame) -> DataFrame:
    c1, c2, c3 = (F.col(f"composition_{i}") for i in SLOTS)
    return df.withColumns(
        {
            "comp_1_2": c1 * c2,
            "comp_1_3": c1 * c3,
            "comp_2_3": c2 * c3,
            "mp_bp_ratio": F.col("melting_point") / (F.col("boiling_point") + 1e-6),
            "electroneg_sq": F.col("electronegativity") * F.col("electronegativity"),
            "radius_sq": F.col("atomic_radius") * F.col("atomic_radius"),
        }
    )
