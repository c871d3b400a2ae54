import math

from pyspark.sql import functions as F

from chelarium.operators import units

SCHEMA = "measurement_id string, variant_id string, target_element string, value double, value_units string, value_type string, value_in_molar double, conditions_notes string, source_paper string"


def frame(spark, rows):
    return spark.createDataFrame([(f"m{i}", "o-1", "La", v, u, t, s, n, "p") for i, (v, u, t, s, n) in enumerate(rows)], SCHEMA)


def wrong(spark, rows):
    return {r.measurement_id: r.value_fm for r in units.wrong_molar(units.to_common_unit(frame(spark, rows))).collect()}


UNITS = [("M", 0), ("mM", -3), (" uM ", -6), ("µM", -6), ("μM", -6), ("NM", -9), ("nm", -9), ("pM", -12), ("fM", -15), ("molar", 0), ("nanomolar", -9), ("nmol/L", -9), ("nmol L^{-1}", -9), ("pmol L⁻¹", -12),
     ("nmol·dm⁻³", -9), ("mmol dm⁻³", -3), ("mmol/m³", -6), ("mol/m3", -3), ("nmol/mL", -6), ("fmol/µL", -9), ("µmol/mL", -3), ("10^-9 M", -9), ("10⁻⁶ M", -6), ("×10⁻⁹ M", -9)]
LOGARITHMS = [("pKd", 9.0, 1e-9), ("-log10(M)", 6.5, 10**-6.5), ("−log10 [M]", 6.0, 1e-6), ("p(Kd)", 7.0, 1e-7), ("log10(M)", -8.0, 1e-8), ("log Kd (M)", -3.5, 10**-3.5)]
NONE = ["%", "kJ/mol", "M⁻¹ s⁻¹", "mM⁻¹·s⁻¹", "L/(s·mmol)", "µg Nd/mg protein", "mg/L", "mol%", "a.u.", "fold", "s^-1", "unitless", "", None]
NOTES = [("30 mM acetate, 1 mM TCEP; the authors quote it in millimolar", -3), ("table header: values in 10^-9 M", -9), ("Kd reported molar", 0), ("value as nmol per mL (footnote b)", -6), ("affinities listed in M throughout; titrated with 250 nM dye", 0), ("constants are given in units of 10⁻⁹ M", -9)]


def test_printed_units(spark):
    assert wrong(spark, [(7.0, unit, "Kd", None, None) for unit, _ in UNITS]) == {f"m{i}": round(7 * 10.0 ** (e + 15)) for i, (_, e) in enumerate(UNITS)}


def test_logarithms(spark):
    assert wrong(spark, [(value, unit, "Kd", None, None) for unit, value, _ in LOGARITHMS]) == {f"m{i}": round(molar * 1e15) for i, (_, _, molar) in enumerate(LOGARITHMS)}


def test_no_concentration(spark):
    assert wrong(spark, [(7.0, unit, "Kd", None, "10 mM HEPES; stock of 9 mM LnCl3") for unit in NONE]) == {}


def test_units_in_notes(spark):
    assert wrong(spark, [(3.0, "see notes", " KD_app ", None, note) for note, _ in NOTES]) == {f"m{i}": round(3 * 10.0 ** (e + 15)) for i, (_, e) in enumerate(NOTES)}


def test_stored_values(spark):
    rows = [(1.0, "nM", "Kd", 1e-9, None), (1.0, "nM", "Kd", 1.009e-9, None), (1.0, "nM", "Kd", 1.02e-9, None), (1.0, "nM", "Kd", math.nan, None), (1.0, "nM", "yield", None, None), (None, "nM", "Kd", None, None), (math.nan, "nM", "Kd", None, None), (0.0, "nM", "Kd", None, None), (1e300, "M", "Kd", None, None)]
    assert wrong(spark, rows) == {"m2": 1_000_000, "m3": 1_000_000, "m7": 0, "m8": None}


def test_links_decide_against_a_misleading_print(spark):
    # a source that writes nM but means micromolar: all its stored values say so
    rows = [(float(i), "nM", "Kd", i * 1e-6, None) for i in range(1, 9)] + [(5.0, "nM", "Kd", None, None)]
    got = units.conversions(units.read_notations(frame(spark, rows))).collect()
    assert [(r.kind, r.exponent, r.n_links, r.basis) for r in got] == [("linear", -6, 8, "anchor")]
    assert wrong(spark, rows) == {"m8": 5_000_000_000}


def test_scale_spreads_over_other_sources(spark):
    rows = [(f"a{i}", f"v{i}", "La", 2.0 + i, "uM", "Kd", (2.0 + i) * 1e-6, None, "p") for i in range(8)]
    rows += [(f"b{i}", f"v{i}", "La", (2.0 + i) * 1000, "nmol/L", "Kd", None, None, "p") for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.notation: (r.exponent, r.basis) for r in units.conversions(units.read_notations(df)).collect()}
    assert got == {"um": (-6, "anchor"), "nmol/l": (-9, "graph")}


def test_scale_spreads_over_several_sources_and_logarithms(spark):
    # molar <- um <- pkd <- 10-7m: each is linked with the one before it only; a quarter of the links are ten times off
    rows = []
    for i in range(12):
        v, off = 2.0 + i, 10.0 if i % 4 == 0 else 1.0
        rows.append((f"a{i}", f"v{i}", "La", v, "uM", "Kd", v * 1e-6 * off, None, "p"))
        rows.append((f"b{i}", f"v{i}", "La", -math.log10(v * 1e-6 * off), "pKd", "Kd", None, None, "p"))
        rows.append((f"c{i}", f"w{i}", "La", 6.0 + i / 10, "pKd", "Kd", None, None, "p"))
        rows.append((f"d{i}", f"w{i}", "La", 10 ** -(6.0 + i / 10) * 1e7 * off, "10^-7 M", "Kd", None, None, "p"))
    got = {r.notation: (r.kind, r.exponent, r.hops, r.basis) for r in units.conversions(units.read_notations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {"um": ("linear", -6, 1, "anchor"), "pkd": ("neglog", 0, 2, "graph"), "10-7m": ("linear", -7, 3, "graph")}


def test_values_ten_times_off_do_not_anchor_a_notation(spark):
    rows = [(float(i), "10^-7 M", "Kd", i * (1e-6 if i % 3 == 0 else 1e-7), None) for i in range(1, 31)]
    assert [(r.exponent, r.n_links) for r in units.conversions(units.read_notations(frame(spark, rows))).collect()] == [(-7, 20)]


def test_empty_repeated_and_clashing(spark):
    empty = frame(spark, []).where("false")
    assert units.wrong_molar(units.to_common_unit(empty)).count() == 0
    twice = frame(spark, [(1.0, "nM", "Kd", None, None)])
    twice = twice.unionByName(twice).withColumns({"notation": F.lit("x"), "entity": F.lit(1), "n": F.lit(0)})
    assert units.wrong_molar(units.to_common_unit(twice)).count() == 2
