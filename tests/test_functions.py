import math

import pytest
from pyspark.sql import functions as F

from chelarium.functions import exprs, protein

# Mature sequence with four known loop motifs.
LOOPS = "A" * 15 + "PDKDGT" + "C" * 18 + "PDKDGT" + "E" * 19 + "PDNDGT" + "F" * 18 + "PDNDGT" + "K" * 19


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_elements(spark):
    texts = ["Nd", "NdIII", "Nd(III)", "Nd3+", "Nd³⁺", "nd(iii)", " neodymium\t", "Cm(III)", "Light REEs", "Unobtanium", None, ""]
    got = values(spark, [(t,) for t in texts], "t string", exprs.element_name("t"), exprs.is_element_group("t"))
    assert [g[0] for g in got] == ["Neodymium"] * 7 + ["Curium", None, None, None, None]
    assert [g[1] for g in got] == [False] * 8 + [True, False, False, False]


def test_units(spark):
    texts = ["uM", "μM", "µM", "Mol L^{-1}", "mol%", "mM", "nmol", "unitless", None]
    got = values(spark, [(3.69, t) for t in texts], "v double, u string", exprs.to_molar("v", "u"), exprs.to_molar("v", "u", strict=True))
    want = [3.69e-6] * 3 + [3.69, None, None, 3.69e-9, None, None]
    for (lenient, strict), w, t in zip(got, want, texts):
        assert lenient is None and w is None or lenient == pytest.approx(w)
        assert strict == pytest.approx(3.69e-3) if t == "mM" else strict == lenient


def test_families(spark):
    texts = ["Kd", " KD_APP ", "Kdimer", "EC50", "ΔGapp", "r₁", "logD", "binding", "fold difference", "kon", None]
    got = [g[0] for g in values(spark, [(t,) for t in texts], "t string", exprs.measurement_family("t"))]
    assert got == ["binding_affinity"] * 2 + ["dimerization_affinity", "response_threshold", "thermodynamics", "relaxivity", "distribution", "binding_capacity", "process_metric", "other", None]


def test_names(spark):
    cases = {
        "mex-LanM": ("Mex-LanM", "o-621", "ortholog", "Lanmodulin"), "O36": ("o-36", "o-36", "ortholog", "Lanmodulin"), "o36": ("o-36", "o-36", "ortholog", "Lanmodulin"),
        "4 P2A": ("4P2A", "4P2A", "point_mutant", "Lanmodulin"), "Mex-LanM-His10-SpyTag": ("Mex-LanM", "o-621", "ortholog", "Lanmodulin"), "WT LanM": ("WT-LanM", "o-621", "ortholog", "Lanmodulin"),
        "R100K": ("Hans-LanM(R100K)", "Hans-LanM(R100K)", "point_mutant", "Lanmodulin"), "O36-Cys": ("O36", "O36", "unknown", None), "NeverSeenProtein-XYZ": ("NeverSeenProtein-XYZ", "NeverSeenProtein-XYZ", "unknown", None),
        "LanM": ("LanM", None, None, None), "  ": (None, None, None, None), "-Cys": ("", "", "unknown", None),
    }
    df = exprs.with_enriched_variant(spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string"), "raw", "e")
    got = {r[0]: tuple(r[1:]) for r in df.select("raw", "e.*").collect()}
    assert got == cases | {None: (None, None, None, None)}


def test_cells(spark):
    got = values(spark, [(" a\t",), ("  ",), (None,), (" 7 ",), ("3.7",)], "t string", exprs.clean_cell("t"), exprs.safe_int("t"))
    assert got == [("a", None), (None, None), (None, None), ("7", 7), ("3.7", None)]
    assert values(spark, [("x", None)], "a string, b string", exprs.taxonomy_text({"p": "a", "q": "b"}), exprs.taxonomy_text({"q": "b"})) == [("p=x", None)]


def test_element_table(spark):
    rows = {r.element: r for r in exprs.element_table(spark).collect()}
    assert len(rows) == 17 and rows["Yttrium"].charge_density == pytest.approx(3 / 101.9**3)
    order = [rows[e].ionic_radius_pm for e in sorted((e for e in rows if rows[e].is_lanthanide), key=lambda e: rows[e].atomic_number)]
    assert order == sorted(order, reverse=True)


def test_validated_sequence(spark):
    ok = "ACDEFGHIKLMNPQRSTVWY" * 5
    cases = [(None, "No sequence provided.", 0), (">a\nAC\n>b\nAC", "Multiple FASTA", 0), (" \n", "No sequence content.", 0), ("A" * 50, "Too short", 50), ("A" * 401, "Too long", 401), (ok[:90] + "X1-", "Not canonical: -, 1, X", 93), (f">x\r\n {ok[:40].lower()} \n{ok[40:]}", None, 100), ("A" * 80, None, 80), ("A" * 400, None, 400)]
    got = values(spark, [(c[0],) for c in cases], "s string", protein.validated_sequence("s").alias("v"))
    for (v,), (_, error, n) in zip(got, cases):
        assert v.is_valid == (error is None) and v.length == n
        assert v.error is None if error is None else v.error.startswith(error)
    assert got[6][0].sequence == ok


def motifs_of(spark, s):
    df = spark.createDataFrame([(s,)], "s string").withColumn("h", protein.motifs(F.col("s")))
    numbers = protein.motif_numbers(F.col("h"), F.col("s"))
    letters = protein.motif_letters(F.col("h"))
    r = df.select("h", *(c.alias(n) for n, c in (numbers | letters).items())).first()
    return [(h.start, h.motif) for h in r.h], r


def test_motifs(spark):
    hits, r = motifs_of(spark, LOOPS)
    assert hits == [(15, "PDKDGT"), (39, "PDKDGT"), (64, "PDNDGT"), (88, "PDNDGT")]
    assert r.ef_hand_count == 4 and r.has_four_ef_hands == 1
    assert r.ef_hand_mean_spacing == pytest.approx(73 / 3) and r.ef_hand_spacing_stdev == pytest.approx(math.sqrt(2) / 3) and r.ef_hand_span_fraction == pytest.approx(73 / len(LOOPS))
    assert (r.ef1_pos0, r.ef3_pos2, r.ef4_pos5) == ("P", "N", "T")
    hits, r = motifs_of(spark, "M" + "A" * 119)
    assert hits == [] and r.ef_hand_count == 0 and r.ef_hand_mean_spacing is None and r.ef1_pos0 == "MISSING"
    assert motifs_of(spark, "PDKDGTDKDGT")[0] == [(0, "PDKDGT")]
    hits, r = motifs_of(spark, "PDKDGT" + "A" * 20 + "PDNDGT" + "A" * 18)
    assert [h[0] for h in hits] == [0, 26] and r.ef_hand_mean_spacing == 26.0 and r.ef_hand_spacing_stdev == 0.0
    hits, r = motifs_of(spark, ("PDKDGT" + "A" * 10) * 5)
    assert len(hits) == 5 and r.has_four_ef_hands == 0
    assert motifs_of(spark, "")[0] == []


def test_descriptors(spark):
    made = protein.sequence_numbers(F.col("s"))
    rows = spark.createDataFrame([("D" * 10,), ("ACDK",), ("G",), ("",)], "s string").select(*(c.alias(n) for n, c in made.items()), protein.instability(F.col("s"), {"AC": 44.94}).alias("ii")).collect()
    assert rows[0].acidic_basic_ratio == 10.0 and rows[0].pct_d == 1.0 and rows[0].isoelectric_point < 4.06
    r = rows[1]
    assert r.molecular_weight == pytest.approx(89.0932 + 121.1582 + 133.1027 + 146.1876 - 3 * 18.0153)
    assert r.gravy == pytest.approx((1.8 + 2.5 - 3.5 - 3.9) / 4) and r.ii == pytest.approx(10 / 4 * (44.94 + 2)) and r.acidic_basic_ratio == 1.0
    assert rows[2].molecular_weight == pytest.approx(75.0666)
    assert rows[3].length == 0 and rows[3].pct_d is None and rows[3].isoelectric_point is None

    def charge(s, ph):
        plus = {"K": 10.0, "R": 12.0, "H": 5.98}
        minus = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
        n = protein.N_END_PK_OF.get(s[0], 7.5)
        c = protein.C_END_PK_OF.get(s[-1], 3.55)
        return sum(1 / (1 + 10 ** (ph - pk)) for pk in [plus[x] for x in s if x in plus] + [n]) - sum(1 / (1 + 10 ** (pk - ph)) for pk in [minus[x] for x in s if x in minus] + [c])

    assert r.charge_at_ph7 == pytest.approx(charge("ACDK", 7))
    assert abs(charge("ACDK", r.isoelectric_point)) < 1e-3


def test_cost(spark):
    got = values(spark, [(135580, 15), (None, 0)], "c bigint, n bigint", exprs.run_cost(F.col("c"), F.col("n")))
    assert got == [(0.0193,), (0.0,)]
