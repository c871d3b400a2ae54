"""Protein expressions: validation, motifs, composition and physical properties, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chelarium.functions.exprs import col, strip

CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC, ACIDIC, BASIC, AROMATIC = "AILMFWVY", "DE", "KRH", "FWY"
MIN_LENGTH, MAX_LENGTH = 80, 400
MOTIF, MOTIF_LENGTH = "[A-Z]D[A-Z]DG[A-Z]", 6
SHOWN_MOTIFS, MOTIF_PLACES = 4, (0, 2, 5)
FRACTIONS = ("D", "E", "N", "T", "K", "R")

# Hydropathy of residues (Kyte and Doolittle 1982).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
# Average masses of the free amino acids, and of water.
MASSES = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729,
    "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926,
    "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
WATER = 18.0153
# pK of side chains and ends (Bjellqvist 1993), with those of particular end residues.
POSITIVE_PK, NEGATIVE_PK = {"K": 10.0, "R": 12.0, "H": 5.98}, {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_END_PK, C_END_PK = 7.5, 3.55
N_END_PK_OF = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_END_PK_OF = {"D": 4.55, "E": 4.75}
PI_LOW, PI_HIGH, PI_STEPS = 4.05, 12.0, 20


def validated_sequence(c: Column | str) -> Column:
    """struct(is_valid, sequence, error, length): checks in the order null, several FASTA records, empty, short, long, alphabet."""
    raw = col(c)
    lines = F.transform(F.split(strip(raw), r"\R|[\x0B\f\x1c\x1d\x1e]"), lambda x: strip(x))
    headers = F.size(F.filter(lines, lambda x: x.startswith(">")))
    body = F.upper(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.startswith(">")), ""), r"[\s\x{85}\p{Z}]+", ""))
    n = F.length(body)
    bad = F.array_sort(F.array_distinct(F.filter(F.split(body, ""), lambda x: (x != "") & ~x.isin(*CANONICAL))))
    span = f"{MIN_LENGTH}-{MAX_LENGTH} residues"
    error = (
        F.when(raw.isNull(), "No sequence provided.")
        .when(headers > 1, F.format_string("Multiple FASTA records (%d).", headers))
        .when(n == 0, "No sequence content.")
        .when(n < MIN_LENGTH, F.format_string(f"Too short (%d residues, {span}).", n))
        .when(n > MAX_LENGTH, F.format_string(f"Too long (%d residues, {span}).", n))
        .when(F.size(bad) > 0, F.concat(F.lit("Not canonical: "), F.array_join(bad, ", ")))
    )
    early = raw.isNull() | (headers > 1)
    return F.struct(
        error.isNull().alias("is_valid"),
        F.when(early, "").otherwise(body).alias("sequence"),
        error.alias("error"),
        F.when(early, 0).otherwise(n).alias("length"),
    )


def residue_count(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def share_of(seq: Column, letters: str) -> Column:
    return F.try_divide(residue_count(seq, letters), F.length(seq))


def acidic_basic_ratio(seq: Column) -> Column:
    """Acidic over basic residues; the acidic count where there are no basic ones."""
    acidic, basic = residue_count(seq, ACIDIC), residue_count(seq, BASIC)
    return F.when(basic == 0, acidic.cast("double")).otherwise(acidic / F.nullif(basic, F.lit(0)))


def _weighted(seq: Column, weights: dict[str, float]) -> Column:
    return sum((residue_count(seq, r) * F.lit(w) for r, w in weights.items()), F.lit(0.0))


def molecular_weight(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, _weighted(seq, MASSES) - (F.length(seq) - 1) * F.lit(WATER))


def hydropathy(seq: Column) -> Column:
    return F.try_divide(_weighted(seq, HYDROPATHY), F.length(seq))


def instability(seq: Column, weights: dict[str, float]) -> Column:
    """10 / length times the sum of the weights of neighbouring residues; the table of 400 weights is a parameter, absent pairs weigh 1."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map(F.lit(""), F.lit(1.0))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(table, F.substring(seq, i, 2)), F.lit(1.0)))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.length(seq) > 1, F.lit(10.0) / F.length(seq) * total)


def _ionic(seq: Column) -> dict[str, Column]:
    """What the charge depends on: counts of the ionic residues and the pK of both ends."""
    end = lambda letter, of, usual: sum((F.when(letter == r, pk - usual).otherwise(0.0) for r, pk in of.items()), F.lit(usual))
    counts = {f"n_{r}": residue_count(seq, r) for r in (*POSITIVE_PK, *NEGATIVE_PK)}
    return counts | {"n_end": end(F.substring(seq, 1, 1), N_END_PK_OF, N_END_PK), "c_end": end(F.substring(seq, -1, 1), C_END_PK_OF, C_END_PK)}


def _charge(ionic, ph: Column) -> Column:
    ten = F.lit(10.0)
    plus = sum((ionic[f"n_{r}"] / (F.pow(ten, ph - pk) + 1) for r, pk in POSITIVE_PK.items()), 1 / (F.pow(ten, ph - ionic["n_end"]) + 1))
    minus = sum((ionic[f"n_{r}"] / (F.pow(ten, pk - ph) + 1) for r, pk in NEGATIVE_PK.items()), 1 / (F.pow(ten, ionic["c_end"] - ph) + 1))
    return plus - minus


def charge_at(seq: Column, ph: Column) -> Column:
    """Net charge at a pH by the Henderson-Hasselbalch equation."""
    return F.when(F.length(seq) > 0, _charge(_ionic(seq), ph))


def isoelectric_point(seq: Column) -> Column:
    """pH without net charge, by PI_STEPS halvings of the interval from PI_LOW to PI_HIGH; residues are counted once."""
    ionic = _ionic(seq)
    start = F.struct(F.lit(PI_LOW).alias("lo"), F.lit(PI_HIGH).alias("hi"), *(c.alias(n) for n, c in ionic.items()))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        up = _charge(s, mid) > 0
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"), *(s[n].alias(n) for n in ionic))

    return F.when(F.length(seq) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(PI_STEPS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2))


def motifs(seq: Column) -> Column:
    """array of struct(start, motif): metal-binding loop motifs from left to right, not overlapping, start counts from 0."""
    found = F.regexp_extract_all(seq, F.lit(f"({MOTIF})"), F.lit(1))
    between = F.transform(F.split(seq, MOTIF, -1), F.length)
    start = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + x) + MOTIF_LENGTH * i
    return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), m.alias("motif")))


def motif_letters(hits: Column) -> dict[str, Column]:
    """Letters of the first motifs at their binding places; MISSING where there is no such motif."""
    return {
        f"ef{k + 1}_pos{p}": F.coalesce(F.substring(F.get(hits, F.lit(k))["motif"], p + 1, 1), F.lit("MISSING"))
        for k in range(SHOWN_MOTIFS)
        for p in MOTIF_PLACES
    }


def motif_numbers(hits: Column, seq: Column) -> dict[str, Column]:
    """Number of motifs, mean and population deviation of their spacing, share of the sequence between first and last start, flag of exactly four."""
    starts = F.transform(hits, lambda h: h["start"])
    n = F.size(hits)
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(n - 1, F.lit(1))), F.slice(starts, 1, F.greatest(n - 1, F.lit(1))), lambda b, a: (b - a).cast("double"))
    several = n >= 2
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.nullif(n - 1, F.lit(0))
    spread = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(n - 1, F.lit(0)) - mean * mean + F.lit(0.0))
    last = F.get(starts, n - 1)
    return {
        "ef_hand_count": n,
        "ef_hand_mean_spacing": F.when(several, mean),
        "ef_hand_spacing_stdev": F.when(several, F.coalesce(F.when(spread.isNotNull() & ~F.isnan(spread), spread), F.lit(0.0))),
        "ef_hand_span_fraction": F.when(several, F.try_divide(last - F.get(starts, F.lit(0)), F.length(seq))),
        "has_four_ef_hands": (n == SHOWN_MOTIFS).cast("int"),
    }


def sequence_numbers(seq: Column) -> dict[str, Column]:
    """The sequence descriptors that need no parameter."""
    return {
        "length": F.length(seq),
        **{f"pct_{r.lower()}": share_of(seq, r) for r in FRACTIONS},
        "hydrophobicity_pct": share_of(seq, HYDROPHOBIC),
        "acidic_basic_ratio": acidic_basic_ratio(seq),
        "molecular_weight": molecular_weight(seq),
        "isoelectric_point": isoelectric_point(seq),
        "charge_at_ph7": charge_at(seq, F.lit(7.0)),
        "aromaticity": share_of(seq, AROMATIC),
        "gravy": hydropathy(seq),
    }
