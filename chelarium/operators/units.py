"""Quantities recorded in different units: notations as sources of one quantity, linked, scaled and propagated.

Every unit notation is a source. Two sources are linked where they give the same entity: the stored
molar column (the anchor, one more source) gives each row a second time, and rows of one variant,
element, type and paper in two notations link these. Each source can be linear, logarithmic or negative
logarithmic; on the scale so chosen, two sources differ by an offset, which is estimated for each pair of sources and scales as the
median over their links and snapped to a known conversion (a power of ten). The scales on which most links lie
within SNAP of that offset hold for the pair, however far off the other links are. Conversions then spread from the anchor over the
graph of sources, over as many links as it takes and the surest first; what the graph does not reach takes the
reading of its printed form.

Scale: the notations are read once into a slim table. Links are counted with map-side combine into one row per pair of
sources; the entity self-join runs on one median per entity and notation, of which an entity has no more than
there are notations. The grammar recognises some hundred notations at any size of data, so the graph is small and is
walked on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelarium.functions.ids import id_key, spelling_key
from chelarium.session import settle

# Value types that are concentrations, in lower case.
CONCENTRATIONS = ("kd", "kd_app", "kd1", "ec50", "kdimer")
# Decimal exponents of the prefixes and, relative to a litre, of the volumes.
PREFIXES = {"femto": -15, "pico": -12, "nano": -9, "micro": -6, "milli": -3, "f": -15, "p": -12, "n": -9, "u": -6, "m": -3}
VOLUMES = {"dm": 0, "cm": -3, "ml": -3, "ul": -6, "nl": -9, "m3": 3, "m-3": 3}

MIN_LINKS, MIN_SHARE, SNAP = 5, 0.5, 0.005
ANCHOR = "stored molar"
# Known conversions, as decimal exponents, and scales of a source, the plainest first.
KNOWN_EXPONENTS = range(-18, 4)
SCALES = ("linear", "neglog", "log")
#: Two known conversions are no further apart.
WIDEST = max(KNOWN_EXPONENTS) - min(KNOWN_EXPONENTS)

_FROM, _TO = "⁻−–‑⁰¹²³⁴⁵⁶⁷⁸⁹µμ·⋅×", "----0123456789uu  x"
_FREE = r"(?<![0-9.]\s{0,2})(?<![a-z0-9])"
_NOTATION = "|".join((
    r"(?<![a-z])p\(?(?:kd|ec50)\)?|-\s?log(?:10)?\s?(?:kd\s?)?[(\[]\s?m\s?[)\]]",
    r"(?<![a-z])log(?:10)?\s?(?:kd\s?)?[(\[]\s?m\s?[)\]]",
    r"(?<![0-9.])x?\s?10\s?-[0-9]{1,2}\s?m(?![a-z0-9/-])",
    _FREE + r"[fpnum]?mol(?:es?)?\s?(?:/|per|\s)\s?(?:lit(?:re|er)|[dc]?m-?3|[unm]?l(?:-1)?)(?![a-z0-9])",
    _FREE + r"(?:femto|pico|nano|micro|milli)?molar(?![a-z])",
    _FREE + r"[fpnum]?m(?![a-z0-9/%-])",
))


def plain_notation(c: Column) -> Column:
    """Lower case, with one spelling of minus, micro, superscripts, times and exponent marks."""
    c = F.lower(F.regexp_replace(F.translate(c, _FROM, _TO), r"[\^{}]", ""))
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def find_notation(text: Column) -> Column:
    """The first concentration unit told in a text, in plain_notation without blanks; empty if there is none.

    A unit that follows a number tells how much of something else there was and is passed over.
    """
    return F.regexp_replace(F.regexp_extract(plain_notation(F.coalesce(text, F.lit(""))), _NOTATION, 0), " ", "")


def _exponent(values: dict[str, int], c: Column) -> Column:
    return reduce(lambda rest, kv: F.when(c == kv[0], kv[1]).otherwise(rest), values.items(), F.lit(0))


def printed_conversion(notation: Column) -> Column:
    """struct(kind, exponent) that a notation's printed form states: molar = value * 10^exponent, 10^value or 10^-value."""
    volume = F.regexp_extract(notation, "mol.*?(dm|cm|ml|ul|nl|m-?3)(?:-?[13])?$", 1)
    prefix = F.regexp_extract(notation, "^(femto|pico|nano|micro|milli|[fpnum](?=m))", 1)
    power = F.regexp_extract(notation, "^x?10-([0-9]+)m$", 1)
    kind = F.when(notation.startswith("log"), "log").when(notation.rlike("^(-|p[(]?(kd|ec50))"), "neglog").otherwise("linear")
    exponent = (
        F.when(kind != "linear", F.lit(0))
        .when(power != "", -power.try_cast("int"))
        .otherwise(_exponent(PREFIXES, prefix) - _exponent(VOLUMES, volume))
    )
    return F.struct(kind.alias("kind"), exponent.cast("int").alias("exponent"))


def read_notations(df: DataFrame) -> DataFrame:
    """The rows whose value is a concentration in a told unit: id, entity, value, stored molar, notation.

    The unit is that of value_units or, where that tells none, of conditions_notes. Rows with a null or NaN value,
    another value_type or an untold unit give no row. A NaN molar counts as null.
    """
    stored = F.col("value_in_molar").cast("double")
    return (
        df.where(F.lower(F.trim(F.regexp_replace("value_type", r"[\s ]+", " "))).isin(*CONCENTRATIONS))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .select(
            "measurement_id",
            F.xxhash64(id_key("variant_id"), spelling_key("target_element"), spelling_key("value_type"), spelling_key("source_paper")).alias("entity"),
            F.col("value").cast("double").alias("value"),
            F.when(~F.isnan(stored), stored).alias("stored"),
            find_notation(F.col("value_units")).alias("in_units"),
            F.col("conditions_notes").alias("notes"),
        )
        .withColumn("notation", F.when(F.col("in_units") != "", F.col("in_units")).otherwise(find_notation(F.col("notes"))))
        .where("notation <> ''")
        .select("measurement_id", "entity", "value", "stored", "notation")
    )


def _on_scales(value: Column, logarithm: Column) -> Column:
    """array of struct(scale, x): the decimal logarithm of the quantity, up to an offset, if the source has that scale."""
    by = {"linear": logarithm, "neglog": -value, "log": value}
    return F.array(*(F.struct(F.lit(k).alias("scale"), by[k].alias("x")) for k in SCALES))


def source_links(rows: DataFrame) -> DataFrame:
    """(source, other, scale, other_scale, d): one row per link and scales; x of other is x of source plus d.

    Links lead to the anchor, from each row, and between notations of one entity, both ways, from their medians.
    """
    lg = lambda c: F.log10(F.when(F.col(c) > 0, F.col(c)))
    on = F.explode(_on_scales(F.col("value"), lg("value"))).alias("s")
    anchored = rows.select(F.col("notation").alias("source"), on, lg("stored").alias("y")).select(
        "source", F.lit(ANCHOR).alias("other"), F.col("s.scale").alias("scale"), F.lit("linear").alias("other_scale"), (F.col("y") - F.col("s.x")).alias("d")
    )
    one = rows.groupBy("entity", "notation").agg(F.percentile_approx("value", 0.5).alias("value"))
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, F.col("a.entity").eqNullSafe(F.col("b.entity")) & (F.col("a.notation") != F.col("b.notation"))).select(
        F.col("a.notation").alias("source"), F.col("b.notation").alias("other"), F.col("a.value").alias("value"), F.col("b.value").alias("theirs")
    )
    both = met.select("source", "other", on, "theirs").select("source", "other", "s", F.explode(_on_scales(F.col("theirs"), lg("theirs"))).alias("o"))
    between = both.select("source", "other", F.col("s.scale").alias("scale"), F.col("o.scale").alias("other_scale"), (F.col("o.x") - F.col("s.x")).alias("d"))
    return anchored.unionByName(between).where("d IS NOT NULL AND NOT isnan(d)")


def estimated_edges(links: DataFrame) -> DataFrame:
    """(source, other, scale, other_scale, exponent, n_links, share): the offset of each pair of sources and scales, snapped, the links within
    SNAP of it and their share of all; pairs without a known conversion near their median, or with too few or too scattered links, have no row.
    """
    pair = ["source", "other", "scale", "other_scale"]
    middle = links.groupBy(*pair).agg(F.percentile_approx("d", 0.5, 10_000).alias("m")).withColumn("exponent", F.rint("m").try_cast("int"))
    # one row per pair of sources and scales, of the notations of the grammar
    near = F.abs(F.col("d") - F.col("exponent")) < SNAP
    scored = links.join(F.broadcast(middle), pair).groupBy(*pair, "exponent").agg(F.count(F.when(near, 1)).alias("n_links"), F.avg(near.cast("double")).alias("share"))
    return scored.where(F.col("exponent").between(-WIDEST, WIDEST) & (F.col("n_links") >= MIN_LINKS) & (F.col("share") >= MIN_SHARE))


def propagate(edges: list) -> dict[str, tuple[str, int, int, int]]:
    """source to (scale, exponent, n_links, hops) for all that edges connect with the anchor, hop by hop, over the edge with most links."""
    known = {ANCHOR: ("linear", 0, 0, 0)}
    while True:
        best: dict = {}
        for e in edges:
            if e.source in known or e.other not in known or known[e.other][0] != e.other_scale:
                continue
            if known[e.other][1] + e.exponent not in KNOWN_EXPONENTS:
                continue
            order = (e.n_links, -SCALES.index(e.scale), e.exponent, e.other)
            if e.source not in best or order > best[e.source][0]:
                _, exponent, _, hops = known[e.other]
                best[e.source] = order, (e.scale, exponent + e.exponent, e.n_links, hops + 1)
        if not best:
            del known[ANCHOR]
            return known
        known |= {s: found for s, (_, found) in best.items()}


def conversions(rows: DataFrame) -> DataFrame:
    """(notation, kind, exponent, n_links, hops, basis): how each notation of read_notations converts to molar.

    basis: `anchor` (linked with the stored molar column), `graph` (over other notations, hops in all) or `printed` (no hops, no links).
    An empty table gives no row; ties go to the linear scale, then to the larger exponent.
    """
    # the grammar bounds the number of notations and so of edges
    known = propagate(estimated_edges(source_links(rows)).collect())
    found = rows.sparkSession.createDataFrame([(s, k, e, n, h) for s, (k, e, n, h) in known.items()], "notation string, kind string, exponent int, n_links bigint, hops int")
    printed = printed_conversion(F.col("notation"))
    return (
        rows.select("notation").distinct().join(F.broadcast(found), "notation", "left").withColumn("p", printed).select(
            "notation", F.coalesce("kind", "p.kind").alias("kind"), F.coalesce("exponent", "p.exponent").alias("exponent"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("hops", F.lit(0)).alias("hops"),
            F.when(F.col("hops").isNull(), "printed").when(F.col("hops") == 1, "anchor").otherwise("graph").alias("basis"),
        )
    )


def to_common_unit(df: DataFrame) -> DataFrame:
    """read_notations plus `molar` and `fm` (femtomolar, unrounded) of every row with a told unit."""
    rows = settle(read_notations(df))
    ten = F.lit(10.0)
    v = F.col("value")
    scaled = lambda shift: F.when(F.col("kind") == "neglog", F.pow(ten, F.col("exponent") + shift - v)).when(F.col("kind") == "log", F.pow(ten, F.col("exponent") + shift + v)).otherwise(v * F.pow(ten, F.col("exponent") + shift))
    # one row per notation of the grammar
    return rows.join(F.broadcast(conversions(rows)), "notation").select(
        "measurement_id", "notation", "value", "stored", scaled(F.lit(0)).alias("molar"), scaled(F.lit(15)).alias("fm")
    )


def wrong_molar(converted: DataFrame) -> DataFrame:
    """(measurement_id, value_fm) of the rows whose stored molar value is null or more than 1 % off.

    value_fm is null where it does not fit into 64 bits. Repeated rows come out as often as they go in.
    """
    off = F.col("stored").isNull() | (F.abs(F.col("stored") - F.col("molar")) > 0.01 * F.abs("molar"))
    return converted.where(off).select("measurement_id", F.rint("fm").try_cast("long").alias("value_fm"))


P2_SQL = r"""
WITH src AS (
  SELECT measurement_id, value, CASE WHEN isnan(value_in_molar) THEN NULL ELSE value_in_molar END AS stored,
    lower(regexp_replace(translate(coalesce(value_units, ''), '⁻−–‑⁰¹²³⁴⁵⁶⁷⁸⁹µμ·⋅×', '----0123456789uu  x'), '[\^{} ]', '', 'g')) AS u,
    lower(regexp_replace(translate(coalesce(conditions_notes, ''), '⁻−–‑⁰¹²³⁴⁵⁶⁷⁸⁹µμ·⋅×', '----0123456789uu  x'), '[\^{}]', '', 'g')) AS n0
  FROM literature_binding_data
  WHERE lower(trim(value_type)) IN ('kd', 'kd_app', 'kd1', 'ec50', 'kdimer') AND value IS NOT NULL AND NOT isnan(value)),
cleaned AS (
  SELECT *, regexp_replace(n0, '(^|[^-0-9.])[0-9.]+ ?[fpnum]?m(ol/l)?\b', '\1', 'g') AS n FROM src),
told AS (
  SELECT *,
    CASE
      WHEN regexp_matches(u, '^(p\(?kd.*|-log.*\[?m\]?.*)$') THEN u
      WHEN regexp_matches(u, '^log(10)?(kd)?[(\[]m[)\]]$') THEN u
      WHEN regexp_matches(u, '^x?10-[0-9]+m$') THEN u
      WHEN regexp_matches(u, '^[fpnum]?mol(/|per)?(litre|liter|[dc]?m-?3|[unm]?l(-1)?)$') THEN u
      WHEN regexp_matches(u, '^(femto|pico|nano|micro|milli)?molar$') THEN u
      WHEN regexp_matches(u, '^[fpnum]?m$') THEN u
      WHEN regexp_matches(n, '10-[0-9]+ ?m\b') THEN replace(regexp_extract(n, '10-[0-9]+ ?m\b'), ' ', '')
      WHEN regexp_matches(n, '\b[fpnum]?mol ?(/|per) ?(litre|liter|[unm]?l)\b') THEN replace(regexp_extract(n, '\b[fpnum]?mol ?(/|per) ?(litre|liter|[unm]?l)\b'), ' ', '')
      WHEN regexp_matches(n, '\b(femto|pico|nano|micro|milli)?molar\b') THEN regexp_extract(n, '\b(femto|pico|nano|micro|milli)?molar\b')
      WHEN regexp_matches(n, '\b[fpnum]?m\b') THEN regexp_extract(n, '\b[fpnum]?m\b')
    END AS t
  FROM cleaned),
conv AS (
  SELECT *,
    CASE WHEN regexp_matches(t, '^(p|-log)') AND NOT regexp_matches(t, '^p(m|icom)') THEN 'neglog' WHEN t LIKE 'log%' THEN 'log' ELSE 'linear' END AS kind,
    CASE
      WHEN regexp_matches(t, '10-[0-9]+m') THEN -CAST(regexp_extract(t, '-([0-9]+)', 1) AS INT)
      ELSE (CASE
          WHEN regexp_matches(t, '^(femto|fm)') THEN -15 WHEN regexp_matches(t, '^(pico|pm)') THEN -12 WHEN regexp_matches(t, '^(nano|nm)') THEN -9
          WHEN regexp_matches(t, '^(micro|um)') THEN -6 WHEN regexp_matches(t, '^(milli|mm)') THEN -3 ELSE 0 END)
        - (CASE WHEN regexp_matches(t, 'mol.*(ml|cm-?3)') THEN -3 WHEN regexp_matches(t, 'mol.*ul') THEN -6
                WHEN regexp_matches(t, 'mol/?m-?3') THEN 3 ELSE 0 END)
    END AS e
  FROM told WHERE t IS NOT NULL),
done AS (
  SELECT *,
    CASE kind WHEN 'neglog' THEN pow(10.0, -value) WHEN 'log' THEN pow(10.0, value) ELSE value * pow(10.0, e) END AS molar,
    CASE kind WHEN 'neglog' THEN pow(10.0, 15 - value) WHEN 'log' THEN pow(10.0, 15 + value) ELSE value * pow(10.0, e + 15) END AS fm
  FROM conv)
SELECT measurement_id, TRY_CAST(round_even(fm, 0) AS BIGINT) AS value_fm FROM done
WHERE stored IS NULL OR abs(stored - molar) > 0.01 * abs(molar)
"""
