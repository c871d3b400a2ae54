"""Column expressions for cells, elements, units, families and variant names. No UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelarium.functions import vocab
from chelarium.functions.ids import spelling_key

_BLANK_ENDS = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), _BLANK_ENDS, "")


def clean_cell(c: Column | str) -> Column:
    """Stripped text of a cell, null if nothing is left."""
    return F.nullif(strip(col(c).cast("string")), F.lit(""))


def safe_int(c: Column | str) -> Column:
    """Truncating cast to int, null where the value is none."""
    return col(c).try_cast("int")


def choose(c: Column, values: dict[str, object]) -> Column:
    """values[c], null for other values; one map literal however often it is used."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def element_name(c: Column | str) -> Column:
    """Canonical element of a spelling; null for groups of elements, unknown names and null."""
    return choose(F.lower(strip(c)), vocab.element_spellings())


def is_element_group(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*vocab.ELEMENT_GROUPS), F.lit(False))


def molar_scale(units: Column | str, strict: bool = False) -> Column:
    """Factor to molar that a unit's spelling states, null if it states none.

    The lenient rules (default) know no millimolar: `mM` gives null. strict reads it as 1e-3.
    """
    u = F.replace(F.replace(F.replace(F.lower(strip(units)), F.lit(" "), F.lit("")), F.lit("mol"), F.lit("m")), F.lit("l^{-1}"), F.lit(""))
    return choose(u, vocab.MOLAR_SCALES | ({"mm": 1e-3} if strict else {}))


def to_molar(value: Column | str, units: Column | str, strict: bool = False) -> Column:
    return col(value) * molar_scale(units, strict)


def measurement_family(c: Column | str) -> Column:
    """Family of a value type; `other` for an unknown one, null for null."""
    t = F.lower(strip(c))
    return F.when(t.isNotNull(), F.coalesce(choose(t, {t: f for f, ts in vocab.FAMILIES.items() for t in ts}), F.lit("other")))


def is_affinity_candidate(value_type: Column | str, molar: Column | str) -> Column:
    return F.coalesce(measurement_family(value_type) == "binding_affinity", F.lit(False)) & col(molar).isNotNull()


def taxonomy_text(parts: dict[str, Column | str]) -> Column:
    """`label=value` of the filled cells, joined by ` | `; null if none is filled."""
    cells = [F.when(clean_cell(c).isNotNull(), F.concat(F.lit(f"{label}="), clean_cell(c))) for label, c in parts.items()]
    return F.nullif(F.concat_ws(" | ", *cells), F.lit(""))


def with_variant_name(df: DataFrame, raw: str, name: str = "name") -> DataFrame:
    """df with the normalised spelling of a construct's name; null for null and blank.

    In this order: ortholog numbers become o-N; stacked suffix tags go; a bare mutation gets its protein; split
    names are closed up; organism prefixes get a capital. The ortholog rule is not repeated after tags have gone.
    Each step is a column of its own, so that no expression is compiled twice.
    """
    tags = "|".join(t.replace("(", r"\(").replace(")", r"\)") for t in vocab.SUFFIX_TAGS)
    out = df.withColumn("_n0", clean_cell(raw))
    out = out.withColumn("_n1", F.regexp_replace("_n0", rf"(?:-*(?:{tags}))+$", ""))
    out = out.withColumn("_n2", F.coalesce(choose(F.col("_n1"), vocab.BARE_MUTATIONS), F.col("_n1")))
    out = out.withColumn("_n3", F.regexp_replace(F.regexp_replace("_n2", r"^(\d)\s+([A-Z]\d+[A-Z])$", "$1$2"), r"^WT\s+LanM$", "WT-LanM"))
    out = out.withColumns({"_n4": F.regexp_extract("_n0", r"^[oO]-?(\d+)$", 1), "_n5": F.substring_index("_n3", "-", 1)})
    known = F.lower("_n5").isin(*vocab.ORGANISM_PREFIXES) & F.col("_n3").contains("-")
    capital = F.concat(F.initcap("_n5"), F.substring(F.col("_n3"), F.length("_n5") + 1, F.length("_n3")))
    final = F.when(F.col("_n4") != "", F.concat(F.lit("o-"), "_n4")).when(known, capital).otherwise(F.col("_n3"))
    return out.withColumn(name, final).drop(*(f"_n{i}" for i in range(6)))


def with_enriched_variant(df: DataFrame, raw: str, out: str) -> DataFrame:
    """df with struct(name, canonical_id, construct_type, parent_scaffold) of a name; canonical_id is null if it is dropped or unreadable."""
    named = with_variant_name(df, raw, "_name").withColumn("_canonical", F.when(~F.col("_name").isin(*vocab.DROPPED_NAMES), F.coalesce(choose(F.col("_name"), vocab.CANONICAL_ALIASES), F.col("_name"))))
    types = {n: t for t, _, ns in vocab.CONSTRUCTS for n in ns}
    scaffolds = {n: s for _, s, ns in vocab.CONSTRUCTS for n in ns}
    kept, screened = F.col("_canonical").isNotNull(), F.col("_canonical").startswith("o-")
    return named.withColumn(
        out,
        F.struct(
            F.col("_name").alias("name"),
            F.col("_canonical").alias("canonical_id"),
            F.when(kept, F.coalesce(choose(F.col("_name"), types), F.when(screened, "ortholog").otherwise("unknown"))).alias("construct_type"),
            F.when(kept, F.coalesce(choose(F.col("_name"), scaffolds), F.when(screened, "Lanmodulin"))).alias("parent_scaffold"),
        ),
    ).drop("_name", "_canonical")


def element_table(spark: SparkSession) -> DataFrame:
    """The 17 elements with their attributes and charge density (charge over cubed radius)."""
    df = spark.createDataFrame([tuple(r) for r in vocab.ELEMENTS], "element string, atomic_number int, oxidation_state int, ionic_radius_pm double, is_lanthanide int")
    return df.withColumn("charge_density", F.col("oxidation_state") / F.pow("ionic_radius_pm", F.lit(3)))


def split_name(c: Column | str) -> Column:
    """train, validation or test, however spelled; null for any other text."""
    k = spelling_key(c)
    return reduce(lambda rest, kv: F.when(k.isin(*kv[1]), kv[0]).otherwise(rest), vocab.SPLITS.items(), F.lit(None).cast("string"))


def run_cost(n_chars: Column, n_texts: Column) -> Column:
    """Estimated price of extracting texts: input at 3.5 characters a token and 0.15 per million, 1500 output tokens each at 0.60 per million."""
    return F.round(F.coalesce(n_chars / 3.5 * 0.15e-6 + 1500 * n_texts * 0.60e-6, F.lit(0.0)), 4)
