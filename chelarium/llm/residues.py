"""Residues of protein variants: from a record's sequence, or from the parent's with the mutations applied."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelarium.functions.ids import id_key
from chelarium.functions.mutations import canonical_mutations
from chelarium.llm.components import join_summary
from chelarium.session import drop_settled, settle

MIN_RESIDUES = 50
#: A parent may be that of a third of all variants; its row is sent to so many tasks.
PARENT_COPIES = 16
MEMBERS_PER_BUCKET = 1000


def clean_residues(sequence: Column) -> Column:
    """Letters in upper case without lines starting with `>`; null if fewer than MIN_RESIDUES."""
    letters = F.upper(F.regexp_replace(F.regexp_replace(sequence, "(?m)^>.*$", ""), "[^A-Za-z]", ""))
    return F.when(F.length(letters) >= MIN_RESIDUES, letters)


def mutate(residues: str, mutations: list[str]) -> str:
    """residues with the mutations applied; positions count from 1 in the given residues, those outside are passed over."""
    out = list(residues)
    for text in mutations:
        for m in canonical_mutations(text):
            old_less = m[1:]
            digits = "".join(ch for ch in old_less if ch.isdigit())
            at, new = int(digits), old_less[len(digits) :]
            if 1 <= at <= len(out):
                out[at - 1] = "" if new == "del" else new
    return "".join(out)


def variant_residues(variants: DataFrame) -> DataFrame:
    """(id, variant_id, residues): one row per variant; residues are null where none can be told.

    A variant has the residues of its earliest loaded record with a sequence, else those of its parent's own sequence
    with its mutations applied, both of its earliest record. Null loaded_at counts as last, equal ones go by record_id.
    variant_id is the spelling of the table (the smallest, if there are several). Null, blank and placeholder ids give
    no row. Columns beside the named ones are not looked at.
    """
    order = F.struct(F.col("loaded_at").isNull(), F.col("loaded_at"), F.col("record_id"))
    rec = variants.select(
        id_key("variant_id").alias("id"), "variant_id", order.alias("o"), clean_residues(F.col("sequence")).alias("own"),
        F.struct(id_key("parent_variant_id").alias("parent"), F.col("mutations")).alias("origin"),
    ).where("id IS NOT NULL")
    one = settle(
        rec.groupBy("id").agg(
            F.min("variant_id").alias("variant_id"),
            F.min_by("own", F.when(F.col("own").isNotNull(), F.col("o"))).alias("own"),
            F.min_by("origin", "o").alias("origin"),
        ),
        compression="zstd",
    )
    is_needy = F.expr("own IS NULL AND origin.parent IS NOT NULL")
    salt = F.pmod(F.xxhash64("id"), F.lit(PARENT_COPIES)).cast("int")
    needy = one.where(is_needy).select("id", "variant_id", F.col("origin.parent").alias("parent"), F.col("origin.mutations").alias("mutations"), salt.alias("salt"))
    wanted = needy.groupBy("parent").agg(F.collect_set("salt").alias("salts"))  # at most PARENT_COPIES each
    parents = one.where("own IS NOT NULL").select(F.col("id").alias("parent"), F.col("own").alias("of_parent")).join(wanted, "parent").select("parent", "of_parent", F.explode("salts").alias("salt"))

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [None if r is None else mutate(r, [x for x in (m if m is not None else []) if x]) for r, m in zip(pdf["of_parent"], pdf["mutations"])]
            yield pd.DataFrame({"id": pdf["id"], "variant_id": pdf["variant_id"], "residues": found}, columns=["id", "variant_id", "residues"])

    derived = needy.join(parents, ["parent", "salt"], "left").select("id", "variant_id", "of_parent", "mutations").mapInPandas(derive, "id string, variant_id string, residues string")
    return one.where(~is_needy).select("id", "variant_id", F.col("own").alias("residues")).unionByName(derived)


def residue_classes(residues: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, members), both settled: classes (cid, residues, n_members) of equal residues, members (cid, n_members, *kept).

    Rows without residues are in neither. A class of any size is counted before it is shuffled, and its members are sent
    through a broadcast of the few large classes, never to one task.
    """
    stored = settle(residues.where("residues IS NOT NULL").select("residues", *kept), compression="zstd")
    known = stored.withColumn("h", F.unhex(F.sha2("residues", 256)))
    classes = settle(known.groupBy("h").agg(F.min("residues").alias("residues"), F.count("*").alias("n_members")).withColumn("cid", F.monotonically_increasing_id()), compression="zstd")
    members = settle(join_summary(known.select("h", *kept), classes.select("h", "cid", "n_members"), "h", known.count(), "n_members").select("cid", "n_members", *kept))
    drop_settled(stored.sparkSession, stored)
    return classes.drop("h"), members


def bucket_count(n: Column) -> Column:
    """Buckets that a class of n members is dealt into where it meets others."""
    return F.ceil(n / MEMBERS_PER_BUCKET).cast("int")


def bucketed(members: DataFrame, by: str) -> DataFrame:
    """members with `bucket`, by the hash of their column `by`; no bucket of a class is expected to hold more than MEMBERS_PER_BUCKET."""
    return members.withColumn("bucket", F.pmod(F.xxhash64(by), bucket_count(F.col("n_members"))).cast("int"))


def to_members(pairs: DataFrame, members: DataFrame, by: str) -> DataFrame:
    """(x, y, and what pairs hold beside): every member of class a with every one of class b; pairs: a, b, n_a, n_b.

    x and y are structs of the members' columns beside cid and n_members. Large classes meet in buckets.
    """
    kept = [c for c in members.columns if c not in ("cid", "n_members")]
    side = bucketed(members, by).select("cid", "bucket", F.struct(*kept).alias("m"))
    every = lambda n: F.explode(F.sequence(F.lit(0), bucket_count(F.col(n)) - 1))
    a = pairs.withColumn("_i", every("n_a")).join(side.select(F.col("cid").alias("a"), F.col("bucket").alias("_i"), F.col("m").alias("x")), ["a", "_i"]).drop("_i")
    b = a.withColumn("_j", every("n_b")).join(side.select(F.col("cid").alias("b"), F.col("bucket").alias("_j"), F.col("m").alias("y")), ["b", "_j"])
    return b.drop("_j", "a", "b", "n_a", "n_b")


def within_classes(members: DataFrame, by: str) -> DataFrame:
    """(x, y): every two members of each class, x before y by column `by`."""
    kept = [c for c in members.columns if c not in ("cid", "n_members")]
    dealt = bucketed(members.where("n_members > 1"), by)
    every = F.explode(F.sequence(F.lit(0), bucket_count(F.col("n_members")) - 1))
    m = dealt.select("cid", F.col("bucket").alias("i"), every.alias("j"), F.struct(*kept).alias("x"))
    o = dealt.select("cid", every.alias("i"), F.col("bucket").alias("j"), F.struct(*kept).alias("y"))
    return m.join(o, ["cid", "i", "j"]).where(F.col(f"x.{by}") < F.col(f"y.{by}")).select("x", "y")
