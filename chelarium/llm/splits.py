"""Splits that keep related records together: component swap search.

Entities that share a source or a submitter form components, which are assigned whole. The search starts from
a hashed assignment and moves or exchanges whole components between splits by simulated annealing, reducing
the deviation of each label's counts from the proportions asked for; several chains run side by side and the
best is kept.

Scale: components come from a distributed contraction. Those with more than 1/GIANTS of all entities (GIANTS at
most) are annealed first, in one chain set; what they leave of each split is the aim of all others, which are
dealt by hash into buckets of about BUCKET components and annealed in parallel, a bucket being its own sample
of all labels. A component carries counts of the labels that it has, and a bucket looks at those of its components. No row is dropped or capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelarium.functions.ids import id_key
from chelarium.llm.components import connected_components, join_summary, link_edges
from chelarium.session import settle

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
GIANTS, BUCKET = 2000, 4000
#: Labels are categories; a column with more of them is refused.
MAX_LABELS = 10_000
CHAINS, STEPS_PER_COMPONENT = 4, 12


def entity_links(rows: DataFrame, entity: str, by: list[str]) -> DataFrame:
    """(node, link): distinct entities and what they are linked by; null, blank and placeholder values link nothing."""
    keyed = rows.select(id_key(entity).alias("node"), *(F.concat(F.lit(f"{c}:"), id_key(c)).alias(f"_{i}") for i, c in enumerate(by)))
    links = keyed.select("node", F.explode(F.array_compact(F.array(*(f"_{i}" for i in range(len(by)))))).alias("link"))
    return links.where("node IS NOT NULL").distinct()


def entity_names(rows: DataFrame, entity: str, master: DataFrame | None = None, master_entity: str | None = None) -> DataFrame:
    """(node, name): the spelling of each entity that master has (the smallest), else the smallest trimmed one of rows."""
    own = rows.select(id_key(entity).alias("node"), F.trim(entity).alias("s")).where("node IS NOT NULL").groupBy("node").agg(F.min("s").alias("s"))
    if master is None:
        return own.withColumnRenamed("s", "name")
    of = master.select(id_key(master_entity or entity).alias("node"), F.col(master_entity or entity).alias("m")).where("node IS NOT NULL").groupBy("node").agg(F.min("m").alias("m"))
    return own.join(of, "node", "left").select("node", F.coalesce("m", "s").alias("name"))


def linked_groups(rows: DataFrame, entity: str, by: list[str], names: DataFrame) -> DataFrame:
    """(node, name, group_id, group_size) of the entities that share a group with another; group_id is its smallest name."""
    named = settle(connected_components(link_edges(settle(entity_links(rows, entity, by)))).join(names, "node"))
    groups = named.groupBy("root").agg(F.min("name").alias("group_id"), F.count("*").alias("group_size"))
    return join_summary(named, groups, "root", named.count(), "group_size").select("node", "name", "group_id", "group_size")


def anneal(sizes: np.ndarray, share: np.ndarray, start: np.ndarray, seed: int, chains: int = CHAINS, steps: int | None = None) -> np.ndarray:
    """Split of each component.

    sizes: components x labels counts. share: labels x splits, the proportions aimed at. start: first split of each.
    The loss is the sum over labels and splits of the squared deviation over the label's total, plus that of the whole.
    """
    n, n_splits = len(sizes), share.shape[1]
    if not n or n_splits < 2:
        return start
    counts = np.c_[sizes, sizes.sum(axis=1)].astype(float)
    totals = np.maximum(counts.sum(axis=0), 1)
    whole = (share * sizes.sum(axis=0)[:, None]).sum(axis=0)
    aim = np.r_[share * sizes.sum(axis=0)[:, None], whole[None]]
    weight = 1 / totals[:, None]
    steps = steps or STEPS_PER_COMPONENT * n + 500
    best, best_loss = start.copy(), np.inf
    for chain in range(chains):
        rng = np.random.default_rng([seed, chain])
        at = start.copy()
        held = np.stack([counts[at == s].sum(axis=0) for s in range(n_splits)], axis=1)
        off = held - aim
        loss = float((weight * off**2).sum())
        if loss < best_loss:
            best, best_loss = at.copy(), loss
        heat = max(loss / max(n, 1), 1e-9)
        picks, goals, swaps, luck = rng.integers(0, n, steps), rng.integers(1, n_splits, steps), rng.integers(0, n, steps), rng.random(steps)
        for k in range(steps):
            i, j = picks[k], swaps[k]
            a = at[i]
            exchange = k % 2 == 1 and at[j] != a
            b = at[j] if exchange else (a + goals[k]) % n_splits
            d = counts[i] - counts[j] if exchange else counts[i]
            change = float((weight[:, 0] * d * (2 * (off[:, b] - off[:, a]) + 2 * d)).sum())
            temperature = heat * (1 - k / steps) ** 2 + 1e-12
            if change < 0 or luck[k] < np.exp(-change / temperature):
                off[:, a] -= d
                off[:, b] += d
                at[i] = b
                if exchange:
                    at[j] = a
                loss += change
                if loss < best_loss - 1e-12:
                    best, best_loss = at.copy(), loss
    return best


def hashed_split(keys: list[str], proportions: list[float], seed: int) -> np.ndarray:
    """A start: each key's split by its hash, in the proportions."""
    edges = np.cumsum(proportions) / sum(proportions)
    u = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=7).digest(), "big") / 2**56 for k in keys])
    return np.minimum(np.searchsorted(edges, u, side="right"), len(proportions) - 1)


def split_groups(rows: DataFrame, entity: str, by: list[str], label: str, names: DataFrame, proportions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(name, group_id, split): every entity of rows with the split of its component; alone standing ones are components.

    An entity's label is the smallest it has; null labels are a label of their own. Every label is aimed at by itself; more than MAX_LABELS are an
    error. An empty table gives no row.
    """
    proportions = proportions or PROPORTIONS
    splits, aims = list(proportions), np.array(list(proportions.values())) / sum(proportions.values())
    labels = rows.select(id_key(entity).alias("node"), F.col(label).cast("string").alias("l")).where("node IS NOT NULL").groupBy("node").agg(F.coalesce(F.min("l"), F.lit("")).alias("l"))
    grouped = linked_groups(rows, entity, by, names).select("node", "group_id")
    members = settle(names.join(labels, "node").join(grouped, "node", "left").select("name", "l", F.coalesce("group_id", "name").alias("group_id")))
    per_label = members.groupBy("l").agg(F.count("*").alias("c")).orderBy("l").limit(MAX_LABELS + 1).collect()
    if len(per_label) > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values and is no category")
    place, sums = {r["l"]: i for i, r in enumerate(per_label)}, np.array([r["c"] for r in per_label], dtype=float)
    counted = members.groupBy("group_id", "l").agg(F.count("*").alias("c"))
    comps = settle(counted.groupBy("group_id").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("l", "c"))).alias("counts")))  # MAX_LABELS entries each
    total, n_comps = comps.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    giant = F.col("n") > max(1, total // GIANTS)
    big = comps.where(giant).orderBy("group_id").collect()

    def dense(counts: list, labels: list[str]) -> np.ndarray:
        at = {v: i for i, v in enumerate(labels)}
        out = np.zeros((len(counts), len(labels)))
        for k, pairs in enumerate(counts):
            for l, c in pairs:
                out[k, at[l]] = c
        return out

    want = sums[:, None] * aims
    if big:
        held = sorted({l for r in big for l, _ in r["counts"]})
        sizes = dense([r["counts"] for r in big], held)
        start = hashed_split([r["group_id"] for r in big], list(aims), seed)
        # giants may take no more than their split's share: aim at their own sum in proportion
        placed = anneal(sizes, np.tile(aims, (len(held), 1)), start, seed, chains=4 * CHAINS)
        rows_of = [place[l] for l in held]
        for s in range(len(splits)):
            want[rows_of, s] -= sizes[placed == s].sum(axis=0)
    want = np.maximum(want, 0)
    rest = want.sum(axis=1, keepdims=True)
    share = np.where(rest > 0, want / np.maximum(rest, 1e-9), aims)
    n_buckets = max(1, (n_comps or 0) // BUCKET)

    def place_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id")
        keys = pdf["group_id"].tolist()
        counts = [[(p["l"], p["c"]) for p in pairs] for pairs in pdf["counts"]]
        labels = sorted({l for pairs in counts for l, _ in pairs})
        own = share[[place[l] for l in labels]]
        found = anneal(dense(counts, labels), own, hashed_split(keys, list(own.sum(axis=0)), seed), seed)
        return pd.DataFrame({"group_id": keys, "n": pdf["n"].to_numpy(), "split": [splits[s] for s in found]})

    schema = "group_id string, n bigint, split string"
    small = comps.where(~giant).withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(n_buckets))).groupBy("bucket").applyInPandas(lambda pdf: place_bucket(pdf), schema)
    spark = rows.sparkSession
    placed_big = spark.createDataFrame([(r["group_id"], r["n"], splits[s]) for r, s in zip(big, placed)] if big else [], schema)
    assigned = settle(small.unionByName(placed_big))
    return join_summary(members, assigned, "group_id", total).select("name", "group_id", "split")
