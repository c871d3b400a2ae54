"""Same or near-same records across splits by content-defined chunks.

A rolling hash over the normalised record is cut where its value is the least within REACH letters on either side,
so cuts depend on content only and find themselves again after an insertion or deletion; a chunk is what lies
between two cuts, and chunks do not overlap. CHUNKINGS hashes give as many chunkings, as one difference
spoils the chunk it stands in. Chunk digests are joined between the training and the evaluation side. The lengths of the chunks that a
pair has in common, frequent ones included, are summed into the fraction of either record that the other
covers; pairs that have a fraction above nought are compared exactly.

Scale: records are classes of equal content with a mask of the splits they are in. A chunk is joined on only if it
holds a run of the rarer part of its record's runs (those that `neardup.prefix_length` keeps), by the
frequency table of fixed size: tags, linkers and carrier domains that unrelated records have in common are frequent, so pairs
are not formed by them, while their length counts in the fraction. A record emits some 80 digests. Skewed digests are those of near copies, all of whose pairs are in the result; adaptive
execution splits them. Overlaps are counted with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelarium.functions.exprs import split_name
from chelarium.functions.ids import id_key
from chelarium.llm.neardup import SHARE, prefix_length, rarity, run_levels, with_sides
from chelarium.llm.residues import residue_classes, to_members, variant_residues, within_classes
from chelarium.llm.shingles import RUN, all_runs, letters, mix, runs, similar_pairs
from chelarium.session import settle

WINDOW, REACH, MIN_CHUNK, CHUNKINGS = 2, 4, 7, 5
TRAIN, VALIDATION, TEST = 1, 2, 4

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def chunks(texts: list[str], chunking: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, digest, start, length) of the chunks of each text, in order and without overlap; starts count over all letters.

    Every letter is in one chunk. Equal texts have equal chunks, wherever they stand.
    """
    codes, owner = letters(texts)
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            h[i:] = h[i:] * np.uint64(31) + codes[: n - i].astype(np.uint64)
        h = mix(h ^ mix(np.array([chunking], np.uint64)))
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        starts_of = np.flatnonzero(first)[np.cumsum(first) - 1]
        h[np.arange(n) - starts_of < WINDOW - 1] = np.iinfo(np.uint64).max
        least = np.ones(n, bool)
        for i in range(1, REACH + 1):
            same = owner[i:] == owner[:-i]
            least[i:] &= ~same | (h[i:] < h[:-i])
            least[:-i] &= ~same | (h[:-i] <= h[i:])
        starts = np.flatnonzero(least | first)
        stop = np.concatenate([starts[1:], [n]])
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64)) * _powers(_BASE, n), dtype=np.uint64)])
        digest = mix((prefix[stop] - prefix[starts]) * _powers(_INVERSE, n)[starts] + mix((stop - starts).astype(np.uint64) + np.uint64(chunking << 32)))
    return owner[starts], digest.view(np.int64), starts, stop - starts


def _selective(texts: list[str], levels: np.ndarray) -> np.ndarray:
    """For every letter how many of the runs that start before it are among the rarer ones of their text (one entry more than letters)."""
    owner, place, code = all_runs(texts)
    out = np.zeros(sum(map(len, texts)) + 1, np.int64)
    if len(code):
        o, c = runs(texts)
        order = rarity(c, levels)
        by = np.lexsort((order, o))
        n_runs = np.bincount(o, minlength=len(texts))
        last = np.cumsum(n_runs) - n_runs + np.maximum(prefix_length(n_runs, SHARE), 1) - 1
        most = np.zeros(len(texts), np.uint64)
        most[n_runs > 0] = order[by][last[n_runs > 0]]
        out[place + 1] = rarity(code, levels) <= most[owner]
    return np.cumsum(out)


def chunk_keys(texts: list[str], levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, digest): the distinct digests of each text that are joined on, of all chunkings."""
    before = _selective(texts, levels)
    owners, digests = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for chunking in range(CHUNKINGS):
        owner, digest, start, length = chunks(texts, chunking)
        at = start[length >= MIN_CHUNK]
        held = before[at + length[length >= MIN_CHUNK] - RUN + 1] > before[at]
        owners.append(owner[length >= MIN_CHUNK][held])
        digests.append(digest[length >= MIN_CHUNK][held])
    o, d = np.concatenate(owners), np.concatenate(digests)
    by = np.lexsort((d, o))
    o, d = o[by], d[by]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (d[1:] != d[:-1])]) if len(o) else np.empty(0, bool)
    return o[new], d[new]


def chunk_table(classes: DataFrame, levels: Broadcast) -> DataFrame:
    """(cid, digest) of the chunks of classes (cid, residues) that are joined on; levels: those of run_levels."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, digest = chunk_keys(pdf["residues"].tolist(), levels.value)
            yield pd.DataFrame({"cid": pdf["cid"].to_numpy()[owner], "digest": digest})

    return classes.select("cid", "residues").mapInPandas(cut, "cid bigint, digest bigint")


def chunk_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a before b: classes (cid, residues, mask) on different sides that have a chunk in common."""
    levels = classes.sparkSession.sparkContext.broadcast(run_levels(classes))
    side = lambda bits, name: chunk_table(classes.where(F.col("mask").bitwiseAND(bits) != 0), levels).withColumnRenamed("cid", name)
    met = side(TRAIN, "t").join(side(VALIDATION + TEST, "e"), "digest").where("t <> e")
    return met.select(F.least("t", "e").alias("a"), F.greatest("t", "e").alias("b")).distinct()


def overlap_fractions(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts the share of the letters of a, and of b, that lie in chunks (of the first chunking) that both have."""
    sides = []
    for texts in (a, b):
        owner, digest, _, length = chunks(texts)
        sides.append((owner, mix(digest.view(np.uint64) ^ mix(owner.astype(np.uint64))), length, np.array([max(1, len(t)) for t in texts], np.int64)))
    (oa, ka, la, na), (ob, kb, lb, nb) = sides
    shared = lambda o, k, other, lengths, n: np.bincount(o, weights=lengths * np.isin(k, other), minlength=len(n)) / n
    return shared(oa, ka, kb, la, na), shared(ob, kb, ka, lb, nb)


def overlapping_classes(classes: DataFrame, share: float = SHARE) -> DataFrame:
    """(a, b, n_a, n_b, of_a, of_b): near-duplicate classes on different sides, a before b, and the fraction of either that the
    chunks of both cover. classes: cid, residues, n_members, mask."""
    full = with_sides(chunk_pairs(classes), classes, ["residues", "n_members"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf[similar_pairs(pdf["ra"].tolist(), pdf["rb"].tolist(), share)]
            of_a, of_b = overlap_fractions(found["ra"].tolist(), found["rb"].tolist())
            yield found[["a", "b", "n_a", "n_b"]].assign(of_a=of_a, of_b=of_b)

    return full.select("a", "b", F.col("_a.n_members").alias("n_a"), F.col("_b.n_members").alias("n_b"), F.col("_a.residues").alias("ra"), F.col("_b.residues").alias("rb")).mapInPandas(
        check, "a bigint, b bigint, n_a bigint, n_b bigint, of_a double, of_b double"
    )


def split_masks(rows: DataFrame) -> DataFrame:
    """(id, shown, mask): the smallest spelling of each variant of `rows` and the splits that it has rows in; null splits don't count."""
    s = split_name(F.col("split"))
    bit = F.when(s == "train", TRAIN).when(s == "validation", VALIDATION).when(s == "test", TEST)
    read = rows.select(id_key("variant_id").alias("id"), F.trim("variant_id").alias("s"), bit.alias("bit")).where("id IS NOT NULL")
    return read.groupBy("id").agg(F.min("s").alias("shown"), F.bit_or("bit").alias("mask")).where("mask IS NOT NULL")


def cross_split_overlaps(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """(x, y, of_x, of_y, eval_split): variants (structs of variant_id and mask) in train and an evaluation split that are one or
    near-duplicates, and the fraction of either's residues that chunks of the other cover; a variant covers itself whole.

    rows: variant_id, split (and others). variants: as for variant_residues. Variants without a record in `variants` keep their
    smallest spelling in `rows` and can only overlap with themselves.
    """
    masks = settle(split_masks(rows))
    known = settle(masks.drop("shown").join(variant_residues(variants), "id").select("id", "variant_id", "mask", "residues"))
    classes, members = residue_classes(known, ["variant_id", "mask"])
    class_masks = members.groupBy("cid").agg(F.bit_or("mask").alias("mask"))
    masked = settle(classes.join(class_masks, "cid"))
    across = to_members(overlapping_classes(masked), members, "variant_id").select("x", "y", F.col("of_a").alias("of_x"), F.col("of_b").alias("of_y"))
    whole = [F.lit(1.0).alias("of_x"), F.lit(1.0).alias("of_y")]
    equal = within_classes(members, "variant_id").select("x", "y", *whole)
    named = masks.where(F.col("mask").bitwiseAND(TRAIN) != 0).join(known.select("id", "variant_id"), "id", "left")
    same = named.select(F.struct(F.coalesce("variant_id", "shown").alias("variant_id"), "mask").alias("x")).select("x", F.col("x").alias("y"), *whole)
    pairs = across.unionByName(equal).unionByName(same)
    meets = lambda bit: ((F.col("x.mask").bitwiseAND(TRAIN) != 0) & (F.col("y.mask").bitwiseAND(bit) != 0)) | ((F.col("y.mask").bitwiseAND(TRAIN) != 0) & (F.col("x.mask").bitwiseAND(bit) != 0))
    found = F.array_compact(F.array(F.when(meets(VALIDATION), F.lit("validation")), F.when(meets(TEST), F.lit("test"))))
    return pairs.select("x", "y", "of_x", "of_y", F.explode(found).alias("eval_split"))


def cross_split_pairs(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant_id_a, variant_id_b, eval_split) of cross_split_overlaps; smaller id first, or both equal."""
    x, y = "x.variant_id", "y.variant_id"
    return cross_split_overlaps(rows, variants).select(F.least(x, y).alias("variant_id_a"), F.greatest(x, y).alias("variant_id_b"), "eval_split")


def covered_records(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant_id, eval_split, n_train, covered): every overlapping variant of an evaluation split, the number of training variants that it
    overlaps with (itself included) and the largest fraction of its residues that one of them covers."""
    bit = F.when(F.col("eval_split") == "validation", VALIDATION).otherwise(TEST)
    side = lambda e, t, of: F.when((F.col(f"{e}.mask").bitwiseAND(bit) != 0) & (F.col(f"{t}.mask").bitwiseAND(TRAIN) != 0), F.struct(F.col(f"{e}.variant_id").alias("e"), F.col(f"{t}.variant_id").alias("t"), F.col(of).alias("part")))
    met = cross_split_overlaps(rows, variants).select("eval_split", F.explode(F.array_distinct(F.array_compact(F.array(side("x", "y", "of_x"), side("y", "x", "of_y"))))).alias("p"))
    return met.groupBy(F.col("p.e").alias("variant_id"), "eval_split").agg(F.count("*").alias("n_train"), F.max("p.part").alias("covered"))


def overlap_report(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(eval_split, source_paper, n_variants): variants of each evaluation split that overlap with train, per source.

    A source is counted under its spelling key; null, blank and placeholder sources under an empty text.
    """
    hit = pairs.select("eval_split", id_key("variant_id_a").alias("id")).unionByName(pairs.select("eval_split", id_key("variant_id_b").alias("id"))).distinct()
    of = rows.select(id_key("variant_id").alias("id"), split_name(F.col("split")).alias("eval_split"), F.coalesce(id_key("source_paper"), F.lit("")).alias("source_paper"))
    return of.where("eval_split <> 'train'").distinct().join(hit, ["id", "eval_split"]).groupBy("eval_split", "source_paper").agg(F.count("*").alias("n_variants"))
