"""Queries of the core operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelarium.functions import exprs, protein, vocab
from chelarium.functions.ids import id_key
from chelarium.operators import encode, features, folds, merge, model, quality, ranks, tables
from chelarium.plans.general import table
from chelarium.plans.reference_sql import ORACLES  # noqa: F401

MEASURES = ["pct_d", "pct_e", "pct_n", "pct_t", "pct_k", "pct_r"]


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, s): the letters of every sequence that has some."""
    v = table(spark, sf_dir, "protein_variants")
    return v.select("record_id", F.upper(F.regexp_replace("sequence", "[^A-Za-z]", "")).alias("s")).where("s <> ''")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def q_spearman_by_element(spark, sf_dir):
    return _rounded(ranks.grouped_spearman(table(spark, sf_dir, "ml_ready_features"), "target_element", "value", "pct_d"))


def q_macro_spearman(spark, sf_dir):
    return _rounded(ranks.macro_spearman(ranks.grouped_spearman(table(spark, sf_dir, "ml_ready_features"), "source_paper", "value", "hydrophobicity_pct")))


def q_average_ranks(spark, sf_dir):
    return ranks.average_ranks(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


def q_regression_metrics(spark, sf_dir):
    return _rounded(ranks.regression_metrics(table(spark, sf_dir, "ml_ready_features"), "value", "hydrophobicity_pct"))


def q_trial_ranks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("trial"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("best_round"))
    return _rounded(model.trial_ranks(p))


def q_unpivot_measures(spark, sf_dir):
    return tables.unpivot_measures(table(spark, sf_dir, "ml_ready_features"), ["measurement_id"], MEASURES, "feature", "share")


def q_onehot_aligned(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # fitted on orders that are open or closed: the status of those partly delivered is unseen and gives zeros throughout
    fitted = encode.fit_categories(o.where("o_orderstatus <> 'P'"), ["o_orderpriority", "o_orderstatus"])
    names = [f"{c}_{v}" for c, vs in fitted.items() for v in vs] + ["o_totalprice", "absent"]
    return encode.align(encode.encode(o.select("o_orderkey", *fitted, "o_totalprice"), fitted, ["o_totalprice"]), names, ["o_orderkey"])


def _strata(spark, sf_dir):
    v = table(spark, sf_dir, "protein_variants").select(id_key("variant_id").alias("variant"), F.col("selectivity_cluster").cast("int").alias("cluster"))
    return folds.entity_strata(v, "variant", "cluster")


def q_group_split(spark, sf_dir):
    return folds.stratified_split(_strata(spark, sf_dir), "variant", "cluster").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def q_folds(spark, sf_dir):
    return folds.stratified_folds(_strata(spark, sf_dir), "variant", "cluster").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def q_split_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "ml_ready_features").select(id_key("variant_id").alias("variant"), exprs.split_name("split").alias("split")).where("variant IS NOT NULL")
    return quality.groups_in_several(rows, "variant", "split")


def q_last_wins(spark, sf_dir):
    v = table(spark, sf_dir, "protein_variants").select(id_key("variant_id").alias("variant"), "record_id", "loaded_at", "construct_type", "source_organism")
    return tables.latest_wins(v, ["variant"], [F.col("loaded_at"), F.col("record_id")]).select("variant", "record_id", "construct_type", "source_organism")


def q_composite_lookup(spark, sf_dir):
    keys = [id_key("variant_id").alias("variant"), "source_paper"]
    m = table(spark, sf_dir, "literature_binding_data").select("measurement_id", *keys)
    v = tables.latest_wins(table(spark, sf_dir, "protein_variants").select(*keys, "record_id", "taxonomy"), ["variant", "source_paper"], [F.col("record_id")])
    return tables.left_lookup(m, v, ["variant", "source_paper"]).select("measurement_id", F.coalesce("record_id", F.lit(-1)).alias("record_id"), "taxonomy")


def q_unlisted_variants(spark, sf_dir):
    m = table(spark, sf_dir, "binding_measurements").select(id_key("variant_id").alias("variant")).where("variant IS NOT NULL")
    return quality.unmatched(m, table(spark, sf_dir, "protein_variants").select(id_key("variant_id").alias("variant")), ["variant"])


def q_dropped_and_kept(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_acctbal < 0")
    indebted = c.select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").where("c_mktsegment = 'BUILDING'").select("n_nationkey").distinct()
    kept = n.join(indebted, "n_nationkey", "left_semi").withColumn("kind", F.lit("kept"))
    return kept.unionByName(n.join(indebted, "n_nationkey", "left_anti").withColumn("kind", F.lit("dropped"))).select("n_nationkey", "kind")


def q_profile_rank(spark, sf_dir):
    order = {e: i for i, e in enumerate(vocab.PREDICTED)}
    rows = table(spark, sf_dir, "ml_ready_features").select("measurement_id", id_key("variant_id").alias("variant"), "target_element", "value").where("variant IS NOT NULL").distinct()
    ranked = tables.first_rank(rows.withColumn("place", exprs.choose(F.col("target_element"), order)), "variant", [F.desc_nulls_last("value"), F.asc_nulls_last("place"), F.asc("measurement_id")])
    return ranked.select("measurement_id", "variant", "target_element", "rank")


def q_element_grid(spark, sf_dir):
    listed = spark.createDataFrame([(e,) for e in vocab.PREDICTED], "target_element string")
    v = table(spark, sf_dir, "protein_variants").select(id_key("variant_id").alias("variant")).distinct()
    elements = exprs.element_table(spark).withColumnRenamed("element", "target_element")
    # every variant by the listed elements is the wanted grid
    grid = v.crossJoin(F.broadcast(listed)).join(F.broadcast(elements), "target_element")
    return grid.select("variant", "target_element", "atomic_number", F.round(F.col("charge_density") * 1e6, 6).alias("density"))


def _positioned_variants(spark, sf_dir):
    v = table(spark, sf_dir, "protein_variants").withColumn("variant", id_key("variant_id"))
    return v.withColumn("selectivity_cluster", F.col("selectivity_cluster").cast("int")).withColumn("ef_hand_count", F.col("ef_hand_count").cast("int"))


def q_merge_duplicates(spark, sf_dir):
    return merge.merge_duplicates(_positioned_variants(spark, sf_dir).drop("source_paper"), ["variant"], "record_id").select(
        "variant", "source_organism", "sequence", "taxonomy", "notes", "parent_variant_id", "mutation_notation", F.coalesce("ef_hand_count", F.lit(-1)).alias("ef_hand_count"), F.coalesce("selectivity_cluster", F.lit(-1)).alias("selectivity_cluster"), "mutations", "construct_type", "parent_scaffold", "n_records"
    )


def q_merged_counts(spark, sf_dir):
    m = q_merge_duplicates(spark, sf_dir)
    return m.groupBy("construct_type").agg(F.count("*").alias("n"), F.sum("n_records").cast("bigint").alias("n_records"), F.sum(F.size("mutations")).cast("bigint").alias("n_mutations"))


def q_running_ids(spark, sf_dir):
    return ranks.numbered(table(spark, sf_dir, "literature_binding_data").select("source_paper", "measurement_id"), ["source_paper", "measurement_id"], "running", "lit_", 4)


def q_motifs(spark, sf_dir):
    return _letters(spark, sf_dir).select("record_id", F.explode(protein.motifs(F.col("s"))).alias("h")).select("record_id", "h.start", "h.motif")


def q_motif_features(spark, sf_dir):
    d = _letters(spark, sf_dir).withColumn("hits", protein.motifs(F.col("s")))
    numbers, letters = protein.motif_numbers(F.col("hits"), F.col("s")), protein.motif_letters(F.col("hits"))
    return _rounded(d.select("record_id", *(c.alias(n) for n, c in numbers.items()), *(c.alias(n) for n, c in letters.items())))


def q_composition(spark, sf_dir):
    s = F.col("s")
    d = _letters(spark, sf_dir)
    made = {n: c for n, c in protein.sequence_numbers(s).items() if n not in ("isoelectric_point", "charge_at_ph7")}
    return _rounded(d.select("record_id", *(c.alias(n) for n, c in made.items())))


def q_charge(spark, sf_dir):
    return _rounded(_letters(spark, sf_dir).select("record_id", protein.charge_at(F.col("s"), F.lit(7.0)).alias("charge")))


def q_isoelectric_point(spark, sf_dir):
    return _rounded(_letters(spark, sf_dir).select("record_id", protein.isoelectric_point(F.col("s")).alias("pi")), 4)


def q_validate_sequence(spark, sf_dir):
    v = table(spark, sf_dir, "protein_variants").select("record_id", protein.validated_sequence("sequence").alias("v"))
    return v.select("record_id", "v.is_valid", "v.length", F.substring_index("v.error", " ", 2).alias("error"))


def q_variant_names(spark, sf_dir):
    m = table(spark, sf_dir, "binding_measurements").select(F.col("variant_id").alias("raw")).distinct()
    return exprs.with_enriched_variant(m, "raw", "e").select("raw", "e.*")


def q_element_names(spark, sf_dir):
    m = table(spark, sf_dir, "binding_measurements").groupBy(F.col("target_element").alias("raw")).agg(F.count("*").alias("n_rows"))
    return m.select("raw", exprs.element_name("raw").alias("element"), exprs.is_element_group("raw").alias("is_group"), "n_rows")


def q_unit_rules(spark, sf_dir):
    t = table(spark, sf_dir, "literature_binding_data").groupBy(F.col("value_units").alias("units")).agg(F.count("*").alias("n_rows"))
    return t.select("units", exprs.molar_scale("units").alias("lenient"), exprs.molar_scale("units", strict=True).alias("strict"), "n_rows")


def q_families(spark, sf_dir):
    t = table(spark, sf_dir, "literature_binding_data")
    return t.groupBy(exprs.measurement_family("value_type").alias("family"), exprs.is_affinity_candidate("value_type", "value_in_molar").alias("candidate")).agg(F.count("*").alias("n_rows"))


def q_strict_tier(spark, sf_dir):
    return tables.strict_tier(table(spark, sf_dir, "literature_binding_data")).select("measurement_id", F.round(-F.log10("value_in_molar"), 6).alias("affinity_score"))


def q_taxonomy_text(spark, sf_dir):
    cells = {"brand": F.when(F.col("p_size") % 3 != 0, F.col("p_brand")), "type": F.when(F.col("p_size") % 2 != 0, F.col("p_type")), "size": F.when(F.col("p_size") > 5, F.col("p_size"))}
    return table(spark, sf_dir, "part").select("p_partkey", exprs.taxonomy_text(cells).alias("text"))


def q_saturation_profile(spark, sf_dir):
    return _rounded(tables.saturation_profile(table(spark, sf_dir, "ml_ready_features"), "target_element", "value"))


def q_concordance(spark, sf_dir):
    lit = table(spark, sf_dir, "literature_binding_data").where("is_molar_affinity_candidate AND value_in_molar > 0")
    score = lit.groupBy(id_key("variant_id").alias("variant"), exprs.element_name("target_element").alias("element")).agg(F.max(-F.log10("value_in_molar")).alias("score"))
    screen = table(spark, sf_dir, "ml_ready_features").groupBy(id_key("variant_id").alias("variant"), F.col("target_element").alias("element")).agg(F.max("value").alias("value"))
    both = score.join(screen, ["variant", "element"])
    w = Window.partitionBy("variant")  # 17 elements at most
    return _rounded(both.select("variant", "element", "score", "value", F.rank().over(w.orderBy(F.desc("score"))).alias("literature_rank"), F.rank().over(w.orderBy(F.desc("value"))).alias("screening_rank")))


def q_value_counts(spark, sf_dir):
    return tables.value_counts(table(spark, sf_dir, "literature_binding_data"), "value_source_type")


def q_top_papers(spark, sf_dir):
    return tables.value_counts(table(spark, sf_dir, "literature_binding_data"), "source_paper", top=5)


def q_coverage(spark, sf_dir):
    return _rounded(tables.coverage(table(spark, sf_dir, "literature_binding_data"), ["variant_id", "sequence", "value", "value_units", "value_in_molar", "conditions_ph", "conditions_notes"]))


def q_completeness(spark, sf_dir):
    t = table(spark, sf_dir, "ml_ready_features").groupBy(id_key("variant_id").alias("variant")).agg(F.count_distinct("target_element").alias("n_elements"))
    return t.groupBy("n_elements").agg(F.count("*").alias("n_variants"))


def q_value_range(spark, sf_dir):
    return table(spark, sf_dir, "ml_ready_features").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("variant_id").alias("n_variants"), F.count_distinct("target_element").alias("n_elements"))


def q_cost_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("text").alias("n_texts"), F.sum(F.length("text")).alias("n_chars")).select("n_texts", "n_chars", exprs.run_cost(F.col("n_chars"), F.col("n_texts")).alias("cost"))


def q_variant_rejects(spark, sf_dir):
    return quality.reject_counts(table(spark, sf_dir, "protein_variants"), quality.variant_rules())


def q_measurement_rejects(spark, sf_dir):
    return quality.reject_counts(table(spark, sf_dir, "binding_measurements"), quality.measurement_rules())


def q_changed_molar(spark, sf_dir):
    t = table(spark, sf_dir, "literature_binding_data").select(F.round(F.log10(F.when(F.col("value_in_molar") > 0, F.col("value_in_molar"))), 6).alias("old"), F.round(F.log10(F.when(F.col("value") > 0, exprs.to_molar("value", "value_units"))), 6).alias("new"))
    return tables.changed_rows(t, "old", "new")


def q_json_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.max(F.to_json("p")).alias("last"))


def q_explode_renest(spark, sf_dir):
    v = table(spark, sf_dir, "protein_variants").select("record_id", F.posexplode("mutations").alias("pos", "m"))
    # a record's own mutations, a short list
    nested = v.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("l"))
    return nested.select("record_id", F.array_join(F.transform("l", lambda x: x["m"]), "|").alias("mutations"), F.size("l").alias("n"))


def _extracted(spark, sf_dir):
    v = table(spark, sf_dir, "protein_variants").select(F.col("source_paper").alias("paper_id"), F.col("record_id").alias("pos"), "variant_id", "source_organism", "sequence", "notes", "mutations", F.col("source_paper"))
    m = table(spark, sf_dir, "literature_binding_data").select(F.col("source_paper").alias("paper_id"), "measurement_id", "variant_id", "target_element")
    return v.where("paper_id IS NOT NULL"), m.where("paper_id IS NOT NULL")


def q_repair_counts(spark, sf_dir):
    return merge.repair_counts(*_extracted(spark, sf_dir))


def q_repaired_variants(spark, sf_dir):
    return merge.repair(*_extracted(spark, sf_dir))[0].select("paper_id", "variant_id", "construct_type", "parent_scaffold", "source_organism")


def _feature_inputs(spark, sf_dir):
    """Measurements with the split read and the sequence of their variant; an exact repeat counts once."""
    rows = table(spark, sf_dir, "ml_ready_features").select("measurement_id", id_key("variant_id").alias("variant_id"), "target_element", "selectivity_cluster", "value", exprs.split_name("split").alias("split"))
    seq = F.upper(F.regexp_replace("sequence", "[^A-Za-z]", ""))
    s = table(spark, sf_dir, "protein_variants").select(id_key("variant_id").alias("variant_id"), seq.alias("sequence")).where(f"sequence RLIKE '^[{protein.CANONICAL}]{{50,}}$'")
    one = s.groupBy("variant_id").agg(F.min("sequence").alias("sequence"))
    return rows.dropDuplicates(["measurement_id"]).join(one, "variant_id", "left")


def _usable(inputs):
    """inputs with `reason`, null where the row can be fitted or scored."""
    rejected = F.when(F.col("variant_id").isNull(), "no_variant").when(F.col("split").isNull(), "no_split").when(F.col("value").isNull() | F.isnan("value"), "no_value")
    known = F.col("target_element").isin(*(e[0] for e in vocab.ELEMENTS))
    return inputs.withColumn("reason", rejected.when(F.col("sequence").isNull(), "no_sequence").when(~F.coalesce(known, F.lit(False)), "unknown_element"))


def _matrix(spark, sf_dir):
    return features.build_matrix(_usable(_feature_inputs(spark, sf_dir)).where("reason IS NULL").drop("reason"))


def q_feature_rejects(spark, sf_dir):
    """Rows that the feature matrix leaves out, by the first reason that holds."""
    return _usable(_feature_inputs(spark, sf_dir)).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n_rows"))


def q_feature_matrix(spark, sf_dir):
    return _rounded(_matrix(spark, sf_dir)[0])


_FITS: dict = {}


def _fitted(spark, sf_dir):
    """The fit of _fit, made once for each session and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FITS:
        _FITS[key] = _fit(spark, sf_dir)
    return _FITS[key]


def _fit(spark, sf_dir):
    """(fitted, matrix, categories, names): the production parameters; the best number of trees by a holdout carved from the training variants."""
    matrix, categories, names = _matrix(spark, sf_dir)
    strata = folds.entity_strata(matrix.where("split = 'train'"), "variant_id", "selectivity_cluster")
    held = folds.stratified_folds(strata, "variant_id", "selectivity_cluster", 7).select("variant_id", "fold")
    train = matrix.where("split = 'train'").join(held, "variant_id").persist()
    fitted = model.fit_with_holdout(train.where("fold > 0"), train.where("fold = 0"), names, model.TreeParams())
    train.unpersist()
    return fitted, matrix, categories, names


def q_gbt_metrics(spark, sf_dir):
    fitted, matrix, _, _ = _fitted(spark, sf_dir)
    return _rounded(ranks.regression_metrics(model.predict(fitted, matrix.where("split = 'test'")), "value", "predicted"))


def q_gbt_bundle(spark, sf_dir):
    """All metrics of the held-out test rows, and rank correlation by element and by variant."""
    fitted, matrix, _, _ = _fitted(spark, sf_dir)
    return _rounded(model.metric_bundle(model.predict(fitted, matrix.where("split = 'test'")), vocab.PREDICTED))


def q_importance(spark, sf_dir):
    return model.importance(_fitted(spark, sf_dir)[0], spark)


def q_prediction_profile(spark, sf_dir):
    fitted, _, categories, names = _fitted(spark, sf_dir)
    seqs = table(spark, sf_dir, "protein_variants").select(F.col("record_id").alias("seq_id"), "sequence")
    grid = features.profile_rows(seqs, categories, names, vocab.PREDICTED)
    return model.ranked_profile(model.predict(fitted, grid)).select("seq_id", "target_element", "rank", "reduced_confidence", F.round("predicted", 6).alias("predicted"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
