"""SQL of the core operators' queries, for DuckDB over the same tables."""

from __future__ import annotations

from chelarium.functions import protein, vocab
from chelarium.functions.ids import id_key_sql

_KEY = id_key_sql("variant_id")
_SPELL = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
_LETTERS = "letters AS (SELECT record_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS s FROM protein_variants WHERE regexp_replace(sequence, '[^A-Za-z]', '', 'g') <> '')"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _case(c: str, values: dict, other: str = "NULL") -> str:
    return f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END)"


def _count(letters: str) -> str:
    return f"(length(s) - length(translate(s, '{letters}', '')))"


def _spearman(group: str, x: str, y: str) -> str:
    return f"""
r AS (SELECT {group} AS g, {x} AS x, {y} AS y FROM ml_ready_features WHERE {x} IS NOT NULL AND NOT isnan({x}) AND {y} IS NOT NULL AND NOT isnan({y})),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM r),
s AS (SELECT g, count(*) AS n, covar_pop(rx, ry) AS c, var_pop(rx) AS vx, var_pop(ry) AS vy FROM k GROUP BY g),
per AS (SELECT g, n, CASE WHEN n > 1 AND vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END AS rho FROM s)"""


_STRATA = f"e AS (SELECT {_KEY} AS variant, min(CAST(trunc(CASE WHEN isnan(selectivity_cluster) THEN NULL ELSE selectivity_cluster END) AS INT)) AS cluster FROM protein_variants WHERE {_KEY} IS NOT NULL GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('42:' || variant), variant) AS place, count(*) OVER (PARTITION BY cluster) AS size FROM e)"

_HITS = _LETTERS + f""",
cut AS (SELECT record_id, s, regexp_extract_all(s, '{protein.MOTIF}') AS m, list_transform(string_split_regex(s, '{protein.MOTIF}'), lambda x: length(x)) AS b FROM letters),
hits AS (SELECT record_id, s, m, list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(b[1:i]) AS INT) + 6 * (CAST(i AS INT) - 1)) AS st FROM cut)"""

_N_END = "(CASE left(s, 1) " + " ".join(f"WHEN '{r}' THEN {pk}" for r, pk in protein.N_END_PK_OF.items()) + f" ELSE {protein.N_END_PK} END)"
_C_END = "(CASE right(s, 1) " + " ".join(f"WHEN '{r}' THEN {pk}" for r, pk in protein.C_END_PK_OF.items()) + f" ELSE {protein.C_END_PK} END)"


def _charge(ph: str) -> str:
    plus = " + ".join(f"{_count(r)} / (pow(10, {ph} - {pk}) + 1)" for r, pk in protein.POSITIVE_PK.items())
    minus = " - ".join(f"{_count(r)} / (pow(10, {pk} - {ph}) + 1)" for r, pk in protein.NEGATIVE_PK.items())
    return f"1 / (pow(10, {ph} - {_N_END}) + 1) + {plus} - 1 / (pow(10, {_C_END} - {ph}) + 1) - {minus}"


_FAMILY = "(CASE WHEN value_type IS NULL THEN NULL ELSE " + _case("lower(trim(value_type))", {t: f for f, ts in vocab.FAMILIES.items() for t in ts}, "'other'") + " END)"
_SCALE = "replace(replace(replace(lower(" + _STRIP.format("value_units") + "), ' ', ''), 'mol', 'm'), 'l^{-1}', '')"
_ELEMENT = _case("lower(" + _STRIP.format("target_element") + ")", vocab.element_spellings())
_IS_GROUP = "coalesce(lower(" + _STRIP.format("target_element") + f") IN ({', '.join(repr(g) for g in vocab.ELEMENT_GROUPS)}), false)"
_FILLED = "({0} IS NOT NULL AND NOT isnan({0}))"

_NAMES = rf"""
n0 AS (SELECT DISTINCT variant_id AS raw, nullif({_STRIP.format("variant_id")}, '') AS c FROM binding_measurements),
n1 AS (SELECT raw, c, regexp_replace(c, '(-*(-Cys|-GSGC|\(GSGC\)|-SpyTag3|-SpyTag|-His6|-His10))+$', '') AS b FROM n0),
n2 AS (SELECT raw, c, regexp_replace(regexp_replace(CASE WHEN b = 'R100K' THEN 'Hans-LanM(R100K)' ELSE b END, '^(\d)\s+([A-Z]\d+[A-Z])$', '\1\2'), '^WT\s+LanM$', 'WT-LanM') AS d FROM n1),
n3 AS (SELECT raw, CASE WHEN regexp_full_match(c, '[oO]-?\d+') THEN 'o-' || regexp_extract(c, '\d+')
    WHEN contains(d, '-') AND lower(split_part(d, '-', 1)) IN ('mex', 'hans', 'melba') THEN upper(left(d, 1)) || lower(substr(split_part(d, '-', 1), 2)) || substr(d, length(split_part(d, '-', 1)) + 1)
    ELSE d END AS name FROM n2),
n4 AS (SELECT raw, name, CASE WHEN name = 'LanM' THEN NULL ELSE {_case("name", vocab.CANONICAL_ALIASES, "name")} END AS canonical_id FROM n3)"""

ORACLES = {
    "q_spearman_by_element": "WITH " + _spearman("target_element", "value", "pct_d") + " SELECT g AS target_element, n, round(rho, 6) AS rho FROM per",
    "q_macro_spearman": "WITH " + _spearman("source_paper", "value", "hydrophobicity_pct") + " SELECT round(avg(rho), 6) AS macro_rho, count(rho) AS n_groups, count(*) - count(rho) AS n_skipped FROM per",
    "q_average_ranks": "SELECT DISTINCT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS times FROM lineitem",
    "q_regression_metrics": "WITH r AS (SELECT value AS y, hydrophobicity_pct AS p FROM ml_ready_features WHERE value IS NOT NULL AND hydrophobicity_pct IS NOT NULL) SELECT count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM r",
    "q_trial_ranks": "WITH t AS (SELECT p_size AS trial, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part GROUP BY 1) SELECT trial, round(m, 6) AS mean_score, round(s, 6) AS std_score, trial AS median_round, rank() OVER (ORDER BY m DESC) AS rank FROM t",
    "q_unpivot_measures": " UNION ALL ".join(f"SELECT measurement_id, '{c}' AS feature, {c} AS share FROM ml_ready_features WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in ("pct_d", "pct_e", "pct_n", "pct_t", "pct_k", "pct_r")),
    "q_onehot_aligned": "SELECT o_orderkey, " + ", ".join(f"""CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS "{c}_{v}" """ for c, vs in {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "o_orderstatus": ["F", "O"]}.items() for v in vs) + ", o_totalprice, 0.0::DOUBLE AS absent FROM orders",
    "q_group_split": f"WITH {_STRATA} SELECT variant, coalesce(cluster, -1) AS cluster, CASE WHEN place <= floor(size * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM p",
    "q_folds": f"WITH {_STRATA} SELECT variant, coalesce(cluster, -1) AS cluster, CAST((place - 1) % 5 AS INT) AS fold FROM p",
    "q_split_overlap": f"""WITH s AS (SELECT {_KEY} AS variant, lower(trim(split, E' \\t\\n')) AS t FROM ml_ready_features),
n AS (SELECT variant, CASE WHEN t LIKE 'tr%' THEN 1 WHEN t LIKE 'val%' OR t LIKE 'dev%' THEN 2 WHEN t LIKE 'test%' OR t LIKE 'held%' OR t LIKE 'hold%' OR t = 'tst' THEN 3 END AS k FROM s WHERE variant IS NOT NULL)
SELECT variant, count(DISTINCT k) AS n_splits FROM n GROUP BY 1 HAVING count(DISTINCT k) > 1""",
    "q_last_wins": f"SELECT variant, record_id, construct_type, source_organism FROM (SELECT *, {_KEY} AS variant, row_number() OVER (PARTITION BY {_KEY} ORDER BY loaded_at DESC, record_id DESC) AS k FROM protein_variants) WHERE k = 1",
    "q_composite_lookup": f"WITH v AS (SELECT {_KEY} AS variant, source_paper, max(record_id) AS record_id, arg_max_null(taxonomy, record_id) AS taxonomy FROM protein_variants GROUP BY 1, 2) SELECT m.measurement_id, coalesce(v.record_id, -1) AS record_id, v.taxonomy FROM literature_binding_data m LEFT JOIN v ON {id_key_sql('m.variant_id')} = v.variant AND m.source_paper = v.source_paper",
    "q_unlisted_variants": f"SELECT DISTINCT {_KEY} AS variant FROM binding_measurements WHERE {_KEY} IS NOT NULL AND {_KEY} NOT IN (SELECT {_KEY} FROM protein_variants WHERE {_KEY} IS NOT NULL)",
    "q_dropped_and_kept": "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING') THEN 'kept' ELSE 'dropped' END AS kind FROM nation",
    "q_profile_rank": f"WITH r AS (SELECT DISTINCT measurement_id, {_KEY} AS variant, target_element, value FROM ml_ready_features WHERE {_KEY} IS NOT NULL) SELECT measurement_id, variant, target_element, row_number() OVER (PARTITION BY variant ORDER BY value DESC NULLS LAST, {_case('target_element', {e: i for i, e in enumerate(vocab.PREDICTED)})} NULLS LAST, measurement_id) AS rank FROM r",
    "q_element_grid": "WITH el(target_element, z, ox, r) AS (VALUES " + ", ".join(f"('{e}', {z}, {ox}, {r}::DOUBLE)" for e, z, ox, r, _ in vocab.ELEMENTS if e in vocab.PREDICTED) + f") SELECT variant, target_element, z AS atomic_number, round(ox / pow(r, 3) * 1e6, 6) AS density FROM (SELECT DISTINCT {_KEY} AS variant FROM protein_variants), el",
    "q_merged_counts": f"""WITH p AS (SELECT *, {_KEY} AS variant FROM protein_variants),
g AS (SELECT variant, count(*) AS n, arg_min_null(construct_type, record_id) AS construct_type FROM p GROUP BY 1),
mu AS (SELECT variant, count(DISTINCT x) AS k FROM (SELECT variant, unnest(mutations) AS x FROM p) GROUP BY 1)
SELECT construct_type, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_mutations FROM g LEFT JOIN mu USING (variant) GROUP BY 1""",
    "q_merge_duplicates": f"""WITH p AS (SELECT *, {_KEY} AS variant FROM protein_variants),
mu AS (SELECT variant, list(x ORDER BY o, i) AS mutations FROM (SELECT variant, x, min(o) AS o, arg_min(i, o) AS i FROM (SELECT variant, record_id AS o, unnest(mutations) AS x, generate_subscripts(mutations, 1) AS i FROM p) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT variant, count(*) AS n_records, """
    + ", ".join(f"arg_max({c}, (length({c}), -record_id)) FILTER (WHERE length({c}) > 0) AS {c}" for c in ("source_organism", "sequence", "taxonomy", "notes"))
    + ", " + ", ".join(f"arg_min({c}, record_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("parent_variant_id", "mutation_notation"))
    + ", " + ", ".join(f"arg_min(CAST({c} AS INT), record_id) FILTER (WHERE {c} IS NOT NULL AND NOT isnan({c})) AS {c}" for c in ("ef_hand_count", "selectivity_cluster"))
    + ", " + ", ".join(f"arg_min_null({c}, record_id) AS {c}" for c in ("construct_type", "parent_scaffold"))
    + " FROM p GROUP BY 1) SELECT g.* REPLACE (coalesce(ef_hand_count, -1) AS ef_hand_count, coalesce(selectivity_cluster, -1) AS selectivity_cluster), coalesce(mutations, []) AS mutations FROM g LEFT JOIN mu ON g.variant IS NOT DISTINCT FROM mu.variant",
    "q_running_ids": "SELECT source_paper, measurement_id, 'lit_' || CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS running FROM (SELECT source_paper, measurement_id, row_number() OVER (ORDER BY source_paper NULLS FIRST, measurement_id) AS k FROM literature_binding_data)",
    "q_motifs": f"WITH {_HITS} SELECT record_id, unnest(st) AS start, unnest(m) AS motif FROM hits",
    "q_motif_features": f"""WITH {_HITS}, gaps AS (SELECT *, list_transform(range(2, len(st) + 1), lambda i: CAST(st[i] - st[i - 1] AS DOUBLE)) AS gap FROM hits)
SELECT record_id, CAST(len(m) AS INT) AS ef_hand_count, round(CASE WHEN len(m) > 1 THEN list_avg(gap) END, 6) AS ef_hand_mean_spacing, round(CASE WHEN len(m) > 1 THEN list_stddev_pop(gap) END, 6) AS ef_hand_spacing_stdev,
  round(CASE WHEN len(m) > 1 THEN (st[len(st)] - st[1]) / length(s) END, 6) AS ef_hand_span_fraction, CAST(len(m) = 4 AS INT) AS has_four_ef_hands,
  """ + ", ".join(f"coalesce(substr(m[{k}], {p + 1}, 1), 'MISSING') AS ef{k}_pos{p}" for k in (1, 2, 3, 4) for p in (0, 2, 5)) + " FROM gaps",
    "q_composition": f"WITH {_LETTERS} SELECT record_id, length(s) AS length, " + ", ".join(f"round({_count(r)} / length(s), 6) AS pct_{r.lower()}" for r in protein.FRACTIONS)
    + f", round({_count(protein.HYDROPHOBIC)} / length(s), 6) AS hydrophobicity_pct, round(CASE WHEN {_count(protein.BASIC)} = 0 THEN {_count(protein.ACIDIC)} ELSE {_count(protein.ACIDIC)} / {_count(protein.BASIC)} END::DOUBLE, 6) AS acidic_basic_ratio"
    + ", round(" + " + ".join(f"{_count(r)} * {w}::DOUBLE" for r, w in protein.MASSES.items()) + f" - (length(s) - 1) * {protein.WATER}::DOUBLE, 6) AS molecular_weight"
    + f", round({_count(protein.AROMATIC)} / length(s), 6) AS aromaticity, round((" + " + ".join(f"{_count(r)} * ({w})::DOUBLE" for r, w in protein.HYDROPATHY.items()) + ") / length(s), 6) AS gravy FROM letters",
    "q_charge": f"WITH {_LETTERS} SELECT record_id, round({_charge('7')}, 6) AS charge FROM letters",
    "q_isoelectric_point": f"""WITH RECURSIVE {_LETTERS},
halved(record_id, s, lo, hi, k) AS (
  SELECT record_id, s, {protein.PI_LOW}::DOUBLE, {protein.PI_HIGH}::DOUBLE, 0 FROM letters
  UNION ALL SELECT record_id, s, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, k + 1
  FROM (SELECT *, {_charge('mid')} > 0 AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE k < {protein.PI_STEPS})))
SELECT record_id, round((lo + hi) / 2, 4) AS pi FROM halved WHERE k = {protein.PI_STEPS}""",
    "q_validate_sequence": rf"""WITH l AS (SELECT record_id, sequence, list_transform(string_split_regex({_STRIP.format('sequence')}, '\r\n|[\r\n\v\f]'), lambda x: {_STRIP.format('x')}) AS ls FROM protein_variants),
b AS (SELECT record_id, sequence, len(list_filter(ls, lambda x: starts_with(x, '>'))) AS h, upper(regexp_replace(array_to_string(list_filter(ls, lambda x: NOT starts_with(x, '>')), ''), '[\s\p{{Z}}]+', '', 'g')) AS s FROM l),
e AS (SELECT record_id, CASE WHEN sequence IS NULL THEN 'No sequence' WHEN h > 1 THEN 'Multiple FASTA' WHEN length(s) = 0 THEN 'No sequence' WHEN length(s) < 80 THEN 'Too short' WHEN length(s) > 400 THEN 'Too long' WHEN NOT regexp_full_match(s, '[{protein.CANONICAL}]*') THEN 'Not canonical:' END AS error, CAST(CASE WHEN sequence IS NULL OR h > 1 THEN 0 ELSE length(s) END AS INT) AS length FROM b)
SELECT record_id, error IS NULL AS is_valid, length, error FROM e""",
    "q_variant_names": f"WITH {_NAMES} SELECT raw, name, canonical_id, CASE WHEN canonical_id IS NULL THEN NULL ELSE {_case('name', {n: t for t, _, ns in vocab.CONSTRUCTS for n in ns}, '''CASE WHEN starts_with(canonical_id, 'o-') THEN 'ortholog' ELSE 'unknown' END''')} END AS construct_type, CASE WHEN canonical_id IS NULL THEN NULL ELSE {_case('name', {n: s for _, s, ns in vocab.CONSTRUCTS for n in ns}, '''CASE WHEN starts_with(canonical_id, 'o-') THEN 'Lanmodulin' END''')} END AS parent_scaffold FROM n4",
    "q_element_names": f"SELECT target_element AS raw, {_ELEMENT} AS element, {_IS_GROUP} AS is_group, count(*) AS n_rows FROM binding_measurements GROUP BY 1, 2, 3",
    "q_unit_rules": f"SELECT value_units AS units, {_case(_SCALE, vocab.MOLAR_SCALES)}::DOUBLE AS lenient, {_case(_SCALE, vocab.MOLAR_SCALES | {'mm': 1e-3})}::DOUBLE AS strict, count(*) AS n_rows FROM literature_binding_data GROUP BY 1, 2, 3",
    "q_families": f"SELECT {_FAMILY} AS family, coalesce({_FAMILY} = 'binding_affinity', false) AND value_in_molar IS NOT NULL AS candidate, count(*) AS n_rows FROM literature_binding_data GROUP BY 1, 2",
    "q_strict_tier": "SELECT measurement_id, round(CASE WHEN value_in_molar > 0 THEN -log10(value_in_molar) END, 6) AS affinity_score FROM literature_binding_data WHERE is_molar_affinity_candidate AND value_source_type = 'primary' AND source_paper IS DISTINCT FROM 'nature_d41586-023-01739' AND NOT coalesce(regexp_matches(lower(" + _STRIP.format("target_element") + r"), '^ca(lcium)?($|[^a-z])'), false)",
    "q_taxonomy_text": "SELECT p_partkey, nullif(concat_ws(' | ', CASE WHEN p_size % 3 <> 0 THEN 'brand=' || p_brand END, CASE WHEN p_size % 2 <> 0 THEN 'type=' || p_type END, CASE WHEN p_size > 5 THEN 'size=' || p_size END), '') AS text FROM part",
    "q_saturation_profile": "SELECT target_element, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg(CAST(value >= 0.95 AS INT)), 6) AS share_high, round(avg(CAST(value = 1 AS INT)), 6) AS share_full, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM ml_ready_features WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1",
    "q_concordance": f"""WITH a AS (SELECT {_KEY} AS variant, {_ELEMENT} AS element, max(-log10(value_in_molar)) AS score FROM literature_binding_data WHERE is_molar_affinity_candidate AND value_in_molar > 0 GROUP BY 1, 2),
b AS (SELECT {_KEY} AS variant, target_element AS element, max(value) AS value FROM ml_ready_features GROUP BY 1, 2)
SELECT a.variant, a.element, round(score, 6) AS score, round(value, 6) AS value, rank() OVER (PARTITION BY a.variant ORDER BY score DESC) AS literature_rank, rank() OVER (PARTITION BY a.variant ORDER BY value DESC) AS screening_rank FROM a JOIN b ON a.variant = b.variant AND a.element = b.element""",
    "q_value_counts": "SELECT value_source_type, count(*) AS n_rows FROM literature_binding_data GROUP BY 1",
    "q_top_papers": "SELECT source_paper, count(*) AS n_rows FROM literature_binding_data GROUP BY 1 ORDER BY n_rows DESC, source_paper ASC NULLS LAST LIMIT 5",
    "q_coverage": " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) FILTER (WHERE {(_FILLED if c in ('value', 'value_in_molar', 'conditions_ph') else '{0} IS NOT NULL').format(c)}) AS n_filled, round(count(*) FILTER (WHERE {(_FILLED if c in ('value', 'value_in_molar', 'conditions_ph') else '{0} IS NOT NULL').format(c)}) / count(*), 6) AS share FROM literature_binding_data" for c in ("variant_id", "sequence", "value", "value_units", "value_in_molar", "conditions_ph", "conditions_notes")),
    "q_completeness": f"SELECT n_elements, count(*) AS n_variants FROM (SELECT {_KEY} AS variant, count(DISTINCT target_element) AS n_elements FROM ml_ready_features GROUP BY 1) GROUP BY 1",
    "q_value_range": "SELECT min(value) AS least, max(value) AS most, count(DISTINCT variant_id) AS n_variants, count(DISTINCT target_element) AS n_elements FROM ml_ready_features",
    "q_cost_estimate": "SELECT count(text) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(CAST(sum(length(text)) AS DOUBLE) / 3.5 * 0.15e-6 + 1500 * count(text) * 0.60e-6, 4) AS cost FROM documents",
    "q_measurement_rejects": f"""WITH r AS (SELECT unnest(list_filter([
  CASE WHEN nullif({_STRIP.format('variant_id')}, '') IS NULL THEN 'no_id' END, CASE WHEN value IS NULL OR isnan(value) THEN 'no_value' END,
  CASE WHEN {_IS_GROUP} THEN 'element_group' END, CASE WHEN {_ELEMENT} IS NULL AND NOT {_IS_GROUP} THEN 'unknown_element' END,
  CASE WHEN {_FILLED.format('value_in_molar')} AND NOT (value_in_molar > 0 AND value_in_molar < 1e-2) THEN 'molar_range' END,
  CASE WHEN {_FILLED.format('conditions_ph')} AND NOT (conditions_ph > 0 AND conditions_ph < 14) THEN 'ph_range' END,
  CASE WHEN value_source_type IS NULL OR value_source_type NOT IN ('primary', 'cited_from_earlier_work') THEN 'unknown_source_type' END], lambda x: x IS NOT NULL)) AS reason FROM binding_measurements)
SELECT reason, count(*) AS n_rows FROM r GROUP BY 1""",
    "q_variant_rejects": f"""WITH r AS (SELECT unnest(list_filter([
  CASE WHEN nullif({_STRIP.format('variant_id')}, '') IS NULL THEN 'no_id' END, CASE WHEN nullif({_STRIP.format('source_organism')}, '') IS NULL THEN 'no_organism' END,
  CASE WHEN length(sequence) < 10 THEN 'short_sequence' END, CASE WHEN NOT regexp_full_match(upper({_STRIP.format('sequence')}), '[{protein.CANONICAL}]*') THEN 'bad_alphabet' END,
  CASE WHEN NOT (ef_hand_count BETWEEN 0 AND 10) THEN 'ef_hand_count_range' END, CASE WHEN NOT (selectivity_cluster BETWEEN 0 AND 10) THEN 'cluster_range' END,
  CASE WHEN construct_type IS NULL OR construct_type NOT IN ({', '.join(repr(t) for t in vocab.CONSTRUCT_TYPES)}) THEN 'unknown_construct' END,
  CASE WHEN parent_scaffold IS NOT NULL AND {_STRIP.format('parent_scaffold')} = '' THEN 'blank_scaffold' END], lambda x: x IS NOT NULL)) AS reason FROM protein_variants)
SELECT reason, count(*) AS n_rows FROM r GROUP BY 1""",
    "q_changed_molar": f"SELECT count(*) FILTER (WHERE a IS DISTINCT FROM b) AS n_changed FROM (SELECT round(CASE WHEN value_in_molar > 0 THEN log10(value_in_molar) END, 6) AS a, round(CASE WHEN value > 0 THEN log10(value * {_case(_SCALE, vocab.MOLAR_SCALES)}::DOUBLE) END, 6) AS b FROM literature_binding_data)",
    "q_feature_rejects": f"""WITH m AS (SELECT measurement_id, any_value({_KEY}) AS variant, any_value(lower(trim(split, E' \\t\\n'))) AS t, any_value(value) AS value, any_value(target_element) AS e FROM ml_ready_features GROUP BY 1),
s AS (SELECT DISTINCT {_KEY} AS variant FROM protein_variants WHERE regexp_full_match(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')), '[{protein.CANONICAL}]{{50,}}')),
r AS (SELECT CASE WHEN m.variant IS NULL THEN 'no_variant' WHEN t IS NULL OR NOT regexp_matches(t, '^(tr|val|dev|test|held|hold|tst)') THEN 'no_split' WHEN value IS NULL OR isnan(value) THEN 'no_value' WHEN s.variant IS NULL THEN 'no_sequence'
  WHEN e IS NULL OR e NOT IN ({', '.join(repr(e[0]) for e in vocab.ELEMENTS)}) THEN 'unknown_element' END AS reason FROM m LEFT JOIN s ON m.variant = s.variant)
SELECT reason, count(*) AS n_rows FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "q_json_fields": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max('{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS last FROM events GROUP BY 1",
    "q_explode_renest": "SELECT record_id, array_to_string(mutations, '|') AS mutations, CAST(len(mutations) AS INT) AS n FROM protein_variants WHERE len(mutations) > 0",
}
