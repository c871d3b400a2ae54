"""SQL of the corpus problems' queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from chelarium.functions.ids import id_key_sql
from chelarium.functions.mutations import THREE_LETTER
from chelarium.functions.vocab import SPLITS

_ONE = "(CASE lower({0}) " + " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in THREE_LETTER.items()) + " ELSE upper({0}) END)"
_CLEAN = "upper(regexp_replace(regexp_replace(sequence, '(?m)^>.*$', '', 'g'), '[^A-Za-z]', '', 'g'))"

_RESIDUES = rf"""
rec AS (
  SELECT {id_key_sql("variant_id")} AS id, variant_id, CASE WHEN length({_CLEAN}) >= 50 THEN {_CLEAN} END AS own,
    (loaded_at IS NULL, loaded_at, record_id) AS o, {id_key_sql("parent_variant_id")} AS parent, mutations
  FROM protein_variants WHERE {id_key_sql("variant_id")} IS NOT NULL),
one AS (
  SELECT id, min(variant_id) AS variant_id, arg_min(own, o) FILTER (WHERE own IS NOT NULL) AS own, arg_min_null(parent, o) AS parent, arg_min_null(mutations, o) AS mutations
  FROM rec GROUP BY id),
needy AS (SELECT c.id, c.mutations, p.own AS s FROM one c JOIN one p ON c.parent = p.id WHERE c.own IS NULL AND p.own IS NOT NULL),
edits AS (
  SELECT id, CAST(regexp_extract(m, '([0-9]+)', 1) AS BIGINT) AS pos, max(CASE
      WHEN regexp_matches(m, '^\s*Δ') OR regexp_matches(m, '[0-9]\s*del') THEN ''
      ELSE {_ONE.format(r"regexp_extract(m, '[0-9]\s*(?:→|->|>)?\s*([A-Za-z]+)\s*$', 1)")} END) AS new
  FROM (SELECT id, unnest(mutations) AS m FROM needy) WHERE regexp_matches(m, '[0-9]') GROUP BY 1, 2),
letters AS (SELECT id, unnest(range(1, length(s) + 1)) AS pos, unnest(string_split(s, '')) AS ch FROM needy),
derived AS (SELECT l.id, string_agg(coalesce(e.new, l.ch), '' ORDER BY l.pos) AS s FROM letters l LEFT JOIN edits e ON l.id = e.id AND l.pos = e.pos GROUP BY 1),
residues AS (SELECT one.id, one.variant_id, coalesce(one.own, derived.s) AS s FROM one LEFT JOIN derived ON one.id = derived.id),
runs AS (SELECT DISTINCT variant_id AS v, substr(s, i, 5) AS r FROM (SELECT variant_id, s, unnest(range(1, length(s) - 3)) AS i FROM residues WHERE s IS NOT NULL)),
sizes AS (SELECT v, count(*) AS n FROM runs GROUP BY 1),
common AS (SELECT a.v AS a, b.v AS b, count(*) AS k FROM runs a JOIN runs b ON a.r = b.r AND a.v < b.v GROUP BY 1, 2),
near AS (SELECT a AS variant_id_a, b AS variant_id_b FROM common JOIN sizes x ON a = x.v JOIN sizes y ON b = y.v WHERE 2 * k >= x.n + y.n - k)"""

_SPLIT = "CASE lower(regexp_replace(split, '[^A-Za-z0-9]', '', 'g')) " + " ".join(f"WHEN '{s}' THEN '{name}'" for name, spelled in SPLITS.items() for s in spelled) + " END"
_NAMES = f"names AS (SELECT {id_key_sql('variant_id')} AS id, min(variant_id) AS name FROM protein_variants GROUP BY 1)"

_P6 = f"""WITH {_RESIDUES}, {_NAMES},
held AS (SELECT DISTINCT names.name AS v, {_SPLIT} AS s FROM ml_ready_features m JOIN names ON {id_key_sql('m.variant_id')} = names.id WHERE {_SPLIT} IS NOT NULL),
pairs AS (SELECT * FROM near UNION ALL SELECT DISTINCT v, v FROM held),
found AS (SELECT DISTINCT variant_id_a, variant_id_b, y.s AS eval_split FROM pairs JOIN held x ON x.s = 'train' AND x.v IN (variant_id_a, variant_id_b)
  JOIN held y ON y.s <> 'train' AND y.v = CASE WHEN x.v = variant_id_a THEN variant_id_b ELSE variant_id_a END)"""

ORACLES = {
    "p4_found": f"WITH {_RESIDUES} SELECT variant_id_a, variant_id_b FROM near",
    "p4_classes": f"""WITH {_RESIDUES},
copies AS (SELECT s, min(variant_id) AS class_id, count(*) AS n_copies FROM residues WHERE s IS NOT NULL GROUP BY 1),
links AS (SELECT v, count(*) AS n FROM (SELECT variant_id_a AS v FROM near UNION ALL SELECT variant_id_b FROM near) GROUP BY 1)
SELECT r.variant_id, class_id, n_copies, coalesce(links.n, 0) AS n_links FROM residues r JOIN copies USING (s) LEFT JOIN links ON links.v = r.variant_id""",
    "p5_found": f"""WITH RECURSIVE {_NAMES},
links AS (
  SELECT DISTINCT {id_key_sql("variant_id")} AS node, 's:' || {id_key_sql("source_paper")} AS link FROM ml_ready_features WHERE {id_key_sql("source_paper")} IS NOT NULL AND {id_key_sql("variant_id")} IS NOT NULL
  UNION SELECT DISTINCT {id_key_sql("variant_id")}, 'g:' || {id_key_sql("submitter")} FROM ml_ready_features WHERE {id_key_sql("submitter")} IS NOT NULL AND {id_key_sql("variant_id")} IS NOT NULL),
edges AS (SELECT DISTINCT a.node AS u, b.node AS v FROM links a JOIN links b ON a.link = b.link),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
SELECT a.name AS variant_id, min(b.name) AS group_id FROM reach JOIN names a ON reach.u = a.id JOIN names b ON reach.v = b.id GROUP BY 1 HAVING count(*) > 1""",
    "p6_found": _P6 + " SELECT * FROM found",
    "p6_report": _P6 + f""",
hit AS (SELECT variant_id_a AS v, eval_split FROM found UNION SELECT variant_id_b, eval_split FROM found),
src AS (SELECT DISTINCT names.name AS v, {_SPLIT} AS eval_split, coalesce({id_key_sql('m.source_paper')}, '') AS source_paper FROM ml_ready_features m JOIN names ON {id_key_sql('m.variant_id')} = names.id)
SELECT eval_split, source_paper, count(*) AS n_variants FROM src JOIN hit USING (v, eval_split) GROUP BY 1, 2""",
}
