import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chelarium.functions.ids import py_id_key
from chelarium.llm import components, splits
from chelarium.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def union_find(pairs):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in pairs:
        par[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(par):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed,hot", [(0, None), (1, None), (2, 4)])
def test_components(spark, seed, hot, monkeypatch):
    if hot:  # every node with four neighbours takes the way of hot nodes
        monkeypatch.setattr(components, "hot_from", lambda total: hot)
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(170)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(200)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = defaultdict(set)
    rows = components.connected_components(spark.createDataFrame([*pairs, ("x", "x"), (None, "y"), ("z", None), pairs[0]], "u string, v string")).collect()
    for r in rows:
        got[r.root].add(r.node)
    assert {frozenset(g) for g in got.values()} == union_find(pairs)
    assert all(root == min(g) for root, g in got.items()) and len(rows) == sum(map(len, got.values()))


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "variant_id string, source_paper string, submitter string, selectivity_cluster int").withColumns({"node": F.lit(1), "n": F.lit(2), "l": F.lit("x"), "name": F.lit("y")})


def test_groups(spark):
    rows = [
        ("o-1", "P 1", None, 1), ("O_1", None, "g1", 1), ("o-2", "p1", "-", 2), ("o-3", "", "G-1", None), ("o-4", "n/a", "unknown", 1),
        ("o-5", "tbd", " ", 1), ("o-6", "p2", "g2", 1), ("o-6", "p2", "g2", 1), (None, "p1", "g2", 1), ("?", "p1", "g2", 1), ("o-7", "g2", None, 1), ("o-8", None, None, 1),
    ]
    df = table(spark, rows)
    names = splits.entity_names(df, "variant_id")
    got = {(r["name"], r.group_id, r.group_size) for r in splits.linked_groups(df, "variant_id", ["source_paper", "submitter"], names).collect()}
    assert got == {("O_1", "O_1", 3), ("o-2", "O_1", 3), ("o-3", "O_1", 3)}
    master = spark.createDataFrame([("o-1",), ("o-6",)], "variant_id string")
    named = {r.node: r["name"] for r in splits.entity_names(df, "variant_id", master).collect()}
    assert named["o1"] == "o-1" and named["o2"] == "o-2"


def test_empty(spark):
    df = table(spark, [])
    names = splits.entity_names(df, "variant_id")
    assert splits.linked_groups(df, "variant_id", ["source_paper"], names).count() == 0
    assert splits.split_groups(df, "variant_id", ["source_paper"], "selectivity_cluster", names).count() == 0


def test_split_keeps_groups_and_proportions(spark):
    rng = random.Random(1)
    rows = [(f"v{i}", f"p{int(i ** 0.8)}" if rng.random() < 0.7 else None, f"g{i // 300}" if i < 600 else None, rng.choice([None, 0, 1, 2])) for i in range(3000)]
    df = table(spark, rows)
    names = splits.entity_names(df, "variant_id")
    out = splits.split_groups(df, "variant_id", ["source_paper", "submitter"], "selectivity_cluster", names).collect()
    assert len(out) == 3000 and len({r["name"] for r in out}) == 3000
    by_group = defaultdict(set)
    for r in out:
        by_group[r.group_id].add(r.split)
    assert all(len(s) == 1 for s in by_group.values())
    cluster = {v: c for v, _, _, c in rows}
    cells = Counter((cluster[r["name"]], r.split) for r in out)
    for c in (None, 0, 1, 2):
        n = sum(v for (k, _), v in cells.items() if k == c)
        for s, share in splits.PROPORTIONS.items():
            assert abs(cells[c, s] / n - share) < 0.02
    again = splits.split_groups(df, "variant_id", ["source_paper", "submitter"], "selectivity_cluster", names).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_every_label_is_balanced(spark, monkeypatch):
    rows = [(f"v{i}", None, None, i % 100) for i in range(8000)]
    df = table(spark, rows)
    names = splits.entity_names(df, "variant_id")
    cells = Counter((int(r["name"][1:]) % 100, r.split) for r in splits.split_groups(df, "variant_id", ["source_paper", "submitter"], "selectivity_cluster", names).collect())
    assert all(abs(cells[c, s] / 80 - share) < 0.06 for c in range(100) for s, share in splits.PROPORTIONS.items())
    monkeypatch.setattr(splits, "MAX_LABELS", 99)
    with pytest.raises(ValueError, match="category"):
        splits.split_groups(df, "variant_id", ["source_paper", "submitter"], "selectivity_cluster", names)


def test_anneal_improves_on_the_hash():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 6, (300, 4)).astype(float)
    share = np.tile([0.8, 0.1, 0.1], (4, 1))
    start = splits.hashed_split([str(i) for i in range(300)], [0.8, 0.1, 0.1], 0)

    def loss(at):
        held = np.stack([sizes[at == s].sum(axis=0) for s in range(3)], axis=1)
        return ((held - share * sizes.sum(axis=0)[:, None]) ** 2).sum()

    assert loss(splits.anneal(sizes, share, start, 0)) < 0.05 * loss(start) + 30


def test_keys():
    assert py_id_key(" GRP 000113 ") == py_id_key("grp-000113") == "grp000113"
