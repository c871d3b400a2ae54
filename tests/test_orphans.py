import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chelarium.functions.ids import py_id_key
from chelarium.operators import orphans

T0 = datetime(2024, 1, 1)


def run(spark, refs, parents, total=None):
    r = spark.createDataFrame(refs, "src_table string, row_id bigint, ref string, loaded_at timestamp_ntz")
    p = spark.createDataFrame(parents, "k string, l timestamp_ntz, d timestamp_ntz")
    out = orphans.find_orphans(r.withColumns({"id": F.lit(1), "born": F.lit(2), "stem": F.lit("s")}), p, "k", "l", "d", len(refs) if total is None else total)
    return sorted((x.src_table, x.row_id, x.reason, x.load_month) for x in out.collect())


def brute(refs, parents):
    life = {}
    for k, l, d in parents:
        k = py_id_key(k)
        if k is not None:
            a, b = life.get(k, (None, None))
            life[k] = (min([x for x in (a, l) if x], default=None), min([x for x in (b, d) if x], default=None))
    out = []
    for t, i, ref, at in refs:
        k = py_id_key(ref)
        if k is None:
            continue
        if k not in life:
            why = "missing"
        elif at is None:
            continue
        else:
            born, dead = life[k]
            why = "late" if born and at < born else "deleted" if dead and at >= dead else None
        if why:
            out.append((t, i, why, at and at.strftime("%Y-%m")))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: T0 + timedelta(days=rng.randint(0, 400))
    names = [f"o-{n}" for n in range(1, 60)] + ["o-007", "x", "o-9a", "PMX-0", "PMX-70000", "o-65536", "o-65535", "n/a", "", None, "o-123456789012345678901234"]
    spelled = lambda n: n and rng.choice([n, n.upper(), n.replace("-", "_"), f" {n}"])
    parents = [(spelled(rng.choice(names[:40] + names[-11:])), day() if rng.random() > 0.1 else None, day() if rng.random() < 0.3 else None) for _ in range(70)]
    refs = [(rng.choice("ab"), i, spelled(rng.choice(names) if rng.random() < 0.7 else "o-3"), day() if rng.random() > 0.05 else None) for i in range(4000)]
    assert sorted(run(spark, refs, parents), key=str) == brute(refs, parents)


def test_runs_are_contiguous(spark):
    ids = spark.createDataFrame([(f"o{n}",) for n in (1, 2, 3, 7, 8, 65535, 65536)] + [("p",), ("o07",)], "id string")
    got = {(r.stem, r.start, r.end) for r in orphans.key_runs(ids).collect()}
    assert got == {("#o", 1, 3), ("#o", 7, 8), ("#o", 65535, 65535), ("#o", 65536, 65536), ("p", -1, -1), ("#o0", 7, 7)}


def test_empty_sides(spark):
    assert run(spark, [], [("o-1", T0, None)]) == []
    assert run(spark, [("a", 1, "o-1", T0)], []) == [("a", 1, "missing", "2024-01")]


def test_repeated_rows_and_hot_id(spark):
    refs = [("a", 1, "o-5", T0)] * 3 + [("a", i, "o-6", T0) for i in range(2000)]
    got = run(spark, refs, [("o-7", T0, None)], total=2003)
    assert len(got) == 2003 and len(set(got)) == 2001 - (1 if ("a", 1, "missing", "2024-01") in set(got) else 0)


def test_report(spark):
    df = spark.createDataFrame([("a", 1, "late", "2024-01"), ("a", 2, "late", "2024-01"), ("b", 1, "missing", None)], "src_table string, row_id bigint, reason string, load_month string")
    assert {tuple(r) for r in orphans.orphan_report(df).collect()} == {("a", "2024-01", "late", 2), ("b", None, "missing", 1)}
