import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chelarium.llm import neardup, overlap, queries, residues, shingles
from chelarium.session import ship_package

AA = "ACDEFGHIKLMNPQRSTVWY"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def five(s):
    return {s[i : i + 5] for i in range(len(s) - 4)}


def alike(a, b):
    x, y = five(a), five(b)
    return len(x & y) * 2 >= len(x | y) and bool(x | y)


def family(rng, n, length, edits):
    base = "".join(rng.choices(AA, k=length))
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(s))
            kind = rng.random()
            if kind < 0.6:
                s[at] = rng.choice(AA)
            elif kind < 0.8:
                s.insert(at, rng.choice(AA))
            elif len(s) > 60:
                del s[at]
        if rng.random() < 0.1:
            at = rng.randrange(20, len(s) - 20)
            s = s[at:] + s[:at]
        out.append("".join(s))
    return out


def corpus(seed):
    rng = random.Random(seed)
    seqs = [s for n, length, edits in ((40, 170, 9), (25, 60, 4), (20, 350, 20), (3, 120, 2)) for s in family(rng, n, length, edits)]
    seqs += ["".join(rng.choices(AA, k=rng.randint(50, 240))) for _ in range(60)] + [seqs[0]] * 5 + ["A" * 80, "A" * 200, "AC" * 60]
    return [(f"v{i}", s) for i, s in enumerate(seqs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = {tuple(sorted((i, j))) for k, (i, a) in enumerate(rows) for j, b in rows[:k] if alike(a, b)}
    got = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id string, residues string")).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert set(got) == want and len(want) > 300


def at_threshold(rng, length, kind):
    """Two texts that are just near-duplicates: scattered substitutions, a fragment, or both."""
    a = "".join(rng.choices(AA, k=length))
    b = list({"edits": a, "fragment": a[: length // 2 + 3], "both": a[: int(length * 0.75)]}[kind])
    while kind != "fragment":
        c = b[:]
        c[rng.randrange(len(b))] = rng.choice(AA)
        if not alike(a, "".join(c)):
            break
        b = c
    return a, "".join(b)


def test_no_pair_is_lost_at_the_threshold(spark):
    rng = random.Random(5)
    rows = [(f"{k}-{length}-{n}-{side}", s) for k in ("edits", "fragment", "both") for length in (11, 24, 60, 90, 130, 170, 257, 400, 900) for n in range(12) for side, s in zip("ab", at_threshold(rng, length, k))]
    want = {(i, j) for (i, a), (j, b) in zip(rows[::2], rows[1::2]) if alike(a, b)}
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id string, residues string")).collect()}
    assert want <= got and len(want) > 300


@pytest.mark.parametrize("part", [0.4, 0.5])
def test_a_common_domain_forms_no_candidates(spark, part):
    rng = random.Random(6)
    domain = "".join(rng.choices(AA, k=int(300 * part)))
    seqs = ["".join(rng.choices(AA, k=150)) + domain + "".join(rng.choices(AA, k=150 - len(domain))) for _ in range(2000)]
    twins = [s[:40] + "WW" + s[42:] for s in seqs[:50]]
    df = spark.createDataFrame([(k, s, 1) for k, s in enumerate(seqs + twins)], "cid bigint, residues string, n_members bigint")
    assert neardup.candidate_pairs(neardup.sketch_classes(df)).count() < 200
    assert neardup.near_duplicate_classes(df).count() == 50


def test_a_common_tag_forms_no_pairs_of_chunks(spark):
    rng = random.Random(7)
    tag = "HHHHHHSSGLVPRGSHM"
    seqs = ["M" + tag + "".join(rng.choices(AA, k=200)) for _ in range(2000)]
    twins = [s[:90] + "WW" + s[92:] for s in seqs[:50]]
    df = spark.createDataFrame([(k, s, 1, k % 2 + 1) for k, s in enumerate(seqs)] + [(5000 + k, s, 1, 2 - k % 2) for k, s in enumerate(twins)], "cid bigint, residues string, n_members bigint, mask int")
    assert overlap.chunk_pairs(df).count() < 200
    found = overlap.overlapping_classes(df).collect()
    assert len(found) == 50 and all(0.6 < r.of_a < 1 and 0.6 < r.of_b < 1 for r in found)


def test_chunks_are_shared_at_the_threshold():
    rng = random.Random(8)
    texts = [s for k in ("edits", "fragment", "both") for length in (60, 90, 130, 170, 257, 400) for _ in range(50) for s in at_threshold(rng, length, k)]
    owner, digest = overlap.chunk_keys(texts, np.ones(neardup.SLOTS, np.uint8))
    keys = np.split(digest, np.searchsorted(owner, np.arange(1, len(texts))))
    common = [len(np.intersect1d(x, y)) for x, y in zip(keys[::2], keys[1::2])]
    assert min(common) >= 1 and np.mean(common) > 10


def test_large_classes_meet_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(residues, "MEMBERS_PER_BUCKET", 4)
    rng = random.Random(9)
    a = "".join(rng.choices(AA, k=120))
    rows = [(f"a{k:03}", a) for k in range(30)] + [(f"b{k:03}", a[:60] + "W" + a[61:]) for k in range(21)] + [("c", "".join(rng.choices(AA, k=120))), ("d", None)]
    df = spark.createDataFrame(rows, "id string, residues string")
    got = [tuple(r) for r in neardup.near_duplicates(df).collect()]
    assert len(got) == len(set(got)) == 51 * 50 // 2
    found = {r.id: tuple(r)[1:] for r in neardup.near_duplicate_summary(df).collect()}
    assert found["a007"] == ("a000", 30, 50) and found["b001"] == ("b000", 21, 50) and found["c"] == ("c", 1, 0) and "d" not in found


def written(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_agreements_by_chance_are_not_shuffled(spark):
    """agreements grow with the square of the number of sequences, so disk may hold none."""
    rng = random.Random(11)
    seqs = ["".join(rng.choices("ACDEFGHI", k=200)) for _ in range(3000)]
    twins = [s[:40] + "WW" + s[42:] for s in seqs[:50]]
    df = spark.createDataFrame([(k, s, 1) for k, s in enumerate(seqs + twins)], "cid bigint, residues string, n_members bigint")
    sketched = neardup.sketch_classes(df)  # with the table of frequencies, whose size is fixed
    before = written(spark)
    assert neardup.candidate_pairs(sketched).count() >= 50
    assert written(spark) - before < 100_000  # the residues are 610,000 bytes


@pytest.mark.parametrize("block", [7, 60])
def test_pairs_of_all_blocks(spark, monkeypatch, block):
    """Also where one size fills several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "MEETINGS", 50)
    monkeypatch.setattr(neardup, "CHECKED", 3)
    rows = corpus(12)[::2] + [(f"t{k}", s) for k, s in enumerate(("ACDEF", "ACDEFG", "ACDEFGH", "WACDEF", "AAAAAA"))]
    want = {tuple(sorted((i, j))) for k, (i, a) in enumerate(rows) for j, b in rows[:k] if alike(a, b)}
    got = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id string, residues string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_size_blocks(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    assert neardup.size_blocks({}) == [] and neardup.size_blocks({0: 5}) == []
    assert neardup.size_blocks({0: 3, 5: 4, 7: 6, 8: 1, 9: 25, 11: 2, 12: 9}) == [(5, 7, 0, 1), (8, 8, 0, 1), (9, 9, 0, 3), (9, 9, 1, 3), (9, 9, 2, 3), (11, 11, 0, 1), (12, 12, 0, 1)]


def test_parity_distance_is_a_lower_bound():
    texts = [s for _, s in corpus(3)]
    owner, code = shingles.runs(texts)
    w = neardup.parity_words(owner, code, len(texts)).view(np.uint64)
    for i in range(0, len(texts), 7):
        for j in range(0, len(texts), 5):
            d = sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(w[i], w[j]))
            assert d <= len(five(texts[i]) ^ five(texts[j]))


def test_empty_and_short(spark):
    schema = "id string, residues string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([("a", "ACD"), ("b", "ACE"), ("c", None)], schema)).count() == 0
    assert neardup.near_duplicate_summary(spark.createDataFrame([], schema)).count() == 0


T = datetime(2024, 1, 1)
VARIANTS = "record_id bigint, variant_id string, sequence string, parent_variant_id string, mutations array<string>, loaded_at timestamp_ntz"


def test_residues(spark):
    base = "".join(random.Random(1).choices(AA, k=60))
    rows = [
        (1, "o-1", f">o-1 mature\r\n{base[:30].lower()} 10\n{base[30:]}*", None, [], T),
        (2, "o-1", "C" * 60, None, None, T.replace(month=2)),
        (3, "o-2", "not reported", "O_1", [f"{base[0]}1W", f"{base[2]}3del"], T),
        (4, "o-3", None, "o-2", ["A1C"], T),
        (5, "o-4", None, "o-1", None, T),
        (6, "o-5", "W" * 49, None, [], None),
        (7, "O5", "W" * 50, None, [], T),
        (8, "n/a", "W" * 80, None, [], T),
        (9, None, "W" * 80, None, [], T),
        (10, "o-6", None, "o-6", [], T),
    ]
    df = spark.createDataFrame(rows, VARIANTS).withColumns({"id": F.lit(1), "own": F.lit("x"), "residues": F.lit("y")})
    got = {r.variant_id: r.residues for r in residues.variant_residues(df).collect()}
    assert got == {"o-1": base, "o-2": "W" + base[1] + base[3:], "o-3": None, "o-4": base, "O5": "W" * 50, "o-6": None}


def test_cross_split(spark):
    rows = corpus(4)
    rng = random.Random(9)
    spelled = {"train": ["train", " Training", "TRN"], "validation": ["val", "dev"], "test": ["test\t", "held-out"], None: [None, "?"]}
    splits = {i: {rng.choice([*spelled]) for _ in range(rng.choice([1, 1, 2]))} for i, _ in rows}
    ml = [(i, rng.choice(spelled[s]), "p1") for i, ss in splits.items() for s in ss] + [("ghost-1", "train", None), ("GHOST1", "test", "p2"), (None, "train", "p"), ("n/a", "test", "p")]
    variants = spark.createDataFrame([(k, i, s, None, [], T) for k, (i, s) in enumerate(rows)], VARIANTS)
    m = spark.createDataFrame(ml, "variant_id string, split string, source_paper string").withColumns({"mask": F.lit(1), "id": F.lit(2)})
    want = {("GHOST1", "GHOST1", "test")}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[: k + 1]:
            if i == j or alike(a, b):
                for e in ("validation", "test"):
                    if "train" in splits[i] and e in splits[j] or "train" in splits[j] and e in splits[i]:
                        want.add((min(i, j), max(i, j), e))
    got = [tuple(r) for r in overlap.cross_split_pairs(m, variants).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    report = {(r.eval_split, r.source_paper): r.n_variants for r in overlap.overlap_report(overlap.cross_split_pairs(m, variants), m).collect()}
    assert report["test", "p2"] == 1 and set(report) == {("test", "p1"), ("validation", "p1"), ("test", "p2")}


def test_covered_records(spark):
    rng = random.Random(3)
    a = "".join(rng.choices(AA, k=200))
    b = a[:100] + "".join(rng.choices(AA, k=3)) + a[103:]
    variants = spark.createDataFrame([(1, "o-1", a, None, [], T), (2, "o-2", b, None, [], T), (3, "o-3", a, None, [], T)], VARIANTS)
    ml = spark.createDataFrame([("o-1", "train"), ("o-2", "test"), ("o-3", "validation"), ("o-3", "train")], "variant_id string, split string")
    got = {(r.variant_id, r.eval_split): (r.n_train, r.covered) for r in overlap.covered_records(ml, variants).collect()}
    assert set(got) == {("o-2", "test"), ("o-3", "validation")}
    assert got["o-3", "validation"] == (2, 1.0) and got["o-2", "test"][0] == 2 and 0.7 < got["o-2", "test"][1] < 1


def test_chunks_cover_and_resynchronise():
    rng = random.Random(2)
    a = "".join(rng.choices(AA, k=400))
    b = "W" * 13 + a
    o, d, start, n = overlap.chunks([a, b, "", "AC"])
    assert [n[o == k].sum() for k in range(4)] == [400, 413, 0, 2] and (start[1:] == (start + n)[:-1]).all()
    da, db = d[o == 0], d[o == 1]
    assert len(np.intersect1d(da, db)) >= len(np.unique(da)) - 2
    assert (overlap.chunks([b])[1] == db).all()
    assert len(overlap.chunks([])[0]) == 0


def test_queries_registered():
    assert set(queries.QUERIES) >= {"p4_found", "p5_found", "p6_found", "p7_ids", "p8_found", "p9_found"}
