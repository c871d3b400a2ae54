import json

import pytest
from pyspark.sql import functions as F

from chelarium.functions.mutations import canonical_mutations, mutation_from_parts
from chelarium.operators.nested import KINDS, label_nodes, link_nodes, read_document, read_payload, shred, unreadable

DOC = {
    "variants": [
        {"variant_id": "o-1", "mutations": ["R100K", "p.Lys77del", {"notation": "ΔQ9"}, {"from": "Ala", "position": "5", "to": None}], "measurements": [{"target_element": "La"}]},
        {"variantId": None, "mutations": "none"},
        {"variant_id": " O_1 ", "mutations": "a9y + Gly10→C; P 11 L"},
    ],
    "measurements": [{"variant_id": "o1", "target_element": "Nd(III)"}, {"variant_id": "n/a", "target_element": None}, {"variantId": "zz", "targetElement": "Y"}],
}
ROWS = {
    ("variant", -1, 0, "o-1"), ("variant", -1, 1, ""), ("variant", -1, 2, " O_1 "),
    ("mutation", 0, 0, "R100K"), ("mutation", 0, 1, "K77del"), ("mutation", 0, 2, "Q9del"), ("mutation", 0, 3, "A5del"),
    ("mutation", 2, 0, "A9Y"), ("mutation", 2, 1, "G10C"), ("mutation", 2, 2, "P11L"),
    ("measurement", 0, 0, "La"), ("measurement", 0, 0, "Nd(III)"), ("measurement", -1, 1, ""), ("measurement", -1, 2, "Y"),
}


def found(spark, payloads, extra=False):
    df = spark.createDataFrame(list(enumerate(payloads)), "extraction_id bigint, payload string")
    if extra:
        df = df.withColumns({"pos": F.lit(1), "kind": F.lit("x"), "row_no": F.lit(2)})
    return [(r.extraction_id, r.kind, r.parent_pos, r.pos, r.item) for r in link_nodes(shred(df, "extraction_id", "payload"), F.col("kind").isin(*KINDS.values())).collect()]


@pytest.mark.parametrize("wrap", ["{}", "```json\n{}\n```", "Here {{it}} is:\n\n{}\n\nMore?", '{{"result": {}, "meta": {{"a": 1}}}}', '{{"output": {{"paper": {{"extraction": {}}}}}}}', "[{}]"])
def test_wrapping(spark, wrap):
    got = found(spark, [wrap.format(json.dumps(DOC))], extra=True)
    assert {r[1:] for r in got} == ROWS and len(got) == len(ROWS)


def test_string_in_string(spark):
    assert {r[1:] for r in found(spark, [json.dumps(json.dumps(DOC))])} == ROWS


def test_any_number_of_layers(spark):
    p = json.dumps(DOC)
    for _ in range(9):
        p = json.dumps(p)
    assert {r[1:] for r in found(spark, [p])} == ROWS


def test_any_depth(spark):
    inner = '{"variants": [{"variant_id": "deep", "mutations": "A1C"}]}'
    p = '{"a": [' * 60000 + inner + "]}" * 60000
    assert found(spark, [p]) == [(0, "variant", -1, 0, "deep"), (0, "mutation", 0, 0, "A1C")]
    assert read_payload(p[:-1])[0] is None
    below = '{"variants": [{"variant_id": "o", "notes": ' + '{"x": ' * 60000 + '{"measurements": {"target_element": "Y"}}' + "}" * 60000 + "}]}"
    assert (0, "measurement", 0, 0, "Y") in found(spark, [below])


def test_objects_below_others(spark):
    doc = {
        "variants": [
            {"variant_id": "a", "assays": [{"measurements": [{"target_element": "La", "replicates": [{"value": 1}, {"value": 2}]}]}, {"measurements": {"target_element": "Y"}}],
             "variants": [{"variant_id": "b", "mutations": ["A1C"]}], "mutations": [{"notation": "C2D/E3F", "effects": [{"measurements": {"target_element": "Nd"}}]}]},
        ],
        "notes": [[{"k": 1}], [{"k": 2}, {"k": 3}]],
    }
    got = {r[1:] for r in found(spark, [json.dumps(doc)])}
    assert got == {
        ("variant", -1, 0, "a"), ("variant", -1, 0, "b"), ("mutation", 0, 0, "A1C"), ("mutation", 0, 0, "C2D"), ("mutation", 0, 1, "E3F"),
        ("measurement", 0, 0, "La"), ("measurement", 0, 0, "Y"), ("measurement", 0, 0, "Nd"),
    }
    df = spark.createDataFrame([(1, json.dumps(doc))], "extraction_id bigint, payload string")
    nodes = {n.pre: n for n in link_nodes(shred(df, "extraction_id", "payload")).collect()}
    assert len(nodes) == len(label_nodes(read_document(json.dumps(doc)))) == 17
    for n in nodes.values():
        around = [m for m in nodes.values() if m.pre < n.pre and m.post > n.post]
        inner = max(around, key=lambda m: m.pre, default=None)
        assert len(around) == n.level and n.parent_pre == (inner.pre if inner else None) and n.parent_kind == (inner.kind if inner else None)
    assert [(n.kind, n.pos) for n in sorted(nodes.values(), key=lambda n: n.pre) if n.kind in ("replicates", "notes")] == [("replicates", 0), ("replicates", 1), ("notes", 0), ("notes", 0), ("notes", 1)]


def test_rejects(spark):
    rows = [(1, None), (2, " \n"), (3, "ERROR"), (4, '{"a": 1}'), (5, json.dumps(DOC)), (6, json.dumps(DOC)[:-1])]
    df = spark.createDataFrame(rows, "id bigint, payload string").withColumn("reason", F.lit("x"))
    assert sorted(map(tuple, unreadable(df, "id", "payload").collect())) == [(1, "null"), (2, "blank"), (3, "no_json"), (4, "no_document"), (6, "no_json")]


def test_nothing_readable(spark):
    whole = json.dumps(DOC)
    cut = [whole[:n] for n in range(1, len(whole) - 1, 7)]
    assert found(spark, [None, "", "  ", "ERROR: timeout", "{}", '{"notes": "a"}', "[]", "3", '"', *cut]) == []
    assert found(spark, []) == []


def test_every_cut_is_incomplete():
    whole = json.dumps(DOC, indent=1)
    assert all(read_document(whole[:n]) is None for n in range(len(whole)))


def test_single_objects_and_repeats(spark):
    p = '{"variants": {"variant_id": "a", "mutations": {"from": "R", "position": 3, "to": "K"}}, "measurements": {"variant_id": "A", "target_element": "Y"}}'
    got = found(spark, [p, p])
    one = [("variant", -1, 0, "a"), ("mutation", 0, 0, "R3K"), ("measurement", 0, 0, "Y")]
    assert sorted(got) == sorted((i, *r) for i in (0, 1) for r in one)


def test_intervals_nest(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC))], "extraction_id bigint, payload string")
    nodes = shred(df, "extraction_id", "payload").collect()
    assert sorted(n.pre for n in nodes) == sorted(n.post for n in nodes) == list(range(len(nodes)))
    for a in nodes:
        for b in nodes:
            inside = a.pre < b.pre and a.post > b.post
            apart = (a.pre < b.pre) == (a.post < b.post)
            assert a is b or inside or apart or (b.pre < a.pre and b.post > a.post)


@pytest.mark.parametrize("text,want", [(None, []), ("", []), ("WT", []), ("-", []), ("R100K/K77del", ["R100K", "K77del"]), ("r100k", ["R100K"]), ("Arg100Lys", ["R100K"]), ("p.(Arg100Lys)", ["R100K"]), ("not a mutation 5", [])])
def test_mutation_text(text, want):
    assert canonical_mutations(text) == want


def test_mutation_parts():
    assert mutation_from_parts("R", 100, "Lys") == "R100K"
    assert mutation_from_parts("R", "100", "del") == "R100del"
    assert mutation_from_parts(None, 1, "K") is None and mutation_from_parts("R", "x", "K") is None
