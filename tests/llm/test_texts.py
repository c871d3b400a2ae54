import random

import pytest
from pyspark.sql import functions as F

from chelarium.llm import encoding, leakage, reading
from chelarium.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


ALPHABET = ["a", "b", " ", " ", "'", "s", "re", "ll", "'ve", "\n", "\r\n", "\t", "  ", "12", "é", "稀", "🧪", ".", ",,", "-", "\xa0", "​", "ﬁ", "<|endoftext|>"]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_tree_equals_whole(leaf):
    whole, tree = encoding.TreeEncoder(leaf=1 << 30), encoding.TreeEncoder(leaf=leaf)
    rng = random.Random(leaf)
    for _ in range(400):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 60)))
        ids = tree.encode(text)
        assert ids == whole.encode(text)
        assert tree.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "\n" * 3001 + "x", "🧪" * 1500, "word " * 3000, "don't " * 900, "".join(chr(0x4E00 + i) for i in range(4000))])
def test_long_runs(text):
    assert encoding.TreeEncoder(leaf=50).encode(text) == encoding.TreeEncoder(leaf=1 << 30).encode(text)


def test_encode_table(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, " \n"), (5, "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"k": F.lit(1), "ids": F.lit(2), "t": F.lit("q")})
    got = sorted(((r.doc_id, list(r.ids)) for r in encoding.encode_texts(df, "doc_id", "text").collect()), key=str)
    enc = encoding.TreeEncoder()
    assert got == sorted(((i, enc.encode(t)) for i, t in rows), key=str)
    assert [ids for i, ids in got if i in (1, 2)] == [[], []]
    assert encoding.encode_texts(df.where("false"), "doc_id", "text").count() == 0


WORDS = [f"w{i}x{i * 7 % 13}" for i in range(400)]


def runs(words, n=12):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "a a a a a a a a a a a a a a a a")]
    docs = []
    for d in range(120):
        words = rng.choices(WORDS, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            src = rng.choice(items[:30])[1].split()
            n = rng.choice([3, 11, 12, 13, 40])
            at = rng.randrange(max(1, len(src) - n + 1))
            words[len(words) // 2 : len(words) // 2] = src[at : at + n]
        docs.append((d, rng.choice([" ", "  ", ", ", "\n"]).join(words)))
    docs += [(200, None), (201, ""), (202, "a " * 12), (203, "A-A.a_a " * 3), (204, "b")]
    want = {(i, d) for i, t in items for d, x in docs if runs(leakage.normal_words(t)) & runs(leakage.normal_words(x))}
    it = spark.createDataFrame(items, "item_id bigint, text string").withColumn("k", F.lit(1))
    dc = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item": F.lit(1), "t": F.lit("z")})
    got = [(r.item_id, r.doc_id) for r in leakage.find_leaks(dc, it).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leakage.find_leaks(dc.where("false"), it).count() == 0 and leakage.find_leaks(dc, it.where("false")).count() == 0


def edit_distance_within(passage, text):
    """Least number of edits between passage and any part of text."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        now = [i]
        for j, c in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (p != c)))
        before = now
    return min(before)


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_edits_against_brute_force(edits):
    rng = random.Random(edits)
    words = ["a", "bb", "cat", "dog", "tree", "house", "green"]
    items = [" ".join(rng.choices(words, k=rng.randint(12, 16))) for _ in range(8)] + ["a " * 12]
    docs = []
    for _ in range(160):
        src = rng.choice(items[:8]).split()
        at = rng.randrange(len(src) - 11)
        part = list(" ".join(src[at : at + rng.choice([11, 12, 13])]))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(part))
            part[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["q"], [" "]])
        docs.append(" ".join([*rng.choices(words, k=rng.randint(0, 6)), "".join(part), *rng.choices(words, k=rng.randint(0, 6))]))
    docs += ["", "a", "a " * 12, "a " * 10]
    index = leakage.PassageIndex(list(range(len(items))), items, edits=edits)
    got = {(d, i) for d, i, _ in index.find_all(docs)}
    want = set()
    for i, t in enumerate(items):
        w = leakage.normal_words(t)
        for d, x in enumerate(docs):
            text = f" {' '.join(leakage.normal_words(x))} "
            if any(edit_distance_within(f" {' '.join(w[k : k + 12])} ", text) <= edits for k in range(len(w) - 11)):
                want.add((d, i))
    assert got == want and len(want) > 15


def test_a_missing_letter(spark):
    passage = " ".join(WORDS[:13])
    docs = spark.createDataFrame([(1, f"before {passage[:30]}{passage[31:]} after"), (2, passage)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert {(r.doc_id, r.n_words) for r in leakage.find_leaks(docs, items, edits=2).collect()} == {(1, 13), (2, 13)}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 3)
    items = spark.createDataFrame([(i, " ".join(WORDS[i * 13 : i * 13 + 13])) for i in range(10)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(WORDS))], "doc_id bigint, text string")
    assert {(r.item_id, r.doc_id) for r in leakage.find_leaks(docs, items).collect()} == {(i, 1) for i in range(10)}


@pytest.mark.parametrize(
    "text",
    ["Eu³⁺ ﬁxed at kesevret", "EU3+ FIXED at kese-\nvret", "eu3+ **fi​xed** at kese-\r\n  vret", "﻿Eu³⁺, ﬁxed; at kesevret.", "Eu3+ fixed at kese­\nvret", "> Eu3+ fixed at kese-\n> vret"],
)
def test_word_forms(text):
    assert leakage.normal_words(text) == ["eu3", "fixed", "at", "kesevret"]


COMMON = "cat dog sun red big run river market garden people".split()
RARE = [f"{a}{b}" for a in ("struct", "interact", "coordin", "deconvol", "thermo", "hetero") for b in ("ure", "ion", "ation", "ity", "ics", "ible", "al", "ing")]


def english(level, rng, n=12):
    """Sentences in which one word of four is rarer for each level above the first."""
    sentences = [[rng.choice(RARE if k < level - 1 else COMMON) for k in range(4)] for _ in range(n)]
    return " ".join("The " + " of the ".join(words) + " was in that." for words in sentences)


def test_reading_levels(spark):
    rng = random.Random(2)
    rows = [(i, english(i % 4 + 1, rng)) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "The cat is in the house."), (903, "der Hund und die Katze sind nicht im Haus " * 8), (904, "稀土 " * 50), (0, rows[0][1])]
    labels = [(i, float(i % 4 + 1), "r") for i in range(0, 200, 3)] + [(1, None, "r"), (5, 1.0, "a"), (5, 4.0, "b"), (None, 2.0, "r"), (7777, 3.0, "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"k": F.lit(1), "t": F.lit("x"), "numbers": F.lit(0), "level": F.lit(9)})
    lab = spark.createDataFrame(labels, "doc_id bigint, reading_level double, rater string")
    got = [(r.doc_id, r.reading_level) for r in reading.reading_levels(docs, lab).collect()]
    assert len(got) == 201 and sum(1 for i, l in got if l == i % 4 + 1) / len(got) > 0.97
    assert {i for i, _ in got} == set(range(200))
    assert reading.reading_levels(docs.where("false"), lab).count() == 0
    bare = reading.reading_levels(docs, lab.where("false")).collect()
    assert len(bare) == 201 and all(1 <= r.reading_level <= 4 for r in bare)


def test_forty_pieces():
    assert len(reading.measure_texts(["the " * 39, None, ""])) == 0
    (row,) = reading.measure_texts(["", "The the. " * 20]).itertuples()
    assert (row.place, row.sentences, row.clear, list(row.counts)) == (1, 20, True, [40]) and list(row.words) == list(reading.word_hash(["the"]))


FOREIGN = {
    "Italian": "La proteina lega il calcio con una grande affinità e la sua struttura è stata risolta in presenza di metalli; i dati sono stati raccolti a temperatura ambiente e in un tampone che non contiene altri ioni, per cui si può dire che il sito è specifico.",
    "Portuguese": "A proteína liga o cálcio com uma grande afinidade e a sua estrutura foi resolvida na presença de metais; os dados foram obtidos a uma temperatura de ambiente e num tampão que não contém outros iões, por isso se pode dizer que o sítio é específico.",
    "Swedish": "Proteinet binder kalcium med hög affinitet och dess struktur har lösts i närvaro av metaller; data samlades in vid rumstemperatur och i en buffert som inte innehåller andra joner, så att man kan säga att bindningsstället är specifikt för dem alla.",
    "Dutch": "Het eiwit bindt calcium met een hoge affiniteit en de structuur is opgelost in aanwezigheid van metalen; de gegevens zijn verzameld bij kamertemperatuur en in een buffer die geen andere ionen bevat, zodat we kunnen zeggen dat de plaats of vorm specifiek is; het was zo.",
    "Danish": "Proteinet binder calcium med stor affinitet, og at det er her, kan man se; at data er af den by og her til, at der er to former, som er at finde her i en by for sig, og at man kan sige at det er specifikt, at det er til og at det er her i nok.",
    "Polish": "Białko wiąże wapń z dużym powinowactwem, a jego struktura została rozwiązana w obecności metali; dane zebrano w temperaturze pokojowej i w buforze, który nie zawiera innych jonów, więc można powiedzieć, że to miejsce jest swoiste i że to są dwie formy w równowadze.",
}


def test_other_languages_are_not_english(spark):
    rng = random.Random(5)
    rows = [(i, english(i % 4 + 1, rng)) for i in range(80)] + [(1000 + k, f"{t} {t}") for k, t in enumerate(FOREIGN.values())]
    # a note without function words, of words that others use
    rows.append((2000, "Structure: interaction, coordination; deconvolution in river market. " * 8))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in reading.reading_levels(docs, spark.createDataFrame([(0, 1.0)], "doc_id bigint, reading_level double")).collect()}
    assert got == {*range(80), 2000}
