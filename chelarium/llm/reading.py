"""Reading level by a familiar-word formula.

Words are familiar by their document frequency in the corpus itself. A document's score combines the share
of its words outside the familiar list, at several lengths of the list, with its average sentence length; the weights of
the formula are fitted on graded documents. Levels count from 1.

A text is English if no other listed language has more function words in it and if at least KNOWN_SHARE of its words are known, that
is, occur in a thousandth of the documents whose function words are English beyond doubt. So texts in languages that are not listed
are no English either, while telegraphic notes without function words are.

Scale: every text is read and tokenised once, into counted hashes of its words, which are written to the shared folder;
all that follows is numbers. Document frequencies are counted with map-side combine over all documents. The words that at
least a share c of the documents contain are no more than the average number of distinct words of a document over c; they
are sent to all executors at 9 bytes each. At most MAX_GRADED graded documents are used to fit the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelarium.session import settle

MIN_WORDS = 40
#: Shares of documents that a word of each familiar list is in, at least; every list reaches a sixth further down.
CUTS = tuple(0.6 * 0.85**i for i in range(30))
KNOWN_CUT, KNOWN_SHARE, CLEAR_SHARE = 0.001, 0.5, 0.05
MAX_GRADED = 20_000

# Frequent function words, by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with by from was were are on at which be this has have it as or not a an but we so you when",
    "de": "der die das und ist von mit den ein eine nicht zu im für auf werden dem des sich es in wird sind auch",
    "fr": "le la les des et est une un du en que pour dans par sur avec qui ne pas au ce cette sont il",
    "es": "el la los las de y es una un en que por con para del se no al como su son lo más este",
}

# Function words that no neighbouring language has, English beyond doubt where they are a twentieth of a text.
CLEARLY_ENGLISH = "the and that with from this were are which have been not it their they she his you but when"

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\W*\s+|\n\s*\n|\r\n\s*\r\n")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u00ad\u2010][ \t]*\r?\n\s*(?=[^\W\d_])")


def word_hash(words: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each word, the same in every process."""
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False).view(np.int64) if len(words) else np.empty(0, np.int64)


def _marked(words: str) -> np.ndarray:
    return np.sort(word_hash(np.array(words.split(), dtype=object)))


def measure_texts(texts: list[str | None]) -> pd.DataFrame:
    """place, sentences, clear, words (hashes) and counts of the texts of at least MIN_WORDS pieces in which no listed language but English prevails.

    clear tells whether CLEARLY_ENGLISH words are CLEAR_SHARE of the text.
    """
    places = [i for i, t in enumerate(texts) if t and len(t.split(None, MIN_WORDS)) >= MIN_WORDS]
    listed = [_WORD.findall(_BROKEN.sub("", texts[i]).lower()) for i in places]
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    at, names = pd.factorize(np.array([w for ws in listed for w in ws], dtype=object))
    hashes = word_hash(names)
    owner = np.repeat(np.arange(len(listed)), lengths)
    cell, n = np.unique(owner * max(1, len(names)) + at, return_counts=True)
    of, word = cell // max(1, len(names)), hashes[cell % max(1, len(names))]
    told = {l: np.bincount(of, weights=n * np.isin(word, _marked(ws)), minlength=len(listed)) for l, ws in FUNCTION_WORDS.items()}
    english = (told["en"] > 0) & (told["en"] >= np.max([told[l] for l in told], axis=0))
    clear = np.bincount(of, weights=n * np.isin(word, _marked(CLEARLY_ENGLISH)), minlength=len(listed)) >= CLEAR_SHARE * lengths
    ends = np.searchsorted(of, np.arange(1, len(listed) + 1))
    rows = [
        (places[k], max(1, sum(1 for s in _SENTENCE.split(texts[places[k]]) if _WORD.search(s))), bool(clear[k]), word[ends[k - 1] if k else 0 : ends[k]], n[ends[k - 1] if k else 0 : ends[k]].astype(np.int32))
        for k in np.flatnonzero(english)
    ]
    return pd.DataFrame(rows, columns=["place", "sentences", "clear", "words", "counts"])


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, sentences, clear, words, counts) of measure_texts, settled; k is id_col."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = measure_texts(pdf["t"].tolist())
            out.insert(0, "k", pdf["k"].iloc[out.pop("place").astype(int)].to_numpy())
            yield out.astype({"k": pdf["k"].dtype, "sentences": "int32", "clear": bool})

    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return settle(slim.mapInPandas(measure, f"k {slim.schema['k'].dataType.simpleString()}, sentences int, clear boolean, words array<bigint>, counts array<int>"))


def frequent_words(texts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, share of the texts that hold each) of the words of at least the share `least` of all texts (words array)."""
    total = texts.count()
    rows = texts.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least * total).orderBy("w").toPandas()
    return rows["w"].to_numpy(np.int64), rows["n"].to_numpy(float) / max(1, total)


def shares_among(words: pd.Series, counts: pd.Series, listed: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the share of its words at each column of weights (listed words x columns of 0 and 1)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    w, n = (np.concatenate([np.asarray(x) for x in c]) if len(owner) else np.empty(0, np.int64) for c in (words, counts))
    at = np.minimum(np.searchsorted(listed, w), max(0, len(listed) - 1))
    hit = np.flatnonzero(listed[at] == w) if len(listed) else np.empty(0, np.int64)
    total = np.maximum(np.bincount(owner, weights=n, minlength=len(words)), 1)
    return np.stack([np.bincount(owner[hit], weights=n[hit] * weights[at[hit], c], minlength=len(words)) for c in range(weights.shape[1])], axis=1) / total[:, None]


def english_texts(texts: DataFrame) -> DataFrame:
    """The texts of `measured` that are English: KNOWN_SHARE of their words are known."""
    known = texts.sparkSession.sparkContext.broadcast(frequent_words(texts.where("clear"), KNOWN_CUT)[0])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[shares_among(pdf["words"], pdf["counts"], known.value, np.ones((len(known.value), 1)))[:, 0] >= KNOWN_SHARE]

    return texts.mapInPandas(keep, texts.schema)


def reading_numbers(english: DataFrame) -> DataFrame:
    """(k, numbers): the formula's numbers of english texts: the shares of words outside the lists of CUTS, and the log of words to a sentence."""
    listed, share = frequent_words(english, CUTS[-1])
    held = english.sparkSession.sparkContext.broadcast((listed, (share[:, None] >= np.array(CUTS)).astype(float)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            familiar = shares_among(pdf["words"], pdf["counts"], *held.value)
            per_sentence = np.array([sum(c) for c in pdf["counts"]], float) / pdf["sentences"].to_numpy(float)
            yield pd.DataFrame({"k": pdf["k"], "numbers": list(np.c_[1 - familiar, np.log(np.maximum(per_sentence, 1e-9))])})

    return english.mapInPandas(measure, f"k {english.schema['k'].dataType.simpleString()}, numbers array<double>")


class LevelFormula:
    """Weights over the formula's numbers, one set per level (multinomial logistic, ridge)."""

    def __init__(self, numbers: np.ndarray, levels: np.ndarray, ridge: float = 1e-3, steps: int = 3000):
        self.levels = np.unique(levels)
        self.mean, self.scale = numbers.mean(axis=0), numbers.std(axis=0) + 1e-6
        z = np.c_[(numbers - self.mean) / self.scale, np.ones(len(numbers))]
        target = (levels[:, None] == self.levels).astype(float)
        self.weights = np.zeros((z.shape[1], len(self.levels)))
        speed = np.zeros_like(self.weights)
        for _ in range(steps):
            p = np.exp(z @ self.weights - (z @ self.weights).max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 0.3 * (z.T @ (p - target) / len(z) + ridge * self.weights)
            self.weights += speed

    def levels_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.levels[(np.c_[(numbers - self.mean) / self.scale, np.ones(len(numbers))] @ self.weights).argmax(axis=1)]


def graded_sample(labels: DataFrame, id_col: str, level_col: str) -> DataFrame:
    """(id_col, level) of at most MAX_GRADED documents on whose level all their graders agree; null grades don't count."""
    one = (
        labels.where(F.col(id_col).isNotNull() & F.col(level_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(level_col).cast("int").alias("level"), F.max(level_col).cast("int").alias("_most"))
        .where("level = _most")
    )
    return one.select(id_col, "level").orderBy(F.xxhash64(id_col)).limit(MAX_GRADED)


def reading_levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", level_col: str = "reading_level") -> DataFrame:
    """(id_col, reading_level): the level of every English document of at least MIN_WORDS pieces between white space.

    Null, empty, short and foreign texts give no row; repeated rows come out as often as they go in. Without any usable
    grade, levels are quarters of the share of words outside the longest familiar list from 0 to 0.4 (1 to 4).
    """
    numbers = settle(reading_numbers(settle(english_texts(measured(docs, id_col, text_col)))))
    graded = graded_sample(labels, id_col, level_col).withColumnRenamed(id_col, "k")
    # MAX_GRADED rows
    fit = numbers.join(F.broadcast(graded), "k").select("numbers", "level").collect()
    formula = LevelFormula(np.array([r["numbers"] for r in fit]), np.array([r["level"] for r in fit])) if fit else None

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["numbers"].tolist(), dtype=float).reshape(len(pdf), len(CUTS) + 1)
            found = formula.levels_of(x) if formula else np.clip(x[:, -2] // 0.1 + 1, 1, 4)
            yield pd.DataFrame({"k": pdf["k"], "reading_level": found.astype("int32")})

    return numbers.mapInPandas(level, f"k {numbers.schema['k'].dataType.simpleString()}, reading_level int").withColumnRenamed("k", id_col)
