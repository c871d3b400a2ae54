"""Evaluation passages in a corpus by q-gram lemma filtering.

Texts are normalised to words between single blanks. A corpus region that holds a passage of n characters
with at most k edits (letters put in, left out or changed) shares at least n + 1 - q - k q of its q-grams, all within k diagonals of each other (the
diagonal is the place in the document less that in the item). Shared q-grams are counted in overlapping bands
of diagonals; bands below the bound are refuted, the others are aligned within the band: for each word of the item,
how far the passage that starts there gets on each diagonal with 0, 1 .. k edits. q is lowered where
passages are so short that the bound would else be void, so no passage is lost to the filter.

Scale: a map over Arrow batches of the corpus against the items' q-grams, which are sent to all executors. The
items are taken in blocks of ITEM_BLOCK, so what is sent is bounded whatever their number; each block is held
against all documents, whose whole texts are read. Hits per document are at most its shared q-grams.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelarium.llm.shingles import mix

Q = 12
PASSAGE_WORDS = 12
ITEM_BLOCK = 20_000
SLICE_LETTERS = 1 << 20
_TABLE_BITS = 24

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-­‐‑][ \t]*(?:\r\n|[\r\n\v\f\x85  ])\s*(?:>\s*)*(?=[^\W_])")
_INVISIBLE = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]")


def normal_words(text: str | None) -> list[str]:
    """Words (longest runs of letters and digits) without case, compatibility forms, invisible characters and line-end hyphens."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        hidden = {c for c in set(text) if c != "­" and unicodedata.category(c) == "Cf"}
        if hidden:
            text = re.sub("[" + re.escape("".join(sorted(hidden))) + "]", "", text)
        text = _INVISIBLE.sub("", text)
    text = _BROKEN.sub("", text).replace("­", "")
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text)


def _grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, hash) of all q-grams of the texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(q):
            h = h * np.uint64(0x100000001B3) + codes[i : i + n]
    owner = np.repeat(np.arange(len(texts)), lengths)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    whole = np.flatnonzero(owner[:n] == owner[q - 1 :])
    o = owner[whole]
    return o, whole - start[o], h[whole]


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def aligned_words(text: np.ndarray, item: np.ndarray, low: int, high: int, edits: int) -> int:
    """Most consecutive words of the item that the text holds with at most `edits` edits at diagonals from low to below high.

    text and item are letters, with a blank before and after every word; those around a passage count as its letters.
    """
    m, blank = len(item), 32
    starts = np.flatnonzero(item == blank)
    # for every diagonal and place in the item: the place up to which both are equal
    equal_to = np.empty((high - low, m + 1), np.int64)
    for d in range(low, high):
        a, b = min(max(0, -d), m), max(0, min(m, len(text) - d))
        differs = np.ones(m + 1, bool)
        if a < b:
            differs[a:b] = text[a + d : b + d] != item[a:b]
        equal_to[d - low] = np.minimum.accumulate(np.where(differs, np.arange(m + 1), m)[::-1])[::-1]
    reach = equal_to[:, starts[:-1]]
    for _ in range(edits):
        more = np.minimum(reach + 1, m)
        more[:-1] = np.maximum(more[:-1], np.minimum(reach[1:] + 1, m))
        more[1:] = np.maximum(more[1:], reach[:-1])
        reach = np.take_along_axis(equal_to, more, axis=1)
    # a passage ends with the blank after its last word
    return int((np.searchsorted(starts, reach.max(axis=0) - 1, side="right") - 1 - np.arange(len(starts) - 1)).max(initial=0))


class PassageIndex:
    """q-grams of a block of items, with the least number of them that a passage of each item has."""

    def __init__(self, ids: list, texts: list[str | None], words: int = PASSAGE_WORDS, edits: int = 0, q: int = Q):
        listed = [normal_words(t) for t in texts]
        kept = [i for i, w in enumerate(listed) if len(w) >= words]
        self.ids = [ids[i] for i in kept]
        self.words, self.edits, self.q = words, edits, q
        self.item_words = [listed[i] for i in kept]
        self.item_text = [f" {' '.join(w)} " for w in self.item_words]
        least = np.array([min(sum(map(len, w[i : i + words])) + words + 1 for i in range(len(w) - words + 1)) for w in self.item_words], np.int64)
        # q-grams of the shortest passage that are left with so many edits, at least one
        q = self.q = max(1, min([q, *(least // (edits + 1))]))
        self.bound = np.maximum(1, least + 1 - q - edits * q)
        self.letters = [_letters(t) for t in self.item_text]
        owner, place, h = _grams(self.item_text, q)
        by = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = mix(h[by]), owner[by], place[by]
        by = np.argsort(self.hash, kind="stable")
        self.hash, self.owner, self.place = self.hash[by], self.owner[by], self.place[by]
        self.seen = np.zeros(1 << (_TABLE_BITS - 3), np.uint8)
        slot = (self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        np.bitwise_or.at(self.seen, slot >> 3, (1 << (slot & 7)).astype(np.uint8))

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text, item, words): the texts that hold so many consecutive words of an item with at most `edits` edits, `words` at least."""
        joined = [f" {' '.join(normal_words(t))} " for t in texts]
        doc, place, h = _grams(joined, self.q)
        if not len(doc) or not len(self.hash):
            return []
        h = mix(h)
        slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        may = np.flatnonzero((self.seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        lo, hi = np.searchsorted(self.hash, h[may]), np.searchsorted(self.hash, h[may], side="right")
        n = hi - lo
        hit = np.repeat(may, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        d, item = doc[hit], self.owner[entry]
        diagonal = place[hit] - self.place[entry]
        width = 2 * max(1, self.edits)
        # bands of twice the edits, each overlapping the next by half, so that k diagonals lie wholly within one
        band = np.concatenate([diagonal // width * 2, (diagonal + width // 2) // width * 2 - 1])
        kept = np.empty((0, 3), np.int64)
        if len(band):
            least, n_items = band.min(), len(self.item_words)
            pair = np.tile(d * n_items + item, 2)
            pair_no = np.unique(pair, return_inverse=True)[1]
            _, first, count = np.unique(pair_no * (int(band.max() - least) + 1) + (band - least), return_index=True, return_counts=True)
            enough = first[count >= self.bound[pair[first] % n_items]]
            kept = np.stack([pair[enough] // n_items, pair[enough] % n_items, band[enough]], axis=1)
        found, letters = {}, {}
        for t, i, b in kept.tolist():
            low = b // 2 * width if b % 2 == 0 else (b + 1) // 2 * width - width // 2
            if t not in letters:
                letters[t] = _letters(joined[t])
            found[t, i] = max(found.get((t, i), 0), aligned_words(letters[t], self.letters[i], low, low + width, self.edits))
        return [(t, i, n) for (t, i), n in found.items() if n >= self.words]

    def find_all(self, texts: list[str | None], letters: int = SLICE_LETTERS) -> list[tuple[int, int, int]]:
        """find, over slices of about so many letters, which bounds the memory; a text is never cut."""
        out, start, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= letters or i == len(texts) - 1:
                out += [(start + d, item, n) for d, item, n in self.find(texts[start : i + 1])]
                start, held = i + 1, 0
        return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", words: int = PASSAGE_WORDS, edits: int = 0) -> DataFrame:
    """(item_col, doc_col, n_words): documents that hold at least `words` consecutive words of an item's text.

    One row per item and document row; the words may have `edits` letters put in, left out or changed in all. Null, empty and short texts hold
    nothing; a null id stays null. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_col).alias("k"), F.col(text_col).alias("t"))
    kind, item_kind = slim.schema["k"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"item {item_kind}, k {kind}, n_words int"
    n_blocks = max(1, -(-items.count() // ITEM_BLOCK))
    block = F.pmod(F.xxhash64(item_col), F.lit(n_blocks))
    out = None
    for b in range(n_blocks):
        listed = items.where(block == b).select(item_col, text_col).collect() if n_blocks > 1 else items.select(item_col, text_col).collect()
        index = spark.sparkContext.broadcast(PassageIndex([r[0] for r in listed], [r[1] for r in listed], words, edits))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            held = index.value
            for pdf in batches:
                found = held.find_all(pdf["t"].tolist())
                yield pd.DataFrame({"item": [held.ids[i] for _, i, _ in found], "k": pdf["k"].iloc[[t for t, _, _ in found]].to_numpy(), "n_words": [n for _, _, n in found]}, columns=["item", "k", "n_words"])

        part = slim.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("item").alias(item_col), F.col("k").alias(doc_col), "n_words")
