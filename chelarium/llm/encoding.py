"""Encoding of texts with a public tokenizer by a tree reduction.

Encodings form a monoid under joining: a text is halved down to leaves of LEAF characters, leaves are encoded,
and neighbours are joined up the tree. Joining re-encodes only a window around the seam. A byte-level BPE
first cuts a text into pieces by a pattern that scans from left to right and looks ahead by two characters
at most beyond a piece (white space: to the end of its run), never back. A piece of the left part that ends two
characters before the seam is therefore final, and from the first place on where the scan of the window
meets a piece start of the right part, with the piece before it final as well, the right part's tokens hold.
The window grows until there is such a place, so the result provably equals the encoding of the whole.

Scale: a map over Arrow batches; no text is ever split over tasks, cut or sampled. The vocabulary file, whose path is a
parameter, is read where the driver runs, shipped to all executors and parsed once per Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 1024

# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after a piece's end that can still change it.
LOOKAHEAD = 2


@lru_cache(maxsize=4)
def _tools(vocabulary: str):
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines()) if a}
    return tiktoken.Encoding(Path(vocabulary).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(PATTERN)


@dataclass
class Encoded:
    """A text with its tokens and the starts of its pieces."""

    text: str
    ids: list[int]
    starts: list[int]


class TreeEncoder:
    """Encodes texts with one vocabulary; leaf is the number of characters that are encoded at once."""

    def __init__(self, vocabulary: str = VOCABULARY, leaf: int = LEAF):
        self._encoding, self._pattern = _tools(vocabulary)
        self._leaf = leaf

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; an empty list for a null or empty text."""
        if not text:
            return []
        if len(text) <= self._leaf:
            return self._encoding.encode_ordinary(text)
        return self._tree(text).ids

    def decode(self, ids: list[int]) -> str:
        return self._encoding.decode_bytes(list(ids)).decode("utf-8", errors="replace")

    def _starts(self, text: str) -> list[int]:
        return [m.start() for m in self._pattern.finditer(text)]

    def _tree(self, text: str) -> Encoded:
        level = [Encoded(t, self._encoding.encode_ordinary(t), self._starts(t)) for t in (text[i : i + self._leaf] for i in range(0, len(text), self._leaf))]
        while len(level) > 1:
            joined = [self._join(a, b) for a, b in zip(level[::2], level[1::2])]
            level = joined + level[len(joined) * 2 :]
        return level[0]

    def _pieces(self, text: str, starts: list[int], stop: int) -> list[int]:
        """Tokens of the pieces at `starts`, the last of which ends at stop."""
        return [t for a, b in zip(starts, [*starts[1:], stop]) for t in self._encoding.encode_ordinary(text[a:b])]

    def _join(self, a: Encoded, b: Encoded) -> Encoded:
        n = len(a.text)
        i = len(a.starts) - 1
        while i > 0 and a.starts[i] > n - LOOKAHEAD:
            i -= 1
        seam = a.starts[i]
        undone = len(self._pieces(a.text, a.starts[i:], n))
        right = set(b.starts)
        width = 16
        while True:
            window = a.text[seam:] + b.text[:width]
            starts = self._starts(window)
            whole = width >= len(b.text)
            meets = next((k for k, s in enumerate(starts) if s > 0 and s - (n - seam) in right and (whole or s <= len(window) - LOOKAHEAD)), None)
            if meets is not None or whole:
                break
            width *= 4
        if meets is None:
            at, meets = len(window), len(starts)
        else:
            at = starts[meets]
        into = at - (n - seam)
        middle = self._pieces(window, starts[:meets], at)
        first = next((j for j, s in enumerate(b.starts) if s >= into), len(b.starts))
        passed = len(self._pieces(b.text, b.starts[:first], into)) if first else 0
        return Encoded(
            a.text + b.text,
            a.ids[: len(a.ids) - undone] + middle + b.ids[passed:],
            a.starts[:i] + [seam + s for s in starts[:meets]] + [n + s for s in b.starts[first:]],
        )


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(id_col, ids array<int>): every row's text as token ids; null and empty texts give an empty list.

    Repeated rows come out as often as they go in, a null id stays null, other columns are not looked at.
    """

    df.sparkSession.sparkContext.addFile(vocabulary)
    shipped = Path(vocabulary).name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TreeEncoder(SparkFiles.get(shipped), leaf)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "ids": [encoder.encode(t) for t in pdf["t"]]}, columns=["k", "ids"])

    slim = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return slim.mapInPandas(run, f"k {slim.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", id_col)
