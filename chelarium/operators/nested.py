"""Deeply nested records into related flat tables by interval labels.

Each payload is read once by a depth-first traversal of the whole document that gives every object, at any depth and under
any key, a pre-order and a post-order number. One node table per object type comes out; an object lies in another exactly when its interval does
(pre later, post earlier), so parents are found by interval containment and no path needs to be kept: a merge over the
nodes in pre-order holds the intervals that are still open, the innermost of which is the parent.

Scale: the traversal is a map over Arrow batches without shuffle. Linking sorts the slim node rows within
their payload, once, and streams over them; payloads are independent, so no key is hot however often a paper recurs. Neither
the layers of string encoding nor the depth of nesting are limited.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chelarium.functions.ids import py_id_key
from chelarium.functions.mutations import canonical_mutations, mutation_from_parts

NODE_FIELDS = (
    "kind string, pre int, post int, level int, pos int, item string, id_key string, variant_id string, value double, units string"
)
#: Names of objects by the key of the list they stand in; others are named by that key.
KINDS = {"variants": "variant", "mutations": "mutation", "measurements": "measurement"}

_DECODER = json.JSONDecoder()
_CUT = re.compile(r"(?:t|tr|tru|f|fa|fal|fals|n|nu|nul|-)?\s*")
_NOT_ALNUM = re.compile("[^a-z0-9]")
_SPACE = re.compile(r"[ \t\n\r]*")
_OPENS = re.compile(r'[{\[]|"(?=\s*\{)')


def read_payload(payload: str | None) -> tuple[dict | None, str | None]:
    """(document, reason): the complete extraction document of an answer, or why there is none.

    Takes away text around it, code fences, string encoding and wrapping objects, however many. A document cut off at the end is
    not complete, even if objects within it are. Reasons: null, blank, no_json (or cut off), no_document.
    """
    if payload is None or not payload.strip():
        return None, "null" if payload is None else "blank"
    value: object = payload
    while isinstance(value, str):
        value = _first_value(value)  # what a string holds is shorter than the string
    found = _document_in(value)
    return found, None if found is not None else "no_json" if value is None else "no_document"


def read_document(payload: str | None) -> dict | None:
    """The document of read_payload."""
    return read_payload(payload)[0]


def _decode(text: str, at: int) -> tuple[object, int]:
    """The JSON value that starts at a place, and its end; values too deep for the decoder are read without recursion."""
    try:
        return _DECODER.raw_decode(text, at)
    except RecursionError:
        return _decode_deep(text, at)


def _decode_deep(text: str, at: int) -> tuple[object, int]:
    open_: list = []  # containers around, with the key under which a value is to go
    skip = _SPACE.match
    while True:
        at = skip(text, at).end()
        c = text[at : at + 1]
        if c in ("{", "["):
            open_.append([{} if c == "{" else [], None])
            at = skip(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    at = _deep_key(text, at, open_[-1])
                continue
            value, at = open_.pop()[0], at + 1
        else:
            value, at = _DECODER.raw_decode(text, at)
        while open_:
            into, key = open_[-1]
            if key is None:
                into.append(value)
            else:
                into[key] = value
            at = skip(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = skip(text, at + 1).end()
                if key is not None:
                    at = _deep_key(text, at, open_[-1])
                break
            if c != ("]" if key is None else "}"):
                raise json.JSONDecodeError("Expecting ',' delimiter", text, at)
            value, at = open_.pop()[0], at + 1
        else:
            return value, at


def _deep_key(text: str, at: int, into: list) -> int:
    if text[at : at + 1] != '"':
        raise json.JSONDecodeError("Expecting property name enclosed in double quotes", text, at)
    into[1], at = _DECODER.raw_decode(text, at)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise json.JSONDecodeError("Expecting ':' delimiter", text, at)
    return at + 1


def _first_value(text: str) -> object:
    text = text.strip().lstrip("\ufeff").strip()
    try:
        value, end = _decode(text, 0)
        if not text[end:].strip():
            return value
    except ValueError:
        pass
    at = 0
    while (m := _OPENS.search(text, at)) is not None:
        try:
            value, end = _decode(text, m.start())
        except json.JSONDecodeError as e:
            if e.msg.startswith("Unterminated string") or _CUT.fullmatch(text, e.pos) or len(text) - e.pos < 8 and "escape" in e.msg:
                # it ran off the end: the outermost object is cut, but a stray bracket before it may be to blame
                if text[m.start()] != "{" or not re.match(r'\{\s*"', text[m.start() :]):
                    at = m.start() + 1
                    continue
                return None
            at = m.start() + 1
            continue
        if _document_in(value) is not None or isinstance(value, str):
            return value
        at = end
    return None


def _norm(key: object) -> str:
    return _NOT_ALNUM.sub("", str(key).lower())


def _fields(o: dict) -> dict:
    return {_norm(k): v for k, v in o.items()}


def _document_in(value: object) -> dict | None:
    """The outermost object with variants or measurements, breadth first."""
    level = [value]
    while level:
        below: list = []
        for x in level:
            if isinstance(x, dict):
                f = _fields(x)
                if "variants" in f or "measurements" in f:
                    return f
                below += x.values()
            elif isinstance(x, list):
                below += x
        level = [x for x in below if isinstance(x, (dict, list))]
    return None


def _listed(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _text(x: object) -> str | None:
    return None if x is None or isinstance(x, (dict, list)) else str(x)


def _number(x: object) -> float | None:
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    try:
        return float(x)
    except (ValueError, OverflowError):
        return None


def _mutations_of(entry: object) -> list[str]:
    if not isinstance(entry, dict):
        return canonical_mutations(_text(entry))
    f = _fields(entry)
    if f.get("notation") is not None:
        return canonical_mutations(_text(f["notation"]))
    return [x for x in [mutation_from_parts(f.get("from"), f.get("position"), f.get("to"))] if x]


def _children(f: dict) -> Iterator[tuple[str, int, str, object]]:
    """(kind, pos, item, object) of the objects right below an object, and of the mutations in it, in order."""
    for key, value in f.items():
        kind = KINDS.get(key, key)
        if kind == "mutation":
            pos = 0
            for entry in _listed(value):
                for k, item in enumerate(_mutations_of(entry)):
                    yield kind, pos, item, entry if k == 0 else None
                    pos += 1
        else:
            lists = [enumerate(_listed(value))]
            while lists:  # lists in lists: places are those in the innermost
                for pos, x in lists[-1]:
                    if isinstance(x, dict):
                        yield kind, pos, "", x
                    elif isinstance(x, list):
                        lists.append(enumerate(x))
                        break
                else:
                    lists.pop()


def label_nodes(document: dict) -> list[list]:
    """NODE_FIELDS of every object of a document, depth first; numbers count from 0."""
    rows: list[list] = []
    pre = post = level = 0
    waiting: list = [("document", 0, "", document)]
    while waiting:
        at = waiting.pop()
        if isinstance(at, list):
            at[2], post, level = post, post + 1, level - 1
            continue
        kind, pos, item, obj = at
        f = obj if kind == "document" else _fields(obj) if isinstance(obj, dict) else {}
        given = value = units = None
        if kind in ("variant", "measurement"):
            given = _text(f.get("variantid"))
            item = (given if kind == "variant" else _text(f.get("targetelement"))) or ""
            if kind == "measurement":
                value, units = _number(f.get("value")), _text(f.get("units"))
        row = [kind, pre, -1, level, pos, item, py_id_key(given), given, value, units]
        rows.append(row)
        pre, level = pre + 1, level + 1
        waiting.append(row)
        waiting += reversed(list(_children(f)))
    return rows


def shred(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """One row per object of every payload's document: id_col, row_no (one per payload) and NODE_FIELDS.

    kind is document, variant, mutation, measurement or, for any other object, the key it stands under (lower-case letters and
    digits); level is the number of objects around it; pos counts from 0 in the list where the object stands, a single
    object is a list of one. item is the id of a variant as written (empty if none), a mutation as R100K or K77del, the
    element of a measurement as written. Null, empty, cut off or otherwise unreadable payloads give no row; an entry of a
    list that is no object keeps its place but gives no row. Repeated rows come out as often as they go in; other columns
    are not looked at.
    """
    names = [f.split()[0] for f in NODE_FIELDS.split(", ")]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, row_nos, rows = [], [], []
            for at, (i, payload) in enumerate(zip(pdf["k"], pdf["payload"])):
                doc = read_document(payload)
                if doc is not None:
                    found = label_nodes(doc)
                    rows += found
                    ids += [i] * len(found)
                    row_nos += [pdf["row_no"].iat[at]] * len(found)
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "row_no", pd.Series(row_nos, dtype="int64"))
            out.insert(0, "k", pd.Series(ids, dtype=pdf["k"].dtype))
            yield out

    slim = df.select(F.col(id_col).alias("k"), F.monotonically_increasing_id().alias("row_no"), F.col(payload_col).cast("string").alias("payload"))
    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInPandas(label, f"k {kind}, row_no bigint, {NODE_FIELDS}").withColumnRenamed("k", id_col)


def link_nodes(nodes: DataFrame, only: Column | str | None = None) -> DataFrame:
    """nodes with what they lie in: parent_kind, parent_pre and, as parent_pos, the place of the variant.

    The parent is the innermost node whose interval holds the node's (null for documents), among all kinds or, with `only`, among the nodes
    that it keeps. parent_pos is the pos of the innermost variant around; a measurement outside of
    variants belongs to the first variant of the document's own list with the same id, else to none (-1), as do variants themselves.
    """
    first = F.min(F.when((F.col("kind") == "variant") & (F.col("level") == 1), F.col("pos"))).over(Window.partitionBy("row_no", "id_key"))
    kept = nodes if only is None else nodes.where(only)
    named = kept.repartition("row_no").withColumn("same_id", F.when(F.col("id_key").isNotNull() & (F.col("kind") == "measurement"), first))

    def contain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        payload, around, variants = None, [], []  # nodes still open: (post, kind, pre), and variants: (post, pos)
        for pdf in batches:
            kinds, pres, places = [], [], []
            for row_no, kind, pre, post, pos, same_id in zip(pdf["row_no"], pdf["kind"], pdf["pre"], pdf["post"], pdf["pos"], pdf["same_id"]):
                if row_no != payload:
                    payload, around, variants = row_no, [], []
                while around and around[-1][0] < post:
                    around.pop()
                while variants and variants[-1][0] < post:
                    variants.pop()
                kinds.append(around[-1][1] if around else None)
                pres.append(around[-1][2] if around else None)
                if kind == "variant":
                    places.append(-1)
                    variants.append((post, pos))
                else:
                    places.append(variants[-1][1] if variants else int(same_id) if same_id == same_id and same_id is not None else -1)
                around.append((post, kind, pre))
            yield pdf.drop(columns="same_id").assign(parent_kind=pd.Series(kinds, pdf.index, dtype=object), parent_pre=pd.Series(pres, pdf.index, dtype="Int32"), parent_pos=pd.Series(places, pdf.index, dtype="int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return named.sortWithinPartitions("row_no", "pre").mapInPandas(contain, f"{schema}, parent_kind string, parent_pre int, parent_pos int")


def unreadable(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id_col, reason) of the payloads that hold no complete document; see read_payload."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reasons = [read_payload(p)[1] for p in pdf["payload"]]
            yield pd.DataFrame({"k": pdf["k"], "reason": pd.Series(reasons, pdf.index, dtype=object)}).dropna(subset="reason")

    slim = df.select(F.col(id_col).alias("k"), F.col(payload_col).cast("string").alias("payload"))
    return slim.mapInPandas(tell, f"k {slim.schema['k'].dataType.simpleString()}, reason string").withColumnRenamed("k", id_col)
