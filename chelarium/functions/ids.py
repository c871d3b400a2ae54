"""Identifier spelling: one canonical key per id, in Spark, SQL and plain Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for an id that names nothing, without their punctuation.
PLACEHOLDERS = (
    "", "anonymous", "missing", "na", "nan", "nd", "nil", "none", "notapplicable", "notavailable",
    "notgiven", "notknown", "notreported", "notspecified", "notstated", "null", "pending", "tba",
    "tbc", "tbd", "undefined", "unknown", "unnamed", "unspecified", "withheld",
)

_NOT_ALNUM = re.compile("[^A-Za-z0-9]")


def spelling_key(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits of an id; two spellings of one id share it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def id_key(c: Column | str) -> Column:
    """spelling_key, but null for a null, blank or placeholder id."""
    k = spelling_key(c)
    return F.when(k.isin(*PLACEHOLDERS), None).otherwise(k)


def id_key_sql(c: str) -> str:
    """The same key as a DuckDB expression."""
    k = f"lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
    return f"(CASE WHEN {k} IN ({', '.join(repr(p) for p in PLACEHOLDERS)}) THEN NULL ELSE {k} END)"


def py_id_key(value: object) -> str | None:
    """The same key for one Python value."""
    if value is None:
        return None
    k = _NOT_ALNUM.sub("", str(value)).lower()
    return None if k in PLACEHOLDERS else k
