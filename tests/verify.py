"""Run queries beside their SQL: python tests/verify.py SF_DIR [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as e  # noqa: E402
from chelarium.session import build_session  # noqa: E402


def rows(pdf: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return tuple(map(plain, x))
        if isinstance(x, dict):
            return tuple(sorted((k, plain(v)) for k, v in x.items()))
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else str(round(x, 6))
        return str(int(x)) if isinstance(x, bool) else str(x)

    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in pdf.itertuples(index=False)), key=repr)


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con.execute(sql).fetchdf()


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        got = q(spark, sf_dir).toPandas()
        took = time.time() - t
        verdict = "no SQL"
        if sql := e.oracle_sql().get(name):
            want = oracle(sf_dir, sql)
            a, b = rows(got), rows(want)
            same = sorted(got.columns) == sorted(want.columns) and a == b
            verdict = "same" if same else f"DIFFERS: {len(a)} rows, SQL {len(b)}; {sorted(got.columns)} {sorted(want.columns)}; only here {sorted(set(a) - set(b))[:4]}, only SQL {sorted(set(b) - set(a))[:4]}"
            bad += not same
        print(f"{name}: {len(got)} rows, {took:.1f} s, {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
