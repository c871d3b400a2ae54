"""Command line: python -m chelarium.cli COMMAND ... Each command prints a summary; exit code 1 on failure."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from chelarium.functions import exprs
from chelarium.operators import tables
from chelarium.session import build_session
from chelarium.sources import readers
from chelarium.sources.xlsx import SheetSource


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chelarium")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"corpus": ["folder"], "cost": ["folder"], "literature": ["folder", "out"], "screening": ["sheet", "out"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name == "cost":
            p.add_argument("--paper")
    args = parser.parse_args(argv)
    spark = build_session("chelarium-cli")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if args.command == "corpus":
            # one row at a time, as the listing may be longer than the driver holds
            for r in readers.read_corpus(spark, args.folder).select("paper_id", F.length("text").alias("n_chars")).orderBy("paper_id").toLocalIterator():
                print(r.paper_id, r.n_chars, sep="\t")
        elif args.command == "cost":
            texts = readers.read_corpus(spark, args.folder)
            if args.paper:
                texts = texts.where(F.col("paper_id") == args.paper)
                if texts.isEmpty():
                    raise ValueError(f"no paper {args.paper}")
            texts.agg(F.count("*").alias("n_texts"), F.sum(F.length("text")).alias("n_chars")).select("*", exprs.run_cost(F.col("n_chars"), F.col("n_texts")).alias("cost")).show()
        elif args.command == "literature":
            long = tables.literature_long(readers.read_extractions(spark, args.folder))
            readers.write_tables({"literature_binding_data": long.orderBy("source_paper", "variant_id", "target_element", "measurement_id")}, args.out)
            print(long.count(), "rows")
        else:
            spark.dataSource.register(SheetSource)
            sheet = tables.rename_screening(spark.read.format("sheet").load(args.sheet))
            long = tables.screening_long(tables.screening_variants(sheet, "screening"))
            readers.write_tables({"screening": long.orderBy("variant_id", "target_element", "measurement_id")}, args.out)
            print(long.count(), "rows")
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
