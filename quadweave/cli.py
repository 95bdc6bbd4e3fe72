"""Command line: grid files to tables and back, and differences between files."""

from __future__ import annotations

import argparse
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.caseSensitive", "true").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    tables = commands.add_parser("tables", help="RDF/XML files to a CSV folder, or a workbook, with a table for each class")
    tables.add_argument("paths", nargs="+")
    tables.add_argument("--out", required=True, help="a folder, or a file that ends in .xlsx")
    differ = commands.add_parser("diff", help="differences between two RDF/XML files or folders; exits with 1 if there are any")
    differ.add_argument("old")
    differ.add_argument("new")
    quads = commands.add_parser("nquads", help="RDF/XML files to N-Quads")
    quads.add_argument("paths", nargs="+")
    quads.add_argument("--out", required=True)
    given = parser.parse_args(args)

    from quadweave.operators.diff import diff_text
    from quadweave.operators.tableview import rendered, tableviews
    from quadweave.sinks.files import write_nquads, write_tables
    from quadweave.sinks.xlsx import write_workbook
    from quadweave.sources.cimxml import read_cimxml

    spark = _session()
    if given.command == "diff":
        volatile = ("Distribution", "NamespaceMap")
        sides = []
        for path in (given.old, given.new):
            data = read_cimxml(spark, path)
            meta = data.where(data["VALUE"].isin(*volatile) & (data["KEY"] == "Type")).select("ID")
            sides.append(data.join(meta, "ID", "left_anti"))
        text = diff_text(*sides)
        print(text)
        return 1 if text else 0
    data = read_cimxml(spark, given.paths)
    if given.command == "nquads":
        write_nquads(data, given.out)
    elif given.out.endswith(".xlsx"):
        write_workbook({n: rendered(v) for n, v in tableviews(data, multivalue=True).items()}, given.out)
    else:
        write_tables(data, given.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
