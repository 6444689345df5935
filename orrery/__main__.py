"""``python -m orrery dump ROOT COLLECTION OUT``: the live rows of a collection as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from orrery.sources.catalog import DEFAULT, Catalog


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="orrery")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("dump", help="write live rows as JSON lines")
    d.add_argument("root")
    d.add_argument("collection")
    d.add_argument("out")
    d.add_argument("--database", default=DEFAULT)
    d.add_argument("--filter", default=None)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("orrery").getOrCreate()
    Catalog(spark, a.root).collection(a.collection, a.database).export_json(a.out, a.filter)


if __name__ == "__main__":
    main()
