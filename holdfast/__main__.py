"""Command line: python -m holdfast formats | list PATH | extract PATH DESTINATION [--on-exists POLICY]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from holdfast import catalog
from holdfast.operators import sink
from holdfast.sources import containers, files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="holdfast")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("formats")
    listing = sub.add_parser("list")
    listing.add_argument("path")
    extract = sub.add_parser("extract")
    extract.add_argument("path")
    extract.add_argument("destination")
    extract.add_argument("--on-exists", default="skip", choices=sorted(sink.POLICIES))
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    catalog.discover()
    if given.command == "formats":
        for r in catalog.formats(spark).orderBy("type", "tag").toLocalIterator():
            print(f"{r['type']:8} {r['tag']:12} {r['description']}")
        return 0
    found = files.files(spark, given.path)
    listed = containers.list_members(found)
    if given.command == "list":
        for r in listed.orderBy("path", "ord").toLocalIterator():
            print(f"{r['offset']:10x} {r['size']:10d}  {r['name']}" if r["name"] is not None else f"{r['path']}: {r['error']}")
        return 0
    done = sink.extract(containers.open_members(listed, found), given.destination, given.on_exists).groupBy(F.substring_index("status", ":", 1).alias("status")).count().collect()
    for r in done:
        print(f"{r['status']}: {r['count']}")
    return int(any(r["status"] == "error" for r in done))


if __name__ == "__main__":
    sys.exit(main())
