"""extract --org ORG --repo REPO DIR: a tree's relations as one JSON object on standard output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.extract import extract
from .sources.sink import print_object, write_ordered
from .sources.tree import read_tree

ORDERS = {"nodes": ["object_type", "name"], "edges": ["source_ref", "edge_type", "target_ref"], "mentions": ["identifier", "kind", "source", "file", "line"], "diagnostics": ["path", "line", "code"], "stats": []}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="extract")
    parser.add_argument("--org", required=True)
    parser.add_argument("--repo", required=True)
    parser.add_argument("--out", help="write each relation as ordered lines of JSON below this folder instead, and print their digests")
    parser.add_argument("dir")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("extract").getOrCreate()
    files, unreadable = read_tree(spark, given.dir, given.org, given.repo)
    found = extract(files).ordered()
    if given.out:
        for name, df in found.items():
            n, digest = write_ordered(df, ORDERS[name], f"{given.out}/{name}").first()
            print(f"{name} {n} {digest}")
    else:
        print_object(found, ("stats",), sys.stdout)
    lost = [r["path"] for r in unreadable.orderBy("path").collect()]
    for path in lost:
        print(f"unreadable: {path}", file=sys.stderr)
    return int(bool(lost))


if __name__ == "__main__":
    sys.exit(main())
