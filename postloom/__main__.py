"""Command line: list the queries, run one into a folder, or show its plan.

    python -m postloom list
    python -m postloom run p6_found --data /data/walls --out /data/instants --format parquet
    python -m postloom explain p6_found --data /data/walls
    python -m postloom clean --data /data/walls --out /data/clean --phases 1-4,7-10
"""

from __future__ import annotations

import argparse
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import SparkSession


def all_queries() -> dict:
    """The queries of the entry module where it can be imported, else those of the core."""
    if find_spec("__spark_entry__") is not None:
        return import_module("__spark_entry__").queries()
    from postloom.plans import registry

    return registry.queries()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="postloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name in ("run", "explain", "clean"):
        c = sub.add_parser(name)
        if name != "clean":
            c.add_argument("query")
        c.add_argument("--data", required=True, help="folder of the Parquet tables")
        if name != "explain":
            c.add_argument("--out", required=True, help="folder to write")
            c.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "orc"])
        if name == "clean":
            c.add_argument("--phases", default="1-10", help="as 1-3,7,9")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(all_queries())))
        return 0
    if a.command != "clean" and a.query not in all_queries():
        p.error(f"no query {a.query}")
    spark = SparkSession.builder.appName(f"postloom {a.command}").getOrCreate()
    if a.command == "clean":
        from postloom.plans.cleaning import FINAL, clean

        done = clean(spark, a.data, a.phases)
        done.where("reason IS NULL").select(*FINAL).write.mode("errorifexists").format(a.format).partitionBy("source_code").save(f"{a.out}/kept")
        done.where("reason IS NOT NULL").select("row_id", "post_id", "source_code", "reason").write.mode("errorifexists").format(a.format).save(f"{a.out}/rejected")
        return 0
    df = all_queries()[a.query](spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    else:
        df.write.mode("errorifexists").format(a.format).save(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
