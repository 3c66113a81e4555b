"""Command-line runner for the registered queries.

    python -m ledgerline list
    python -m ledgerline show <query> [--data DIR] [-n 20]
    python -m ledgerline run <query> [--data DIR] --out PATH      # parquet, staged replace
    python -m ledgerline explain <query> [--data DIR]

``--data`` is a folder of the driver's parquet tables (default sf0.01).  On a
cluster, submit with spark-submit; the session comes from the environment.
"""

from __future__ import annotations

import argparse
import os
import sys

DEFAULT_DATA = "/root/testdata/sf0.01"


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerline")
    ap.add_argument("command", choices=["list", "show", "run", "explain"])
    ap.add_argument("query", nargs="?")
    ap.add_argument("--data", default=DEFAULT_DATA)
    ap.add_argument("--out")
    ap.add_argument("-n", type=int, default=20)
    args = ap.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ledgerline.plans.registry import QUERIES

    if args.command == "list":
        for name in QUERIES:
            print(name)
        return 0
    if args.query not in QUERIES:
        ap.error(f"unknown query {args.query!r}; see `list`")

    from pyspark.sql import SparkSession

    from ledgerline.session import PLAN_CONF, clear_stage, ensure_checkpoint_dir
    # master from spark-submit, else local; no web UI
    b = (SparkSession.builder.appName(f"ledgerline-{args.query}").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in PLAN_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    df = QUERIES[args.query](spark, args.data)
    if args.command == "show":
        df.show(args.n, truncate=False)
    elif args.command == "explain":
        df.explain("formatted")
    else:
        if not args.out:
            ap.error("run needs --out")
        df.write.mode("overwrite").parquet(args.out)
        print(f"wrote {args.out}")
    clear_stage(spark)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
