"""python -m maskloom anonymise FOLDER | restore FOLDER."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.runs import anonymise_folder, restore_folder


def main(args: list[str] | None = None) -> int:
    """0 if all went well, 1 if files failed or there was nothing to do, 2 without a mapping to restore from."""
    parser = argparse.ArgumentParser(prog="maskloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("anonymise", "restore"):
        p = commands.add_parser(name)
        p.add_argument("target")
        p.add_argument("--out")
        p.add_argument("--mapping", required=name == "restore")
        if name == "anonymise":
            p.add_argument("--dictionaries")
            p.add_argument("--reset-mapping", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("maskloom").getOrCreate()
    if a.command == "anonymise":
        report = anonymise_folder(spark, a.target, a.out, a.mapping, a.dictionaries, a.reset_mapping)
        print(*(f"{k}: {v}" for k, v in report.items()), sep="\n")
        return int(report["error_count"] > 0)
    try:
        report = restore_folder(spark, a.target, a.mapping, a.out)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    print(*(f"{k}: {v}" for k, v in report.items()), sep="\n")
    return int(report["files"] == 0)


if __name__ == "__main__":
    sys.exit(main())
