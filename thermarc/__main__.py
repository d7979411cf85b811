"""python -m thermarc reproduce EXP-ID --root FOLDER --rows PARQUET: 0 if the metrics come out again, else 1."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from thermarc.plans.experiment import Store, reproduce
from thermarc.schema import DEFAULT


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="thermarc")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reproduce")
    r.add_argument("experiment")
    r.add_argument("--root", required=True)
    r.add_argument("--rows", required=True, help="Parquet of the canonical rows")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    status, found = reproduce(Store(a.root), a.experiment, spark.read.parquet(a.rows), DEFAULT)
    print(status, *found, sep="\n")
    return int(status == "MISMATCH")


if __name__ == "__main__":
    sys.exit(main())
