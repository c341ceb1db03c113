"""python -m eventloom PARAMS.json: runs the pipeline of a parameter file."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from eventloom.config import elapsed, load
from eventloom.pipeline import from_params


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="eventloom", description=__doc__)
    parser.add_argument("params", help="parameters: JSON, comments allowed")
    args = parser.parse_args(argv)
    began = time.time()
    spark = SparkSession.builder.appName("eventloom").getOrCreate()
    data = from_params(spark, load(args.params)).run()
    print(f"{data.units.count()} units in {elapsed(time.time() - began)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
