"""Count morae in a file, or in the first line of standard input."""

import argparse
import os
import time

from pyspark.sql import SparkSession

from hakuspark.sources import count_file, count_line


def run(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hakuspark", description="Count morae in a file")
    parser.add_argument("filename", nargs="?", default="", help="input file; if omitted, the first line of standard input is used")
    parser.add_argument("-v", "--validate", action="store_true", help="fail on characters that are not kana")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if not given.filename:
        print(f"$ total mora count: {count_line(spark, input(), validate=given.validate)}")
        return
    start = time.time()
    total = count_file(spark, given.filename, validate=given.validate).agg({"morae": "sum"}).first()[0] or 0
    print(f"$ source file: {os.path.abspath(given.filename)}\n$ processing time: {(time.time() - start) * 1000} ms\n$ total mora count: {total}")


if __name__ == "__main__":
    run()
