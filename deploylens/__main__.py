"""python -m deploylens [-input X] [-output OUT] [-threads N] [-verbose] PATH..."""

from __future__ import annotations

import argparse
import sys

from .operators.detect import UnsupportedInput
from .plans import analysis
from .session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="deploylens")
    p.add_argument("-input", action="append", default=[])
    p.add_argument("-output", default="report.xlsx")
    p.add_argument("-threads", default="*")
    p.add_argument("-verbose", action="store_true")
    p.add_argument("paths", nargs="*")
    args = p.parse_args(argv)
    inputs = args.input + args.paths
    if not inputs:
        p.print_usage(sys.stderr)
        return 1
    spark = session(f"local[{args.threads}]")
    try:
        made = analysis.run(spark, inputs, args.output)
    except (FileNotFoundError, ValueError, UnsupportedInput) as e:
        print(e, file=sys.stderr)
        return 1
    for row in made.summary().collect():
        print(f"{row['relation']}: {row['n']}")
    if args.verbose:
        made.routes.groupBy("input_id").count().orderBy("input_id").show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
