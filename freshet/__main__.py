"""python -m freshet list | run NAME FOLDER [OUT]: the library's queries over a folder of Parquet tables."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from freshet.plans.registry import QUERIES


def main(args: list[str]) -> int:
    if args == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(args) not in (3, 4) or args[0] != "run" or args[1] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    found = QUERIES[args[1]](spark, args[2])
    if len(args) == 4:
        found.write.parquet(args[3])
    else:
        found.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
