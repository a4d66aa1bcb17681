"""Command line: python -m latticeon PATH ["STATEMENT"]; without a statement, a script from standard input."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .api import DB

HELP = ".tables  .edges  .schema NAME  .stats  .compact  .open PATH  .help  .quit, or a statement"
_READS = ("SELECT", "MATCH", "SHOW", "EXPLAIN")


def run(db: DB, line: str) -> DB:
    line = line.strip().rstrip(";")
    word = line.split(" ")[0].upper()
    if not line or line.startswith("--"):
        return db
    if line == ".tables":
        db.query("SHOW TABLES").show(1000, False)
    elif line == ".edges":
        db.query("SHOW EDGES").show(1000, False)
    elif line.startswith(".schema "):
        db.query(f"SHOW {line[8:]}").show(1000, False)
    elif line == ".stats":
        print(f"nodes: {db.node_count()}, edges: {db.edge_count()}")
    elif line == ".compact":
        print(f"version {db.compact()}")
    elif line.startswith(".open "):
        return DB(db.spark, line[6:].strip())
    elif line.startswith("."):
        print(HELP)
    elif word == "EXPLAIN":
        rest = line[8:].strip()
        analyze = rest.upper().startswith("ANALYZE ")
        print(db.explain(rest[8:] if analyze else rest, analyze=analyze))
    elif word in _READS and not (word == "MATCH" and " INSERT " in line.upper()):
        db.query(line).show(1000, False)
    else:
        print(db.execute(line))
    return db


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("latticeon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    db = DB(spark, args[0])
    for line in args[1:] or (x for x in sys.stdin):
        if line.strip() == ".quit":
            break
        try:
            db = run(db, line)
        except ValueError as e:
            print(f"error: {e}", file=sys.stderr)
            if len(args) > 1:
                return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
