"""python -m pipworks.cli COMMAND: check, search, ingest, reconcile, compact, hide-names."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from pipworks.session import local_session, ship


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pipworks")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about, args in (
        ("check", "read and check the match files below a folder", ["folder"]),
        ("search", "rows of a catalog that a search finds", ["catalog", "search"]),
        ("ingest", "store the new matches of an inbox", ["inbox", "store", "checkpoint"]),
        ("reconcile", "transcripts below a folder that are of one match", ["folder"]),
        ("compact", "consolidate a table of small files (path, file_no, content, modified_at)", ["files", "store"]),
        ("hide-names", "replace names in a catalog by pseudonyms", ["catalog", "key", "domain", "out"]),
    ):
        one = commands.add_parser(name, help=about)
        for a in args:
            one.add_argument(a)
        one.add_argument("--rows", type=int, default=50, help="rows to show")
    return parser


def main(argv: list[str] | None = None) -> int:
    """Exit code 0; 1 where `check` finds errors; 2 for a wrong call."""
    args = _parser().parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    if args.command in ("check", "reconcile"):
        from pipworks.operators.reconcile import reconcile
        from pipworks.operators.transcripts import folder, summaries

        files = folder(spark, args.folder)
        if args.command == "reconcile":
            reconcile(spark, files).orderBy("root", "path").show(args.rows, False)
            return 0
        found = summaries(files).cache()
        found.select("path", "format", "games", "s0", "s1", "status", F.substring("content_hash", 1, 16).alias("identity")).show(args.rows, False)
        return int(not found.filter("status = 'error'").isEmpty() or not files.filter("problem is not null").isEmpty())
    if args.command == "search":
        from pipworks.functions.query import parse
        from pipworks.operators.catalog import page

        for error in parse(args.search).errors:
            print(error, file=sys.stderr)
        page(spark.read.parquet(args.catalog), args.search, 1, args.rows).select("id", "p0", "p1", "event", "round", "date", "len").show(args.rows, False)
    elif args.command == "ingest":
        from pipworks.streaming.inbox import ingest

        ingest(spark, args.inbox, args.store, args.checkpoint).awaitTermination()
    elif args.command == "compact":
        from pipworks.operators.compaction import CompactionStore, stored_files

        store = CompactionStore(spark, args.store)
        print(*store.compact(stored_files(spark.read.parquet(args.files))), sep="\n")
        store.containers().show(args.rows, False)
    else:
        from pipworks.functions.pseudonyms import hide_names

        rows = spark.read.parquet(args.catalog)
        hide_names(rows, bytes.fromhex(args.key), ["p0", "p1"], [c for c in ("event", "round", "n0", "n1", "hay") if c in rows.columns], args.domain).write.parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
