"""python -m quernel index PATH | search QUERY [-p PATH] [-l LIMIT] [--bm25-only] [--json]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.engine import Engine, json_rows, text_lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quernel")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("path")
    two = commands.add_parser("search")
    two.add_argument("query")
    two.add_argument("-p", "--path", default=".")
    two.add_argument("-l", "--limit", type=int, default=10)
    two.add_argument("--bm25-only", action="store_true")
    two.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("quernel").getOrCreate(), args.path)
    try:
        if args.command == "index":
            summary = engine.index()
            print("no files to index" if not summary.get("kept") else json.dumps(summary))
        else:
            rows = engine.search(args.query, args.limit, args.bm25_only)
            if args.json:
                print(json.dumps([json.loads(r.json) for r in json_rows(rows).collect()], indent=2))
            else:
                print("\n".join(r.line for r in text_lines(rows).collect()))
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
