"""The command line: index, watch, search, why-not, serve, stats, check, compact, help.

Exit codes: 0 done, 1 failed, 2 wrong usage or a query that doesn't parse.
"""

from __future__ import annotations

import re
import sys
import time

from pyspark.sql import SparkSession

from .engine import Engine, recency_of, to_json
from .plans.syntax import QuerySyntaxError, parse_size

DONE, FAILED, USAGE = 0, 1, 2
DEFAULT_INDEX = ".searchindex"

HELP = """usage: python -m textmill.cli COMMAND [ARGUMENTS] [FLAGS]

  index DIR...          bring the index up to date with folders    --max-size 2MB
  watch DIR...          the same again and again                   --interval 2 --max-size 2MB
  search QUERY...       the best documents                         -n 10 --json --explain --recency R --half-life 30d
  why-not QUERY PATH    why a document isn't found                 --json
  serve                 a read-only HTTP interface                 --host 127.0.0.1 --port 8080
  stats, check, compact
All take --index FOLDER (.searchindex).
"""

#: Flags of each command, and whether they take a value.
FLAGS = {
    "index": {"max-size": True},
    "watch": {"max-size": True, "interval": True},
    "search": {"n": True, "json": False, "explain": False, "recency": True, "half-life": True, "no-color": False},
    "why-not": {"json": False},
    "serve": {"host": True, "port": True},
    "stats": {"json": False},
    "check": {"json": False},
    "compact": {},
    "help": {},
}


class UsageError(ValueError):
    pass


def parse_flags(args: list[str], known: dict[str, bool]) -> tuple[dict[str, str], list[str]]:
    """Flags, anywhere and with one dash or two, and what is left. A value is never another known flag."""
    values, rest, queue = {}, [], list(args)
    while queue:
        arg = queue.pop(0)
        if not arg.startswith("-") or arg == "-":
            rest.append(arg)
            continue
        name, given, value = arg.lstrip("-").partition("=")
        if name not in known:
            raise UsageError(f"unknown flag {arg}")
        if known[name] and not given:
            if not queue or (queue[0].startswith("-") and queue[0].lstrip("-").partition("=")[0] in known):
                raise UsageError(f"{arg} needs a value")
            value = queue.pop(0)
        values[name] = value if given or known[name] else "true"
    return values, rest


def parse_days(text: str) -> float:
    """Days of 30d, 12h, 2w or 365; 30 for anything else."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?)\s*([dhw]?)\s*", text.lower())
    return float(m[1]) * {"": 1, "d": 1, "h": 1 / 24, "w": 7}[m[2]] if m else 30.0


def number(values: dict[str, str], name: str, default: int, low: int, high: int) -> int:
    try:
        n = int(values.get(name, default))
    except ValueError:
        n = low - 1
    if not low <= n <= high:
        raise UsageError(f"{name} must be from {low} to {high}")
    return n


def run(command: str, values: dict[str, str], rest: list[str], engine: Engine, out=print) -> int:
    if command == "index":
        for change, n in sorted(engine.index(rest).items()):
            out(f"{change}: {n}")
    elif command == "watch":
        query = engine.watch(rest, float(values.get("interval", "2")), on_commit=lambda counts: out(to_json(counts)))
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()
    elif command == "search":
        recency = recency_of(float(values.get("recency", "0")), parse_days(values.get("half-life", "30d")))
        found = engine.results(" ".join(rest), number(values, "n", 10, 1, 1000), recency, values.get("explain") == "true")
        if values.get("json") == "true":
            out(to_json(found))
            return DONE
        for k, hit in enumerate(found["hits"], 1):
            out(f"{k}. {hit['path']}  {hit['score']:.4f}  {hit['title']}")
            out("   " + " ".join(hit["snippet"]["text"].split()))
            for t in (hit.get("explain") or {}).get("terms", []):
                out(f"   {t['term']}: weight {t['weight']:.3g}, df {t['df']}, idf {t['idf']:.4f}, adds {t['contribution']:.4f}")
        out(f"{found['total']} documents" + ", expansions cut off" * found["truncated"])
    elif command == "why-not":
        if len(rest) < 2:
            raise UsageError("why-not needs a query and a path")
        report = engine.why_not(" ".join(rest[:-1]), rest[-1])
        out(report.to_json() if values.get("json") == "true" else report.render())
    elif command == "serve":
        from .server import serve

        serve(engine, values.get("host", "127.0.0.1"), number(values, "port", 8080, 0, 65535))
    elif command == "stats":
        out(to_json(engine.stats()))
    elif command == "check":
        wrong = engine.check()
        out(to_json(wrong) if values.get("json") == "true" else "\n".join(wrong) or "sound")
        return FAILED if wrong else DONE
    elif command == "compact":
        out(f"generation {engine.compact()}")
    return DONE


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    command = args.pop(0) if args else "help"
    if command in ("help", "-h", "--help"):
        out(HELP)
        return DONE
    try:
        if command not in FLAGS:
            raise UsageError(f"unknown command {command}")
        values, rest = parse_flags(args, FLAGS[command] | {"index": True})
        if command in ("index", "watch", "search") and not rest:
            raise UsageError(f"{command} needs an argument")
        max_size = parse_size(values.get("max-size", "2MB"))
        spark = spark or SparkSession.builder.appName("textmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return run(command, values, rest, Engine(spark, values.get("index", DEFAULT_INDEX), max_size=max_size), out)
    except (UsageError, QuerySyntaxError, ValueError) as e:
        print(e, file=sys.stderr)
        return USAGE
    except Exception as e:
        print(f"{time.strftime('%H:%M:%S')} {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
