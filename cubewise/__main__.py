"""Command line entry points, for ``spark-submit`` or ``python -m cubewise``.

    python -m cubewise facts --tables DIR --facts ROOT
    python -m cubewise build --tables DIR --cubes ROOT [--facts ROOT] [--since YYYY-MM-DD]
    python -m cubewise change --tables DIR --facts ROOT --cubes ROOT [--orders PATH] [--lines PATH]
                              [--deleted-orders PATH] [--deleted-lines PATH] [--parts PATH] [--event-day YYYY-MM-DD ...]
    python -m cubewise late --tables DIR --cubes ROOT [--known DIR --day YYYY-MM-DD ...]
    python -m cubewise prune --root ROOT [--keep N]
    python -m cubewise route --cubes ROOT --family NAME --shape SHAPE
                             [--year Y] [--party P] [--as-of YYYY-MM-DD] [--allow PARTY ...] --out PATH

``facts`` stores lines by the month of their order. ``build`` runs the feed job
(full, or incremental from ``--since``; from the facts if they are given).
``change`` applies changed rows (Parquet tables) to the facts and rebuilds the
cubes of the days they touch. ``late`` adds rows that came late, in a folder
of their own, to the published cubes; ``--known`` has the orders of the days
that late lines may belong to. ``prune`` removes old versions of cubes or
facts. ``route`` answers one route from the stored cubes and writes its JSON
documents as text files under ``--out`` (one document per line, written by
the executors).
"""

from __future__ import annotations

import argparse
import datetime as dt

from .functions.calendar import day_windows
from .plans.bindings import LateRows, StoredCubes, TableCubes, build_all
from .plans.build import add_rows
from .plans.documents import route_json
from .plans.facts import Changes, FactCubes, Facts
from .session import build_session
from .sources.versions import Versions

CHANGES = ("orders", "lines", "deleted_orders", "deleted_lines", "parts")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cubewise")
    sub = parser.add_subparsers(dest="command", required=True)
    day = dt.date.fromisoformat
    f = sub.add_parser("facts", help="store order and line facts")
    b = sub.add_parser("build", help="write all cube collections")
    c = sub.add_parser("change", help="apply changed rows to facts and cubes")
    t = sub.add_parser("late", help="add late rows to the cubes")
    p = sub.add_parser("prune", help="remove old versions")
    r = sub.add_parser("route", help="answer one route from stored cubes as JSON documents")
    for one in (f, b, c, t):
        one.add_argument("--tables", required=True)
    for one in (b, c, t, r):
        one.add_argument("--cubes", required=True)
    f.add_argument("--facts", required=True)
    b.add_argument("--facts")
    b.add_argument("--since", type=day)
    c.add_argument("--facts", required=True)
    for name in CHANGES:
        c.add_argument("--" + name.replace("_", "-"), metavar="PATH")
    c.add_argument("--event-day", type=day, action="append", default=[])
    t.add_argument("--known")
    t.add_argument("--day", type=day, action="append", default=[])
    p.add_argument("--root", required=True)
    p.add_argument("--keep", type=int, default=2)
    r.add_argument("--family", required=True)
    r.add_argument("--shape", required=True)
    r.add_argument("--year", type=int)
    r.add_argument("--party")
    r.add_argument("--as-of", type=day)
    r.add_argument("--allow", action="append", metavar="PARTY",
                   help="a party that one-party routes may ask for (repeat; default: any)")
    r.add_argument("--out", required=True)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session()
    written: list[str] = []
    if args.command == "facts":
        Facts(spark, args.facts).build(TableCubes(spark, args.tables))
    elif args.command == "build":
        src = FactCubes(spark, args.tables, args.facts) if args.facts else TableCubes(spark, args.tables)
        written = build_all(src, args.cubes, since=args.since)
    elif args.command == "change":
        paths = {name: getattr(args, name) for name in CHANGES}
        changes = Changes(**{name: spark.read.parquet(path) for name, path in paths.items() if path})
        days = Facts(spark, args.facts).apply(changes, TableCubes(spark, args.tables))
        if days or args.event_day:
            written = build_all(FactCubes(spark, args.tables, args.facts), args.cubes, days=days, event_days=args.event_day)
    elif args.command == "late":
        known = TableCubes(spark, args.known) if args.known else None
        written = add_rows(LateRows(spark, args.tables, known, day_windows(args.day)), args.cubes)
    elif args.command == "prune":
        written = [f"version {n} removed" for n in Versions(spark, args.root).prune(args.keep)]
    else:
        docs = route_json(StoredCubes(spark, args.cubes), args.family, args.shape, year=args.year,
                          party=args.party, as_of=args.as_of, ordered=True,
                          allowed_parties=tuple(args.allow) if args.allow else None)
        docs.select("json").write.mode("overwrite").text(args.out)
    for line in written:
        print(line)


if __name__ == "__main__":
    main()
