"""Command line over `tallyframe.api`: python -m tallyframe.cli ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json

from .api import TABLES, Register
from .session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyframe", description="Registers of companies and care providers on Spark")
    p.add_argument("root", help="folder of the tables")
    p.add_argument("--master", default="local[*]")
    commands = p.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="merge a Parquet snapshot into a table behind the gate")
    load.add_argument("table", choices=TABLES)
    load.add_argument("path")
    load.add_argument("--key", required=True)
    load.add_argument("--month", required=True, help="YYYY-MM-DD")
    load.add_argument("--force", action="store_true")
    companies = commands.add_parser("companies", help="a page of companies")
    for name in ("search", "status", "sic-codes", "postcode-prefix", "sort-by"):
        companies.add_argument(f"--{name}")
    companies.add_argument("--active", action=argparse.BooleanOptionalAction, default=None)
    for name in ("locations", "providers"):
        more = commands.add_parser(name, help=f"a page of {name}")
        for option in ("service-types", "regions", "local-authorities", "provider-name-contains"):
            more.add_argument(f"--{option}")
        more.add_argument("--active", action=argparse.BooleanOptionalAction, default=None)
    for name in ("companies", "locations", "providers"):
        commands.choices[name].add_argument("--page", type=int, default=1)
        commands.choices[name].add_argument("--page-size", type=int, default=50)
    commands.add_parser("roll-up", help="providers from locations")
    commands.add_parser("targets", help="scored and tiered companies").add_argument("--all", action="store_true")
    export = commands.add_parser("export", help="write a table")
    export.add_argument("table", choices=TABLES)
    export.add_argument("path")
    export.add_argument("--form", choices=("csv", "bundle", "sqlite"), default="csv")
    report = commands.add_parser("report", help="report of a list of company numbers")
    report.add_argument("numbers", nargs="+")
    report.add_argument("--year", type=int, required=True)
    return p


def run(args: argparse.Namespace, store: Register) -> list[str]:
    """Lines to print: JSON rows, or figures."""
    rows = lambda df: [json.dumps(r.asDict(recursive=True), default=str) for r in df.collect()]  # a page, a report or targets
    options = {k: v for k, v in vars(args).items() if k not in ("root", "master", "command", "active") and v is not None}
    if args.command == "load":
        return [json.dumps(store.load(args.table, store.spark.read.parquet(args.path), args.key, args.month, args.force), default=str)]
    if args.command in ("companies", "locations", "providers"):
        found, total = getattr(store, args.command)(**options, is_active=args.active)
        return [*rows(found), json.dumps({"total": total})]
    if args.command == "roll-up":
        return [json.dumps({"providers": store.roll_up()})]
    if args.command == "targets":
        return rows(store.targets(None) if args.all else store.targets())
    if args.command == "export":
        return [json.dumps({"rows": store.export(args.table, args.path, args.form)})]
    return rows(store.report(args.numbers, args.year))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(args.master, "tallyframe")
    print(*run(args, Register(spark, args.root)), sep="\n")
    spark.stop()


if __name__ == "__main__":
    main()
