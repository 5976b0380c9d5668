"""Command line over one store."""

from __future__ import annotations

import argparse
import json
import sys

from queryvitals.functions.text import FIRST_ISOLATE, LAST_ISOLATE
from queryvitals.operators import ingest as I
from queryvitals.operators import metrics as M
from queryvitals.operators import reports as R
from queryvitals.operators import review as V
from queryvitals.schemas import Settings


def say(text: str) -> None:
    print(text.replace(FIRST_ISOLATE, "").replace(LAST_ISOLATE, ""))


def show(df, limit: int = 50) -> None:
    for row in df.limit(limit).toJSON().collect():
        say(row)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="queryvitals", description=__doc__)
    p.add_argument("--store", help="folder of the store")
    sub = p.add_subparsers(dest="command")
    etl = sub.add_parser("etl", help="load a dump, or a live database")
    etl.add_argument("dump", nargs="?")
    etl.add_argument("--source", choices=("dump", "database"), default="dump")
    etl.add_argument("--url", help="JDBC address of the database")
    etl.add_argument("--driver", help="class of its JDBC driver")
    mock = sub.add_parser("sample-data", help="write a mock dump, and load it")
    mock.add_argument("out")
    mock.add_argument("--days", type=int, default=28)
    mock.add_argument("--sessions-per-day", type=int, default=6)
    mock.add_argument("--seed", type=int, default=7)
    for name in ("report", "discover", "export", "tools", "status"):
        sub.add_parser(name)
    listing = sub.add_parser("suggestions")
    listing.add_argument("--status")
    listing.add_argument("--kind")
    listing.add_argument("--limit", type=int, default=50)
    for name in V.DECISIONS:
        one = sub.add_parser(name)
        one.add_argument("id", type=int)
        one.add_argument("--reviewer")
        one.add_argument("--note")
    sub.add_parser("ask").add_argument("question")
    digest = sub.add_parser("digest")
    digest.add_argument("--days", type=int, default=7)
    digest.add_argument("--end")
    bi = sub.add_parser("export-bi")
    bi.add_argument("folder")
    bi.add_argument("--base-url", default="")
    sub.add_parser("export-site").add_argument("folder")
    web = sub.add_parser("serve")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    return p


def main(arguments: list[str] | None = None, spark=None) -> int:
    """0 done, 1 no command, 2 a missing file, 130 an interrupt."""
    args = parser().parse_args(arguments)
    if not args.command:
        parser().print_help()
        return 1
    try:
        run(args, spark)
    except FileNotFoundError as e:
        print(f"not found: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    return 0


def run(args: argparse.Namespace, spark=None) -> None:
    from dataclasses import replace

    from queryvitals.service import Service

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("queryvitals").getOrCreate()
    settings = Settings.from_environment()
    service = Service(spark, replace(settings, store=args.store) if args.store else settings)
    c = args.command
    if c == "etl":
        if args.source == "database":
            say(json.dumps(service.load_database(args.url, {"driver": args.driver} if args.driver else None)))
        elif args.dump:
            say(json.dumps(service.load_dump(args.dump)))
        else:
            raise FileNotFoundError("a dump is needed")
    elif c == "sample-data":
        from queryvitals.sources.sample import generate

        with open(args.out, "w", encoding="utf-8") as f:
            f.write(generate(args.days, args.sessions_per_day, args.seed))
        say(json.dumps(service.load_dump(args.out)))
    elif c == "report":
        show(service.overview())
        show(M.problem_queries(service.quality()).select("display_query", "searches", "severity", "impact", "reason_codes"))
        show(service.terms().select("term", "verdict", "headline"))
    elif c == "discover":
        say(json.dumps(service.discover()))
    elif c == "suggestions":
        show(V.listed(service.queue(), args.status, args.kind, args.limit), args.limit)
    elif c in V.DECISIONS:
        service.decide(args.id, c, args.reviewer, args.note)
    elif c == "export":
        say(json.dumps(service.export(), ensure_ascii=False))
    elif c == "ask":
        say("\n".join(service.planner().ask(args.question)))
    elif c == "tools":
        say("\n".join(f"{t['name']}: {t['description']}" for t in service.planner().described()))
    elif c == "digest":
        say(service.digest(args.days, args.end)["body_md"])
    elif c == "export-bi":
        say(json.dumps(R.export_tables(service.tables(), args.folder, args.base_url)))
    elif c == "export-site":
        site(service, args.folder)
    elif c == "serve":
        from queryvitals.api import serve

        serve(service, args.host, args.port)
    elif c == "status":
        say(json.dumps(service.status()))


def site(service, folder: str) -> None:
    """A static snapshot: measures and lists as JSON files, whole, and every query's detail."""
    quality = M.reason_texts(service.quality())
    queue = service.queue()
    R.export_json(
        {
            "overview": M.overview(quality),
            "queries-all": M.ranked(quality),
            "queries-problems": M.ranked(quality.where("is_problem")),
            "query-details": M.ranked(quality.join(I.latest_results(service.events()), "norm_query", "left")),
            "terms": service.terms(),
            **{f"suggestions-{s}": V.listed(queue, s, limit=None) for s in ("pending", "approved", "rejected")},
        },
        folder,
        {"rules-export": service.export(), "status": service.status(), **{f"digest-{d}": service.digest(d) for d in (7, 14, 30)}},
    )


if __name__ == "__main__":
    sys.exit(main())
