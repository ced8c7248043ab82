"""python -m quillstream queries | run NAME DIR [--rows N] | sql NAME | health DIR | ingest BASE --feeds FILE --rules FILE
| record BASE --analyses FILE | build BASE --date DATE [--title CATEGORY=TITLE] [--heading TEXT] [--hours N] | show BASE [--date DATE]"""

from __future__ import annotations

import argparse
import json
import sys

from quillstream.plans import catalogue, runs
from quillstream.plans.daily import CATEGORIES
from quillstream.plans.adapters import articles, registry
from quillstream.session import session
from quillstream.sources import feeds


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0, or 1 for an unknown query, feeds without entries and a digest that isn't there."""
    parser = argparse.ArgumentParser(prog="quillstream")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("queries", help="names of the queries")
    run = verbs.add_parser("run", help="the first rows of a query over the tables of a folder")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--rows", type=int, default=20)
    verbs.add_parser("sql", help="a query's SQL").add_argument("name")
    verbs.add_parser("health", help="state of the feeds").add_argument("folder")
    take = verbs.add_parser("ingest", help="fetch, classify and cluster what feeds have, and store it below a folder")
    take.add_argument("base")
    take.add_argument("--feeds", required=True, help="JSON list of feeds: slug, path, row_tag, lang, enabled, name, lean, reliability, weight, categories")
    take.add_argument("--rules", required=True, help="JSON object: vocab, segments, noise, lexicon, letters")
    note = verbs.add_parser("record", help="store analyses of stories")
    note.add_argument("base")
    note.add_argument("--analyses", required=True, help="JSON lines: cluster_key and what is said of it")
    make = verbs.add_parser("build", help="select and render the digest of a day")
    make.add_argument("base")
    make.add_argument("--date", required=True, help="yyyy-mm-dd")
    make.add_argument("--title", action="append", default=[], help="CATEGORY=TITLE, once for each category that is to be shown")
    make.add_argument("--heading", default="Digest")
    make.add_argument("--hours", type=int)
    look = verbs.add_parser("show", help="the messages of a digest, the latest by default")
    look.add_argument("base")
    look.add_argument("--date")
    args = parser.parse_args(argv)
    if args.verb == "ingest":
        with open(args.feeds, encoding="utf-8") as f, open(args.rules, encoding="utf-8") as r:
            done = runs.ingest(session(), args.base, json.load(f), runs.rules_of(r.read()))
        print(json.dumps({row.stat: row.value for row in done["stats"].collect()} | {f"new {k}": v for k, v in done["inserted"].items()}, indent=2))
        for row in done["probes"].filter("error is not null").collect():
            print(f"FAIL {row.slug}: {row.error}")
        for row in done["preview"].orderBy("category", "rank").collect():
            print(f"{row.category} {row.rank}. [{row.source_count} sources] {row.headline}")
        return 0
    if args.verb == "record":
        spark = session()
        print(f"new analyses: {runs.record(spark, args.base, spark.read.schema(runs.ANALYSIS).json(args.analyses))}")
        return 0
    if args.verb in ("build", "show"):
        if args.verb == "build":
            titles = dict(t.split("=", 1) for t in args.title) or {c: c.replace("_", " ").capitalize() for c in CATEGORIES}
            said = runs.build(session(), args.base, args.date, titles, args.heading, hours=args.hours)
        else:
            said = runs.show(session(), args.base, args.date)
        rows = said.orderBy("category", "seq").collect()  # nine stories at most
        print("\n\n".join(r.message for r in rows) or "no digest")
        return int(not rows)
    if args.verb == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if args.verb == "health":
        spark = session()
        state = feeds.feed_health(registry(spark, args.folder), articles(spark, args.folder))
        state.orderBy("slug").show(1000, truncate=False)
        return int(not state.filter("status = 'DEAD'").isEmpty())
    known = catalogue.ORACLES if args.verb == "sql" else catalogue.QUERIES
    if args.name not in known:
        print(f"no such query: {args.name}", file=sys.stderr)
        return 1
    if args.verb == "sql":
        print(known[args.name])
    else:
        known[args.name](session(), args.folder).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
