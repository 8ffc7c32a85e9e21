"""Command line: scan a folder (the two later generations of the detector), crawl the preprint service (the first), or enrich identifiers."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from palimpsest.sources import api
from palimpsest.sources.folder import distinct_keys, not_done, processed
from palimpsest.streaming.sinks import append, crawl, run


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    sub = top.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("--input_dir", required=True)
    scan.add_argument("--out", default="findings.csv")
    scan.add_argument("--preset", choices=("v3", "v2"), default="v3")
    for flag in ("no_recursive", "no_resume", "no_sort"):
        scan.add_argument(f"--{flag}", action="store_true")
    for number in ("max_files", "shard_count", "shard_index"):
        scan.add_argument(f"--{number}", type=int, default=0)
    crawl_ = sub.add_parser("crawl")
    crawl_.add_argument("--start", required=True)
    crawl_.add_argument("--end", required=True)
    crawl_.add_argument("--outdir", default="./medrxiv_pdfs")
    crawl_.add_argument("--out", default="findings.csv")
    crawl_.add_argument("--sleep", type=float, default=0.25)
    crawl_.add_argument("--max_papers", type=int, default=0)
    crawl_.add_argument("--no_resume", action="store_true")
    meta = sub.add_parser("enrich")
    meta.add_argument("--per_version", required=True)
    meta.add_argument("--out", default="meta.csv")
    meta.add_argument("--server", default="medrxiv")
    meta.add_argument("--sleep", type=float, default=0.2)
    meta.add_argument("--timeout", type=int, default=60)
    meta.add_argument("--max_dois", type=int, default=0)
    for command in (crawl_, meta):
        command.add_argument("--max_retries", type=int, default=8)
        command.add_argument("--user_agent", default="")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    if args.command == "scan":
        print(run(spark, args.input_dir, out=args.out, recursive=not args.no_recursive, resume=not args.no_resume, sort=not args.no_sort, max_files=args.max_files, shard_count=args.shard_count, shard_index=args.shard_index, preset=args.preset))
        return
    if args.command == "crawl":
        print(crawl(spark, args.start, args.end, outdir=args.outdir, out=args.out, pause=args.sleep, max_papers=args.max_papers, resume=not args.no_resume, retry=replace(api.SCAN, attempts=args.max_retries), fetcher=api.client(user_agent=args.user_agent)))
        return
    dois = distinct_keys(spark.read.csv(args.per_version, header=True).select("doi"), limit=args.max_dois)
    done = processed(spark, args.out, {"doi": "doi"})
    left = dois if done is None else not_done(dois, done, ["doi"])
    found = api.enrich(left, args.server, api.client(args.timeout, args.user_agent), replace(api.ENRICH, attempts=args.max_retries), args.sleep)
    append(found, args.out, api.META)


if __name__ == "__main__":
    main()
