"""Command line: compile, inspect or validate a folder of files as one Spark job.

Exit codes: 0 all well, 1 wrong use, 2 a document did not compile or validate, 3 nothing could be verified.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gistmill.plans.compile import MODES, Policy, compile_documents, document_atoms, document_blocks, validate_results
from gistmill.sources.files import read_files, write_results


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gistmill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compile")
    c.add_argument("path")
    c.add_argument("--output", required=True)
    c.add_argument("--mode", default="compact", choices=MODES)
    c.add_argument("--budget", type=int)
    c.add_argument("--soft", action="store_true")
    c.add_argument("--tokenizer", default="openai:cl100k_base")
    c.add_argument("--require", action="append", default=[])
    c.add_argument("--abbreviations", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("path")
    i.add_argument("--show", default="blocks,atoms")
    v = sub.add_parser("validate")
    v.add_argument("results")
    v.add_argument("--source", required=True)
    v.add_argument("--allow-unverified", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    path = args.source if args.command == "validate" else args.path
    if "://" not in path and not os.path.exists(path):
        print(f"Error: {path} does not exist", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("gistmill").getOrCreate()
    files = read_files(spark, path)
    if args.command == "compile":
        policy = Policy(mode=args.mode, tokens=args.budget, hard_budget=not args.soft, tokenizer=args.tokenizer, required_terms=tuple(args.require), abbreviations=args.abbreviations)
        write_results(compile_documents(files, "path", "content", policy), args.output)
        counts = spark.read.parquet(f"{args.output}/results").groupBy("status").count()
        counts.orderBy("status").show(truncate=False)
        return 2 if counts.where("status <> 'OK'").count() else 0
    if args.command == "inspect":
        shown = {s.strip().lower() for s in args.show.split(",")}
        if shown & {"blocks", "all"}:
            document_blocks(files, "path", "content").select("path", "kind", "block_id", F.substring("text", 1, 60).alias("text")).show(1000, truncate=False)
        if shown & {"atoms", "all"}:
            document_atoms(files, "path", "content").select("path", "kind", "surface", "canonical", "required").show(1000, truncate=False)
        return 0
    verdicts = validate_results(spark.read.parquet(f"{args.results}/results").where("status = 'OK'"), files, "path", "content")
    n = {r.verdict: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
    print(n)
    if n.get("FAILED"):
        return 2
    return 3 if n.get("UNVERIFIED") and not n.get("PASSED") and not args.allow_unverified else 0


if __name__ == "__main__":
    sys.exit(main())
