"""Files in, report out: ``python -m lectern.plans.run FILE... [options]``; without files, standard input if something is piped in.

Exit status: 0, 1 if a finding of the strongest severity (or, strict, of the second) is left, 2 if the run failed.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import reduce, report
from lectern.plans.lint import Options, lint, words_of
from lectern.sources.catalogue import CatalogueError, load, rules_df, select
from lectern.sources.files import read_texts


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, path, text of the named files, numbered in the order of the arguments."""
    order = spark.createDataFrame([(i, p, "file:" + os.path.abspath(p)) for i, p in enumerate(dict.fromkeys(paths), 1)], "doc_id bigint, path string, uri string")
    files = read_texts(spark, [os.path.abspath(p) for p in dict.fromkeys(paths)]).select(F.regexp_replace("path", "^file:/+", "file:/").alias("uri"), "text")
    return order.join(files, "uri").select("doc_id", "path", "text")


def reports(docs: DataFrame, options: Options = Options(), formal: bool = False, width: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entries in order: doc_id, finding_no, block; summary line; exit status; rule files) of documents (doc_id, path, text)."""
    spark = docs.sparkSession
    rules = rules_df(spark, select(load(), set(options.only), set(options.disable), set(options.disable_category), options.no_emoji))
    found = lint(docs, options)
    entries = report.rendered(reduce.first_or_repeat(found, rules), docs, width, formal).select("doc_id", "finding_no", "block").orderBy("doc_id", "finding_no")
    summary = report.summary_line(reduce.severity_summary(found, words_of(docs)), formal)
    return entries, summary, reduce.exit_status(found, options.strict), report.footer(found, rules)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("paths", nargs="*")
    some = {"action": "append", "default": []}
    p.add_argument("--only", **some, help="rule to run, no others (repeatable)")
    p.add_argument("--disable", **some, help="rule to leave out (repeatable)")
    p.add_argument("--disable-category", **some, help="category to leave out (repeatable)")
    p.add_argument("--no-emoji", action="store_true", help="report emoji too")
    p.add_argument("--skip-quotes", action="store_true", help="leave quotations out")
    p.add_argument("--strict", action="store_true", help="warnings fail the run as well")
    p.add_argument("--formal", action="store_true", help="error, warning, suggestion")
    p.add_argument("--width", type=int, default=int(os.environ.get("COLUMNS") or 100))
    p.add_argument("--list-rules", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, stdin=sys.stdin) -> int:
    a = parser().parse_args(argv)
    split = lambda xs: frozenset(y for x in xs for y in x.split(",") if y)
    options = Options(split(a.only), split(a.disable), split(a.disable_category), a.no_emoji, a.skip_quotes, a.strict)
    try:
        rules = select(load(), set(options.only), set(options.disable), set(options.disable_category), options.no_emoji)
        if a.list_rules:
            print("\n".join(f"{r.id}  {r.severity}  {r.message}" for r in rules), file=out)
            return 0
        piped = "" if a.paths or stdin is None or stdin.isatty() else stdin.read()
        if missing := [p for p in a.paths if not os.path.isfile(p)]:
            print(f"no such file: {', '.join(missing)}", file=sys.stderr)
            return 2
        if not a.paths and not piped.strip():
            print("nothing to read", file=sys.stderr)
            return 2
        spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
        docs = documents(spark, a.paths) if a.paths else spark.createDataFrame([(1, "-", piped)], "doc_id bigint, path string, text string")
        entries, summary, status, footer = reports(docs, options, a.formal, a.width)
        for r in entries.toLocalIterator():
            print(r["block"], end="\n\n", file=out)
        print(summary.first()["line"], file=out)
        code = status.first()["exit_status"]
        if files := footer.first()["files"]:
            print(f"Rules: {files}", file=out)
        return code
    except CatalogueError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # any other failure is one of the tool, not of the text
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
