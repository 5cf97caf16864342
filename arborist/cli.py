"""Command line: transforms, queries, validates or checks files, in batch; a refused document is a row, not a failure.

    python -m arborist.cli [--xsl FILE | --xpath E | --xsd FILE | --rng FILE | --rules FILE] PATH -o OUT
"""

from __future__ import annotations

import argparse
import json
import sys
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.plans.lower import Engine
from arborist.schema import rng
from arborist.schema.xsd import Schema, validate
from arborist.sources.catalog import file_resolver
from arborist.sources.shred import Limits, read
from arborist.xslt.interpreter import Stylesheet, transform
from arborist.xslt.rules import Assertion, Rule, Rules, schematron, svrl
from arborist.xslt.serialize import write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arborist")
    p.add_argument("path", help="files, each a document")
    p.add_argument("-o", "--out", help="folder for the result as JSON lines; standard output without it")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--xsl", help="a stylesheet")
    what.add_argument("--xpath")
    what.add_argument("--xsd")
    what.add_argument("--rng")
    what.add_argument("--rules", help='JSON: {"select": E, "rules": [{"match": P, "value": E, ...}]} or {"assertions": [{"id", "context", "test"}]}')
    p.add_argument("--allow-dir", action="append", default=[], help="folder from which schemas may include files")
    p.add_argument("--allow-doctype", action="store_true")
    p.add_argument("--track-positions", action="store_true")
    p.add_argument("--timeout", type=float, help="seconds after which the job is cancelled")
    p.add_argument("--mode", default="")
    p.add_argument("--result-dir", help="folder for SVRL reports, a file a document")
    p.add_argument("--fail-fast", action="store_true", help="stop at the first document that is refused")
    p.add_argument("-p", dest="params", action="append", default=[], metavar="NAME=VALUE", help="variables of the expression")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    limits = Limits(allow_doctype=args.allow_doctype, positions=args.track_positions)
    nodes, errors = read(spark, args.path, limits)
    if args.fail_fast and not errors.isEmpty():
        raise SystemExit(errors.first().message)
    resolve = file_resolver(args.allow_dir) if args.allow_dir else None
    if args.xsl:
        with open(args.xsl) as f:
            sheet = Stylesheet(f.read(), resolve)
        files = spark.read.format("binaryFile").load(args.path).select(F.xxhash64("path").alias("doc_id"), F.col("content").alias("xml"))
        found = transform(files, sheet, params=dict(x.split("=", 1) for x in args.params), limits=limits, mode=args.mode)
        if args.result_dir:
            write_results(found.where("href IS NOT NULL"), args.result_dir)
        return found
    if args.xpath:
        return Engine(nodes).xpath(args.xpath, **dict(x.split("=", 1) for x in args.params))
    if args.xsd:
        with open(args.xsd) as f:
            return validate(nodes, Schema(f.read(), resolve=resolve))
    if args.rng:
        with open(args.rng) as f:
            grammar = rng.Grammar(f.read(), resolve)
        files = spark.read.format("binaryFile").load(args.path).select(F.xxhash64("path").alias("doc_id"), F.col("content").cast("string").alias("xml"))
        return rng.validate(files, grammar)
    with open(args.rules) as f:
        spec = json.load(f)
    engine = Engine(nodes)
    if "assertions" in spec:
        found = schematron(engine, [Assertion(**a) for a in spec["assertions"]])
        if args.result_dir:
            svrl(found).select(F.concat(F.col("doc_id").cast("string"), F.lit(".svrl")).alias("href"), "text").write.partitionBy("href").mode("overwrite").text(args.result_dir)
        return found
    return Rules(engine, [Rule(**r) for r in spec["rules"]]).values(spec["select"], args.mode)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("arborist").getOrCreate()
    if args.timeout:
        timer = threading.Timer(args.timeout, spark.sparkContext.cancelAllJobs)
        timer.daemon = True
        timer.start()
    found = run(spark, args)
    if args.out:
        found.write.mode("overwrite").json(args.out)
    else:
        for line in found.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
