"""Command line: segment, parse, corpus, blocks, validate, profiles. Exit codes: 0 all well, 1 some file failed, 2 misuse."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lavra", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name, text in (("segment", "segment rows as JSON lines"), ("parse", "write XML documents"), ("corpus", "report on a batch"), ("blocks", "the blocks as read"), ("validate", "XML files against schemas")):
        p = sub.add_parser(name, help=text)
        p.add_argument("paths", nargs="+")
        p.add_argument("--limit", type=int)
        p.add_argument("--emitter", choices=("auto", "generico", "generico-aninhado"), default="auto")
        p.add_argument("--schema", action="append", default=[], help="a schema file; a statute that fails one is published in the general form")
        p.add_argument("--out", help="folder for results; else they are printed")
    sub.add_parser("profiles", help="the registered genres")
    return out


def _show(rows, out: str | None) -> None:
    if out:
        rows.write.mode("overwrite").json(out)
    else:
        for line in rows.toJSON().toLocalIterator():
            print(line)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .operators import corpus, profiles, xml

    if args.command == "profiles":
        for p in profiles.profiles():
            print(json.dumps({"name": p.name, "urn_type": p.urn_type, "default_authority": p.default_authority}))
        return 0
    from pyspark.sql import SparkSession

    from .sources import readers

    spark = SparkSession.builder.getOrCreate()
    if args.command == "blocks":
        found = readers.read_corpus(spark, *args.paths, limit=args.limit)
        _show(found.orderBy("doc_id", "idx"), args.out)
        return int(not found.where("error is not null").isEmpty())
    for schema in args.schema:
        spark.sparkContext.addFile(schema)
    if args.command == "validate":
        if not args.schema:
            print("validate needs --schema", file=sys.stderr)
            return 2
        found = readers.read_xml(spark, *args.paths, limit=args.limit)
        checked = xml.validate(found, {s.rpartition("/")[2]: s for s in args.schema}).join(found.select("doc_id", "path"), "doc_id")
        _show(checked.select("path", "results", "ok").orderBy("path"), args.out)
        return int(not checked.where("not ok").isEmpty())
    outcomes, documents = corpus.run(spark, *args.paths, emitter=args.emitter, limit=args.limit, schemas=tuple(args.schema))
    if args.command == "segment":
        _show(xml.segments_of(documents), args.out)
    elif args.command == "parse":
        if not args.out:
            print("parse needs --out", file=sys.stderr)
            return 2
        _show(readers.write_xml(documents, args.out), None)
    else:
        for name, rows in corpus.report(outcomes).items():
            print(f"# {name}")
            _show(rows, None)
    failed = outcomes.where("not ok").select("source", "error").collect()
    for r in failed:
        print(f"{r['source']}: {r['error']}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
