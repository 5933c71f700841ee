"""Command line: one package, standard input, or whole folders.

Exit codes: 0 done, 1 some of a batch failed, 2 usage, 3 unsupported format,
4 corrupt archive, 6 internal error.  Only the result goes to standard output.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from inkweave import __version__

CODES = {"ok": 0, "unsupported_format": 3, "corrupt_archive": 4, "internal_error": 6}
FIELDS = ("markdown", "charts_found", "charts_rendered", "warnings", "vlm_used", "groups_found")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkweave", description="Convert office packages to Markdown.")
    p.add_argument("sources", help="files or folders; standard input without any", metavar="SOURCE", nargs="*")
    p.add_argument("-o", "--output", help="file, or the folder of a batch")
    p.add_argument("--format", help="format of standard input", choices=("docx", "xlsx"))
    p.add_argument("--gate", help="which diagrams stay", choices=("structural", "off", "none"), default="structural")
    switches = {"--fail-fast": "end a batch at its first failure", "--json": "write whole results", "--strict": "reserved"}
    for name, text in switches.items():
        p.add_argument(name, help=text, action="store_true")
    loud = p.add_mutually_exclusive_group()
    for names in (("-v", "--verbose"), ("-q", "--quiet")):
        loud.add_argument(*names, action="store_true")
    p.add_argument("--version", version=__version__, action="version")
    return p


def _text(row, as_json: bool) -> str:
    if not as_json:
        return row["markdown"]
    return json.dumps({k: row[k] for k in FIELDS}, ensure_ascii=False, indent=2) + "\n"


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def main(argv: list[str] | None = None, spark=None) -> int:
    from inkweave import engine
    from inkweave.sources import sinks
    from inkweave.sources.batch import SUFFIXES, walk
    from inkweave.sources.tables import stored

    p = parser()
    args = p.parse_args(argv)
    paths = [Path(s) for s in args.sources]
    for path in paths:
        if not path.exists():
            p.error(f"{path}: no such file or directory")
        if path.is_file() and path.suffix.lower() not in SUFFIXES:
            p.error(f"{path}: neither .docx nor .xlsx")
        if not path.is_file() and not path.is_dir():
            _say(f"error: {path}: not a regular file")
            return CODES["corrupt_archive"]
    many = len(paths) > 1 or any(path.is_dir() for path in paths)
    if not paths and args.format is None:
        p.error("--format is required when reading from standard input")
    if many and args.output is None:
        p.error("-o is required for a batch")
    suffix = ".json" if args.json else ".md"
    listing = walk(paths) if many else []
    if many:
        if not listing:
            p.error("no .docx or .xlsx files found")
        targets: dict[Path, list[str]] = {}
        for path, rel in listing:
            targets.setdefault(Path(rel).with_suffix(suffix), []).append(path)
        if clash := {k: v for k, v in targets.items() if len(v) > 1}:
            for k, v in sorted(clash.items()):
                _say(f"error: {k} would be written by several inputs: {', '.join(v)}")
            return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("inkweave").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    config = engine.Config(strict=args.strict, gate=args.gate)
    if not many:
        path = paths[0] if paths else None
        form = SUFFIXES[path.suffix.lower()] if path else args.format
        source = engine.in_memory(spark, [(str(path or "-"), form, path.read_bytes() if path else sys.stdin.buffer.read())])
        row = engine.convert(source, config).first()
        if row["status"] != "ok":
            _say(f"error: {row['error']}")
            return CODES[row["status"]]
        if not args.quiet:
            for w in row["warnings"]:
                _say(f"warning: {w}")
        if args.output:
            Path(args.output).write_text(_text(row, args.json), encoding="utf-8")
        else:
            sys.stdout.write(_text(row, args.json))
        return 0
    # a batch reads its files on the executors and comes back one result at a time
    from pyspark.sql import functions as F

    plan = spark.createDataFrame([(k, path, rel) for k, (path, rel) in enumerate(listing)], "ord long, local string, rel string")
    files = spark.read.format("binaryFile").load([f"file://{path}" for path, _ in listing]).select("path", "content")
    rows = files.join(plan, F.regexp_replace("path", "^file:/+", "/") == F.col("local")).select(F.col("rel").alias("source_id"), F.lower(F.regexp_extract("local", r"\.([^.]*)$", 1)).alias("format"), "content")
    # files are written on the executors (here all on this machine); only what there is to say comes back
    folder = Path(args.output).resolve()
    results = stored(engine.convert(rows, config).join(plan.select(F.col("rel").alias("source_id"), "ord"), "source_id"), "results")
    wanted = results
    if args.fail_fast and (first := results.where("status <> 'ok'").agg(F.min("ord")).first()[0]) is not None:
        wanted = results.where(F.col("ord") <= first)
    written = stored(sinks.write_each(wanted, folder.as_uri(), args.json), "written")
    told = written.join(wanted.select("source_id", "ord"), "source_id").orderBy("ord")
    done = failed = 0
    for row in told.toLocalIterator():
        if row["status"] != "ok":
            _say(f"error: {row['source_id']}: {row['error']}")
            if args.fail_fast:
                return CODES[row["status"]]
            failed += 1
            continue
        if not args.quiet:
            for w in row["warnings"]:
                _say(f"warning: {row['source_id']}: {w}")
        done += 1
        if args.verbose:
            _say(f"converted: {row['source_id']} -> {row['path']}")
    _say(f"{done}/{len(listing)} converted, {failed} failed")
    return 1 if failed else 0
