"""mask, analyze and check over files or standard input: ``python -m maskloom.cli mask IN -o OUT --format csv`` (UDF5).

Input and output default to standard input and output, as ``-`` names them. Rows are read
and masked by Spark; what goes to standard output or to one file passes the driver row by
row, is staged whole, and appears only once every row is done. ``--folder`` writes a
folder by Spark's own writers instead, for data that no single file should hold.

Exit codes: 0 done (check: nothing found), 1 something found by check, 2 failure. No
message holds text of the input.
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import os
import shutil
import signal
import sys
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom import udfs
from maskloom.functions import vocab as V
from maskloom.operators import structured
from maskloom.operators.detect import Detector, pick
from maskloom.sources import files

MODELS, MODEL_THRESHOLD = ("e5", "kcelectra"), 0.9


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maskloom", description="Find and mask Korean personal data in UTF-8 files.")
    out.add_argument("command", choices=("mask", "analyze", "check"))
    out.add_argument("input", nargs="?", default="-", help="a path; standard input by default")
    where = out.add_mutually_exclusive_group()
    where.add_argument("-o", "--output", default="-", help="a file; standard output by default")
    where.add_argument("--folder", help="a new folder, written in parallel")
    out.add_argument("--format", choices=("text", "json", "jsonl", "csv"), default="text")
    out.add_argument("--style", choices=V.STYLES, default="tag")
    out.add_argument("--strict-fields", action="store_true", help="mask every value of a wanted personal field")
    out.add_argument("--entity", action="append", choices=V.ENTITIES, help="look for these only; may be repeated")
    out.add_argument("--threshold", type=float, default=V.THRESHOLD)
    out.add_argument("--ner", action="store_true", help="use a registered name and address model")
    out.add_argument("--ner-model", choices=MODELS, default=MODELS[0])
    out.add_argument("--ner-threshold", type=float, default=MODEL_THRESHOLD)
    return out


def complaint(args: argparse.Namespace) -> str:
    """What is wrong with a combination of options; empty if nothing is."""
    named = (args.ner_model, args.ner_threshold) != (MODELS[0], MODEL_THRESHOLD)
    rules = (
        (args.command != "mask" and args.format != "text", "analyze and check read --format text"),
        (args.command != "mask" and (args.output != "-" or args.folder), "analyze and check write to standard output"),
        (args.strict_fields and (args.command != "mask" or args.format == "text"), "--strict-fields goes with mask and --format json, jsonl or csv"),
        (args.ner and not {"KR_NAME", "KR_ADDRESS"} & set(args.entity or ()), "--ner goes with --entity KR_NAME or KR_ADDRESS"),
        (args.ner and args.format != "text", "--ner goes with --format text"),
        (not args.ner and named, "--ner-model and --ner-threshold go with --ner"),
        (not 0 <= args.ner_threshold <= 1, "--ner-threshold is a number from 0 to 1"),
    )
    return next((text for wrong, text in rules if wrong), "")


def check_target(source: str, target: str) -> None:
    """The output may not be a folder, a link, or the input (SNK3)."""
    if os.path.isdir(target) or os.path.islink(target):
        raise ValueError("The output must be a plain file")
    if source != "-" and os.path.exists(target) and os.path.exists(source) and os.path.samefile(source, target):
        raise ValueError("Input and output must be different files")


def _typed(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """The input as a table: column text or document, or the columns of a CSV file (SRC1-5)."""
    if source != "-":
        reader = {"text": files.read_text, "json": files.read_json, "jsonl": files.read_jsonl, "csv": files.read_csv}[kind]
        return reader(spark, source)
    stream = sys.stdin.buffer.read() if hasattr(sys.stdin, "buffer") else sys.stdin.read().encode("utf-8")
    data = stream.decode("utf-8")  # strict: other encodings fail
    if kind == "text":
        return spark.createDataFrame([(data,)], "text string")
    data = data.removeprefix(files.BOM)
    if kind == "json":
        return spark.createDataFrame([(data,)], "document string")
    if kind == "jsonl":
        lines = data.split("\n")[: -1 if data.endswith("\n") else None] if data else []
        if any(not x.strip() for x in lines):
            raise ValueError("Blank line")
        return spark.createDataFrame([("-", 0, i, x) for i, x in enumerate(lines)], "file string, block int, at int, document string")
    rows = list(csv.reader(io.StringIO(data, newline=""), strict=True))
    if not rows or not all(n.strip() for n in rows[0]) or len(set(rows[0])) != len(rows[0]) or any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("CSV rows must fit a header of distinct names")
    names = ", ".join(f"`{n.replace('`', '``')}` string" for n in rows[0])
    return spark.createDataFrame(rows[1:], names)


def _findings(rows: DataFrame, detector: Detector, args: argparse.Namespace) -> DataFrame:
    """Rows with findings, a model's among them with --ner."""
    if not args.ner:
        return rows.withColumn("found", detector.findings(F.col("text")))
    return udfs.with_model(rows, "text", detector, udfs.confident(args.ner_model, args.ner_threshold), "found")


def masked(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The masked input: column value, or the columns of a CSV file."""
    detector, rows = pick(args.entity, threshold=args.threshold), _typed(spark, args.input, args.format)
    if args.format == "csv":
        return structured.mask_columns(rows, detector, args.style, args.strict_fields)
    if args.format == "text":
        if args.ner:
            from maskloom.functions import masking

            return _findings(rows, detector, args).select(masking.splice(F.col("text"), F.col("found"), args.style).alias("value"))
        return rows.select(detector.mask(F.col("text"), args.style).alias("value"))
    out = structured.mask_json(rows, "document", detector, args.style, args.strict_fields)
    out = out.orderBy("file", "block", "at") if args.format == "jsonl" else out
    return out.select(F.col("document").alias("value"))


def _emit(rows: DataFrame, kind: str, target: TextIO) -> None:
    if kind == "csv":
        writer = csv.writer(target, lineterminator="\n")
        writer.writerow(rows.columns)
        writer.writerows(rows.toLocalIterator())
        return
    for row in rows.toLocalIterator():
        target.write(row["value"] if kind == "text" else row["value"] + "\n")


@contextmanager
def _interruptible(spark: SparkSession) -> Iterator[None]:
    """An interrupt cancels the jobs and raises, so that staged files go (SNK9)."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(number, frame):
        spark.sparkContext.cancelAllJobs()
        raise InterruptedError("interrupted")

    before = {s: signal.signal(s, stop) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def write(spark: SparkSession, args: argparse.Namespace) -> None:
    """The masked input to standard output, one file or a folder; nothing of it if anything fails (SNK1-2, SNK9)."""
    with _interruptible(spark):
        if args.folder:
            rows = masked(spark, args)
            files.write_csv(rows, args.folder) if args.format == "csv" else files.write_documents(rows, "value", args.folder)
        elif args.output == "-":
            with tempfile.TemporaryFile("w+", encoding="utf-8", newline="") as staged:
                _emit(masked(spark, args), args.format, staged)
                staged.seek(0)
                shutil.copyfileobj(staged, sys.stdout)
        else:
            check_target(args.input, args.output)
            folder, name = os.path.split(os.path.abspath(args.output))
            handle, path = tempfile.mkstemp(dir=folder, prefix=f".{name}.", suffix=".tmp")  # of mode 0600, beside its target
            try:
                with open(handle, "w", encoding="utf-8", newline="") as staged:
                    _emit(masked(spark, args), args.format, staged)
                    staged.flush()
                    os.fsync(staged.fileno())
                os.replace(path, args.output)
            finally:
                if os.path.exists(path):
                    os.unlink(path)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "mask":
        write(spark, args)
        return 0
    found = _findings(_typed(spark, args.input, "text"), pick(args.entity, threshold=args.threshold), args)
    if args.command == "check":
        return int(not found.where(F.size("found") > 0).isEmpty())
    shown = found.select(F.transform("found", lambda f: F.struct(*(f[n].alias(n) for n in ("entity", "start", "end", "score")))).alias("found"))
    report = [f.asDict() for row in shown.collect() for f in row["found"]]  # of one text; a folder's come in the order of its files
    sys.stdout.write(json.dumps(report, ensure_ascii=False) + "\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    options = parser()
    args = options.parse_args(argv)
    if wrong := complaint(args):
        options.error(wrong)
    try:
        return run(SparkSession.builder.appName("maskloom").getOrCreate(), args)
    except Exception as error:  # the message may hold input, the type does not
        print(f"maskloom: {type(error).__name__}; no complete result was produced", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
