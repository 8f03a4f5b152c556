"""Readers and writers of text, JSON, JSONL and CSV (SRC*, SNK*).

Readers fail on malformed input rather than pass text through unscreened; writers rely
on Spark's commit protocol, so a failed job leaves no visible output.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_CASE = "id string, text string, entities array<struct<type:string,start:int,end:int,surface:string>>, ignore array<struct<start:int,end:int,surface:string>>, negative_spans array<struct<start:int,end:int,surface:string>>"
PATH_CASE = "id string, record string, targets array<struct<path:array<string>,type:string,surface:string>>, ignore_paths array<array<string>>, negative_paths array<array<string>>"
TAG_CASE = "sent_idx string, sentence string, sent_seq array<string>, labelling_seq array<string>, PII_set array<struct<begin:int,end:int,label:string,form:string>>"
BOM = "\ufeff"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one document: path, text (SRC1)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one JSON value: path, document; a leading byte order mark goes (SRC2)."""
    return read_text(spark, path).select("path", F.regexp_replace("text", f"\\A{BOM}", "").alias("document"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number from 1: blocks of a file in order, and rows in a block."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("at"))
    ordered = Window.partitionBy("file").orderBy("block", "at")
    return rows.select("file", F.row_number().over(ordered).alias("line_no"), "line")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON value a line: file, block, at (which order the lines of a file), document (SRC3).

    A blank line fails. The line reader itself drops a byte order mark at a file's start.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blank = F.raise_error(F.concat(F.lit("Blank line in "), F.col("file"))).cast("string")
    return rows.select("file", "block", "at", F.when(F.trim("line") == "", blank).otherwise(F.col("line")).alias("document"))


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV table, all columns text. The header must be there, with distinct names that are not empty; a row of another width fails (SRC4)."""
    base = {"multiLine": True, "escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": -1, "enforceSchema": True} | options
    first = spark.read.options(**base).csv(path, header=False).first()
    if first is None:
        raise ValueError("CSV has no header")
    names = [str(n).removeprefix(BOM) if n is not None else "" for n in first]
    if any(not n.strip() for n in names) or max(Counter(names).values()) > 1:
        raise ValueError("CSV header names must be distinct and not empty")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(**base, header=True, nullValue="\u0000").schema(schema).csv(path).na.fill("")


def read_cases(spark: SparkSession, path: str, schema: str = SPAN_CASE) -> DataFrame:
    """Annotated cases as JSONL, by schema; a line that does not parse fails (SRC6-8)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tag_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of tagged sentences (SRC12)."""
    return spark.read.schema(TAG_CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def verify_digest(spark: SparkSession, path: str, sha256: str) -> None:
    """Fail unless every file under ``path`` has the pinned digest (SRC13, SNK10)."""
    wrong = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h")).where(F.col("h") != sha256)
    if not wrong.isEmpty():
        raise ValueError("A pinned input does not match its digest")


def write_csv(table: DataFrame, path: str) -> None:
    """Header and rows; the target must not exist (SNK1, SNK4)."""
    if len(set(table.columns)) != len(table.columns):
        raise ValueError("CSV header names must be distinct")
    table.write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="")


def write_documents(rows: DataFrame, column: str, path: str) -> None:
    """One document a line (SNK5)."""
    rows.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def write_findings(rows: DataFrame, findings: str, path: str, key: str | None = None) -> None:
    """JSON reports of entity, start, end and score; never the text (SNK6)."""
    shown = F.transform(findings, lambda f: F.struct(f["entity"].alias("entity"), f["start"].alias("start"), f["end"].alias("end"), f["score"].alias("score")))
    rows.select(*([key] if key else []), shown.alias("findings")).write.mode("errorifexists").json(path)


def write_report(aggregates: DataFrame, path: str) -> None:
    """Aggregates as one JSON file (SNK8)."""
    aggregates.coalesce(1).write.mode("errorifexists").json(path)


def freeze(table: DataFrame, path: str) -> DataFrame:
    """An immutable copy of the input with a content digest of each row, read back (SNK10)."""
    table.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*table.columns)), 256)).write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)
