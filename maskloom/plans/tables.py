"""Inputs of the registered queries: the driver's tables, and texts and spans built from their keys.

The texts are plain SQL that Spark and other engines evaluate alike, so what a detector
must find in them is known without detecting anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import vocab as V
from maskloom.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much each, dealt out: its file may be one row group."""
    return spread(table(spark, sf_dir, name))


def padded(key: str, width: int) -> str:
    return f"lpad(cast(({key}) % {10**width} as string), {width}, '0')"


def digit_sum(value: str, weights) -> str:
    return " + ".join(f"cast(substr({value}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights))


MOBILE = f"'010-' || cast(2000 + c_custkey % 8000 as string) || '-' || {padded('c_custkey * 7', 4)}"
#: steps of (name, SQL over the earlier columns) that build a number with a right check digit
RRN = [
    ("born", "cast(50 + c_custkey % 50 as string) || lpad(cast(1 + c_custkey % 12 as string), 2, '0') || lpad(cast(1 + c_custkey % 28 as string), 2, '0')"),
    ("body", f"born || '1' || lpad(cast(c_custkey % 96 as string), 2, '0') || {padded('c_custkey', 3)}"),
    ("total", digit_sum("body", V.RRN_WEIGHTS)),
    ("value", "born || '-' || substr(body, 7) || cast((11 - total % 11) % 10 as string)"),
]
FRN = [
    # every seventh customer is born on the 31st of February
    ("born", "cast(50 + c_custkey % 50 as string) || CASE WHEN c_custkey % 7 = 0 THEN '0231' ELSE lpad(cast(1 + c_custkey % 12 as string), 2, '0') || lpad(cast(1 + c_custkey % 28 as string), 2, '0') END"),
    ("value", f"born || '-5' || {padded('c_custkey * 31 + 1', 6)}"),
]
BRN = [
    ("body", padded("s_suppkey * 37", 9)),
    ("total", digit_sum("body", V.BRN_WEIGHTS[:8]) + " + cast(substr(body, 9, 1) as int) * 5 + CASE WHEN cast(substr(body, 9, 1) as int) * 5 >= 40 THEN 4 WHEN cast(substr(body, 9, 1) as int) * 5 >= 30 THEN 3 WHEN cast(substr(body, 9, 1) as int) * 5 >= 20 THEN 2 WHEN cast(substr(body, 9, 1) as int) * 5 >= 10 THEN 1 ELSE 0 END"),
    # every third number has a wrong check digit
    ("value", "substr(body, 1, 3) || '-' || substr(body, 4, 2) || '-' || substr(body, 6) || cast((10 - total % 10 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) % 10 as string)"),
]
CARD = [
    ("body", "'4' || " + padded("o_orderkey * 7919", 14)),
    ("total", " + ".join(
        (f"(CASE WHEN cast(substr(body, {i + 1}, 1) as int) > 4 THEN cast(substr(body, {i + 1}, 1) as int) * 2 - 9 ELSE cast(substr(body, {i + 1}, 1) as int) * 2 END)"
         if i % 2 == 0 else f"cast(substr(body, {i + 1}, 1) as int)") for i in range(15))),
    ("number", "body || cast((10 - total % 10 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 10 as string)"),
    ("value", "substr(number, 1, 4) || ' ' || substr(number, 5, 4) || ' ' || substr(number, 9, 4) || ' ' || substr(number, 13)"),
]


def derive(rows: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, expression in steps:
        rows = rows.withColumn(name, F.expr(expression))
    return rows


def derived_sql(source: str, steps: list[tuple[str, str]]) -> str:
    """The same steps as nested SELECTs."""
    for name, expression in steps:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return source


# --- spans from order lines: gold, predictions of two systems, ignore and negative spans -----

ENTITY_SQL = "CASE l_suppkey % 3 WHEN 0 THEN 'PHONE_NUMBER' WHEN 1 THEN 'EMAIL_ADDRESS' ELSE 'KR_ACCOUNT' END"
OTHER_SQL = "CASE l_suppkey % 3 WHEN 0 THEN 'KR_ACCOUNT' WHEN 1 THEN 'PHONE_NUMBER' ELSE 'EMAIL_ADDRESS' END"
#: one row for each order and line number, so that a document's gold spans are disjoint
LINES = ("(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag "
         "FROM lineitem GROUP BY l_orderkey, l_linenumber) lines")
AT = "(l_linenumber - 1) * 24"


def _spans_sql(entity: str, start: str, length: str, where: str = "true", extra: str = "") -> str:
    return (f'SELECT l_orderkey AS doc_id, {entity} AS entity, cast({start} as int) AS "start", '
            f'cast({start} + {length} as int) AS "end"{extra} FROM {LINES} WHERE {where}')


GOLD = _spans_sql(ENTITY_SQL, AT, "6 + l_partkey % 9", "l_partkey % 8 <> 3",
                  ", CASE l_returnflag WHEN 'N' THEN 'prose' ELSE 'fields' END AS track")
SCORE_SQL = ", cast(round(0.3 + (l_partkey % 70) / 100.0, 2) as double) AS score"
BASE = _spans_sql(f"CASE WHEN l_partkey % 11 = 0 THEN {OTHER_SQL} ELSE {ENTITY_SQL} END", f"{AT} + CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 0 END",
                  "6 + l_partkey % 9 - CASE WHEN l_partkey % 6 = 0 THEN 3 ELSE 0 END", "l_partkey % 5 <> 0",
                  SCORE_SQL + ", CASE l_returnflag WHEN 'N' THEN 'prose' ELSE 'fields' END AS track")
CANDIDATE = _spans_sql(ENTITY_SQL, f"{AT} + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END",
                       "6 + l_partkey % 9 + CASE WHEN l_partkey % 10 = 0 THEN 2 ELSE 0 END", "l_partkey % 7 <> 0",
                       SCORE_SQL + ", CASE l_returnflag WHEN 'N' THEN 'prose' ELSE 'fields' END AS track")
IGNORE = _spans_sql("'IGNORE'", AT, "20", "l_partkey % 8 = 3 AND l_suppkey % 2 = 0")
NEGATIVE = _spans_sql("'NEGATIVE'", f"{AT} + 1", "9", "l_partkey % 8 = 3 AND l_suppkey % 2 = 1")
#: crossing and nested candidates: two readings of most lines
CROSSING = (
    _spans_sql(ENTITY_SQL, "(l_linenumber - 1) * 8", "6 + l_partkey % 9", "true", SCORE_SQL) + " UNION ALL "
    + _spans_sql(OTHER_SQL, "(l_linenumber - 1) * 8 + l_suppkey % 5", "3 + l_partkey % 5", "l_partkey % 3 <> 0",
                 ", cast(round(0.3 + (l_suppkey % 60) / 100.0, 2) as double) AS score"))


def spans(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A span table by its SQL text, over the order lines."""
    text = sql.replace('"start"', "`start`").replace('"end"', "`end`").replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))
