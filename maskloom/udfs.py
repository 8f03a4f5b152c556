"""The SQL surface: detectors as temporary SQL functions, and a table function (UDF1-6).

A detector's column expression is rendered as SQL text, so ``mask_pii(text)`` in a query
is inlined into the plan like any built-in expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.detect import FINDING, MODEL_SPAN, Detector
from maskloom.runtime import ship

_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`\]])(<=>|<=|>=|<>|!=|==|=|<|>|\+|-|\*|/|%|!|and|or|not|in|exists|replace|filter)\(|\bend\b(?=: |[,)])", re.S)


def as_sql(column: Column) -> str:
    """A column expression as SQL text; operators become quoted function names, and ``end`` a quoted name."""
    def quote(match: re.Match) -> str:
        if match.group(1):
            return f"`{match.group(1)}`("
        return "`end`" if match.group() == "end" else match.group()

    return _TOKEN.sub(quote, column._jc.node().sql())


def register(spark: SparkSession, detector: Detector | None = None, prefix: str = "") -> None:
    """Create pii_findings, contains_pii, mask_pii, mask_pii_stars and mask_pii_partial for SQL."""
    detector = detector or Detector()
    text = F.col("text")
    bodies = {
        "pii_findings": ("ARRAY<" + FINDING.replace("end:", "`end`:") + ">", detector.findings(text)), "contains_pii": ("BOOLEAN", detector.contains(text)),
        "mask_pii": ("STRING", detector.mask(text)), "mask_pii_stars": ("STRING", detector.mask(text, "stars")),
        "mask_pii_partial": ("STRING", detector.mask(text, "partial")),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(text STRING) RETURNS {kind} RETURN {as_sql(body)}")


def findings_long(rows: DataFrame, key: str, column: str, detector: Detector | None = None) -> DataFrame:
    """One row a finding: key, entity, start, end, score, text."""
    found = rows.select(key, F.explode((detector or Detector()).findings(F.col(column))).alias("f"))
    return found.select(key, "f.*")


def guard(rows: DataFrame, column: str, detector: Detector | None = None, style: str = "tag") -> DataFrame:
    """A pass or fail verdict with the repaired text and the spans at fault (UDF4)."""
    checked = rows.withColumn("__m", (detector or Detector()).mask_with_details(F.col(column), style))
    return checked.withColumn("outcome", F.when(F.size("__m.redactions") > 0, "fail").otherwise("pass")).withColumn(
        "fix_value", F.col("__m.text")).withColumn("error_spans", F.col("__m.redactions")).drop("__m")


_models: dict[str, Callable[[], Callable[[str], list]]] = {}


def register_model(name: str, factory: Callable[[], Callable[[str], list]]) -> None:
    """Name a factory of ``analyze(text) -> [(entity, start, end, score), ...]`` (UDF1, UDF6)."""
    _models[name] = factory


def confident(name: str, threshold: float) -> Callable[[], Callable[[str], list]]:
    """The factory of a named model whose spans below ``threshold`` go; an unknown name fails."""
    if name not in _models:
        raise ValueError("No model of that name is registered")
    factory = _models[name]

    def make() -> Callable[[str], list]:
        analyze = factory()
        return lambda text: [span for span in analyze(text) if span[3] >= threshold]

    return make


def model_spans(text: Column, factory: str | Callable[[], Callable[[str], list]]) -> Column:
    """A model's spans of a (normalised) text column; the model is built once for each Python worker's task."""
    make = _models[factory] if isinstance(factory, str) else factory
    ship(SparkSession.active())

    @F.pandas_udf(f"array<{MODEL_SPAN}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyze = make()
        for batch in batches:
            yield pd.Series([None if t is None else [
                {"entity": e, "start": s, "end": n, "score": p} for e, s, n, p in analyze(t)] for t in batch])

    return run(text)


def with_model(rows: DataFrame, column: str, detector: Detector, factory: str | Callable, into: str = "findings") -> DataFrame:
    """Findings with a name and address model beside the rules (ML1, GAT10)."""
    from maskloom.functions.text import normalize

    view = normalize(F.col(column)) if detector.normalize else F.col(column)
    given = rows.withColumn("__view", view).withColumn("__model", model_spans(F.col("__view"), factory))
    return detector.findings_with(given, column, "__model", into).drop("__view", "__model")
