"""Masking of fields: typed columns, CSV rows and JSON trees (FN14-15, GAT16-20, JOI12-14).

A field's key gives its values the context that a label gives in prose. JSON trees are
taken apart and put together again in Arrow batches, since only that keeps key order
and number spelling; what is masked in between is one column expression over the
document's leaves, in its row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions import masking, text as texts
from maskloom.functions import vocab as V
from maskloom.functions.kernel import any_word, built, let, matches, none_of
from maskloom.operators.detect import FINDING, Detector, check_style
from maskloom.runtime import ship

LEAF = "struct<text:string,label:string>"
_EMAIL_TOKEN = r"[^\s<>,;]+@[^\s<>,;]+"


def label_of(key: str) -> str:
    """The canonical label of a field name; empty if it names no personal field."""
    return V.FIELD_LABEL.get(key.strip().casefold(), "")


def _entity_of(label: Column) -> Column:
    last = F.substring_index(label, " ", -1)
    out = F.lit(None).cast("string")
    for name, entity in V.FIELD_ENTITY.items():
        out = F.when(last == name, entity).otherwise(out)
    return out


def _card_like(text: Column) -> Column:
    view = texts.normalize(text)
    return matches(view, "[0-9]+(?:[ -][0-9]+)*") & F.length(F.regexp_replace(view, "[^0-9]", "")).between(13, 19)


def _email_like(text: Column) -> Column:
    parts = lambda token: matches(token, rf"[^@]*[\p{{L}}\p{{N}}][^@]*@[^@]*[\p{{L}}\p{{N}}][^@]*")
    return F.exists(F.regexp_extract_all(text, F.lit(_EMAIL_TOKEN), F.lit(0)), parts)


def _prefix(label: Column) -> Column:
    return F.when(label == "", "").otherwise(F.concat(label, F.lit(": ")))


@built
def field_findings(detector: Detector, text: Column, label: Column) -> Column:
    """Findings of a value behind its label."""
    return detector.findings(F.concat(_prefix(label), text))


@built
def settle_field(detector: Detector, text: Column, label: Column, found: Column, style: str = "tag", strict: bool = False) -> Column:
    """A value masked by the findings of :func:`field_findings` and by the rules for typed fields.

    ``strict`` masks every value of a wanted personal field that is not blank. A finding
    that starts inside the label fails. Under a card, e-mail or name label a value of the
    right shape is masked even where no detector finds it.
    """
    whole = lambda entity: masking.replacement(text, F.lit(entity) if isinstance(entity, str) else entity, style)
    ahead = F.length(_prefix(label))
    moved = F.transform(found, lambda f: F.struct(
        f["entity"].alias("entity"), (f["start"] - ahead).alias("start"), (f["end"] - ahead).alias("end"), f["score"].alias("score")))
    out = let(moved, lambda m: masking.splice(text, m, style))
    if "KR_NAME" in detector.entities:
        alone = label.isin("성명", "이름", "예금주") & (F.size(found) == 0) & matches(text, "[가-힣]")
        out = F.when(alone, F.lit("<KR_NAME>" if style == "tag" else "*")).otherwise(out)
    if "EMAIL_ADDRESS" in detector.entities:
        out = F.when((label == "이메일") & _email_like(text), whole("EMAIL_ADDRESS")).otherwise(out)
    if "CREDIT_CARD" in detector.entities:
        out = F.when((label == "카드번호") & (F.size(found) == 0) & _card_like(text), whole("CREDIT_CARD")).otherwise(out)
    crossing = F.exists(found, lambda f: f["start"] < ahead)
    out = F.when(crossing, F.raise_error(F.lit("A finding crosses a field boundary")).cast("string")).otherwise(out)
    if strict:
        entity = _entity_of(label)
        forced = whole(entity)
        if style == "partial":
            forced = F.when(forced == text, F.repeat(F.lit("*"), F.length(text))).otherwise(forced)
        out = F.when(_forced(detector, text, label), forced).otherwise(out)
    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(out)


def _forced(detector: Detector, text: Column, label: Column) -> Column:
    """Whether strict masking takes the value whatever it holds."""
    return _entity_of(label).isin(*detector.entities) & (F.regexp_replace(text, r"[\s\p{Z}]+", "") != "")


def mask_field(detector: Detector, text: Column, label: Column | str, style: str = "tag", strict: bool = False) -> Column:
    """One value masked in the context of its label ('' for none), as one expression.

    Tables and documents use the two steps apart, which keeps plans shallow.
    """
    check_style(style)
    label = F.lit(label) if isinstance(label, str) else label
    row = F.struct(text.alias("text"), F.coalesce(label, F.lit("")).alias("label"))
    return let(row, lambda r: let(field_findings(detector, r["text"], r["label"]), lambda found: settle_field(
        detector, r["text"], r["label"], found, style, strict)))


def _mask_leaves(rows: DataFrame, detector: Detector, style: str, strict: bool) -> DataFrame:
    """Rows with ``__leaves`` array<struct<text,label>> and their masked values as ``__masked``.

    One expression serves all leaves of a row, so the plan's size does not grow with the
    number of columns; detection and settlement are two projections.
    """

    def spans(x: Column) -> Column:
        seen = field_findings(detector, x["text"], x["label"])
        return F.when(_forced(detector, x["text"], x["label"]), none_of(FINDING)).otherwise(seen) if strict else seen

    found = rows.withColumn("__found", F.transform("__leaves", spans))
    return found.withColumn("__masked", F.zip_with("__leaves", "__found", lambda x, f: settle_field(
        detector, x["text"], x["label"], f, style, strict))).drop("__leaves", "__found")


# --- tables -------------------------------------------------------------------------------


def _row_bank(columns: Sequence[str]) -> Column | None:
    """The one documented bank that a row's bank columns agree on; '' otherwise."""
    names = [c for c in columns if c.strip().casefold() in V.BANK_KEYS]
    if not names:
        return None

    def bank(name: str) -> Column:
        value = F.regexp_replace(F.col(f"`{name}`"), r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")
        return reduce(lambda out, kv: F.when(value == kv[0], kv[1]).otherwise(out), V.BANK_VALUES.items(), F.lit(None).cast("string"))

    banks = [bank(n) for n in names]
    agree = reduce(lambda a, b: a & b, (F.coalesce(b == banks[0], F.lit(False)) for b in banks))
    return F.when(agree, banks[0]).otherwise("")


def mask_headers(spark: SparkSession, detector: Detector, names: Sequence[str], style: str = "tag") -> list[str]:
    """Column names with findings replaced; two that become equal fail. One small driver-side row."""
    if not any(n for n in names):
        raise ValueError("CSV header is empty")
    leaf = lambda n: F.struct(F.lit(n).alias("text"), F.lit("").alias("label"))
    row = _mask_leaves(spark.range(1).select(F.array(*map(leaf, names)).alias("__leaves")), detector, style, False).first()["__masked"]
    if len(set(row)) != len(names):
        raise ValueError("Masking would create duplicate column names")
    return list(row)


def mask_columns(table: DataFrame, detector: Detector, style: str = "tag", strict: bool = False, headers: bool = True) -> DataFrame:
    """All columns (as text) masked in the context of their names; names too with ``headers``."""
    check_style(style)
    bank = _row_bank(table.columns)
    names, cells = list(table.columns), []
    for name in names:
        label = F.lit(label_of(name))
        if label_of(name) == "계좌번호" and bank is not None:
            label = F.when(bank != "", F.concat(bank, F.lit(" 계좌번호"))).otherwise("계좌번호")
        cells.append(F.struct(F.col(f"`{name}`").cast("string").alias("text"), label.alias("label")))
    masked = _mask_leaves(table.select(F.array(*cells).alias("__leaves")), detector, style, strict).select(
        *(F.get("__masked", F.lit(i)).alias(name) for i, name in enumerate(names)))
    return masked.toDF(*mask_headers(table.sparkSession, detector, names, style)) if headers else masked


# --- JSON ---------------------------------------------------------------------------------


def parse(document: str):
    """A JSON value; repeated keys and numbers that are not finite fail."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("JSON object has duplicate keys")
        return out

    def refuse(name):
        raise ValueError("JSON holds a number that is not finite")

    return json.loads(document, object_pairs_hook=unique, parse_constant=refuse)


def _bank(item: dict) -> str:
    given = [v for k, v in item.items() if k.strip().casefold() in V.BANK_KEYS]
    known = {V.BANK_VALUES.get(v.strip()) if isinstance(v, str) else None for v in given}
    return known.pop() or "" if len(known) == 1 else ""


class _Tree:
    """Takes a JSON tree apart by the type of each node, in order of appearance."""

    def __init__(self, leaf: Callable[[str, str], str], inherit: bool):
        self.leaf, self.inherit = leaf, inherit
        same = lambda node, label, depth: node
        self.by_type = {dict: self.members, list: self.items, str: self.text, int: self.integer, float: self.real, bool: same, type(None): same}

    def node(self, node, label: str, depth: int):
        if type(node) not in self.by_type:
            raise TypeError(f"{type(node).__name__} is no JSON value")
        if depth > V.MAX_DEPTH:
            raise ValueError(f"JSON nests deeper than {V.MAX_DEPTH} levels")
        return self.by_type[type(node)](node, label, depth)

    def text(self, node: str, label: str, depth: int) -> str:
        return self.leaf(node, label)

    def integer(self, node: int, label: str, depth: int):
        digits = str(node)
        masked = self.leaf(digits, label)
        return node if masked == digits else masked

    def real(self, node: float, label: str, depth: int) -> float:
        if label:
            raise ValueError("A personal field holds a floating-point number")
        if not math.isfinite(node):
            raise ValueError("JSON holds a number that is not finite")
        return node

    def items(self, node: list, label: str, depth: int) -> list:
        return [self.node(item, label, depth + 1) for item in node]

    def members(self, node: dict, label: str, depth: int) -> dict:
        if not all(isinstance(key, str) for key in node):
            raise TypeError("JSON keys are strings")
        bank, out = _bank(node), {}
        for key, child in node.items():
            shown = self.leaf(key, "")
            if shown in out:
                raise ValueError("Masking would create duplicate JSON keys")
            own = label_of(key) or (label if self.inherit else "")
            out[shown] = self.node(child, f"{bank} {own}" if bank and own == "계좌번호" else own, depth + 1)
        return out


def walk(value, leaf: Callable[[str, str], str], inherit: bool = False):
    """The tree with every key, string and integer given to ``leaf`` in order of appearance."""
    return _Tree(leaf, inherit).node(value, "", 0)


def _leaves(document: str, inherit: bool) -> list[dict]:
    out: list[dict] = []

    def keep(text: str, label: str) -> str:
        out.append({"text": text, "label": label})
        return f"{len(out)}"  # unique, so that no two keys clash yet

    walk(parse(document), keep, inherit)
    return out


def _rebuilt(document: str, masked: Sequence[str], inherit: bool) -> str:
    values = iter(masked)
    return json.dumps(walk(parse(document), lambda text, label: next(values), inherit), ensure_ascii=False)


def with_leaves(rows: DataFrame, column: str, inherit: bool = False, into: str = "__leaves") -> DataFrame:
    """Rows with array<struct<text,label>> of a JSON document column: keys, strings and integers in order."""
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T._parse_datatype_string(f"array<{LEAF}>"))])
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = batch.column(batch.schema.get_field_index(column)).to_pylist()
            found = pa.array([None if d is None else _leaves(d, inherit) for d in documents], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, schema)


def rebuilt(rows: DataFrame, column: str, masked: str, into: str, inherit: bool = False) -> DataFrame:
    """Rows with the document put together again from its masked leaves; both helper columns go."""
    ship(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != into and not f.name.startswith("__")]
    schema = T.StructType([*kept, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            out = [None if d is None else _rebuilt(d, m, inherit) for d, m in zip(get(column).to_pylist(), get(masked).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(get(f.name) for f in kept), pa.array(out, pa.string())], names=[*(f.name for f in kept), into])

    return rows.mapInArrow(run, schema)


def mask_json(rows: DataFrame, column: str, detector: Detector, style: str = "tag", strict: bool = False, into: str | None = None) -> DataFrame:
    """Rows with a JSON document column masked; with ``strict``, nested values inherit their parent's label."""
    check_style(style)
    if not isinstance(strict, bool):
        raise TypeError("strict must be a bool")
    into = into or column
    masked = _mask_leaves(with_leaves(rows, column, strict), detector, style, strict)
    names = list(dict.fromkeys([*rows.columns, into]))
    return rebuilt(masked, column, "__masked", into, strict).select(*names)


def transform_json(rows: DataFrame, column: str, transform: Callable[[str, str], str], into: str | None = None, inherit: bool = False, pure: bool = False) -> DataFrame:
    """Rows with a JSON document column whose keys, strings and integers went through ``transform(text, label)`` (UDF3).

    Keys have no label. A ``pure`` transform (the same result for the same arguments) is asked
    once for each key of a batch.
    """
    ship(rows.sparkSession)
    into = into or column
    kept = [f for f in rows.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, str] = {}

            def leaf(text: str, label: str) -> str:
                if label or not pure:
                    return transform(text, label)
                if text not in seen:
                    seen[text] = transform(text, label)
                return seen[text]

            get = lambda name: batch.column(batch.schema.get_field_index(name))
            out = [None if d is None else json.dumps(walk(parse(d), leaf, inherit), ensure_ascii=False) for d in get(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(get(f.name) for f in kept), pa.array(out, pa.string())], names=[*(f.name for f in kept), into])

    return rows.mapInArrow(run, schema).select(*dict.fromkeys([*rows.columns, into]))


class _Number(str):
    """A number as it is written."""


def _scalars(document: str) -> list[tuple[str, str]]:
    """Paths of a document's scalars, and each scalar as JSON."""
    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("JSON object has duplicate keys")
        return out

    def refuse(name):
        raise ValueError("JSON holds a number that is not finite")

    out, rest = [], [("$", json.loads(document, object_pairs_hook=unique, parse_int=_Number, parse_float=_Number, parse_constant=refuse))]
    while rest:
        path, node = rest.pop()
        if isinstance(node, dict):
            rest.extend((f"{path}.{key}", child) for key, child in node.items())
        elif isinstance(node, list):
            rest.extend((f"{path}[{at}]", child) for at, child in enumerate(node))
        else:  # a key may hold half a surrogate pair, as the escapes of a value do
            out.append((path.encode("utf-8", "replace").decode(), str(node) if isinstance(node, _Number) else json.dumps(node)))
    return out


def leaf_table(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Scalar leaves of JSON documents with their paths (AGG14, FN16).

    Documents are taken apart in Arrow batches, whatever their number and depth; values are spelled by the engine's own variant type.
    """
    ship(rows.sparkSession)
    given = rows.select(key, column)
    schema = T.StructType([given.schema[key], T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, *leaf) for at, d in enumerate(batch.column(1).to_pylist()) if d is not None for leaf in _scalars(d)]
            at, paths, values = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())],
                                             names=[key, "path", "value"])

    return given.mapInArrow(run, schema).select(key, "path", F.parse_json("value").cast("string").alias("value"))


def paired_leaves(original: DataFrame, masked: DataFrame, key: str, column: str) -> DataFrame:
    """Leaves of a document before and after, joined by their ordinal, as masking may change keys (JOI14)."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return with_leaves(df.select(key, column), column).select(key, F.posexplode("__leaves").alias("n", "leaf")).select(key, "n", F.col("leaf.text").alias(name))

    return numbered(original, "before").join(numbered(masked, "after"), [key, "n"], "full")


def sibling_banks(leaf_rows: DataFrame) -> DataFrame:
    """The one documented bank of each object (doc_id, parent, key, value), else '' (JOI12)."""
    key = F.lower(F.trim("key"))
    value = F.trim("value")
    known = reduce(lambda out, kv: F.when(value == kv[0], kv[1]).otherwise(out), V.BANK_VALUES.items(), F.lit(None).cast("string"))
    fields = leaf_rows.where(key.isin(*V.BANK_KEYS)).select("doc_id", "parent", known.alias("bank"))
    return fields.groupBy("doc_id", "parent").agg(
        F.when(F.bool_and(F.col("bank").isNotNull()) & (F.min("bank") == F.max("bank")), F.min("bank")).otherwise("").alias("bank"))


def label_pattern() -> str:
    """All field keys as one pattern, for readers that only need to know whether a key is personal."""
    return any_word(V.FIELD_LABEL)
