"""Constraints on annotated inputs (VAL*): each broken rule is a row; callers fail or quarantine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import vocab as V


def _overlapping(spans: Column) -> Column:
    """Whether neighbours of the sorted spans overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.exists(F.transform(ordered, lambda s, i: (i > 0) & (F.get(ordered, F.greatest(i - 1, F.lit(0)))["end"] > s["start"])), lambda x: x)


def _crossing(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def resolve_spans(cases: DataFrame) -> DataFrame:
    """Annotations given by surface alone get their offsets where the surface occurs once."""
    def placed(spans: str, typed: bool) -> Column:
        def one(s: Column) -> Column:
            once = F.size(F.split(F.col("text"), F.concat(F.lit("\\Q"), s["surface"], F.lit("\\E")), -1)) == 2
            found = F.when(s["start"].isNull() & s["end"].isNull() & once, F.position(s["surface"], F.col("text")) - 1)
            start = F.coalesce(s["start"], found)
            fields = [start.alias("start"), F.coalesce(s["end"], start + F.length(s["surface"])).alias("end"), s["surface"].alias("surface"),
                      (s["start"].isNull() != s["end"].isNull()).alias("half")]
            return F.struct(*([s["type"].alias("type")] if typed else []), *fields)

        return F.transform(F.coalesce(F.col(spans), F.array().cast(dict(cases.dtypes)[spans])), one)

    return cases.select("id", "text", placed("entities", True).alias("entities"), placed("ignore", False).alias("ignore"),
                        placed("negative_spans", False).alias("negative_spans"))


def span_case_errors(cases: DataFrame, allowed: Iterable[str] = V.ENTITIES) -> DataFrame:
    """(id, error) for every rule that an annotated case breaks (VAL1)."""
    rows = resolve_spans(cases)
    n = F.length("text")
    every = F.concat(*(F.transform(c, lambda s: F.struct(*(s[f].alias(f) for f in ("start", "end", "surface", "half")))) for c in ("entities", "ignore", "negative_spans")))
    inside = F.forall(every, lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n), F.lit(False)))
    surface = F.forall(every, lambda s: s["surface"].isNull() | (F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["surface"]))
    shown = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    rules = {
        "empty id": F.coalesce(F.col("id") != "", F.lit(False)), "empty text": F.coalesce(F.col("text") != "", F.lit(False)),
        "type not allowed": F.forall("entities", lambda s: F.coalesce(s["type"].isin(*allowed), F.lit(False))),
        "start without end": ~F.exists(every, lambda s: s["half"]), "span outside text or surface not unique": inside,
        "surface differs": ~inside | surface,
        "masked gold": ~inside | ~F.exists("entities", lambda s: shown(s).rlike(r"\A(?:\*+|<[A-Z][A-Z0-9_]*>)\z")),
        "overlapping gold": ~_overlapping(F.col("entities")), "overlapping ignore": ~_overlapping(F.col("ignore")),
        "ignore overlaps gold": ~_crossing(F.col("ignore"), F.col("entities")),
        "negative overlaps gold or ignore": ~_crossing(F.col("negative_spans"), F.col("entities")) & ~_crossing(F.col("negative_spans"), F.col("ignore")),
    }
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    found = rows.select("id", F.explode(broken).alias("error"))
    repeated = cases.groupBy("id").count().where(F.col("count") > 1).select("id", F.lit("repeated id").alias("error"))
    return found.unionByName(repeated)


def path_case_errors(cases: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, error) for targets without a leaf, and for paths of two kinds (VAL2). ``leaves``: id, path (string), value."""
    show = lambda kind, column: cases.select("id", F.lit(kind).alias("kind"), F.explode(column).alias("path"))
    paths = show("target", F.transform("targets", lambda t: F.array_join(t["path"], "/"))).unionByName(
        show("ignore", F.transform("ignore_paths", lambda p: F.array_join(p, "/")))).unionByName(
        show("negative", F.transform("negative_paths", lambda p: F.array_join(p, "/"))))
    bare = leaves.where((F.col("value") != "") & ~F.col("value").rlike(r"\A(?:\*+|<[A-Z][A-Z0-9_]*>)\z")).select("id", "path")
    lost = paths.where(F.col("kind") == "target").join(bare, ["id", "path"], "left_anti").select("id", F.lit("target without a leaf").alias("error"))
    twice = paths.groupBy("id", "path").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id", F.lit("path named twice").alias("error"))
    deep = paths.where(F.size(F.split("path", "/")) > V.MAX_DEPTH).select("id", F.lit("path too deep").alias("error"))
    return lost.unionByName(twice).unionByName(deep)


def tag_case_errors(cases: DataFrame) -> DataFrame:
    """(sent_idx, error) where characters, tags and spans contradict each other (VAL4-5)."""
    from maskloom.operators.sequence import spans_to_tags

    spans = F.transform("PII_set", lambda s: F.struct(s["label"].alias("entity"), s["begin"].alias("start"), s["end"].alias("end")))
    chars = F.when(F.length("sentence") == 0, F.array().cast("array<string>")).otherwise(F.split("sentence", ""))
    fits = F.forall("PII_set", lambda s: F.coalesce(
        (s["begin"] >= 0) & (s["begin"] < s["end"]) & (s["end"] <= F.length("sentence"))
        & (F.substring(F.col("sentence"), s["begin"] + 1, s["end"] - s["begin"]) == s["form"]), F.lit(False)))
    distinct = F.array_distinct(spans)
    rules = {
        "characters differ from text": F.col("sent_seq") == chars, "tags differ in number": F.size("labelling_seq") == F.length("sentence"),
        "span differs from its surface": fits, "overlapping spans": ~_overlapping(distinct),
        "tags differ from spans": F.col("labelling_seq") == spans_to_tags(F.col("sentence"), distinct),
    }
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return cases.select("sent_idx", F.explode(broken).alias("error"))


def repeated_annotations(cases: DataFrame) -> DataFrame:
    """Identical annotations of a case with the indices of all of them (VAL6)."""
    long = cases.select("sent_idx", F.posexplode("PII_set").alias("n", "s"))
    return long.groupBy("sent_idx", "s").agg(F.sort_array(F.collect_list("n")).alias("indices")).where(F.size("indices") > 1).select(
        "sent_idx", F.col("s.label").alias("label"), F.col("s.begin").alias("start"), F.col("s.end").alias("end"), "indices")


def strict_json(document: Column) -> Column:
    """The variant of a document; duplicate keys and numbers that are not finite fail (VAL3)."""
    return F.parse_json(document)


def split_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids and (normalised) texts that two splits share; must be empty (VAL1, JOI10)."""
    from maskloom.functions.text import fingerprint

    marks = lambda df: df.select(F.explode(F.array(F.concat(F.lit("id:"), F.col("id")), fingerprint(F.col("text")), fingerprint(F.col("text"), True))).alias("mark")).distinct()
    return marks(first).join(marks(second), "mark", "left_semi")


def must_be_empty(errors: DataFrame, what: str) -> None:
    """Fail with the first broken rule (ids and rules only, no text)."""
    row = errors.orderBy(*errors.columns).first()
    if row is not None:
        raise ValueError(f"{what}: {row.asDict()}")
