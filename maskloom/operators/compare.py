"""Evaluators over several systems at once: text spans, structured fields, versions, sources, policies
(EVL1-3, EVL5-8, EVL15-16, EVL19, AGG14, AGG17, AGG23).

A system is a column: its predictions stand beside those of the others, and one job
counts them all. Systems are named by the caller, so gold rows are repeated once for each.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators import evaluate, spanjoin
from maskloom.operators.detect import Detector

COORDINATES = ("doc_id", "entity", "start", "end")


def _each(rows: DataFrame, systems: Sequence[str]) -> DataFrame:
    return rows.withColumn("system", F.explode(F.array(*map(F.lit, systems))))


def _keyed(rows: DataFrame) -> DataFrame:
    """The system becomes part of the document, so that every span operator keeps systems apart."""
    return rows.withColumn("doc_id", F.struct("system", "doc_id")).drop("system")


def systems_report(gold: DataFrame, predicted: DataFrame, systems: Sequence[str], negative: DataFrame | None = None,
                   ignore: DataFrame | None = None) -> DataFrame:
    """One row a system: exact counts and scores, full coverage, leaking documents, negatives hit (EVL1).

    ``predicted`` has a column system. Predictions inside an ignore span that touch no gold do not count.
    """
    keyed_gold = _keyed(_each(gold.select(*COORDINATES), systems))
    found = _keyed(predicted.where(F.col("system").isin(*systems)).select("system", *COORDINATES))
    if ignore is not None:
        found = spanjoin.countable_predictions(found, keyed_gold, _keyed(_each(ignore.select("doc_id", "start", "end"), systems)))
    counts = evaluate.outcomes(keyed_gold, found).groupBy(F.col("doc_id.system").alias("system")).agg(
        *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    per_document = spanjoin.covered(keyed_gold, found).groupBy("doc_id").agg(
        F.count("*").alias("gold"), F.count_if("covered").alias("covered"))
    coverage = per_document.groupBy(F.col("doc_id.system").alias("system")).agg(
        F.sum("gold").alias("gold"), F.sum("covered").alias("covered"), F.count("*").alias("positive"),
        F.count_if(F.col("covered") < F.col("gold")).alias("leaking"))
    out = evaluate.with_scores(counts).join(coverage, "system")
    if negative is None:
        return out
    hit = spanjoin.overlap_semi(_keyed(_each(negative.select("doc_id", "start", "end"), systems)), found)
    hits = hit.groupBy(F.col("doc_id.system").alias("system")).agg(F.count("*").alias("negatives_hit"))
    return out.join(hits, "system", "left").withColumn("negatives_hit", F.coalesce("negatives_hit", F.lit(0)))


def versions(gold: DataFrame, predicted: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every system against the one before it: spans lost, introduced and newly exposed, and whether it passes (EVL15)."""
    of = lambda name: predicted.where(F.col("system") == name).select(*COORDINATES)
    out = None
    for before, after in zip(order, order[1:]):
        changes = evaluate.nonregression(gold, of(before), of(after)).agg(
            F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"), F.coalesce(F.sum("introduced"), F.lit(0)).alias("introduced"))
        exposed = evaluate.newly_exposed(gold.select(*COORDINATES), of(before), of(after)).agg(F.count("*").alias("exposed"))
        row = changes.join(exposed).select(F.lit(before).alias("base"), F.lit(after).alias("candidate"), "lost", "introduced", "exposed")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passes", (F.col("lost") == 0) & (F.col("introduced") == 0) & (F.col("exposed") == 0))


def source_of(case_id: Column) -> Column:
    """The source of a case: what its id has after the last hyphen."""
    return F.substring_index(case_id, "-", -1)


def by_source(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts and scores by source (AGG17)."""
    flags = evaluate.outcomes(gold, predicted).withColumn("source", source_of(F.col("doc_id")))
    return evaluate.with_scores(flags.groupBy("source").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def paired_sources(gold: DataFrame, base: DataFrame, candidate: DataFrame) -> DataFrame:
    """By source, the F1 of two systems and what the second lost and introduced (EVL16)."""
    f1 = lambda df, name: by_source(gold, df).select("source", F.col("f1").alias(name))
    changes = evaluate.nonregression(gold, base, candidate).groupBy(source_of(F.col("doc_id")).alias("source")).agg(
        F.sum("lost").alias("lost"), F.sum("introduced").alias("introduced"))
    rows = f1(base, "f1_base").join(f1(candidate, "f1_candidate"), "source", "full").join(changes, "source", "left")
    return rows.na.fill(0, ["lost", "introduced"])


def replay(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs' spans with scores: those that only one has, and the largest gap of a score (AGG23)."""
    a = first.select(*COORDINATES, F.col("score").alias("a"))
    b = second.select(*COORDINATES, F.col("score").alias("b"))
    both = a.join(b, list(COORDINATES), "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"),
                    F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("largest_gap"))


def mapped(spans: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Spans with another scheme's types as this one's; types without a counterpart go (EVL5)."""
    names = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    return spans.withColumn("entity", F.try_element_at(names, F.col("entity"))).where(F.col("entity").isNotNull())


# --- structured fields ------------------------------------------------------------------------


def field_flags(leaves: DataFrame) -> DataFrame:
    """Leaves with what each counts as: target, exact type, fully masked, changed.

    ``leaves`` has original, tagged and starred values, the gold type (null for none), and
    whether the leaf is a key, ignored, or a hard negative.
    """
    target = F.col("gold").isNotNull()
    changed = ~F.col("tagged").eqNullSafe(F.col("original")) | ~F.col("starred").eqNullSafe(F.col("original"))
    exact = (F.col("tagged") == F.concat(F.lit("<"), F.col("gold"), F.lit(">"))) & (F.col("tagged") != F.col("original"))
    full = (F.col("starred") == F.repeat(F.lit("*"), F.length("original"))) & (F.col("starred") != F.col("original"))
    return leaves.withColumn("counts", ~F.col("is_key") & ~F.col("ignored")).withColumn("target", target).withColumn(
        "changed", changed).withColumn("exact", target & exact).withColumn("full", target & full)


def field_counters(leaves: DataFrame, by: Iterable[str] = ("system",)) -> DataFrame:
    """The counters of fields and records for each system (AGG14, EVL2-3)."""
    by = list(by)
    c, target = F.col("counts"), F.col("target")
    number = lambda condition, name: F.count_if(condition).alias(name)
    records = field_flags(leaves).groupBy(*by, "doc_id").agg(
        number(c & target, "targets"), number(c & F.col("exact"), "exact_type"), number(c & F.col("full"), "fully_masked"),
        number(c & ~target, "others"), number(c & ~target & F.col("changed"), "others_changed"),
        number(c & ~target & F.col("negative"), "negatives"), number(c & ~target & F.col("negative") & F.col("changed"), "negatives_changed"),
        number(~F.col("is_key") & F.col("ignored"), "ignored"), number(F.col("is_key") & F.col("changed"), "keys_changed"))
    positive = F.col("targets") > 0
    names = ["targets", "exact_type", "fully_masked", "others", "others_changed", "negatives", "negatives_changed", "ignored", "keys_changed"]
    return records.groupBy(*by).agg(
        *(F.sum(n).alias(n) for n in names), number(positive, "positive_records"),
        number(positive & (F.col("fully_masked") < F.col("targets")), "positive_records_leaking"),
        number(~positive, "negative_records"), number(~positive & (F.col("others_changed") > 0), "negative_records_changed"))


def field_types(leaves: DataFrame) -> DataFrame:
    """By system and gold type: fields, exact types, full masks, and fields tagged as another type (AGG14)."""
    rows = field_flags(leaves).where(F.col("counts") & F.col("target"))
    other = F.regexp_extract("tagged", r"\A<([A-Z_]+)>\z", 1)
    return rows.groupBy("system", "gold").agg(
        F.count("*").alias("fields"), F.count_if("exact").alias("exact_type"), F.count_if("full").alias("fully_masked"),
        F.count_if((other != "") & (other != F.col("gold"))).alias("wrong_type"))


# --- probes -----------------------------------------------------------------------------------


def probes(rows: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """Rows with their findings, for the two counts below."""
    return rows.withColumn("findings", detector.findings(F.col(text)))


def false_alarms(probed: DataFrame, by: str = "template") -> DataFrame:
    """Texts without personal data: how many are flagged, and with how many findings (EVL6, EVL8)."""
    return probed.groupBy(by).agg(F.count("*").alias("texts"), F.count_if(F.size("findings") > 0).alias("flagged"),
                                  F.sum(F.size("findings")).alias("findings"))


def mislabelled(probed: DataFrame, entity: str, by: str = "template") -> DataFrame:
    """Texts with an identifier of another kind: in how many one is taken for ``entity`` (EVL7-8)."""
    taken = F.exists("findings", lambda f: f["entity"] == entity)
    return probed.groupBy(by).agg(F.count("*").alias("texts"), F.count_if(taken).alias("mislabelled"))


def recalled(probed: DataFrame, masked: str = "masked") -> DataFrame:
    """Rows (entity, number, text, findings, starred text) with hit, covered and extra, for ``evaluate.recall_table`` (EVL8)."""
    start = F.expr("instr(text, number)") - 1
    end = start + F.length("number")
    own = lambda f: (f["entity"] == F.col("entity")) & (f["start"] == start) & (f["end"] == end)
    return probed.withColumn("hit", F.exists("findings", own)).withColumn(
        "covered", F.substring(F.col(masked), start + 1, F.length("number")) == F.repeat(F.lit("*"), F.length("number"))).withColumn(
        "extra", F.size(F.filter("findings", lambda f: ~own(f))))


# --- policies ---------------------------------------------------------------------------------


def grid(rows: DataFrame, **choices: Sequence) -> DataFrame:
    """Every row under every combination of the choices, one column a choice (EVL19)."""
    policies = [F.struct(*(F.lit(v).alias(n) for n, v in zip(choices, values))) for values in product(*choices.values())]
    return rows.withColumn("__policy", F.explode(F.array(*policies))).select(*rows.columns, "__policy.*")


def coverage_cutoff(reports: DataFrame, baseline: Mapping[str, float]) -> DataFrame:
    """The cutoff that covers most names, then masks least besides, then has the best F1, of those
    no worse than the baseline in any of covered, f1, false_sentences and extra_characters (SEL7)."""
    at_least = [F.col(n) >= baseline[n] for n in ("covered", "f1")]
    at_most = [F.col(n) <= baseline[n] for n in ("false_sentences", "extra_characters")]
    feasible = at_least[0] & at_least[1] & at_most[0] & at_most[1]
    return evaluate.choose(reports, feasible, [F.desc("covered"), "extra_characters", F.desc("f1"), "cutoff"])
