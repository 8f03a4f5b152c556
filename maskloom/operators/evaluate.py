"""Quality measurement over span tables: set algebra, metrics, gates (SET*, AGG*, EVL*).

``gold`` and ``predicted`` are long-form: doc_id, entity, start, end. Counting is one
shuffle: both sides are tagged, united and grouped by span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators import spanjoin
from maskloom.runtime import ship

SPAN = ("doc_id", "entity", "start", "end")


def ratio(a: Column, b: Column, zero: float | None = None) -> Column:
    """a / b; ``zero`` (null by default) where b is 0."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if zero is None else F.coalesce(out, F.lit(float(zero)))


def with_scores(counts: DataFrame, zero: float | None = None) -> DataFrame:
    """Counts tp, fp, fn with precision, recall and F1 (AGG1)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (counts.withColumn("precision", F.round(ratio(tp, tp + fp, zero), 6))
            .withColumn("recall", F.round(ratio(tp, tp + fn, zero), 6))
            .withColumn("f1", F.round(ratio(2 * tp, 2 * tp + fp + fn, zero), 6)))


def outcomes(gold: DataFrame, predicted: DataFrame, key: Iterable[str] = SPAN) -> DataFrame:
    """Each distinct span with flags tp, fp, fn (SET1), by one grouping of the tagged union."""
    key = list(key)
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        predicted.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    flags = both.groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return flags.select(*key, (F.col("g") * F.col("p")).cast("long").alias("tp"),
                        ((1 - F.col("g")) * F.col("p")).cast("long").alias("fp"), (F.col("g") * (1 - F.col("p"))).cast("long").alias("fn"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]


def by_entity(gold: DataFrame, predicted: DataFrame, zero: float | None = None) -> DataFrame:
    """tp, fp, fn and scores of each entity (AGG2)."""
    return with_scores(outcomes(gold, predicted).groupBy("entity").agg(*_sums()), zero)


def rollup(gold: DataFrame, predicted: DataFrame, track: str = "track", zero: float | None = 0.0) -> DataFrame:
    """The counters in total, by entity, by track, and by both (AGG8). Both tables carry the track."""
    flags = outcomes(gold, predicted, (*SPAN, track))
    sets = [[], [F.col("entity")], [F.col(track)], [F.col(track), F.col("entity")]]
    return with_scores(flags.groupingSets(sets, track, "entity").agg(*_sums()), zero)


def slices(rows: DataFrame, first: str, dimensions: Iterable[str]) -> DataFrame:
    """tp, fp, fn by ``first`` alone and by it with each dimension (AGG9-10)."""
    names = list(dimensions)
    sets = [[F.col(first)], *([F.col(first), F.col(d)] for d in names)]
    return rows.groupingSets(sets, first, *names).agg(*_sums())


def merge_shards(reports: DataFrame, by: str = "entity") -> DataFrame:
    """Shard counts summed, ratios computed anew (AGG15)."""
    return with_scores(reports.groupBy(by).agg(*_sums()))


def coverage(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per entity and in total: gold spans, and those whose every character is predicted (AGG3)."""
    flags = spanjoin.covered(gold, predicted)
    return flags.groupingSets([[], [F.col("entity")]], "entity").agg(
        F.count("*").alias("gold"), F.count_if("covered").alias("covered"))


def leak_rates(documents: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Documents with gold that leak some of it, and documents without gold that are flagged (AGG4)."""
    per_gold = spanjoin.covered(gold, predicted).groupBy("doc_id").agg(F.bool_and("covered").alias("safe"))
    flagged = predicted.select("doc_id", F.lit(True).alias("flagged")).distinct()
    rows = documents.select("doc_id").join(per_gold, "doc_id", "left").join(flagged, "doc_id", "left")
    positive = F.col("safe").isNotNull()
    counts = rows.agg(
        F.count_if(positive).alias("positive"), F.count_if(positive & ~F.col("safe")).alias("leaking"),
        F.count_if(~positive).alias("negative"), F.count_if(~positive & F.col("flagged").isNotNull()).alias("flagged"))
    return counts.withColumn("leak_rate", F.round(ratio(F.col("leaking"), F.col("positive")), 6)).withColumn(
        "false_rate", F.round(ratio(F.col("flagged"), F.col("negative")), 6))


def character_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Character precision, recall and over-masking (AGG5)."""
    shared = spanjoin.overlap_characters(spanjoin.merged(gold).withColumn("entity", F.lit("")), spanjoin.merged(predicted))
    total = lambda df, name: df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(name))
    row = total(spanjoin.merged(gold), "gold_chars").join(total(spanjoin.merged(predicted), "predicted_chars")).join(
        shared.agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("shared_chars")))
    return (row.withColumn("precision", F.round(ratio(F.col("shared_chars"), F.col("predicted_chars")), 6))
            .withColumn("recall", F.round(ratio(F.col("shared_chars"), F.col("gold_chars")), 6))
            .withColumn("over_masked", F.col("predicted_chars") - F.col("shared_chars")))


def ignore_stats(ignore: DataFrame) -> DataFrame:
    """Number, characters and longest of the ignore spans (AGG6)."""
    n = F.col("end") - F.col("start")
    return ignore.agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.max(n).alias("longest"))


def negative_hits(negative: DataFrame, predicted: DataFrame) -> DataFrame:
    """Negative spans, and those that a prediction touches (JOI8)."""
    return negative.agg(F.count("*").alias("negatives")).join(
        spanjoin.overlap_semi(negative, predicted).agg(F.count("*").alias("hit")))


def by_applied_operation(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Recall by each operation that was applied to a gold span; 'none' stands for no operation (AGG11)."""
    found = predicted.select(*SPAN).distinct().withColumn("hit", F.lit(1))
    rows = gold.join(found, list(SPAN), "left")
    ops = F.when(F.size("applied_ops") > 0, F.col("applied_ops")).otherwise(F.array(F.lit("none")))
    return rows.select(F.explode(ops).alias("operation"), F.coalesce("hit", F.lit(0)).alias("hit")).groupBy("operation").agg(
        F.count("*").alias("gold"), F.sum("hit").alias("tp"))


def boundary_taxonomy(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each gold span: exact, missed, partial (inside), overwide (around), boundary error, split (AGG12)."""
    key = list(SPAN)
    pairs = spanjoin.overlap_pairs(gold.select(*key), predicted.select(*key), on=("doc_id", "entity"))
    s, e, a, b = (F.col(c) for c in ("start", "end", "start_r", "end_r"))
    touched = pairs.groupBy(*key).agg(
        F.count("*").alias("n"), F.bool_or((a == s) & (b == e)).alias("exact"),
        F.bool_or((a <= s) & (b >= e)).alias("around"), F.bool_or((a >= s) & (b <= e)).alias("inside"))
    kind = (F.when(F.col("n").isNull(), "missed").when(F.col("exact"), "exact").when(F.col("n") > 1, "split")
            .when(F.col("around"), "overwide").when(F.col("inside"), "partial").otherwise("boundary_error"))
    return gold.select(*key).join(touched, key, "left").groupBy("entity", kind.alias("outcome")).agg(F.count("*").alias("n"))


def universal_groups(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Contrast groups with both polarities, and those that are right throughout (AGG13)."""
    groups = rows.groupBy(group).agg(
        F.bool_or("positive").alias("has_positive"), F.bool_or(~F.col("positive")).alias("has_negative"),
        F.bool_and("correct").alias("all_correct"))
    both = groups.where(F.col("has_positive") & F.col("has_negative"))
    return both.agg(F.count("*").alias("contrast_groups"), F.count_if("all_correct").alias("all_correct"))


def nonregression(gold: DataFrame, base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Spans lost (right before, gone now) and introduced (wrong now, not before), per document (SET2, JOI9)."""
    key = list(SPAN)
    tagged = None
    for at, df in enumerate((gold, base, candidate)):
        part = df.select(*key, *(F.lit(int(at == i)).alias(n) for i, n in enumerate("gbc")))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy(*key).agg(*(F.max(n).alias(n) for n in "gbc"))
    lost = (F.col("g") == 1) & (F.col("b") == 1) & (F.col("c") == 0)
    new = (F.col("g") == 0) & (F.col("b") == 0) & (F.col("c") == 1)
    return flags.groupBy("doc_id").agg(F.count_if(lost).alias("lost"), F.count_if(new).alias("introduced")).where(
        (F.col("lost") > 0) | (F.col("introduced") > 0))


def newly_exposed(gold: DataFrame, base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Gold spans that the base covered and the candidate no longer does (SET3)."""
    old = spanjoin.covered(gold, base).where("covered").drop("covered")
    return spanjoin.covered(old, candidate).where(~F.col("covered")).drop("covered")


def reconstruct(gold: DataFrame, missed: DataFrame, extra: DataFrame) -> DataFrame:
    """Predictions from gold without the missed and with the false (SET6)."""
    key = list(SPAN)
    return gold.select(*key).exceptAll(missed.select(*key)).unionByName(extra.select(*key)).distinct()


def parity(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two runs over the same cases: disagreeing spans, scores and masks, and the largest score gap (AGG22-23).

    Both have ``key``, spans (array), score and masked.
    """
    a = first.select(key, F.col("spans").alias("sa"), F.col("score").alias("pa"), F.col("masked").alias("ma"))
    b = second.select(key, F.col("spans").alias("sb"), F.col("score").alias("pb"), F.col("masked").alias("mb"))
    both = a.join(b, key, "full")
    differs = lambda x, y: F.count_if(~F.col(x).eqNullSafe(F.col(y)))
    return both.agg(F.count("*").alias("cases"), differs("sa", "sb").alias("spans"), differs("pa", "pb").alias("scores"),
                    differs("ma", "mb").alias("masks"), F.round(F.max(F.abs(F.col("pa") - F.col("pb"))), 6).alias("largest_gap"))


def first_failing_stage(gold: DataFrame, proposals: DataFrame, thresholded: DataFrame, filtered: DataFrame, final: DataFrame) -> DataFrame:
    """Where each lost gold span was lost (AGG18-19)."""
    key = list(SPAN)
    rows = gold.select(*key)
    for name, df in (("p", proposals), ("t", thresholded), ("f", filtered), ("o", final)):
        rows = rows.join(df.select(*key).distinct().withColumn(name, F.lit(True)), key, "left")
    stage = (F.when(F.col("p").isNull(), "no_exact_proposal").when(F.col("t").isNull(), "below_threshold")
             .when(F.col("f").isNull(), "filtered_out").when(F.col("o").isNull(), "overlap_blocked").otherwise("found"))
    return rows.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def macro_rank(reports: DataFrame) -> DataFrame:
    """Configurations by mean F1 over sources, then fewer false alarms, then threshold and earlier epoch (AGG25)."""
    return reports.groupBy("config", "threshold", "epoch").agg(
        F.round(F.avg("f1"), 6).alias("mean_f1"), F.sum("fp").alias("fp")).orderBy(
        F.desc("mean_f1"), "fp", F.desc("threshold"), "epoch")


def choose(configurations: DataFrame, feasible: Column, order: Iterable[Column]) -> DataFrame:
    """The best feasible configuration; none where none is feasible (SEL6-7, SEL11)."""
    return configurations.where(feasible).orderBy(*order).limit(1)


def violations(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a report row breaks; a null verdict counts as broken (EVL17, VAL9)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return metrics.withColumn("rule", F.explode(broken))


def consistent(metrics: DataFrame) -> DataFrame:
    """Reports whose counts and ratios contradict each other (VAL9)."""
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0)
    return violations(metrics, {
        "gold is tp plus fn": F.col("gold") == F.col("tp") + F.col("fn"), "covered within gold": F.col("covered").between(0, F.col("gold")),
        "f1 as recomputed": F.abs(F.col("f1") - f1) <= 1e-6,
    })


def bootstrap(per_document: DataFrame, repetitions: int = 500, seed: int = 2026) -> DataFrame:
    """Paired 95 % interval of F1(candidate) - F1(base) (AGG24).

    ``per_document`` has doc_id and tp, fp, fn of both systems (suffixes _b and _c). Documents
    are resampled with Poisson(1) weights. Those with equal counts are alike, and n of them weigh
    Poisson(n) together, so one row for each distinct vector of counts is drawn for, by a
    generator that the vector seeds: reruns agree, and the work does not grow with the documents.
    """
    ship(per_document.sparkSession)
    names = [f"{c}_{s}" for s in "bc" for c in ("tp", "fp", "fn")]
    vectors = per_document.groupBy(*(F.col(n).cast("long").alias(n) for n in names)).agg(F.count("*").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((repetitions, len(names)))
        for batch in batches:
            for *counts, n in batch[[*names, "n"]].itertuples(index=False, name=None):
                generator = np.random.default_rng([seed, *counts])
                sums += generator.poisson(n, repetitions)[:, None] * np.array(counts, float)
        yield pd.DataFrame(sums, columns=names).assign(rep=np.arange(repetitions))

    drawn = vectors.mapInPandas(draw, ", ".join(f"{n} double" for n in names) + ", rep long")
    sums = drawn.groupBy("rep").agg(*(F.sum(n).alias(n) for n in names))
    f1 = lambda s: ratio(2 * F.col(f"tp_{s}"), 2 * F.col(f"tp_{s}") + F.col(f"fp_{s}") + F.col(f"fn_{s}"), 0.0)
    ordered = sums.select((f1("c") - f1("b")).alias("d")).agg(F.sort_array(F.collect_list("d")).alias("v"))
    pick = lambda q: F.round(F.get("v", F.lit(int(q * (repetitions - 1)))), 6)
    return ordered.select(pick(0.025).alias("low"), pick(0.5).alias("middle"), pick(0.975).alias("high"))


def recall_table(cases: DataFrame) -> DataFrame:
    """Hits, covered and extra findings by entity and template (AGG26). ``cases``: entity, template, hit, covered, extra."""
    return cases.groupBy("entity", "template").agg(
        F.count("*").alias("cases"), F.count_if("hit").alias("hits"), F.count_if("covered").alias("covered"), F.sum("extra").alias("extra"))


def error_ids(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Ids of documents with any wrong or missing span; never their text (AGG27)."""
    return outcomes(gold, predicted).where((F.col("fp") > 0) | (F.col("fn") > 0)).select("doc_id").distinct()


def medians(timings: DataFrame, by: str) -> DataFrame:
    return timings.groupBy(by).agg(F.round(F.median("ms"), 6).alias("median_ms"), F.count("*").alias("runs"))


def changed_characters(original: Column, masked: Column) -> Column:
    """Positions at which two texts of equal length differ (SET7)."""
    a, b = F.split(original, ""), F.split(masked, "")
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    marked = F.transform(same, lambda eq, i: F.struct((~eq).alias("d"), i.alias("i")))
    return F.transform(F.filter(marked, lambda m: m["d"]), lambda m: m["i"])


def rank_keep_first(rows: DataFrame, key: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """The first row of each key (WIN7)."""
    ordered = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") == 1).drop("__n")
