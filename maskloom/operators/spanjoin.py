"""Joins of long-form span tables (doc_id, entity, start, end, ...).

A pair of overlapping spans shares a bucket of ``WIDTH`` positions of its document, so
overlap joins are equi-joins on (doc_id, bucket) with a residual range condition: one
very long document spreads over its buckets, and no pair is emitted twice (only the
bucket where the later of the two starts lies counts).
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.runtime import ship

WIDTH = 512
KEY = ("doc_id",)


def _bucketed(spans: DataFrame) -> DataFrame:
    first, last = F.floor(F.col("start") / WIDTH), F.floor((F.col("end") - 1) / WIDTH)
    return spans.withColumn("__b", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, suffix: str = "_r", on: tuple[str, ...] = KEY) -> DataFrame:
    """Each pair of overlapping spans of a document once; right columns get ``suffix``. Touching spans do not overlap."""
    l, r = _bucketed(left), _bucketed(right)
    r = r.select(*(F.col(c).alias(c if c in on or c == "__b" else c + suffix) for c in r.columns))
    start, end = F.col(f"start{suffix}"), F.col(f"end{suffix}")
    joined = l.join(r, [*on, "__b"]).where((F.col("start") < end) & (start < F.col("end")))
    return joined.where(F.col("__b") == F.floor(F.greatest("start", start) / WIDTH)).drop("__b")


def _match(left: DataFrame, right: DataFrame, how: str, condition: Column, on: tuple[str, ...]) -> DataFrame:
    return left.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, (F.col(f"l.{c}") == F.col(f"r.{c}") for c in on)) & condition, how)


def overlap_semi(left: DataFrame, right: DataFrame, anti: bool = False, on: tuple[str, ...] = KEY) -> DataFrame:
    """Left spans that overlap some (or with ``anti`` no) right span of their document (JOI1, JOI8)."""
    keyed = left.withColumn("__row", F.struct(*on, "start", "end"))
    hit = overlap_pairs(left.select(*on, "start", "end"), right.select(*on, "start", "end"), on=on)
    hit = hit.select(F.struct(*on, "start", "end").alias("__row")).distinct()
    return keyed.join(hit, "__row", "left_anti" if anti else "left_semi").drop("__row")


def inside_semi(left: DataFrame, right: DataFrame, on: tuple[str, ...] = KEY) -> DataFrame:
    """Left spans that lie wholly inside some right span."""
    pairs = overlap_pairs(left.select(*on, "start", "end"), right.select(*on, "start", "end"), on=on)
    hit = pairs.where((F.col("start_r") <= F.col("start")) & (F.col("end") <= F.col("end_r"))).select(*on, "start", "end").distinct()
    return left.join(hit, [*on, "start", "end"], "left_semi")


def same_span_anti(left: DataFrame, right: DataFrame, on: tuple[str, ...] = KEY) -> DataFrame:
    """Left spans whose coordinates no right span has (JOI3)."""
    return left.join(right.select(*on, "start", "end").distinct(), [*on, "start", "end"], "left_anti")


def veto(candidates: DataFrame, entity: str = "KR_ACCOUNT", protect: float = 0.4) -> DataFrame:
    """Without spans of ``entity`` that overlap a span of another entity at ``protect`` or above (GAT6)."""
    weak = F.col("entity") == entity
    return candidates.where(~weak).unionByName(
        overlap_semi(candidates.where(weak), candidates.where(~weak & (F.col("score") >= protect)), anti=True))


def _cluster_numbers(rows: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Numbers of the clusters that spans chain into by overlap; rows are sorted by ``by``, start and end."""
    keys = rows[list(by)]
    fresh = (keys != keys.shift()).any(axis=1).to_numpy()
    group = fresh.cumsum()
    reach = rows["end"].groupby(group).cummax().groupby(group).shift()
    return (fresh | (rows["start"] >= reach).to_numpy()).cumsum() - 1


def _by_cluster(spans: DataFrame, by: Sequence[str], resolve: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """The spans that ``resolve`` keeps, cluster by cluster: sorted by Spark, which spills, and read as a
    stream, so that a task holds a batch or the largest cluster, not a document."""
    ship(spans.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            number = _cluster_numbers(rows, by)
            done = number < number[-1]
            if done.any():
                yield rows[done][resolve(rows[done], number[done])]
            held = rows[~done].reset_index(drop=True)
        if held is not None:
            yield held[resolve(held, np.zeros(len(held), np.int64))]

    return spans.repartition(*by).sortWithinPartitions(*by, "start", "end").mapInPandas(of, spans.schema)


def _contested(number: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, bool]]]:
    """Which rows are alone in their cluster; the others by cluster and keys, with whether a new cluster begins."""
    alone = np.bincount(number)[number] == 1
    order = np.lexsort((*reversed(keys), number))
    order = order[~alone[order]]
    begins = np.diff(number[order], prepend=-1) != 0
    return alone, zip(order.tolist(), begins.tolist())


def _uncontained(rows: pd.DataFrame, number: np.ndarray) -> np.ndarray:
    """Better spans first; those that have been contain a span if the furthest end of the ones that begin
    no later reaches its end. Only spans that reach further than all that begin before are remembered."""
    start, end, score = (rows[c].to_numpy() for c in ("start", "end", "score"))
    keep, order = _contested(number, -score, start, -end)
    starts, ends, before, verdict = [], [], None, True
    for i, begins in order:
        s, e = start[i], end[i]
        if begins:
            starts, ends, before = [], [], None
        if before != (score[i], s, e):  # equal spans share a verdict
            at = bisect.bisect_right(starts, s)
            before, verdict = (score[i], s, e), not (at and ends[at - 1] >= e)
            if verdict:
                first = at - 1 if at and starts[at - 1] == s else at
                upto = bisect.bisect_right(ends, e, lo=at)  # those that begin later and reach no further
                starts[first:upto], ends[first:upto] = [s], [e]
        keep[i] = verdict
    return keep


def drop_contained(spans: DataFrame) -> DataFrame:
    """Without spans inside a better one of the same entity, and without zero scores (JOI2)."""
    return _by_cluster(spans.where(F.col("score") != 0).distinct(), ("doc_id", "entity"), _uncontained)


def prefix_max_end(spans: DataFrame) -> DataFrame:
    """Each span with the greatest end so far, and the number of spans so far (WIN1-3)."""
    ordered = Window.partitionBy("doc_id").orderBy("start", "end", "entity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spans.withColumn("max_end", F.max("end").over(ordered)).withColumn("seen", F.count("*").over(ordered))


def adjacent_overlaps(spans: DataFrame) -> DataFrame:
    """Spans that start before their predecessor ends (WIN5)."""
    ordered = Window.partitionBy("doc_id").orderBy("start", "end", "entity")
    return spans.withColumn("previous_end", F.lag("end").over(ordered)).where(F.col("previous_end") > F.col("start"))


def _disjoint(rows: pd.DataFrame, number: np.ndarray) -> np.ndarray:
    """Best first, each kept if it overlaps none of those kept, which lie sorted and apart."""
    start, end = rows["start"].to_numpy(), rows["end"].to_numpy()
    keep, order = _contested(number, -rows["score"].to_numpy(), rows["rank"].to_numpy(), start, end)
    starts, ends = [], []
    for i, begins in order:
        if begins:
            starts, ends = [], []
        s, e = start[i], end[i]
        at = bisect.bisect_right(starts, s)
        if not (at and s < ends[at - 1] and starts[at - 1] < e) and not (at < len(starts) and s < ends[at] and starts[at] < e):
            starts.insert(at, s)
            ends.insert(at, e)
            keep[i] = True
    return keep


def greedy_select(spans: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """The best disjoint spans of each document (SEL1): score, entity priority, start, end."""
    from maskloom.functions import vocab as V

    rank = F.lit(99)
    for entity, at in (priority or V.PRIORITY).items():
        rank = F.when(F.col("entity") == entity, at).otherwise(rank)
    rows = spans.select("doc_id", "entity", "start", "end", "score", rank.alias("rank"))
    return _by_cluster(rows, ("doc_id",), _disjoint).drop("rank")


def disjoint_insert(accepted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accepted spans, and of the candidates disjoint from them the best disjoint ones (JOI16)."""
    free = overlap_semi(candidates, accepted, anti=True)
    columns = ["doc_id", "entity", "start", "end", "score"]
    return accepted.select(*columns).unionByName(greedy_select(free, {}).select(*columns))


def overlap_characters(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Characters that each gold span shares with (disjoint) predictions (JOI5)."""
    pairs = overlap_pairs(gold.select("doc_id", "entity", "start", "end"), predicted.select("doc_id", "start", "end"))
    shared = F.least("end", "end_r") - F.greatest("start", "start_r")
    return pairs.groupBy("doc_id", "entity", "start", "end").agg(F.sum(shared).alias("shared"))


def merged(spans: DataFrame) -> DataFrame:
    """The union of each document's spans as disjoint spans (gaps and islands)."""
    ordered = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("doc_id", "start", "end").withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    # equal spans share an island in whatever order they come
    numbered = marked.withColumn("island", F.sum("new").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def covered(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold spans with whether the union of predictions covers every character (JOI6)."""
    shared = overlap_characters(gold, merged(predicted))
    return gold.join(shared, ["doc_id", "entity", "start", "end"], "left").withColumn(
        "covered", F.coalesce(F.col("shared"), F.lit(0)) == F.col("end") - F.col("start")).drop("shared")


def countable_predictions(predicted: DataFrame, gold: DataFrame, ignore: DataFrame) -> DataFrame:
    """Without predictions inside an ignore span that touch no gold span (JOI7)."""
    free = overlap_semi(predicted, gold, anti=True)
    dropped = inside_semi(free, ignore).select("doc_id", "entity", "start", "end").distinct()
    return predicted.join(dropped, ["doc_id", "entity", "start", "end"], "left_anti")


def confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(gold, predicted) entity pairs on equal coordinates, counted (JOI4, AGG7)."""
    p = predicted.select("doc_id", "start", "end", F.col("entity").alias("predicted"))
    both = gold.select("doc_id", "start", "end", F.col("entity").alias("gold")).join(p, ["doc_id", "start", "end"])
    return both.where(F.col("gold") != F.col("predicted")).groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def output_offsets(findings: DataFrame, replacement_length: Column) -> DataFrame:
    """Where each replacement lies in the masked text (WIN4)."""
    ahead = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = findings.withColumn("__n", replacement_length)
    shift = F.coalesce(F.sum(F.col("__n") - (F.col("end") - F.col("start"))).over(ahead), F.lit(0))
    return rows.withColumn("output_start", F.col("start") + shift).withColumn("output_end", F.col("output_start") + F.col("__n")).drop("__n")
