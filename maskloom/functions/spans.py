"""Interval kernels inside a row: half-open spans in arrays of structs with fields s and e.

Touching spans do not overlap (JOI1-2, SEL1). The long-form joins are in
``maskloom.operators.spanjoin``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.kernel import chained, let, none_of, running

SPAN = "struct<s:int,e:int,entity:string,rank:int,score:double,proof:boolean>"


def span(entity: Column, rank: Column, start: Column, end: Column, score: Column, proof: Column | None = None) -> Column:
    """A span; its order as a struct is that of starts. ``proof`` marks an account with evidence against a card."""
    return F.struct(
        start.cast("int").alias("s"), end.cast("int").alias("e"), entity.alias("entity"), rank.cast("int").alias("rank"),
        score.cast("double").alias("score"), (F.lit(False) if proof is None else F.coalesce(proof, F.lit(False))).alias("proof"))


def touches(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def overlaps_any(item: Column, others: Column) -> Column:
    return F.exists(others, lambda other: touches(item, other))


def without_overlap(items: Column, others: Column) -> Column:
    """Items that overlap none of the others (a range anti-join within the row)."""
    return F.when(F.size(others) == 0, items).otherwise(F.filter(items, lambda item: ~overlaps_any(item, others)))


def drop_contained(items: Column) -> Column:
    """Without items inside a better one of the same entity, and without zero scores.

    Better is a higher score, then an earlier start, then a longer span. Containment
    is transitive, so an item falls exactly when any better item contains it.
    """
    live = F.filter(items, lambda x: x["score"] != 0)

    def beats(y: Column, x: Column) -> Column:
        inside = (y["entity"] == x["entity"]) & (y["s"] <= x["s"]) & (y["e"] >= x["e"])
        longer = (y["s"] < x["s"]) | ((y["s"] == x["s"]) & (y["e"] > x["e"]))
        return inside & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & longer))

    def keep(all_: Column) -> Column:
        return F.filter(all_, lambda x: ~F.exists(all_, lambda y: beats(y, x)))

    return let(F.array_distinct(live), keep)


def _greedy(items: Column) -> Column:
    """Best first: score down, entity rank, start, end; each kept if disjoint from all kept."""
    keyed = F.transform(items, lambda x: F.struct(
        (-x["score"]).alias("k"), x["rank"].alias("r"), x["s"].alias("a"), x["e"].alias("b"), x.alias("x")))
    return F.aggregate(
        F.array_sort(keyed), none_of(SPAN),
        lambda kept, k: F.when(overlaps_any(k["x"], kept), kept).otherwise(chained(kept, F.array(k["x"]))))


def by_cluster(items: Column, resolve: Callable[[Column], Column]) -> Column:
    """``resolve`` applied to each cluster of spans that chain by overlap; results in order of clusters.

    Spans of different clusters never overlap, so what depends on overlaps can be
    decided cluster by cluster, and a document with many findings costs their number.
    """
    def split(view: Column) -> Column:
        x, first = view["x"], view["first"]

        def cluster(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(first, k + 1), F.size(x))
            return let(F.slice(x, start + 1, end - start), resolve)

        return F.flatten(F.transform(first, cluster))

    def bounded(x: Column) -> Column:
        reach = running(F.transform(x, lambda y: y["e"]), -1, lambda a, b: F.greatest(a, b))
        heads = let(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["s"] >= F.get(r, i)))
        return let(F.struct(x.alias("x"), F.when(F.size(x) == 1, F.array(F.lit(0))).otherwise(heads).alias("first")), split)

    def sorted_(x: Column) -> Column:
        pair = (F.size(x) == 2) & touches(F.get(x, F.lit(0)), F.get(x, F.lit(1)))
        return F.when((F.size(x) == 1) | pair, resolve(x)).otherwise(bounded(x))

    return F.when(F.size(items) == 0, items).otherwise(let(F.when(F.size(items) == 1, items).otherwise(F.array_sort(items)), sorted_))


def greedy(items: Column) -> Column:
    """The best disjoint spans of one cluster, by start."""
    return F.when(F.size(items) < 2, items).otherwise(F.array_sort(_greedy(items)))


def select_greedy(items: Column) -> Column:
    """The best disjoint spans, taken greedily; ordered by start."""
    return F.when(F.size(items) < 2, items).otherwise(by_cluster(items, greedy))
