"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source gets a target number of words by weight, capped at ``cap`` times its
own size. A source's rows are dealt by a seeded hash into blocks, and the blocks
into a random order. As many whole passes over all blocks, and then blocks in that
order, are drawn as the target allows. The rows of the block where it ends and of the
one before are dealt into blocks again, until few are left; of these, rows are taken in
permuted order, and the last few by size to close the gap. The exact block quotas of all sources are
partitioned among the output shards by recursive halving, each half drawing its
counts from a multivariate hypergeometric distribution; a shard then owns a
disjoint range of each source's permuted draws and is shuffled locally.

Only one row per source reaches the driver (at most ``MAX_SOURCES``, checked).
Blocks of a source are bounded in number, so a hot source is spread over them.

Defined results: null text has size 0; null is a source of its own, ordered last;
a source of size 0 has target 0; null ids hash like any value; repeated rows and ids are
rows of their own; a text of any length is drawn whole or not; empty input gives empty
output. Other columns may have any name; they are ignored, and kept by ``draw``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.llm.common import named, row_hash
from maskloom.runtime import cut, ship

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
SHARDS, MAX_BLOCKS, BLOCK_ROWS = 64, 4096, 128
POOL, CLOSERS, LEVELS = 4, 16, 4
WORDS_PER_TASK = 1 << 22
MAX_SOURCES, BROADCAST_SOURCES = 1_000_000, 10_000
SEED = 20240611
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Split ``share`` of all sizes by weight; what exceeds ``cap`` times a size is
    shared again by weight among the others until none is above."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_tree(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Counts (source, shard): rows sum to the quotas, shards differ by rounding only."""
    counts = np.zeros((len(quotas), shards), np.int64)
    stack = [(np.asarray(quotas, np.int64), 0, shards)]
    while stack:
        have, first, width = stack.pop()
        if width == 1:
            counts[:, first] = have
            continue
        half = width // 2
        draw = int(have.sum()) * half // width
        rng = np.random.Generator(np.random.Philox(key=[seed, first * 2**32 + width]))
        # `marginals` draws source after source: no array as long as the population
        left = rng.multivariate_hypergeometric(have, draw, method="marginals") if len(have) else have
        stack += [(left, first, half), (have - left, first + half, width - half)]
    return counts


def _per_source(spark, rows: list[tuple], schema: str) -> DataFrame:
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_SOURCES else frame


def _collect_sources(df: DataFrame) -> list:
    rows = df.take(MAX_SOURCES + 1)
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: weights by source need a coarser source column")
    return rows


def _fit(sizes: np.ndarray, left: int) -> np.ndarray:
    """Which rows, given in permuted order, fill what the source has left: rows as they come until
    one does not fit, with the last ``CLOSERS`` of them and all behind chosen again, larger ones
    first; then the smallest other one if it brings the sum nearer."""
    upto = np.cumsum(sizes)
    first = max(0, int(np.searchsorted(upto, left, side="right")) - CLOSERS)
    take = np.zeros(len(sizes), np.int32)
    take[:first] = 1
    left -= int(upto[first - 1]) if first else 0
    order = first + np.argsort(-sizes[first:], kind="stable")
    for i in order.tolist():
        if sizes[i] <= left:
            take[i] = 1
            left -= int(sizes[i])
    others = [i for i in order.tolist() if not take[i]]
    if others and sizes[others[-1]] - left < left:
        take[others[-1]] = 1
    return take


def _blocks(rows: DataFrame, seed: int) -> DataFrame:
    """The blocks of rows (src, block, size, quota) in their random order: whether a block is drawn
    whole (extra), what of the quota is left before it, and whether the quota ends in it (edge) or
    in the one behind it (near holds for both)."""
    blocks = rows.groupBy("src", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("quota").alias("quota"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "block"), "block")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("pos", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(running))
    ends = (F.col("upto") > F.col("quota")) & (F.col("upto") - F.col("words") < F.col("quota"))
    blocks = blocks.withColumn("edge", ends).withColumn("near", F.col("edge") | F.coalesce(F.lead("edge").over(order), F.lit(False)))
    # blocks of zero words behind the edge have upto == the edge's upto > quota: they are not drawn
    return blocks.select("src", "block", "pos", "n", "edge", "near", (F.col("upto") <= F.col("quota")).cast("int").alias("extra"),
                         (F.col("quota") - F.col("upto") + F.col("words")).alias("left"))


def _same(a: str, b: str):
    return F.col(f"{a}.src").eqNullSafe(F.col(f"{b}.src"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: float,
             shards: int, max_blocks: int, block_rows: int, seed: int) -> DataFrame:
    """Every row with id, key (a hash of the whole row), size, source_size, target, copies and the shards of its copies."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    sized = cut(docs.select(
        named(id_col).alias("id"), named(source_col).cast("string").alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), named(id_col), text).alias("h"), row_hash(docs).alias("key"),
    ))
    found = _collect_sources(sized.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    found.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
    aims = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, cap)
    many = lambda rows: int(min(max_blocks, max(1, rows // block_rows)))
    plan = []
    for row, aim in zip(found, aims):
        passes = int(aim // row["size"]) if row["size"] else 0
        plan.append((row["src"], row["size"], float(aim), passes, int(round(aim - passes * row["size"])), many(row["rows"])))
    planned = _per_source(spark, plan, "src string, source_size long, target double, passes int, quota long, blocks int")
    keyed = sized.alias("d").join(planned.alias("p"), _same("d", "p")).select(
        "id", "key", F.col("d.src").alias("src"), "size", "h", "source_size", "target", "passes", "quota",
        F.pmod("h", F.col("blocks").cast("long")).cast("int").alias("block"))
    blocks = cut(_blocks(keyed, seed))
    drawn = _collect_sources(blocks.groupBy("src").agg(
        F.sum("extra").alias("extra"), F.count("*").alias("n"), F.max(F.col("edge").cast("int")).alias("edge")))
    drawn.sort(key=lambda r: (r["src"] is None, r["src"] or ""))  # the tree draws source after source
    passes = {r[0]: r[3] for r in plan}
    counts = split_tree([r["n"] * passes[r["src"]] + r["extra"] + r["edge"] for r in drawn], shards, seed)
    starts = np.cumsum(counts, axis=1) - counts
    ranges = _per_source(spark, [(r["src"], starts[i].tolist(), r["n"], passes[r["src"]]) for i, r in enumerate(drawn)],
                         "src string, starts array<long>, drawn_blocks long, passes int")
    shard = lambda at: (F.size(F.filter("starts", lambda s: s <= at)) - 1).cast("int")
    placed = blocks.alias("b").join(ranges.alias("r"), _same("b", "r")).select(
        F.col("b.src").alias("src"), "block", "extra", "near", "left",
        F.expr("transform(sequence(0, passes), i -> i * drawn_blocks + pos)").alias("draws"), "starts",
    ).select("src", "block", "extra", "near", "left", F.transform("draws", shard).alias("places"))
    rows = keyed.alias("k").join(placed.alias("b"), _same("k", "b") & (F.col("k.block") == F.col("b.block"))).select(
        "id", "key", "size", "source_size", "target", "passes", "places", "k.src", "h", "extra", "near", "left")
    names = ["id", "key", "size", "source_size", "target", "passes", "places"]
    done, open_, level = [rows.where(~F.col("near")).select(*names, "extra")], rows.where("near").select(*names, "src", "h", "left"), 0
    while True:  # what is left of a quota ends in two blocks: deal their rows into blocks again, until they are few
        open_ = cut(open_)
        pools = _collect_sources(open_.groupBy("src").agg(F.count("*").alias("n"), F.max("left").alias("quota")))
        if max((r["n"] for r in pools), default=0) <= POOL * block_rows or level == LEVELS:
            break
        level += 1
        frame = _per_source(spark, [(r["src"], r["quota"], many(r["n"])) for r in pools], "src string, quota long, blocks int")
        again = open_.alias("o").join(frame.alias("f"), _same("o", "f")).select(
            *names, F.col("o.src").alias("src"), "h", "quota",
            F.pmod(F.xxhash64(F.lit(seed + level), "h"), F.col("blocks").cast("long")).cast("int").alias("block"))
        parts = cut(_blocks(again, seed + level))
        again = again.alias("k").join(parts.alias("b"), _same("k", "b") & (F.col("k.block") == F.col("b.block"))).select(
            *names, "k.src", "h", "left", "near", "extra")
        done.append(again.where(~F.col("near")).select(*names, "extra"))
        open_ = again.where("near").select(*names, "src", "h", "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "size", "key"], kind="stable").reset_index(drop=True)
        return pdf[names].assign(extra=_fit(pdf["size"].to_numpy(), int(pdf["left"].max())))

    kinds = {f.name: f.dataType for f in open_.schema}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names] + [T.StructField("extra", T.IntegerType())])
    taken = open_.groupBy("src").applyInPandas(choose, schema)
    for part in done:
        taken = taken.unionByName(part)
    copies = F.col("passes") + F.col("extra")
    return taken.select("id", "key", "size", "source_size", "target", copies.alias("copies"), F.slice("places", F.lit(1), copies).alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS,
        max_blocks: int = MAX_BLOCKS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """Every row with id, size, source_size, target, taken, copies and the shards of its copies."""
    rows = _planned(docs, id_col, text_col, source_col, weights, share, cap, shards, max_blocks, block_rows, seed)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
                       "copies", "shards")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS,
                max_blocks: int = MAX_BLOCKS, block_rows: int = BLOCK_ROWS, seed: int = SEED, words_per_task: int = WORDS_PER_TASK,
                shard_col: str | None = None) -> DataFrame:
    """The mixed rows themselves, repeats included: a row drawn twice comes twice, one not drawn goes.

    Rows lie by shard, and inside it by a seeded hash; a shard of more than ``words_per_task``
    words is dealt to several tasks. Columns are those of ``docs``, then ``shard_col`` if given.
    Rows are found again by id and a hash of the whole row; of rows that are equal in all, one
    stands for the draws of them all.
    """
    mixed = cut(_planned(docs, id_col, text_col, source_col, weights, share, cap, shards, max_blocks, block_rows, seed))
    words = mixed.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    tasks = max(1, -(-int(words) // (shards * words_per_task)))
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), named(id_col).alias("id"), row_hash(docs).alias("key"))
    if mixed.groupBy("id", "key").count().where(F.col("count") > 1).take(1):
        order = Window.partitionBy("id", "key").orderBy("key")
        rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1).drop("nth")
    draws = mixed.select(F.col("id").alias("of"), F.col("key").alias("key_of"), F.posexplode("shards").alias("copy", "shard"))
    joined = rows.join(draws, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("key_of")))
    mixed_up = F.xxhash64(F.lit(seed), "key", "copy")
    joined = joined.withColumn("at", mixed_up).withColumn("task", F.pmod("at", F.lit(tasks)))
    joined = joined.repartition(shards * tasks, "shard", "task").sortWithinPartitions("shard", "task", "at")
    return joined.select("row.*", *([F.col("shard").alias(shard_col)] if shard_col else []))


def draw(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, in their shards' order."""
    return materialise(docs, **options)
