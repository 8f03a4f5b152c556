"""Exact top-k inner product search by no-random-access aggregation (NRA).

The candidates are dealt into shards by a hash of their id. Within a shard every
dimension has a list of the candidates sorted by that component, read from its high end
for a positive query weight, from its low end for a negative one, and not at all for
zero. All lists are read in step, a chunk of entries at a time. A candidate's lower bound counts its unread components as the far end of
their lists, its upper bound counts them as the cursors' entries. Reading an entry changes
the lower bound and the number of unread components of its candidate alone. A candidate is
out for good when its upper bound falls below the k-th lower bound, and one not seen in any
list when the cursors' entries together do. Reading stops when k are left, or so few that
their scores are had sooner than by reading on; these are then resolved exactly from their
vectors.

A task holds one shard (about ``SHARD_ROWS`` candidates) and one block of queries, so
memory is bounded however many there are of either. For N candidates and Q queries
``N * ceil(Q / QUERY_BLOCK) + Q * ceil(N / SHARD_ROWS)`` rows are shuffled; with Q a fixed
share of N this grows with the square of N, as the number of scores asked for does.
Each task returns its k best a query; a partial aggregate and a merge of those lists
give the result.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part; shorter vectors count as padded with zeros; a query never finds its
own id; ties go to the smaller id; fewer than k candidates give fewer rows; null ids
take no part; repeated candidate rows are ranked each on its own, repeated query ids
are asked once (smallest vector); empty input gives empty output. Components are
scaled integers; scores are exact within 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import give_back, named
from maskloom.runtime import ship

K, SCALE = 10, 1024
LEFT = 16  # of one candidate in so many, the scores are had sooner than by reading on
SHARD_ROWS, QUERY_BLOCK = 8192, 16384
CHUNK, ROUNDS = 64, 24


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long; null where the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


class Lists:
    """The candidates of a shard as two lists for each dimension, from its low end and from its
    high end: who stands at a depth, and how far its component is from the other end."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        self.count, self.width = vectors.shape
        columns = vectors.astype(np.float64)
        order = np.argsort(columns, axis=0, kind="stable")
        value = np.take_along_axis(columns, order, 0)
        self.low, self.high = value[0], value[-1]
        self.who = np.concatenate((order, order[::-1]), 1)  # by depth, then the low and the high lists
        self.gain = np.concatenate((value[-1] - value, (value - value[0])[::-1]), 1)

    def nra(self, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """The candidates that may be among the k best, those of ``own`` left out, and how many
        entries of every list were read. Bounds are float64; a slack covers their rounding."""
        n, used = self.count, np.flatnonzero(query)
        allowed = np.ones(n, bool)
        allowed[own] = False
        if n - len(own) <= k or not len(used):
            return np.flatnonzero(allowed), 0
        weight = np.abs(query[used].astype(np.float64))
        lists = used + np.where(query[used] > 0, self.width, 0)
        far = float((query[used] * np.where(query[used] > 0, self.low[used], self.high[used])).sum())
        slack = 1e-9 * float(weight @ np.maximum(np.abs(self.low[used]), np.abs(self.high[used])))
        lower, unread = np.where(allowed, far, -np.inf), np.full(n, len(used))
        live, depth, step = None, 0, max(CHUNK, n // ROUNDS)
        while depth < n:
            upto = min(n, depth + step)
            who = self.who[depth:upto].take(lists, 1).ravel()
            lower += np.bincount(who, (self.gain[depth:upto].take(lists, 1) * weight).ravel(), n)
            unread -= np.bincount(who, minlength=n)
            depth = upto
            # an unread component adds what the cursor's entry would; which lists are unread is not
            # kept, so that of m unread ones the m largest count
            most = np.concatenate(([0.0], np.cumsum(np.sort(self.gain[depth - 1, lists] * weight)[::-1])))
            kth = np.partition(lower, n - k)[n - k] - slack
            if live is None:
                if far + most[-1] >= kth:
                    continue  # a candidate not seen yet may still be among the best
                live = np.flatnonzero((unread < len(used)) & allowed)
            live = live[lower[live] + most[unread[live]] >= kth]
            if len(live) <= max(k, n // LEFT):
                break
        return (np.flatnonzero(allowed) if live is None else live), depth


def _search(k: int):
    def of(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score", "depth"]
        if not len(candidates) or not len(queries):
            return pd.DataFrame({n: [] for n in names}).astype("int64")
        width = max(max(map(len, candidates["v"])), max(map(len, queries["v"])), 1)

        def pack(vs) -> np.ndarray:
            out = np.zeros((len(vs), width), np.int64)
            for i, v in enumerate(vs):
                out[i, : len(v)] = v
            return out

        ids, asked = candidates["id"].to_numpy(), queries["id"].to_numpy()
        q, lists = pack(queries["v"]), Lists(pack(candidates["v"]))
        place: dict[int, list[int]] = {}
        for i in np.flatnonzero(np.isin(ids, asked)):
            place.setdefault(int(ids[i]), []).append(int(i))
        out: list[np.ndarray] = []
        for i, one in enumerate(asked.tolist()):
            at, depth = lists.nra(q[i], np.array(place.get(one, []), np.int64), k)
            score = lists.x[at] @ q[i]
            best = np.lexsort((ids[at], -score))[:k]
            out.append(np.stack((np.full(len(best), one), ids[at][best], score[best], np.full(len(best), depth)), 1))
        give_back()
        return pd.DataFrame(np.concatenate(out), columns=names)

    return of


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, depth): the k best of ``vectors`` for each row of ``queries``;
    depth is how many entries of each list the row's shard had read for the query when it stopped."""
    ship(vectors.sparkSession)
    take = lambda df: df.select(
        named(id_col).cast("long").alias("id"), scaled(named(vector_col), scale).alias("v")).where("id is not null and v is not null")
    have = take(vectors)
    asked = take(queries).groupBy("id").agg(F.min("v").alias("v"))
    size, many = have.count(), asked.count()
    shards, blocks = max(1, -(-size // shard_rows)), max(1, -(-many // query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = have.withColumn("shard", deal(shards, 1)).withColumn("block", every(blocks))
    right = asked.withColumn("block", deal(blocks, 2)).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long, depth long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "depth")


