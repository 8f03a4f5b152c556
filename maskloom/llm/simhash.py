"""SimHash near-dedup by a binary trie self-join.

Fingerprints (64 bits, one per document) are reduced to distinct values, each
represented by its smallest id. Values within ``budget`` differing bits agree on
at least one of ``budget + 1`` bit blocks, so the values are dealt out by (block
number, block value); every such group is a binary trie that is joined with
itself: node pairs are traversed together, differing bits are accumulated, and a
pair is dropped once it exceeds the budget. A group emits a spanning forest of
its links, never all pairs. Oversized groups are dealt out once more by a block
of their other bits, which loses no link. Connected components of the forest
edges give each document its class.

Defined results: null text and text without words have fingerprint zero and are
linked like any other; repeated rows share a fingerprint; null ids are kept, but
do not name a class unless no other row has their fingerprint (then the class is
null). Empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import give_back, named
from maskloom.llm.graph import components
from maskloom.runtime import cut, ship

BUDGET = 4
SHINGLE = 4
HOT_GROUP = 20_000
PAIRS_AT_ONCE, CHECKS_AT_ONCE = 1_000_000, 4_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash over the XXH64 (seed 42) of word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    count = len(words)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, count)
    ends = np.cumsum(lengths) + np.arange(count)
    starts = ends - lengths
    take = min(shingle, count)
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: count - take + 1].tolist(), ends[take - 1 :].tolist())],
        dtype=np.uint64,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row."""
    ship(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fp": np.array([fingerprint(t, shingle) for t in batch["text"]], np.int64)})
        give_back()

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInPandas(of, "id long, fp long")


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of nearly equal parts of ``width`` bits."""
    sizes = [width // parts + (i < width % parts) for i in range(parts)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(parts)]


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component after adding the links a-b to the labels."""
    while len(a):
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to ``most`` or little more."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def _expand(al, ah, bl, bh):
    """Index pairs of all node pairs: i < j inside a node, all across two nodes."""
    sizes = (ah - al) * (bh - bl)
    of = np.repeat(np.arange(len(al)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = (bh - bl)[of]
    i, j = al[of] + at // wide, bl[of] + at % wide
    keep = (al[of] != bl[of]) | (i < j)
    return i[keep], j[keep]


def trie_links(values: np.ndarray, groups: np.ndarray, budget: int, leaf: int = 64) -> np.ndarray:
    """Labels (smallest index of the component) of values that link within their group.

    ``values`` is uint64, sorted inside each group; ``groups`` has the start of each
    group and the total count. A first pass with a budget of one joins dense
    clusters, so that the pass with the full budget can skip node pairs whose
    members are all of one component already.
    """
    count = len(values)
    label = np.arange(count)
    ones: dict[int, np.ndarray] = {}

    def prefix(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))))
        return ones[bit]

    for limit in dict.fromkeys((min(1, budget), budget)):
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))) if count else label
        start, stop = groups[:-1], groups[1:]
        many = stop - start > 1
        start, stop = start[many], stop[many]
        stack = [(63, (start, stop, start, stop, np.zeros(len(start), np.int64)))]
        while stack:
            bit, pairs = stack.pop()
            al, ah, bl, bh, err = pairs
            if len(al) > PAIRS_AT_ONCE:
                half = len(al) // 2
                stack += [(bit, tuple(x[half:] for x in pairs)), (bit, tuple(x[:half] for x in pairs))]
                continue
            one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
            small = ~one & (((ah - al) * (bh - bl) <= leaf) | (bit < 0))
            if small.any():
                before = label
                for part in _parts((ah - al)[small] * (bh - bl)[small], CHECKS_AT_ONCE):
                    i, j = _expand(al[small][part], ah[small][part], bl[small][part], bh[small][part])
                    close = np.bitwise_count(values[i] ^ values[j]) <= limit
                    label = _roots(label.copy(), i[close], j[close])
                if (label != before).any():
                    changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            rest = ~one & ~small
            if bit < 0 or not rest.any():
                continue
            al, ah, bl, bh, err = (x[rest] for x in (al, ah, bl, bh, err))
            up = prefix(bit)
            am, bm = ah - (up[ah] - up[al]), bh - (up[bh] - up[bl])
            cross = al != bl
            new = [
                np.concatenate(x)
                for x in zip(
                    (al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1),
                    tuple(x[cross] for x in (am, ah, bl, bm, err + 1)),
                )
            ]
            al, ah, bl, bh, err = new
            keep = (ah > al) & (bh > bl) & (err <= limit) & ((al != bl) | (ah - al > 1))
            if keep.any():
                stack.append((bit - 1, tuple(x[keep] for x in new)))
    return label


def _forest(budget: int):
    """Links of each (k, key, j, sub) group of a partition that is sorted by group and value."""
    names = ["k", "key", "j", "sub"]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[names].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        groups = np.concatenate(([0], edge, [len(rows)]))
        label = trie_links(rows["u"].to_numpy().astype(np.uint64), groups, budget)
        ids = rows["id"].to_numpy()
        linked = np.flatnonzero(label != np.arange(len(rows)))
        return pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            batch["u"] = batch["fp"].to_numpy().view(np.uint64)
            last = (batch[names].to_numpy() != batch[names].to_numpy()[-1]).any(1)
            whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if whole:  # the groups that end inside this batch, the carried one included
                done = pd.concat([*held, batch.iloc[:whole]], ignore_index=True)
                held = []
                yield links(done)
            elif held and (held[-1][names].to_numpy()[-1] != batch[names].to_numpy()[0]).any():
                yield links(pd.concat(held, ignore_index=True))
                held = []
            held.append(batch.iloc[whole:])
        if held:
            yield links(pd.concat(held, ignore_index=True))
        give_back()

    return of


def link_edges(distinct: DataFrame, budget: int = BUDGET, hot_group: int = HOT_GROUP) -> DataFrame:
    """(a, b) forest edges between the ids of distinct fingerprints (fp, id)."""
    ship(distinct.sparkSession)
    blocks = _blocks(64, budget + 1)
    part = lambda shift, bits: F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1)
    dealt = distinct.select(
        "fp", "id",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), part(s, n).alias("key")) for k, (s, n) in enumerate(blocks)])).alias("b"),
    ).select("fp", "id", "b.k", "b.key")
    hot = dealt.groupBy("k", "key").count().where(F.col("count") > hot_group).select("k", "key", F.lit(True).alias("hot"))
    single = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("sub")))
    if hot.take(1):
        inner = F.lit(None)
        for k, (shift, bits) in enumerate(blocks):
            low = F.lit(0).cast("long") if shift == 0 else F.col("fp").bitwiseAND((1 << shift) - 1)
            high = F.lit(0).cast("long") if shift + bits == 64 else F.shiftleft(F.shiftrightunsigned("fp", shift + bits), shift)
            inner = F.when(F.col("k") == k, low.bitwiseOR(high)).otherwise(inner)
        rest = 64 - max(n for _, n in blocks)
        again = F.array(*[
            F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(F.col("inner"), s).bitwiseAND((1 << n) - 1).alias("sub"))
            for j, (s, n) in enumerate(_blocks(rest + 1, budget + 1))
        ])
        dealt = dealt.join(hot, ["k", "key"], "left").withColumn("inner", inner).select(
            "fp", "id", "k", "key", F.explode(F.when(F.col("hot"), again).otherwise(single)).alias("s"))
    else:
        dealt = dealt.select("fp", "id", "k", "key", F.explode(single).alias("s"))
    dealt = dealt.select("fp", "id", "k", "key", "s.j", "s.sub")
    # Signed order breaks at the sign bit, so order by it apart: then bits descend as in an unsigned value.
    ready = dealt.repartition("k", "key", "j", "sub").sortWithinPartitions("k", "key", "j", "sub", F.col("fp") < 0, "fp")
    return ready.mapInPandas(_forest(budget), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET,
                    shingle: int = SHINGLE, hot_group: int = HOT_GROUP) -> DataFrame:
    """Every row with id, fingerprint (16 hex digits) and component_id."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("id"))
    edges = link_edges(distinct.where(F.col("id").isNotNull()), budget, hot_group)
    found = components(edges)
    named = distinct.join(found, distinct["id"] == found["node"], "left").select(
        F.col("fp").alias("of"), F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("of")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that name their class: one document of each group stays (rows that repeat an id stay or go together)."""
    found = near_duplicates(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), "id", "text", **options)
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("stay"))
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), named(id_col).cast("long").alias("key"))
    return rows.join(stay, F.col("key").eqNullSafe(F.col("stay")), "left_semi").select("row.*")
