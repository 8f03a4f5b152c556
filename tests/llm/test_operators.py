"""Each operator against brute force on small fixtures, with the odd cases its docstring names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import exact, graph, html, langid, licenses, mixing, pieces, pii, queries, simhash, topk, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]), with extra columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, 1, 2, "x", "y") for r in rows]
    return spark.createDataFrame(full, DOC)


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two  three"), (5, "one two  three"), (6, "onetwo three"),
    (7, "a b ЖЖ \U0001F600"), (8, "word " * 30000), (None, "one two three"), (9, "one two three"),
]


# --- exact dedup


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (i, t), n in zip(rows, norm):
        groups.setdefault(n, []).append((-len(t or ""), i is None, i or 0, i))
    return sorted((str(i), str(min(groups[n])[3]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm))


def test_exact_dedup(spark):
    got = exact.exact_dedup(docs(spark, ODD)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_exact(ODD)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id is not None)
    assert exact.exact_dedup(docs(spark, [])).count() == 0


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    left = exact.drop_copies(docs(spark, ODD))
    assert left.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 8]


def test_drop_copies_with_repeated_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, row string, digest string, keep long, tie int, __keep long, nth int"
    rows = [(1, "a b", "r", "d", 0, 0, 0, 0), (1, "a  b", "r", "d", 0, 0, 0, 0), (1, "ab", "r", "d", 0, 0, 0, 0), (2, "a b", "r", "d", 0, 0, 0, 0),
            (3, "x", "r", "d", 0, 0, 0, 0), (3, "x", "r", "d", 0, 0, 0, 0), (3, "x", "other", "d", 0, 0, 0, 0), (3, "y", "r", "d", 0, 0, 0, 0),
            (None, "z", "r", "d", 0, 0, 0, 0), (None, "z", "r", "d", 0, 0, 0, 0), (4, None, "r", "d", 0, 0, 0, 0), (5, "", "r", "d", 0, 0, 0, 0)]
    table = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), r.text) for r in exact.drop_copies(table).collect())
    assert got == [("1", "a  b"), ("3", "x"), ("3", "y"), ("4", None), ("None", "z")]
    again = exact.drop_copies(table.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, exact.drop_copies(table).collect())) and exact.drop_copies(table).columns == table.columns
    assert exact.drop_copies(table.where("false")).count() == 0


# --- SimHash


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def brute_components(values):
    """values: {id: fingerprint} -> {id: smallest id reachable}"""
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(values[a] ^ values[b]).count("1") <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 40, 300)))] for _ in range(60)]
    rows = []
    for i in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = f"W{rng.randrange(400)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(1, None), (2, "  "), (3, "Äb C"), (3, "Äb C")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)
    assert simhash.near_duplicates(docs(spark, rows)).count() == len(rows)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, rows)).select("doc_id").distinct().count() == len(set(want.values()))


def test_keep_one_with_clashing_columns(spark):
    schema = "doc_id long, text string, __stay long, stay long, key long, row string, id long, fp long"
    rows = [(1, "same words here", 9, 9, 9, "r", 9, 9), (2, "same words here", 9, 9, 9, "r", 9, 9), (3, "quite another text", 9, 9, 9, "r", 9, 9), (3, "quite another text", 9, 9, 9, "r", 9, 9)]
    left = simhash.keep_one(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, left.collect())) == [rows[0], rows[2], rows[3]]


def test_many_close_values_are_compared_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 2**63, 30, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (30, 20), dtype=np.uint64)))
    whole = simhash.trie_links(values, np.array([0, len(values)]), 4)
    monkeypatch.setattr(simhash, "CHECKS_AT_ONCE", 7)
    assert (simhash.trie_links(values, np.array([0, len(values)]), 4) == whole).all()


@pytest.mark.parametrize("hot", [5, 10**9])
def test_link_edges_with_and_without_hot_groups(spark, hot):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 25, dtype=np.uint64)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(12):
            v = int(s)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    table = {i: v for i, v in enumerate(sorted(values))}
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in table.items()], "fp long, id long")
    found = {r.node: r.component for r in graph.components(simhash.link_edges(rows, 4, hot)).collect()}
    assert {i: found.get(i, i) for i in table} == brute_components(table)


def test_trie_links_dense_cluster():
    values = np.array(sorted({(a << 60) | (1 << b) | (1 << c) for a in (1, 9) for b in range(40) for c in range(40)}), np.uint64)
    label = simhash.trie_links(values, np.array([0, len(values)]), 4)
    want = brute_components({i: int(v) for i, v in enumerate(values)})
    assert label.tolist() == [want[i] for i in range(len(values))]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_components_never_stop_early(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(edges, max_rounds=1)
    assert graph.components(edges.where("false"), max_rounds=0).count() == 0


# --- mixing


def brute_targets(sizes, weights):
    total, cap = 1.5 * sum(sizes), [2 * s for s in sizes]
    out, capped = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s == 0}
    while len(capped) < len(sizes):
        rest = total - sum(cap[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        new = {i for i in range(len(sizes)) if i not in capped and rest * weights[i] / w > cap[i]}
        out = [cap[i] if i in capped else rest * weights[i] / w for i in range(len(sizes))]
        if not new:
            return out
        capped |= new
    return [float(c) for c in cap]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), None, rng.choice(["a", "b", "b", "b", "B", "é", None])) for i in range(900)]
    rows += [(900, None, None, "nothing"), (901, "x", None, "tiny"), (None, "x y", None, "tiny")]
    got = mixing.mix(docs(spark, rows), block_rows=32).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = [sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == n) for n in names]
    aims = dict(zip(names, brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])))
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        n = source[r.doc_id]
        assert r.target == pytest.approx(aims[n]) and r.source_size == sizes[names.index(n)]
        assert r.taken == r.size * r.copies <= 2 * r.size and len(r.shards) == r.copies
        taken[n] = taken.get(n, 0) + r.taken
    for n, t in taken.items():
        assert abs(t - aims[n]) <= 2, (n, t, aims[n])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows).repartition(7), block_rows=32).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0


def spark_hash(*values):
    """xxhash64 of integers (int32 as ("i", n)), longs and strings as Spark chains it; nulls count for nothing."""
    from xxhash import xxh64_intdigest

    h = 42
    for v in values:
        if v is not None:
            data = v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode()
            h = xxh64_intdigest(data, h)
    return h - 2**64 if h >= 2**63 else h


def brute_mix(rows, shards, block_rows, seed=mixing.SEED):
    """{id: (copies, shards)} by the module's docstring, source by source and row by row; ids are unique."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = [sum(size[i] for i, _, s in rows if s == n) for n in names]
    aims = brute_targets(total, [(3, 1, 2)[i % 3] for i in range(len(names))])
    per, quotas, out = {}, [], {}
    for n, words, aim in zip(names, total, aims):
        mine = [(spark_hash(("i", seed), i, t or ""), size[i], i) for i, t, s in rows if s == n]
        many, passes = max(1, len(mine) // block_rows), int(aim // words) if words else 0
        quota = round(aim - passes * words)
        blocks = {}
        for h, w, i in mine:
            blocks.setdefault(h % many, []).append((h, w, i))
        order = sorted(blocks, key=lambda b: (spark_hash(("i", seed), n, ("i", b)), b))
        upto, extra, edge = 0, {}, None
        for at, b in enumerate(order):
            w = sum(x[1] for x in blocks[b])
            extra[b] = upto + w <= quota
            if upto < quota < upto + w:
                edge = at
            upto += w
        near = order[max(0, edge - 1) : edge + 1] if edge is not None else []
        left = quota - sum(x[1] for b in order[: order.index(near[0])] for x in blocks[b]) if near else 0
        pool = sorted(x for b in near for x in blocks[b])
        taken, gap = [], left
        for x in pool:  # as they come, until one does not fit
            if x[1] > gap:
                break
            taken.append(x)
            gap -= x[1]
        keep = taken[: max(0, len(taken) - mixing.CLOSERS)]
        gap, rest = left - sum(x[1] for x in keep), sorted(pool[len(keep) :], key=lambda x: -x[1])
        chosen = {x[2] for x in keep}
        for x in rest:
            if x[1] <= gap:
                chosen.add(x[2])
                gap -= x[1]
        others = [x for x in rest if x[2] not in chosen]
        if others and others[-1][1] - gap < gap:
            chosen.add(others[-1][2])
        per[n] = (order, blocks, passes, {i: int(i in chosen if b in near else extra[b]) for b in order for _, _, i in blocks[b]})
        quotas.append(len(order) * passes + sum(extra.values()) + (edge is not None))
    counts = mixing.split_tree(quotas, shards, seed)
    for row, n in zip(counts, names):
        order, blocks, passes, more = per[n]
        owner = np.repeat(np.arange(shards), row)
        for at, b in enumerate(order):
            for _, _, i in blocks[b]:
                copies = passes + more[i]
                places = [c * len(order) + at for c in range(copies)]
                out[i] = copies, [int(owner[p]) if p < len(owner) else shards - 1 for p in places]
    return out


def test_mix_against_brute_force(spark):
    rng = random.Random(17)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(700)] + [(900, None, "empty"), (901, "x " * 5000, "c")]
    want = brute_mix(rows, 8, 16)
    got = {r.doc_id: (r.copies, list(r.shards)) for r in mixing.mix(docs(spark, [(i, t, None, s) for i, t, s in rows]), shards=8, block_rows=16).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert got == want


def test_split_tree_is_exact_and_even():
    counts = mixing.split_tree([1000, 3, 0, 77], 13)
    assert counts.sum(1).tolist() == [1000, 3, 0, 77]
    assert counts.sum(0).max() - counts.sum(0).min() <= 4 and (counts >= 0).all()


def test_materialised_shards(spark):
    rows = docs(spark, [(i, "w " * (i % 9 + 1), None, "abc"[i % 3]) for i in range(60)])
    options = {"shards": 4, "block_rows": 8, "max_blocks": 4}
    want = {r.doc_id: sorted(r.shards) for r in mixing.mix(rows, **options).collect() if r.copies}
    out = mixing.materialise(rows, shard_col="shard", words_per_task=20, **options)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.shard)
    assert {i: sorted(s) for i, s in got.items()} == want and mixing.draw(rows, **options).columns == rows.columns
    places = out.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(places) > 4  # a shard of many words lies in several tasks


def test_edge_blocks_are_dealt_again_when_they_are_large(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 40), None, "a" if i % 5 else "b") for i in range(1200)]
    got = mixing.mix(docs(spark, rows), max_blocks=3, block_rows=16).collect()
    for name in "ab":
        some = [r for r in got if (r.doc_id % 5 == 0) == (name == "b")]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 2
    size = {c: [r.size for r in got if r.copies == c] for c in (1, 2)}  # drawn by blocks, not by size
    assert abs(np.mean(size[1]) - np.mean(size[2])) < 4


def test_draws_are_by_row_not_by_id(spark):
    clash = "doc_id long, text string, lang string, source string, n_chars long, __id long, __copies long, shard int, key string"
    rows = [(1, "a " * 50, None, "s", 0, 1, 1, 1, "k"), (1, "b", None, "s", 0, 1, 1, 1, "k"), (2, "c " * 10, None, "s", 0, 1, 1, 1, "k"),
            (None, "d " * 7, None, "t", 0, 1, 1, 1, "k"), (None, "e " * 9, None, "t", 0, 1, 1, 1, "k"), (3, "f f", None, "t", 0, 1, 1, 1, "k"), (3, "f f", None, "t", 0, 1, 1, 1, "k"),
            (4, None, None, None, 0, 1, 1, 1, "k"), (5, "x " * 60000, None, "long", 0, 1, 1, 1, "k")]
    table = spark.createDataFrame(rows, clash)
    planned, drawn = mixing.mix(table).collect(), mixing.draw(table).collect()
    assert sum(r.taken for r in planned) == sum(len(WORD.findall(r.text or "")) for r in drawn)
    assert sorted(mixing.draw(table).columns) == sorted(table.columns) and len(drawn) == sum(r.copies for r in planned)
    allowed = {(r[0], r[1]): 2 * sum((x[0], x[1]) == (r[0], r[1]) for x in rows) for r in rows}
    assert all(sum((r.doc_id, r.text) == k for r in drawn) <= n for k, n in allowed.items())


# --- SentencePiece


def test_sampled_pieces_follow_the_lattice():
    vocab = pieces.Vocabulary.load()
    sampler = pieces.Sampler(vocab)
    weight = {p: sampler.weight[i] for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds)) if k == 0}
    text, word, many = "athe", "▁athe", 30000
    want = {}

    def spell(at, so_far, w):
        if at == len(word):
            want[tuple(so_far)] = w
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in weight:
                spell(end, [*so_far, word[at:end]], w * weight[word[at:end]])

    spell(0, [], 1.0)
    total, got, at = sum(want.values()), {}, 0
    ids, sizes = sampler.encode([text] * many, np.arange(many, dtype=np.uint64) * np.uint64(2654435761))
    for n in sizes:
        key = tuple(vocab.pieces[i] for i in ids[at : at + n])
        got[key] = got.get(key, 0) + 1
        at += n
    assert set(got) <= set(want)
    for key, w in want.items():
        assert abs(got.get(key, 0) / many - w / total) < 0.012


def test_pieces_round_trip_and_do_not_depend_on_partitioning(spark):
    rows = ODD + [(20, " a  b\n▁c\r\n"), (21, "héllo 梦 \U0001F600 <0x0A> <s> </s>"), (22, "x" * 3000), (23, "▁▁ ▁"), (24, "梦" * 500)]
    coded = pieces.decode(pieces.encode(docs(spark, rows)))
    got = coded.collect()
    assert all(r.decoded == r.text for r in got) and [r for r in got if r.text is None][0].ids is None
    both = pieces.encode(docs(spark, rows), decoded_col="size").collect()
    assert sorted((str(r.doc_id), str(r["size"])) for r in both) == sorted((str(r.doc_id), str(r.decoded)) for r in got)
    again = pieces.encode(docs(spark, rows[::-1]).repartition(5)).collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.text)[:50], tuple(r.ids or ())) for r in rs)
    assert key(got) == key(again)
    assert pieces.encode(docs(spark, [])).count() == 0


def test_long_chunks_are_sampled_like_short_ones(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("athe梦x😀") for _ in range(n)) for n in (1, 5, 300, 1999)]
    keys = np.arange(len(texts), dtype=np.uint64) + np.uint64(77)
    sampler = pieces.Sampler(pieces.Vocabulary.load())
    want = [x.tolist() for x in sampler.encode(texts, keys)]
    monkeypatch.setattr(pieces, "LONG", 0)
    for block in (7, 64, 1 << 16):
        monkeypatch.setattr(pieces, "BLOCK", block)
        assert [x.tolist() for x in sampler.encode(texts, keys)] == want
    big = "".join(rng.choice("abcde") for _ in range(200_000))
    monkeypatch.setattr(pieces, "BLOCK", 1 << 14)
    ids, sizes = sampler.encode([big, "short one"], keys[:2])
    assert sampler.decode(ids, sizes) == [big, "short one"]


def test_draws_next_to_one_lose_no_text(spark):
    rows = [(i, "dog, a cat") for i in (26652863, 32252310, 41030677)] + [(1, "internationalization responsibilities")]  # first draws of 1 - 2^-25 or more
    got = pieces.decode(pieces.encode(docs(spark, rows).coalesce(1))).collect()
    assert [r.decoded for r in got] == [t for _, t in rows]


# --- language ID


def test_language_id_on_held_out_rows(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_langid(spark, sf).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_language_id_odd_rows(spark):
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(6))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(30)), "xx" if i % 2 else "yy") for i in range(60)]
    model = langid.fit(docs(spark, rows + [(99, "abc", None)]))
    got = {r.doc_id: r for r in langid.identify(docs(spark, [(1, None), (2, "123 \n!"), (3, "abc bad cab dab"), (4, "ЖЖЖЖ ЖЖЖ")]), model).collect()}
    assert (got[1].lang_pred, got[1].score, got[1].rejected) == ("und", 0.0, True) and got[2].lang_pred == "und"
    assert got[3].lang_pred == "xx" and 0 < got[3].score <= 1 and not got[3].rejected
    assert got[4].rejected and got[4].lang_pred in ("xx", "yy")
    kept = langid.keep_known(docs(spark, rows), model)
    assert kept.count() == len(rows) and kept.columns == docs(spark, []).columns
    nothing = langid.fit(docs(spark, [(1, "abc", None)]))
    assert langid.identify(docs(spark, rows[:2]), nothing).first().lang_pred == "und"


def test_language_id_columns_that_clash_and_long_texts(spark):
    schema = "doc_id long, text string, lang string, score string, rejected int, lang_pred string, found string"
    rows = [(i, ("abcde fghij " if i % 2 else "vwxyz stuvw ") * (3 + i % 4), "xx" if i % 2 else "yy", "s", i, "p", "f") for i in range(40)]
    rows += [rows[0], (50, "abcde fghij " * 40000, "xx", "s", 50, "p", "f"), (51, None, "xx", "s", 51, "p", "f")]
    table = spark.createDataFrame(rows, schema)
    model = langid.fit(table)
    kept = langid.keep_known(table, model)
    assert kept.columns == table.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[1])
    got = langid.identify(table, model)
    assert got.columns == ["doc_id", "text", "lang", "found", "lang_pred", "score", "rejected"]
    assert {r.lang_pred for r in got.collect() if r.doc_id == 50} == {"xx"}


def test_language_id_against_brute_force_centroids():
    """Cosines and the pick by plain arithmetic over dictionaries of cells."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeéß .") for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["", None, "1 2"]
    idf, centroids = np.linspace(1, 3, langid.DIMS).astype(np.float32), np.stack([
        langid.weighted(langid.counts(t)[None], np.ones(langid.DIMS, np.float32))[0] for t in ("abc abc", "éß é", "dead bead", "cab")])
    model = langid.Model(["aa", "bb"], idf, centroids, np.array([0, 0, 1, 1]), np.array([0.2, 0.3]))
    langs, score, rejected = model.predict(texts)
    for t, lang, s, gone in zip(texts, langs, score, rejected):
        c = langid.counts(t)
        if c is None:
            assert (lang, s, gone) == ("und", 0.0, True)
            continue
        cells = {i: float(np.log1p(c[i])) * float(idf[i]) for i in np.flatnonzero(c)}
        norm = sum(v * v for v in cells.values()) ** 0.5
        cosine = [sum(v * float(m[i]) for i, v in cells.items()) / norm for m in centroids]
        best = max(cosine[:2]), max(cosine[2:])
        assert s == pytest.approx(max(best), abs=1e-5) and (lang == ("bb" if best[1] > best[0] else "aa") or abs(best[0] - best[1]) < 1e-5)
        assert gone == (max(best) < model.radius[("aa", "bb").index(lang)]) or abs(max(best) - model.radius[("aa", "bb").index(lang)]) < 1e-5


# --- HTML


def test_extraction_on_generated_pages_not_trained_on():
    rng, right = random.Random(4242), 0
    for _ in range(150):
        page = html.training_page(rng)
        nodes = html.walk(html.parse(page))
        gold = "\n".join(n.text for n, y in zip(nodes[1:], html.labels(nodes)) if y and n.text)
        right += gold == html.main_texts([page], html.trained())[0]
    assert right >= 0.88 * 150


def test_extraction_cases(spark):
    page = ("<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>News</a></li></ul></nav>"
            "<article><h1>A &amp; B</h1><p>First   line,\n it goes on &eacute;.<p>Second <b>bold</b> one.<br>More of it, with words.</p>"
            "<div class='ad'>Buy this now. <a href=x>buy</a></div><p>The last of all paragraphs here.</p></article>"
            "<section id='comments'><p>I disagree with this.</p><p>Me too, friend.</p></section><footer>&copy; 2024 someone</footer></body></html>")
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain"), (5, "<p>" + "long text, " * 50000)], "page_id long, html string")
    got = {r.page_id: r.text for r in html.extract(rows).collect()}
    assert got[1] == "A & B\nFirst line, it goes on é.\nSecond bold one. More of it, with words.\nThe last of all paragraphs here."
    assert got[2] == got[3] == "" and got[4] is not None


GOLD_BREAK = re.compile(r"<(?:h1|/h1|p|/p|article|/article)>")


def gold_blocks(page):
    """The blocks of a test page's article, read by hand: its pages hold h1 and p, with b and br inside."""
    import html as entities

    inside = page[page.index("<article>") : page.index("</article>")]
    out = []
    for part in GOLD_BREAK.split(inside):
        text = " ".join(entities.unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", part)).split())
        if text:
            out.append(text)
    return out


def test_blocks_of_the_test_pages(spark, sf):
    """Precision and recall of blocks, by count, on every page of the table against its article."""
    rows = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/pages.parquet").collect()
    assert len(rows) >= 100
    from collections import Counter

    found = html.main_texts([r.html for r in rows], html.trained())
    right = kept = wanted = whole = 0
    for r, text in zip(rows, found):
        gold, got = Counter(gold_blocks(r.html)), Counter(text.split("\n") if text else [])
        right, kept, wanted = right + (gold & got).total(), kept + got.total(), wanted + gold.total()
        whole += text == "\n".join(gold_blocks(r.html))
    assert right / kept >= 0.99 and right / wanted >= 0.99 and whole >= 0.97 * len(rows), (right / kept, right / wanted, whole / len(rows))


def test_text_of_any_element_counts():
    page = ("<html><body><nav><a href=/>Home</a><a href=/b>All news</a></nav><article><h1>On energy and mass</h1><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> equal to mass, by a long known law of nature.</p>"
            "<noscript><p>Shown where scripts are not run, as a paragraph of its own.</p></noscript><xmp>a <b> &amp; c, printed as it stands</xmp>"
            "<object><p>What stands for an object that cannot be shown here.</p></object><map><p>The text that stands in a map of this page.</p></map>"
            "<video>A film of the experiment, in words.</video><p>Closing words <svg><text>drawn</text></svg> and <canvas>painted</canvas> of it.</p></article><footer>&copy; 2024</footer></body></html>")
    text = html.main_texts([page], html.trained())[0]
    for part in ("Energy is E=m equal", "Shown where scripts", "a <b> &amp; c, printed", "What stands for an object", "text that stands in a map", "A film of the experiment", "drawn and painted of it"):
        assert part in text, (part, text)
    assert "Home" not in text and "2024" not in text


@pytest.mark.parametrize("unit", ["\"'", "<div>", "<svg>", '"<a ', "<a x=\"'", '<a x=">" ', "<b>", "<li><div>", "<td>", "</i><b>", "<p>x", "<!--", "<textarea>", "<a<", "<a b='"])
def test_parsing_takes_linear_time(unit):
    import time

    begun = time.perf_counter()
    nodes = html.walk(html.parse(unit * (1_000_000 // len(unit))))
    if len(nodes) > 1:
        html.features(nodes)
    assert time.perf_counter() - begun < 20  # a second or two each, seven for the deepest trees


def brute_parse(page):
    """Text leaves with the block tags above them, by a plain scan for well-formed pages."""
    out, above, text = [], [], ""
    for m in re.finditer(r"<(/?)(\w+)([^>]*)>|([^<]+)", page):
        if m[4]:
            text += m[4]
        elif m[2] in html.BLOCKS:
            if " ".join(text.split()):
                out.append((tuple(above), " ".join(text.split())))
            text = ""
            above = above[:-1] if m[1] else [*above, m[2]]
    return [*out, ((), " ".join(text.split()))] if text.split() else out


def test_parsing_and_features_against_brute_force():
    rng = random.Random(12)

    def piece(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["some text. ", "more, ", "<b>bold</b> ", "<a href='/x'>a link</a> ", "<i>x</i>y"])
        tag = rng.choice(["div", "section", "ul", "article", "blockquote"])
        return f"<{tag}>" + "".join(piece(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(200):
        page = "".join(piece(4) for _ in range(3))
        nodes = html.walk(html.parse(page))
        leaves = []
        for n in nodes:
            if n.text:
                path, up = [], n.parent
                while up.parent is not None:
                    path.append(up.tag)
                    up = up.parent
                leaves.append((tuple(reversed(path)), n.text))
        assert leaves == brute_parse(page)
        rows = html.features(nodes)
        below = lambda n: [n, *(x for k in n.kids for x in below(k))]
        first = 2 + 2 * html.N_GROUPS + 12
        for n, row in zip(nodes[1:], rows):
            size = sum(len(x.text) for x in below(n))
            assert row[first] == pytest.approx(np.log1p(size)) and row[first + 3] == pytest.approx(np.log1p(len(below(n)) - 1))
            depth, up = 0, n.parent
            while up.parent is not None:
                depth, up = depth + 1, up.parent
            assert row[first + 8] == depth
            assert row[first + 11] == pytest.approx(sum(k.tag == n.tag for k in n.parent.kids) / len(n.parent.kids))


def test_siblings_count_at_any_number():
    nodes = html.walk(html.parse("<div>" + "<p>x</p>" * 200 + "<ul></ul></div>"))
    rows = html.features(nodes)
    same = 2 + 2 * html.N_GROUPS + 12 + 11
    assert rows[[i for i, n in enumerate(nodes[1:]) if n.tag == "p"][0]][same] == pytest.approx(200 / 201)


def test_extraction_of_repeated_rows_and_ties(spark):
    page = "<body><article><h1>Same</h1><p>The same words in both of the paragraphs.</p><p>The same words in both of the paragraphs.</p></article></body>"
    rows = spark.createDataFrame([(1, page, "kept"), (1, page, "kept"), (2, page, None)], "page_id long, html string, text string")
    got = html.extract(rows).collect()
    assert len(got) == 3 and {r.text for r in got} == {"Same\nThe same words in both of the paragraphs.\nThe same words in both of the paragraphs."}


def test_decoding_never_keeps_below_a_dropped_node():
    rng = random.Random(3)
    for _ in range(20):
        nodes = html.walk(html.parse(html.training_page(rng)))
        score = np.array([rng.uniform(-2, 2) for _ in nodes[1:]])
        keep = html.decode(nodes, score)
        where = {id(n): k for n, k in zip(nodes, keep)}
        assert all(where[id(n.parent)] for n, k in zip(nodes[1:], keep[1:]) if k)
    root = html.walk(html.parse("<div><p>a</p><p>b</p></div>"))  # div, p, text, p, text
    best = max((sum(s for s, k in zip((-1.0, 2.0, 1.0, -3.0, 1.0), ks) if k), ks) for ks in itertools.product((0, 1), repeat=5)
               if all(ks[c] <= ks[p] for c, p in ((1, 0), (2, 1), (3, 0), (4, 3))))
    assert html.decode(root, np.array([-1.0, 2.0, 1.0, -3.0, 1.0]))[1:] == [bool(k) for k in best[1]]


# --- top-k


def brute_topk(rows, asked, k=10):
    vec = {}
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    out = []
    for q in asked:
        own = [v for i, v in good if i == q]
        if own:
            score = [(-sum(a * b for a, b in zip(min(own), v)), i) for i, v in good if i != q]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(score)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_block", [(4096, 1024), (16, 3)])
def test_top_k_against_brute_force(spark, shard_rows, query_block):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 8), 2)]) for i in range(150)]
    rows += [(200, None), (201, [1.0] * 7 + [float("nan")]), (202, [None] + [1.0] * 7), (203, [float("inf")] * 8), (204, rows[0][1]), (205, []), (207, [0.5])]
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    asked = [i for i, _ in rows if i % 10 == 0 or i == 207]
    got = topk.top_k(table, table.where("vec_id % 10 = 0 or vec_id = 207"), shard_rows=shard_rows, query_block=query_block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_topk(rows, asked)
    few = topk.top_k(table.where("vec_id < 4"), table.where("vec_id = 0"))
    assert few.count() == 3 and topk.top_k(table.where("false"), table).count() == 0


def test_reading_stops_before_the_end_on_skewed_lists():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * rng.exponential(1.0, (5000, 6)) ** 3).astype(np.int64)
    lists = topk.Lists(x)
    for query in (np.array([5, 1, 0, 2, 1, 3]), np.array([900, 1, 1, 0, 0, 0]), np.array([-1, 0, 2, 0, -3, 1])):
        at, depth = lists.nra(query, np.array([17]), 10)
        best = sorted((-int(x[i] @ query), i) for i in range(len(x)) if i != 17)[:10]
        assert {i for _, i in best} <= set(at.tolist()) and depth <= (len(x) / 2 if (query >= 0).all() else len(x)), depth
        assert len(at) <= len(x) / topk.LEFT and 17 not in at
    ties = topk.Lists(np.ones((500, 4), np.int64))
    assert len(ties.nra(np.array([1, 1, 1, 1]), np.array([], int), 10)[0]) == 500  # none can be told from another


def test_top_k_of_ties_repeated_and_long_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(30)] + [(30, [0.0, 0.0, 0.0]), (31, [3.0] * 500), (5, [1.0, 2.0, 0.0]), (None, [9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(table, table.where("vec_id in (0, 5, 30, 31)"), shard_rows=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_topk(rows, [0, 5, 30, 31])


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_brute_force(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x_y.z@w-1.co.uk", "@", ".", "+", "-", " ", "  ", "1", "22", "255", "256", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 (30) 1234-5678",
            "10.0.0.1", "0010.1.1.1", "é", "\U0001F600", "_", "4111111111111111", "\n", "e@f", "%", "1.2.3.4.5.6.7.8", ")", "text"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "a" * 50000 + "@b"), (2003, "1 " * 20000)]
    got = docs(spark, rows).select("doc_id", pii.listed(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    texts = dict(rows)
    for r in got:
        assert r.s == ",".join(brute_base(texts[r.doc_id])), texts[r.doc_id][:200]


def brute_terms(rows, share=pii.DISCLOSURE, least=pii.MIN_TEXTS):
    """{(id, text): terms} by the definition in the module's docstring."""
    from math import log2

    def parts(t):
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in brute_base(t))]
        values = {(k, t[a:b].lower()) for a, b, k in spans}
        left = t
        for a, b, _ in spans:
            left = left.replace(t[a:b], " ")
        return values, {w for w in re.findall(r"[^\W\d_]+", left.lower()) if len(w) >= 4}

    every = [(i, t or "", *parts(t or "")) for i, t in rows]
    n, out = len(every), {}
    df_t = {}
    for _, t, _, _ in every:
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            df_t[w] = df_t.get(w, 0) + 1
    for e in {v for x in every for v in x[2]}:
        has = [x for x in every if e in x[2]]
        if len({x[1] for x in has}) < least or len(has) == n:
            continue
        for w in {w for x in has for w in x[3]}:
            both = [x for x in has if w in x[3]]
            if len({x[1] for x in both}) >= least and log2(n * len(both) / (len(has) * df_t[w])) >= share * log2(n / len(has)):
                for x in both:
                    out.setdefault((x[0], x[1]), set()).add(w)
    return out


def test_revealing_terms_against_brute_force(spark):
    rng = random.Random(4)
    plain = [f"plain{c}word" for c in "abcdefghij"]
    rows = []
    for i in range(200):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 20 == 0:
            words += ["write", "Kestrel@example.com", "Falconer", "falconry"]
        if i % 31 == 0:
            words += ["once" + "abcdefghijk"[i // 31] * 4, "10.1.2.3"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(500, rows[0][1]), (501, None)]
    got = pii.find_private(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_terms(rows)
    assert any("falconer" in v for v in want.values())
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        spans = ",".join(s for s in (f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in want.get((r.doc_id, t), ())))
        base = brute_base(t)
        inside = [tuple(map(int, b.split(":")[1:])) for b in base]
        spans = ",".join(s for s in spans.split(",") if s and not any(a < int(s.split(":")[2]) and int(s.split(":")[1]) < b for a, b in inside))
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.extra) == spans
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans) == ",".join(base)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert clean and all("@" not in t and "falconer" not in t.lower() for i, t in clean.items() if i % 20 == 0)
    assert any("<EMAIL>" in t for t in clean.values()) and pii.find_private(docs(spark, [])).count() == 0


def test_every_protected_value_is_estimated(spark):
    rows = [(i, f"common words only {'again ' * (i % 3)}") for i in range(40)]
    rows += [(50, "common words mention Falconer, falconry, kestrel@example.com, 10.1.2.3"), (51, "common words mention nobody"), (52, "common Heron 10.9.9.9")]
    rows += [(i, "common words mention Bittern +49 30 1234567") for i in (60, 61, 62)]  # copies of one text
    texts, want = dict(rows), brute_terms(rows, least=1)
    got = {r.doc_id: {texts[r.doc_id][s["start"] : s["end"]].lower() for s in r.extra} for r in pii.find_private(docs(spark, rows)).collect()}
    assert got == {i: want.get((i, t), set()) for i, t in rows}
    assert got[50] == {"falconer", "falconry"} and got[52] == {"heron"} and got[60] == got[62] == {"bittern"}


def test_offsets_of_many_matches(spark):
    text = " ".join(f"a{i}@b{i % 7}.org, 10.0.{i % 256}.1" for i in range(3000))
    got = docs(spark, [(1, text)]).select(pii.listed(pii.base_spans(F.col("text"))).alias("s")).first().s
    assert got == ",".join(brute_base(text)) and got.count("email") == 3000


def test_values_of_the_same_texts_are_one_entity(spark):
    rows = [(i, f"plain words here {'more ' * (i % 4)}") for i in range(60)]
    both = " ".join(f"u{j}@example.com" for j in range(40))
    rows += [(100 + i, f"{both} Osprey words {'tail ' * i}") for i in range(3)] + [(200, "u1@example.com Osprey alone"), (201, "u50@example.com words Osprey")]
    texts, want = dict(rows), brute_terms(rows, least=1)
    got = {r.doc_id: {texts[r.doc_id][s["start"] : s["end"]].lower() for s in r.extra if s["end"] - s["start"] >= 4} for r in pii.find_private(docs(spark, rows)).collect()}
    assert got == {i: want.get((i, t), set()) for i, t in rows} and any(got.values())


def test_terms_of_any_length_and_with_digits(spark):
    rows = [(i, "a note of the day 7") for i in range(40)]
    rows += [(50, "a note of Kim, KX7 and \u674e\u660e x@example.com"), (51, "the note of Kimberley and of KX77")]
    got = {r.doc_id: [s["value"] for s in r.extra] for r in pii.find_private(docs(spark, rows)).collect()}
    assert got.pop(50) == ["Kim", "KX7", "\u674e\u660e"] and not any(got.values())


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "ä" * 100 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://www.Example.com:80/b?q#f", body), (3, "https://example.com/a", body), (9, None, body), (1, "x\ny", "short"), (2, "http://a.b/", "short"), (4, "http://a.b/", None), (None, "http://z/", "q" * 200)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.capture_histories(pages, str(tmp_path / "a"), records_per_file=2).orderBy("history_pos").collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and [(by[i].record_type, by[i].refers_to) for i in (3, 5, 9)] == [("response", None), ("revisit", 3), ("revisit", 3)]
    assert all(by[i].record_type == "response" for i in (1, 2, 4, None))
    for i, _, h in rows:
        assert by[i].payload_bytes == len((h or "").encode()) and by[i].payload_digest == hashlib.sha256((h or "").encode()).hexdigest()
    keys = [(r.url_key, r.captured_at, r.page_id is None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and by[5].url_key == "com,example)/b?q"
    assert warc.capture_histories(pages.where("false"), str(tmp_path / "b")).count() == 0


def test_loser_tree():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(k)]
        tree, out = warc.LoserTree(lambda x: x), []
        for first, run, rows in sorted((r[at], i, r[at : at + 3]) for i, r in enumerate(runs) for at in range(0, len(r), 3)):
            while tree.peek() is not None and tree.peek() < first:
                out.append(tree.take())
            tree.feed(run, rows)
            assert len(tree.slot) <= k
        while tree.peek() is not None:
            out.append(tree.take())
        assert out == sorted(x for r in runs for x in r)


def test_merge_holds_one_block_a_run():
    keys = [(f"u{i:06d}", "t", i, "", "", None, 0, "", "", 0) for i in range(20_000)]
    import pandas as pd

    runs = {f"r{j}": keys[j::5] for j in range(5)}
    blocks = sorted((b[3], b[0], b[1], b[5]) for name, rows in runs.items() for b in warc._blocks(name, rows))
    held, most = {}, 0

    class Watched(warc.LoserTree):
        def feed(self, run, rows):
            nonlocal most
            super().feed(run, rows)
            most = max(most, sum(len(r) - at for r, at in zip(self.rows, self.at)))

    real, warc.LoserTree = warc.LoserTree, Watched
    try:
        frame = pd.DataFrame([(0, r, f, c) for f, r, _, c in blocks], columns=["part", "run", "first", "captures"])
        got = [row for _, row in warc._merged(iter([frame]), lambda part: (None, None))]
    finally:
        warc.LoserTree = real
    assert got == keys and most <= 5 * 2 * warc.BLOCK and not held


@pytest.mark.parametrize("fan_in,range_rows", [(512, 10_000), (3, 40)])
def test_captures_in_one_global_order(spark, tmp_path, monkeypatch, fan_in, range_rows):
    rng = random.Random(5)
    same = "<p>" + "hot payload " * 20 + "</p>"
    rows = [(i, rng.choice(["http://hot.example/", f"https://www.h{rng.randrange(9)}.org:443/p?{rng.randrange(5)}", "no url", None, "//x.y/é"]),
             same if i % 3 == 0 else f"page {i} " * rng.randrange(30)) for i in range(400)]
    rows += [rows[3], (3, rows[3][1], "another text of the same id " * 9), (None, "http://hot.example/", same), (7, "http://long/", "long " * 400_000)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    monkeypatch.setattr(warc, "BLOCK", 8)
    got = warc.capture_histories(pages, str(tmp_path / "a"), fan_in, range_rows, records_per_file=20).orderBy("history_pos").collect()
    keys = [(warc.url_key(r.url), r.captured_at, r.page_id is None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and [r.history_pos for r in got] == list(range(1, len(rows) + 1))
    assert range_rows > 100 or len({r.merge_part for r in got}) > 3
    big = [r for r in rows if len((r[2] or "").encode()) >= 100 and r[0] is not None]
    first = {}
    for i, _, h in big:
        first[h] = min(first.get(h, i), i)
    want = sorted((str(i), str(first[h]) if (i, u, h) in big and first[h] != i else "None", hashlib.sha256(h.encode()).hexdigest()) for i, u, h in rows)
    assert sorted((str(r.page_id), str(r.refers_to), r.payload_digest) for r in got) == want


# --- licences


def brute_licences(text, model):
    """(families, n_license, n_confirmed, license, probability) by the module's docstring, on plain Python values."""
    hits = []
    for line in (text or "").split("\n"):
        tokens = licenses.words(line)
        p = model.scores(line)
        family = model.families[int(p.argmax())]
        if family != "none" and p.max() >= model.threshold:
            own = {" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}
            known = {s for t in licenses.TEMPLATES[family] for w in [licenses.words(t)] for s in (" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))}
            hits.append((-round(float(p.max()), 6), family, len(own & known) / len(own) >= 0.8))
    best = min(hits, default=(None, None, None))
    return ",".join(sorted({h[1] for h in hits})), len(hits), sum(h[2] for h in hits), best[1], best[0]


def test_licences_against_brute_force(spark):
    import textwrap

    rng, model = random.Random(11), licenses.fit()
    every = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(i, t) for i, (_, t) in enumerate(every)] + [(200, None), (201, ""), (202, "\n\n"), (203, "x " * 40000 + "\nReleased under the MIT License.")]
    for i in range(120):
        lines = [rng.choice(licenses.ORDINARY + licenses.OTHER_LICENCES) for _ in range(3)] + textwrap.wrap(rng.choice(every)[1], rng.choice((40, 72, 300)))
        rng.shuffle(lines)
        rows.append((300 + i, "\n".join(lines)))
    rows += [rows[-1], rows[-1]]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: brute_licences(t, model) for i, t in rows}
    for r in got:
        families, n, confirmed, family, behind = want[r.doc_id]
        assert (r.families, r.n_license, r.n_confirmed, r.license) == (families, n, confirmed, family), dict(rows)[r.doc_id][:300]
        assert (r.probability is None) == (behind is None) and (behind is None or r.probability == pytest.approx(-behind, abs=2e-6))
    assert all(want[i][0] == f and want[i][2] == 1 for i, (f, _) in enumerate(every))  # body paragraphs as they are published
    assert licenses.scan(docs(spark, [])).count() == 0


def test_a_line_without_a_weighted_word_scores_the_bias():
    model = licenses.fit()
    for line in ("nothing at all stands in here", "12 2.0 3 x y", "Ganz anderes steht dort, und sie kam nicht"):
        assert not set(licenses.words(line)) & set(model.vocabulary)
        assert model.scores(line) == pytest.approx(model.scores("")) and model.families[int(model.scores("").argmax())] == "none"
    assert re.fullmatch(licenses._one_of(["a", "ab", "abc", "b"]).replace("?+", "?"), "abc") and not re.fullmatch(licenses._one_of(["ab", "b"]), "a")


HELD_OUT = """MIT|Licensed to you under the terms of the MIT license, see LICENSE for details.
GPL|This package is free software and comes under the GNU General Public License version 2 or later.
BSD|Copyright (c) 2015, the project authors; use is governed by a BSD-style licence found in the LICENSE file.
Apache-2.0|Everything here is available under the Apache License, Version 2.0.
CC-BY-SA|Text and images: Creative Commons Attribution-ShareAlike 4.0 International.
CC-BY-NC|You are free to share this text under CC BY-NC 4.0.
AGPL|This file is part of a program under the GNU Affero General Public License.
LGPL|The library may be linked under the GNU Lesser General Public License, version 2.1.
MPL-2.0|Subject to the Mozilla Public License, version 2.0; a copy is at mozilla.org.
Proprietary|All rights reserved. No part may be copied without written permission.
Unlicense|Released as free and unencumbered software into the public domain.
none|The fox has a license to hunt on the land of the company.
none|Please copy the file to the other computer.
none|The software company was sold in January for a large price.
none|Under the terms of the contract the work has to be done in May.
none|The general public was free to use the library.
none|Permission was granted.
none|Sie kam mit der Bahn, und er ging mit dem Hund nach Hause.
none|The warranty for the washing machine covers damages for two years.
none|A copyright dispute between two authors ended in court.""".splitlines()


def test_held_out_paragraphs_by_hand():
    model, right = licenses.fit(), 0
    for row in HELD_OUT:
        family, _, text = row.partition("|")
        p = model.scores(text)
        right += family == (model.families[int(p.argmax())] if p.max() >= model.threshold else "none")
    assert right >= len(HELD_OUT) - 1
    assert sum(model.scores(t).max() >= model.threshold and model.families[int(model.scores(t).argmax())] != "none" for t in licenses.OTHER_LICENCES[1::2]) <= 1


def test_mit_alone_is_a_licence_word(spark):
    named = ["Distributed under MIT.", "MIT-Lizenz", "Available under the terms of MIT", "distributed under mit"]
    plain = ["Sie kam mit dem Zug.", "Wir gehen mit euch in den Garten und dann nach Hause.", "mit", "Er sprach mit ihr über die Arbeit", "The university MIT is in Cambridge."]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, list(enumerate(named + plain)))).collect()}
    assert [got[i] for i in range(len(named + plain))] == ["MIT"] * len(named) + [None] * len(plain)
