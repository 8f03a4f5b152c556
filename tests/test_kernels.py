"""Column kernels and decoders against plain Python."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import spans, text
from maskloom.functions.kernel import find
from maskloom.operators import decode, spanjoin


def test_find_equals_finditer(spark):
    texts = ["", "a1b22c333", "📎a010가나12", "12", "가" * 50 + "7", "a\n1\r\n2", "１2３"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern in ("[0-9]+", "[a-z][0-9]", "(?<=a)[0-9]", "가+"):
        got = rows.select("text", find(F.col("text"), pattern).alias("h")).collect()
        assert [[(x.s, x.e, x.v) for x in r.h] for r in got] == [[(*m.span(), m.group()) for m in re.finditer(pattern, r.text)] for r in got]


def test_folding_keeps_positions(spark):
    texts = ["ＡＢ－１２", "𝟎𝟏𝟎-1234", "가​나", "0​1", "0​‌1​", "​01", "a­­b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (r.n, r.p) for r in rows.select("text", text.normalize(F.col("text")).alias("n"), text.positions(F.col("text")).alias("p")).collect()}
    assert [got[t][0] for t in texts] == ["AB-12", "010-1234", "가​나", "01", "01​", "​01", "ab"]
    assert got["0​‌1​"][1] == [0, 3, 4] and got["a­­b"][1] == [0, 3] and got["가​나"][1] is None


def test_positions_read_a_text_once(spark):
    """Not once for each position, which is quadratic in its length."""
    import time

    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "1", "가", "\u200b", "\U0001f4e9"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts.append("0\u200b\u2060" * 200 + "가나 " * 10_000 + "1\u200b2")
    removed = [[i for m in re.finditer("(?<=[A-Za-z0-9@._+-])[\u200b\u2060]+(?=[A-Za-z0-9@._+-])", t) for i in range(*m.span())] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    begun = time.perf_counter()
    got = {r.i: r.p for r in rows.select("i", text.positions(F.col("t")).alias("p")).collect()}
    assert time.perf_counter() - begun < 30
    for i, gone in enumerate(removed):
        gone = set(gone)
        assert got[i] == ([at for at in range(len(texts[i])) if at not in gone] if gone else None)


def _random_spans(rng, n):
    out = []
    for _ in range(n):
        s = rng.randrange(120)
        out.append((rng.choice(["KR_RRN", "KR_ACCOUNT", "OTHER"]), s, s + rng.randint(1, 25), rng.choice([0.0, 0.1, 0.4, 0.5, 1.0])))
    return out


RANK = {"KR_RRN": 0, "KR_ACCOUNT": 8, "OTHER": 99}


def _greedy(items):
    kept = []
    for x in sorted(items, key=lambda x: (-x[3], RANK[x[0]], x[1], x[2])):
        if all(x[2] <= k[1] or k[2] <= x[1] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[1])


def test_span_kernels_against_brute_force(spark):
    rng = random.Random(5)
    cases = [_random_spans(rng, rng.randint(0, 25)) for _ in range(60)]
    rows = spark.createDataFrame([(i, [(s, t, e, RANK[e], p, False) for e, s, t, p in c]) for i, c in enumerate(cases)], f"id int, x array<{spans.SPAN}>")
    got = rows.select("id", spans.select_greedy(F.col("x")).alias("g"), spans.drop_contained(F.col("x")).alias("d")).collect()
    for r in got:
        assert [(x.entity, x.s, x.e, x.score) for x in r.g] == _greedy(cases[r.id])
        kept = []
        for x in sorted(set(cases[r.id]), key=lambda x: (-x[3], x[1], -(x[2] - x[1]))):
            if x[3] and not any(k[0] == x[0] and k[1] <= x[1] and k[2] >= x[2] for k in kept):
                kept.append(x)
        assert sorted((x.entity, x.s, x.e, x.score) for x in r.d) == sorted(kept)
    long = spark.createDataFrame([(i, *x) for i, c in enumerate(cases) for x in c], "doc_id int, entity string, start int, end int, score double")
    want = sorted((i, *x) for i, c in enumerate(cases) for x in _greedy(c))
    assert sorted(tuple(r) for r in spanjoin.greedy_select(long).collect()) == want
    pairs = {(r.doc_id, r.start, r.end, r.start_r, r.end_r) for r in spanjoin.overlap_pairs(long, long).collect()}
    assert pairs == {(i, a[1], a[2], b[1], b[2]) for i, c in enumerate(cases) for a in c for b in c if a[1] < b[2] and b[1] < a[2]}


def test_overlap_pairs_across_buckets(spark):
    a = spark.createDataFrame([(1, "A", 0, 5000)], "doc_id int, entity string, start int, end int")
    b = spark.createDataFrame([(1, "B", 510, 1600), (1, "B", 5000, 5001), (2, "B", 0, 9)], a.schema)
    assert [(r.start_r, r.end_r) for r in spanjoin.overlap_pairs(a, b).collect()] == [(510, 1600)]
    assert spanjoin.covered(a, b.where("start = 510")).first().covered is False


# --- decoders: every legal path of short sequences --------------------------------------------------


def _paths(n):
    for path in itertools.product("OBIES", repeat=n):
        if path[0] in decode.STARTS and path[-1] in decode.ENDS and all(b in decode.FOLLOW[a] for a, b in zip(path, path[1:])):
            yield path


def _names(path):
    out, start = [], None
    for i, tag in enumerate(path):
        if tag in "BS":
            start = i
        if tag in "ES":
            out.append((start, i + 1))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_decoders_against_enumeration(n):
    logits = np.random.default_rng(n).normal(size=(n, 5)) * 2
    weight = {p: float(np.exp(sum(logits[i, decode.LABELS.index(t)] for i, t in enumerate(p)))) for p in _paths(n)}
    total = sum(weight.values())
    best = max(weight, key=weight.get)
    assert "".join(decode.LABELS[i] for i in decode.best_path(logits)) == "".join(best)
    inside = [sum(w for p, w in weight.items() if p[i] != "O") / total for i in range(n)]
    assert np.allclose(decode.inside_probability(logits), inside)
    got = decode.span_probability(logits)
    for s, e in itertools.combinations(range(n + 1), 2):
        assert np.isclose(got[s, e - s - 1], sum(w for p, w in weight.items() if (s, e) in _names(p)) / total)
        assert np.isclose(decode.outside_probability(logits, [(s, e)])[0], sum(w for p, w in weight.items() if set(p[s:e]) == {"O"}) / total)
    items = [(s, e, got[s, e - s - 1]) for s, e in itertools.combinations(range(n + 1), 2)]
    options = [c for k in range(n + 1) for c in itertools.combinations(items, k) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))]
    gain = lambda c: sum(p - 0.1 for _, _, p in c)
    assert np.isclose(gain(decode.best_intervals(items, 0.1)), max(map(gain, options)))


def test_selective_decoding_keeps_and_drops_anchors():
    strong = np.array([[0, 9, 0, 0, 0], [0, 0, 0, 9, 0], [9, 0, 0, 0, 0], [9, 0, 0, 0, 0.0]])
    assert [x[:2] for x in decode.selective_spans(strong, 0.5, 0.5, [(2, 4, 0.8)])] == [(0, 2)]
    assert [x[:2] for x in decode.selective_spans(strong, 1.0, 1.0, [(2, 4, 0.8)])] == [(2, 4)]
    assert decode.path_spans(np.zeros((0, 5))) == []
    with pytest.raises(ValueError):
        decode.best_path([[float("nan")] * 5])


def test_detection_without_fast_building(spark, monkeypatch):
    """Public functions alone give the same plan's results."""
    from maskloom.functions import kernel
    from maskloom.operators.detect import Detector

    rows = spark.createDataFrame([("연락처 010-1234-5678",), (None,), ("a@b.co.kr",)], "t string")
    fast = [r.m for r in rows.select(Detector().mask(F.col("t")).alias("m")).collect()]
    for name in ("_create_lambda", "_to_seq", "_origin"):
        monkeypatch.setattr(kernel, name, None)
    assert [r.m for r in rows.select(Detector().mask(F.col("t")).alias("m")).collect()] == fast


def test_a_cluster_without_a_shared_folder_fails(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from maskloom import runtime

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(RuntimeError):
        runtime.shared_dir(session)
    session.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert runtime.shared_dir(session) == "hdfs://shared"
    with pytest.raises(ValueError):
        runtime.remove(session, "hdfs://shared/data")


def test_bootstrap_against_resampled_documents(spark):
    """The interval is that of documents drawn with replacement, by plain arrays."""
    from maskloom.operators import evaluate

    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (400, 6))
    rows = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(counts)], "doc_id long, tp_b long, fp_b long, fn_b long, tp_c long, fp_c long, fn_c long")
    got = evaluate.bootstrap(rows, 2000).first()
    f1 = lambda s: 2 * s[:, 0] / (2 * s[:, 0] + s[:, 1] + s[:, 2])
    sums = np.stack([counts[rng.integers(0, 400, 400)].sum(0) for _ in range(4000)])
    gaps = np.sort(f1(sums[:, 3:]) - f1(sums[:, :3]))
    for q, value in ((0.025, got.low), (0.5, got.middle), (0.975, got.high)):
        assert abs(np.quantile(gaps, q) - value) < 0.006
    assert evaluate.bootstrap(rows.repartition(5), 2000).first() == got


def test_span_conflicts_by_cluster_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(d, rng.choice("AB"), s := rng.randrange(60), s + rng.randint(1, 12), rng.choice((0.0, 0.1, 0.4, 0.5, 1.0)), rng.choice("xy")) for d in range(12) for _ in range(rng.choice((0, 1, 3, 40)))]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "doc_id long, entity string, start int, end int, score double, note string")
    better = lambda y, x: (y[:2] == x[:2]) and y[2] <= x[2] and y[3] >= x[3] and (-y[4], y[2], -y[3]) < (-x[4], x[2], -x[3])
    live = {r for r in rows if r[4] != 0}
    assert sorted(map(tuple, spanjoin.drop_contained(table).collect())) == sorted(x for x in live if not any(better(y, x) for y in live))
    want = []
    for d in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[4], "AB".index(r[1]), r[2], r[3])):
            if not any(r[2] < k[3] and k[2] < r[3] for k in kept):
                kept.append(r)
        want += [k[:5] for k in kept]
    got = spanjoin.greedy_select(table, {"A": 0, "B": 1})
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["doc_id", "entity", "start", "end", "score"]


def test_many_spans_that_all_overlap_take_little_time(spark):
    import time

    rows = spark.range(20_000).selectExpr("id div 5000 AS doc_id", "'A' AS entity", "cast(id % 5000 as int) AS start", "cast(10000 + id % 5000 * 7 % 5000 as int) AS `end`", "cast(id * 13 % 97 as double) / 100 AS score")
    begun = time.perf_counter()
    assert spanjoin.drop_contained(rows).count() > 0 and spanjoin.greedy_select(rows).count() == 4
    assert time.perf_counter() - begun < 30


# --- decoders over columns ------------------------------------------------------------------------


def test_column_decoders_equal_single_cases(spark):
    """Cases of several lengths, an empty one and null in one batch."""
    rng = np.random.default_rng(7)
    cases = [None if i == 3 else rng.normal(size=(i * 5 % 13, 5)).tolist() for i in range(60)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, logits array<array<double>>").coalesce(1)
    anchors = F.when(F.size("logits") > 2, F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit(0.9).alias("score")))).otherwise(
        F.array().cast("array<struct<start:int,end:int,score:double>>"))
    rows = df.select("i", decode.decode_best(F.col("logits"), 0.2).alias("best"), decode.decode_coverage(F.col("logits"), 0.6).alias("coverage"),
                     decode.decode_evidence(F.col("logits"), 0.1, 3).alias("evidence"), decode.marginals(F.col("logits")).alias("inside"),
                     decode.decode_selective(F.col("logits"), anchors, 0.2, 0.5).alias("selective")).collect()
    plain = lambda spans: None if spans is None else [tuple(x) for x in spans]
    assert len(rows) == len(cases)
    for row in rows:
        x = cases[row.i]
        if x is None:
            assert row[1:] == (None,) * 5
            continue
        assert plain(row.best) == decode.path_spans(x, 0.2) and plain(row.coverage) == decode.coverage_spans(x, 0.6)
        assert plain(row.evidence) == decode.evidence_spans(decode.span_probability(x, 3), 0.1)
        assert row.inside == decode.inside_probability(x).tolist()
        assert plain(row.selective) == decode.selective_spans(x, 0.2, 0.5, [(0, 2, 0.9)] if len(x) > 2 else [])


def test_decoding_many_short_cases_takes_little_time():
    import time

    import pyarrow as pa

    logits = pa.array(np.random.default_rng(5).normal(size=(40_000, 12, 5)).tolist(), pa.list_(pa.list_(pa.float64())))
    begun = time.perf_counter()
    seen = 0
    for places, unary in decode._blocks(logits, lambda n: n):
        seen += len(places)
        decode._path_spans(unary, 0.2), decode._coverage_spans(unary, 0.6)
        list(decode._evidence(decode._spanning(unary, decode._sums(unary), 12), 0.3, [()] * len(places)))
    assert seen == 40_000 and time.perf_counter() - begun < 30  # case by case it took more than a minute


def test_decoder_queries_run_in_many_tasks(spark, sf):
    """The customers are one small file, and one task would read it."""
    from maskloom import plans

    for name in ("selective_evidence", "span_posteriors", "coverage_decode", "name_marginals"):
        assert plans.queries()[name](spark, sf).rdd.getNumPartitions() > 1


def test_equal_spans_share_an_island(spark):
    """The plan sums over peers, so that the order of equal spans is of no account."""
    df = spark.createDataFrame([(1, 0, 4), (1, 4, 9), (1, 10, 12), (1, 10, 12), (1, 20, 21)], "doc_id int, start int, end int")
    out = spanjoin.merged(df)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 9), (1, 10, 12), (1, 20, 21)]
    assert "RangeFrame" in out._jdf.queryExecution().optimizedPlan().toString()


def test_reserve_texts_are_hashed_after_dealing(spark, sf):
    """A join must not infer a filter that hashes every text within the scan, which may be one task."""
    from maskloom import plans

    plan = plans.queries()["reserve_unique"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    level = lambda line: len(line) - len(line.lstrip(" :+-"))
    dealt = [i for i, line in enumerate(plan) if "Repartition 4" in line]
    assert len(dealt) == 3
    for i in dealt:
        below = plan[i + 1 :]
        end = next((n for n, line in enumerate(below) if level(line) <= level(plan[i])), len(below))
        assert end and not any("sha2" in line for line in below[:end])


def test_reserve_verdicts_by_normalised_text(spark):
    from maskloom.operators.corpus import reserve_unique

    reserve = spark.createDataFrame([("a", 1, 1, "번호 ０１０-1"), ("a", 2, 2, "번호 010-1"), ("a", 3, 3, "x​y"), ("b", 4, 4, None), ("b", 5, 5, "")],
                                    "domain string, position int, id int, text string")
    got = {r.id: r.verdict for r in reserve_unique(reserve, spark.createDataFrame([("xy",), (None,)], "text string")).collect()}
    assert got == {1: "selected", 2: "reserve_duplicate", 3: "consumed", 5: "selected"}
