"""Queries of the span joins and the evaluation layer, over spans built from order lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import vocab as V
from maskloom.operators import evaluate, spanjoin
from maskloom.plans import tables as B

QUERIES: dict[str, tuple[Callable, str | None]] = {}

_WITH = f"""WITH gold AS ({B.GOLD}), base AS ({B.BASE}), cand AS ({B.CANDIDATE}), ign AS ({B.IGNORE}), neg AS ({B.NEGATIVE}), crossing AS ({B.CROSSING}),
    tagged AS (SELECT doc_id, entity, "start", "end", 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, entity, "start", "end", 0, 1 FROM base),
    flags AS (SELECT doc_id, entity, "start", "end", max(g) AS g, max(p) AS p FROM tagged GROUP BY ALL),
    counted AS (SELECT *, g * p AS tp, (1 - g) * p AS fp, g * (1 - p) AS fn FROM flags),
    cover AS (SELECT g.doc_id, g.entity, g."start", g."end", g.track, coalesce((SELECT sum(least(g."end", b."end") - greatest(g."start", b."start")) FROM base b
              WHERE b.doc_id = g.doc_id AND b."start" < g."end" AND g."start" < b."end"), 0) AS shared FROM gold g),
    cover2 AS (SELECT g.doc_id, g.entity, g."start", g."end", coalesce((SELECT sum(least(g."end", b."end") - greatest(g."start", b."start")) FROM cand b
              WHERE b.doc_id = g.doc_id AND b."start" < g."end" AND g."start" < b."end"), 0) AS shared FROM gold g)
"""
_SCORES = """round(CASE WHEN tp + fp = 0 THEN {z} ELSE tp * 1.0 / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN {z} ELSE tp * 1.0 / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN {z} ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"""
_SUMS = "cast(sum(tp) as bigint) AS tp, cast(sum(fp) as bigint) AS fp, cast(sum(fn) as bigint) AS fn"


def query(name: str, sql: str | None, *inputs: str):
    """Register a function of span tables under a name."""
    texts = {"gold": B.GOLD, "base": B.BASE, "cand": B.CANDIDATE, "ign": B.IGNORE, "neg": B.NEGATIVE, "crossing": B.CROSSING}

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*(B.spans(spark, sf_dir, texts[i]) for i in inputs))

        QUERIES[name] = (run, _WITH + sql if sql else None)
        return function

    return register


def _se(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "s", "end": "e"})


query("span_tp_fp_fn", 'SELECT doc_id, entity, "start" AS s, "end" AS e, cast(tp as bigint) AS tp, cast(fp as bigint) AS fp, cast(fn as bigint) AS fn FROM counted',
      "gold", "base")(lambda g, p: _se(evaluate.outcomes(g, p)))
query("span_prf_by_entity", f"SELECT entity, tp, fp, fn, {_SCORES.format(z='NULL')} FROM (SELECT entity, {_SUMS} FROM counted GROUP BY entity)",
      "gold", "base")(evaluate.by_entity)
query("metrics_grouping_sets", f"""
    , t AS (SELECT doc_id, entity, "start", "end", track, 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, entity, "start", "end", track, 0, 1 FROM base),
    f AS (SELECT doc_id, entity, "start", "end", track, max(g) AS g, max(p) AS p FROM t GROUP BY ALL), c AS (SELECT *, g * p AS tp, (1 - g) * p AS fp, g * (1 - p) AS fn FROM f)
    SELECT track, entity, tp, fp, fn, {_SCORES.format(z='0.0')} FROM (SELECT track, entity, {_SUMS} FROM c GROUP BY GROUPING SETS ((), (entity), (track), (track, entity)))""",
      "gold", "base")(evaluate.rollup)
query("metrics_slices", f"""
    SELECT entity, track, length, {_SUMS} FROM (SELECT c.*, CASE WHEN "end" - "start" > 9 THEN 'long' ELSE 'short' END AS length,
        CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS track FROM counted c) GROUP BY GROUPING SETS ((entity), (entity, track), (entity, length))""",
      "gold", "base")(lambda g, p: evaluate.slices(
          evaluate.outcomes(g, p).withColumn("length", F.when(F.col("end") - F.col("start") > 9, "long").otherwise("short"))
          .withColumn("track", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")), "entity", ["track", "length"]))
query("coverage_full_mask", """SELECT entity, count(*) AS gold, count(*) FILTER (shared = "end" - "start") AS covered FROM cover GROUP BY GROUPING SETS ((), (entity))""",
      "gold", "base")(evaluate.coverage)
query("char_precision_recall", """
    SELECT cast(g as bigint) AS gold_chars, cast(p as bigint) AS predicted_chars, cast(s as bigint) AS shared_chars, round(s * 1.0 / p, 6) AS precision,
           round(s * 1.0 / g, 6) AS recall, cast(p - s as bigint) AS over_masked
    FROM (SELECT (SELECT sum("end" - "start") FROM gold) AS g, (SELECT sum("end" - "start") FROM base) AS p, (SELECT sum(shared) FROM cover) AS s)""",
      "gold", "base")(evaluate.character_scores)
query("confusion_pairs", """SELECT g.entity AS gold, b.entity AS predicted, count(*) AS n FROM gold g JOIN base b USING (doc_id, "start", "end")
    WHERE g.entity <> b.entity GROUP BY ALL""", "gold", "base")(spanjoin.confusion)
query("overlap_characters", 'SELECT doc_id, entity, "start" AS s, "end" AS e, cast(shared as bigint) AS shared FROM cover WHERE shared > 0',
      "gold", "base")(lambda g, p: _se(spanjoin.overlap_characters(g, p)))
query("ignore_filter", """SELECT doc_id, entity, "start" AS s, "end" AS e FROM base b
    WHERE EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = b.doc_id AND g."start" < b."end" AND b."start" < g."end")
       OR NOT EXISTS (SELECT 1 FROM ign i WHERE i.doc_id = b.doc_id AND i."start" <= b."start" AND b."end" <= i."end")""",
      "gold", "base", "ign")(lambda g, p, i: _se(spanjoin.countable_predictions(p.select(*evaluate.SPAN), g, i)))
query("ignore_stats", 'SELECT count(*) AS n, cast(sum("end" - "start") as bigint) AS chars, max("end" - "start") AS longest FROM ign', "ign")(evaluate.ignore_stats)
query("negative_span_hits", """SELECT count(*) AS negatives, count(*) FILTER (EXISTS (SELECT 1 FROM base b WHERE b.doc_id = n.doc_id AND b."start" < n."end" AND n."start" < b."end")) AS hit
    FROM neg n""", "neg", "base")(evaluate.negative_hits)
query("overlap_veto", """SELECT doc_id, entity, "start" AS s, "end" AS e, score FROM crossing c WHERE entity <> 'KR_ACCOUNT' OR NOT EXISTS (
        SELECT 1 FROM crossing x WHERE x.doc_id = c.doc_id AND x.entity <> 'KR_ACCOUNT' AND x.score >= 0.4 AND x."start" < c."end" AND c."start" < x."end")""",
      "crossing")(lambda c: _se(spanjoin.veto(c)))
query("containment_dedup", """
    , d AS (SELECT DISTINCT * FROM crossing WHERE score <> 0)
    SELECT doc_id, entity, "start" AS s, "end" AS e, score FROM d WHERE NOT EXISTS (
        SELECT 1 FROM d y WHERE y.doc_id = d.doc_id AND y.entity = d.entity AND y."start" <= d."start" AND y."end" >= d."end"
          AND (y.score > d.score OR (y.score = d.score AND (y."start" < d."start" OR (y."start" = d."start" AND y."end" > d."end")))))""",
      "crossing")(lambda c: _se(spanjoin.drop_contained(c)))
query("card_evidence_anti", """SELECT doc_id, entity, "start" AS s, "end" AS e FROM base b WHERE NOT EXISTS (
        SELECT 1 FROM cand c WHERE c.doc_id = b.doc_id AND c."start" = b."start" AND c."end" = b."end")""",
      "base", "cand")(lambda b, c: _se(spanjoin.same_span_anti(b.select(*evaluate.SPAN), c)))
query("prefix_max_end", """SELECT doc_id, entity, "start" AS s, "end" AS e, max("end") OVER w AS max_end, count(*) OVER w AS seen FROM crossing
    WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end", entity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
      "crossing")(lambda c: _se(spanjoin.prefix_max_end(c.select(*evaluate.SPAN))))
query("adjacent_overlap", """SELECT * FROM (SELECT doc_id, entity, "start" AS s, "end" AS e, lag("end") OVER (PARTITION BY doc_id ORDER BY "start", "end", entity) AS previous_end FROM crossing)
    WHERE previous_end > s""", "crossing")(lambda c: _se(spanjoin.adjacent_overlaps(c.select(*evaluate.SPAN))))
query("merged_spans", """
    , m AS (SELECT doc_id, "start", "end", CASE WHEN coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < "start" THEN 1 ELSE 0 END AS n FROM crossing),
    i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
    SELECT doc_id, min("start") AS s, max("end") AS e FROM i GROUP BY doc_id, island""", "crossing")(lambda c: _se(spanjoin.merged(c)))
_RANK = "CASE entity " + " ".join(f"WHEN '{e}' THEN {i}" for e, i in V.PRIORITY.items()) + " ELSE 99 END"
_GREEDY = f"""
    , r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {_RANK}, "start", "end") AS n FROM crossing),
    walk AS (SELECT doc_id, 0 AS n, cast([] as struct(s int, e int)[]) AS kept, false AS took FROM (SELECT DISTINCT doc_id FROM crossing)
        UNION ALL SELECT w.doc_id, r.n, CASE WHEN len(list_filter(w.kept, lambda k: k.s < r."end" AND r."start" < k.e)) = 0
               THEN list_append(w.kept, struct_pack(s := r."start", e := r."end")) ELSE w.kept END,
               len(list_filter(w.kept, lambda k: k.s < r."end" AND r."start" < k.e)) = 0 FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.n = w.n + 1)
    SELECT r.doc_id, r.entity, r."start" AS s, r."end" AS e, r.score FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.n = w.n WHERE w.took"""
query("greedy_select", _GREEDY, "crossing")(lambda c: _se(spanjoin.greedy_select(c)))
QUERIES["greedy_select"] = (QUERIES["greedy_select"][0], QUERIES["greedy_select"][1].replace("WITH gold", "WITH RECURSIVE gold", 1))
query("disjoint_insert", """
    , free AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b."start" < c."end" AND c."start" < b."end"))
    SELECT doc_id, entity, "start" AS s, "end" AS e, score FROM base UNION ALL SELECT doc_id, entity, "start", "end", score FROM free""",
      "base", "cand")(lambda b, c: _se(spanjoin.disjoint_insert(b, c)))
query("window_output_offsets", """SELECT doc_id, entity, "start" AS s, "end" AS e, cast("start" + o as bigint) AS output_start, cast("start" + o + length(entity) + 2 as bigint) AS output_end
    FROM (SELECT *, coalesce(sum(length(entity) + 2 - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM gold)""",
      "gold")(lambda g: _se(spanjoin.output_offsets(g.select(*evaluate.SPAN), F.length("entity") + 2)))


def _documents(gold: DataFrame, base: DataFrame) -> DataFrame:
    return gold.select("doc_id").union(base.select("doc_id")).distinct()


query("doc_leak_rate", """
    , d AS (SELECT doc_id FROM gold UNION SELECT doc_id FROM base), s AS (SELECT doc_id, bool_and(shared = "end" - "start") AS safe FROM cover GROUP BY doc_id),
    c AS (SELECT count(*) FILTER (safe IS NOT NULL) AS positive, count(*) FILTER (NOT safe) AS leaking, count(*) FILTER (safe IS NULL) AS negative,
          count(*) FILTER (safe IS NULL AND EXISTS (SELECT 1 FROM base b WHERE b.doc_id = d.doc_id)) AS flagged FROM d LEFT JOIN s USING (doc_id))
    SELECT *, round(leaking * 1.0 / nullif(positive, 0), 6) AS leak_rate, round(flagged * 1.0 / nullif(negative, 0), 6) AS false_rate FROM c""",
      "gold", "base")(lambda g, b: evaluate.leak_rates(_documents(g, b), g, b))
query("boundary_taxonomy", """
    , t AS (SELECT g.doc_id, g.entity, g."start", g."end", count(b.doc_id) AS n, bool_or(b."start" = g."start" AND b."end" = g."end") AS exact,
            bool_or(b."start" <= g."start" AND b."end" >= g."end") AS around, bool_or(b."start" >= g."start" AND b."end" <= g."end") AS inside
            FROM gold g LEFT JOIN base b ON b.doc_id = g.doc_id AND b.entity = g.entity AND b."start" < g."end" AND g."start" < b."end" GROUP BY ALL)
    SELECT entity, CASE WHEN n = 0 THEN 'missed' WHEN exact THEN 'exact' WHEN n > 1 THEN 'split' WHEN around THEN 'overwide' WHEN inside THEN 'partial' ELSE 'boundary_error' END AS outcome,
           count(*) AS n FROM t GROUP BY ALL""", "gold", "base")(evaluate.boundary_taxonomy)
query("universal_groups", """
    , r AS (SELECT doc_id % 97 AS group_id, g = 1 AS positive, fp + fn = 0 AS correct FROM counted),
    k AS (SELECT group_id, bool_or(positive) AS a, bool_or(NOT positive) AS b, bool_and(correct) AS c FROM r GROUP BY group_id)
    SELECT count(*) AS contrast_groups, count(*) FILTER (c) AS all_correct FROM k WHERE a AND b""", "gold", "base")(
    lambda g, b: evaluate.universal_groups(evaluate.outcomes(g, b).select(
        (F.col("doc_id") % 97).alias("group_id"), (F.col("tp") + F.col("fn") > 0).alias("positive"), (F.col("fp") + F.col("fn") == 0).alias("correct"))))


def _with_ops(gold: DataFrame) -> DataFrame:
    ops = F.array_compact(F.array(F.when(F.col("end") % 2 == 0, "spaced"), F.when(F.col("end") % 3 == 0, "masked")))
    return gold.select(*evaluate.SPAN, ops.alias("applied_ops"))


query("stratified_ops_explode", """
    , o AS (SELECT g.*, list_filter([CASE WHEN "end" % 2 = 0 THEN 'spaced' END, CASE WHEN "end" % 3 = 0 THEN 'masked' END], lambda x: x IS NOT NULL) AS ops FROM gold g),
    u AS (SELECT o.doc_id, o.entity, o."start", o."end", unnest(CASE WHEN len(ops) = 0 THEN ['none'] ELSE ops END) AS operation FROM o)
    SELECT operation, count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM base b WHERE b.doc_id = u.doc_id AND b.entity = u.entity AND b."start" = u."start" AND b."end" = u."end")) AS tp
    FROM u GROUP BY operation""", "gold", "base")(lambda g, b: evaluate.by_applied_operation(_with_ops(g), b))
query("nonregression_gate", """
    , a AS (SELECT doc_id, entity, "start", "end", 1 AS g, 0 AS b, 0 AS c FROM gold UNION ALL SELECT doc_id, entity, "start", "end", 0, 1, 0 FROM base
            UNION ALL SELECT doc_id, entity, "start", "end", 0, 0, 1 FROM cand),
    f AS (SELECT doc_id, entity, "start", "end", max(g) AS g, max(b) AS b, max(c) AS c FROM a GROUP BY ALL)
    SELECT * FROM (SELECT doc_id, count(*) FILTER (g = 1 AND b = 1 AND c = 0) AS lost, count(*) FILTER (g = 0 AND b = 0 AND c = 1) AS introduced FROM f GROUP BY doc_id)
    WHERE lost > 0 OR introduced > 0""", "gold", "base", "cand")(evaluate.nonregression)
query("newly_exposed", """SELECT doc_id, entity, "start" AS s, "end" AS e FROM cover JOIN cover2 USING (doc_id, entity, "start", "end")
    WHERE cover.shared = "end" - "start" AND cover2.shared < "end" - "start\"""", "gold", "base", "cand")(
    lambda g, b, c: _se(evaluate.newly_exposed(g.select(*evaluate.SPAN), b, c)))
query("error_ids", "SELECT DISTINCT doc_id FROM counted WHERE fp + fn > 0", "gold", "base")(evaluate.error_ids)
query("shard_merge", f"SELECT entity, tp, fp, fn, {_SCORES.format(z='NULL')} FROM (SELECT entity, {_SUMS} FROM counted GROUP BY entity)", "gold", "base")(
    lambda g, b: evaluate.merge_shards(evaluate.outcomes(g, b).groupBy("entity", (F.col("doc_id") % 7).alias("shard")).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))))
query("reconstruct_predictions", 'SELECT doc_id, entity, "start" AS s, "end" AS e FROM flags WHERE p = 1', "gold", "base")(
    lambda g, b: _se(evaluate.reconstruct(g, evaluate.outcomes(g, b).where("fn = 1"), evaluate.outcomes(g, b).where("fp = 1"))))
query("first_failing_stage", """
    , x AS (SELECT g.doc_id, g.entity, g."start", g."end", b.score FROM gold g LEFT JOIN base b USING (doc_id, entity, "start", "end"))
    SELECT CASE WHEN score IS NULL THEN 'no_exact_proposal' WHEN score < 0.5 THEN 'below_threshold' WHEN "start" % 5 = 0 THEN 'filtered_out' WHEN "end" % 7 = 0 THEN 'overlap_blocked' ELSE 'found' END AS stage,
           count(*) AS n FROM x GROUP BY ALL""", "gold", "base")(lambda g, b: evaluate.first_failing_stage(
    g, b, b.where("score >= 0.5"), b.where("score >= 0.5 AND start % 5 <> 0"), b.where("score >= 0.5 AND start % 5 <> 0 AND end % 7 <> 0")))


def _run(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id").agg(F.sort_array(F.collect_list("start")).alias("spans"), F.round(F.max("score"), 6).alias("score"),
                                    F.count("*").alias("masked"))


query("run_parity", """
    , a AS (SELECT doc_id, list_sort(list("start")) AS s, max(score) AS p, count(*) AS m FROM base GROUP BY doc_id),
    b AS (SELECT doc_id, list_sort(list("start")) AS s, max(score) AS p, count(*) AS m FROM cand GROUP BY doc_id)
    SELECT count(*) AS cases, count(*) FILTER (a.s IS DISTINCT FROM b.s) AS spans, count(*) FILTER (a.p IS DISTINCT FROM b.p) AS scores,
           count(*) FILTER (a.m IS DISTINCT FROM b.m) AS masks, round(max(abs(a.p - b.p)), 6) AS largest_gap FROM a FULL JOIN b USING (doc_id)""",
      "base", "cand")(lambda b, c: evaluate.parity(_run(b), _run(c)))


def _reports(b: DataFrame, g: DataFrame) -> DataFrame:
    """F1 by threshold (the configuration) and track (the source)."""
    parts = None
    for at, threshold in enumerate((0.4, 0.6, 0.8)):
        flags = evaluate.outcomes(g, b.where(F.col("score") >= threshold), (*evaluate.SPAN, "track"))
        rows = evaluate.with_scores(flags.groupBy("track").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")), 0.0)
        rows = rows.select(F.lit(f"t{at}").alias("config"), F.lit(threshold).alias("threshold"), F.lit(at).alias("epoch"), "track", "tp", "fp", "fn", "f1")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


_REPORTS = """
    , th(config, threshold, epoch) AS (VALUES ('t0', cast(0.4 as double), 0), ('t1', cast(0.6 as double), 1), ('t2', cast(0.8 as double), 2)),
    tg AS (SELECT config, threshold, epoch, doc_id, entity, "start", "end", track, 1 AS g, 0 AS p FROM gold, th
           UNION ALL SELECT config, threshold, epoch, doc_id, entity, "start", "end", track, 0, 1 FROM base, th WHERE score >= threshold),
    fg AS (SELECT config, threshold, epoch, doc_id, entity, "start", "end", track, max(g) AS g, max(p) AS p FROM tg GROUP BY ALL),
    rep AS (SELECT config, threshold, epoch, track, cast(sum(g * p) as bigint) AS tp, cast(sum((1 - g) * p) as bigint) AS fp, cast(sum(g * (1 - p)) as bigint) AS fn FROM fg GROUP BY ALL),
    reports AS (SELECT *, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM rep)"""
query("macro_rank", _REPORTS + " SELECT config, threshold, epoch, round(avg(f1), 6) AS mean_f1, cast(sum(fp) as bigint) AS fp FROM reports GROUP BY ALL", "base", "gold")(
    lambda b, g: evaluate.macro_rank(_reports(b, g)))
query("choose_policy", _REPORTS + """ SELECT config, track, tp, fp, fn, f1 FROM reports WHERE fp < 1000000 AND tp > 0 AND track = 'prose'
    ORDER BY f1 DESC, fp, config LIMIT 1""", "base", "gold")(lambda b, g: evaluate.choose(
    _reports(b, g), (F.col("fp") < 1000000) & (F.col("tp") > 0) & (F.col("track") == "prose"), [F.desc("f1"), F.col("fp"), F.col("config")]).select(
        "config", "track", "tp", "fp", "fn", "f1"))
query("release_gate", _REPORTS + """
    SELECT config, track, rule FROM (SELECT config, track, unnest(list_filter([CASE WHEN NOT (f1 >= 0.5) THEN 'f1 floor' END, CASE WHEN NOT (fp <= fn) THEN 'no more alarms than misses' END], lambda x: x IS NOT NULL)) AS rule FROM reports)""",
      "base", "gold")(lambda b, g: evaluate.violations(_reports(b, g), {
          "f1 floor": F.col("f1") >= 0.5, "no more alarms than misses": F.col("fp") <= F.col("fn")}).select("config", "track", "rule"))
query("metric_consistency", _REPORTS + """
    SELECT config, track, 'gold is tp plus fn' AS rule FROM reports WHERE config = 't1'""", "base", "gold")(
    lambda b, g: evaluate.consistent(_reports(b, g).withColumn(
        "gold", F.col("tp") + F.col("fn") + (F.col("config") == "t1").cast("long")).withColumn("covered", F.col("tp"))).select("config", "track", "rule"))
query("recall_by_template", """
    SELECT entity, track AS template, count(*) AS cases, count(*) FILTER (g."end" % 2 = 0) AS hits, count(*) FILTER (g."end" % 2 = 0 OR g."end" % 3 = 0) AS covered, cast(sum(g."start" % 3) as bigint) AS extra
    FROM gold g GROUP BY ALL""", "gold")(lambda g: evaluate.recall_table(g.select(
        "entity", F.col("track").alias("template"), (F.col("end") % 2 == 0).alias("hit"), ((F.col("end") % 2 == 0) | (F.col("end") % 3 == 0)).alias("covered"),
        (F.col("start") % 3).cast("long").alias("extra"))))


@query("bootstrap_ci", None, "gold", "base", "cand")
def _bootstrap(g: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    sums = lambda p, s: evaluate.outcomes(g, p).groupBy("doc_id").agg(*(F.sum(x).alias(f"{x}_{s}") for x in ("tp", "fp", "fn")))
    return evaluate.bootstrap(sums(b, "b").join(sums(c, "c"), "doc_id", "full").na.fill(0))


def median_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms"))
    return evaluate.medians(rows, "event_type")


QUERIES["median_timing"] = (median_timing, "SELECT event_type, round(median(value), 6) AS median_ms, count(*) AS runs FROM events GROUP BY event_type")


def changed_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that star masking changed."""
    from maskloom.operators.detect import Detector

    rows = B.table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'번호 ' || {B.MOBILE}").alias("text"))
    masked = rows.withColumn("masked", Detector().mask(F.col("text"), "stars"))
    return masked.select("c_custkey", F.array_join(evaluate.changed_characters(F.col("text"), F.col("masked")).cast("array<string>"), ",").alias("changed"))


QUERIES["changed_characters"] = (changed_characters, "SELECT c_custkey, '3,4,5,6,7,8,9,10,11,12,13,14,15' AS changed FROM customer")
