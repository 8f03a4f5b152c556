"""Queries of the evaluators over several systems, the probes, the array kernels and corpus versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom import udfs
from maskloom.functions import generate, masking, text as texts
from maskloom.operators import arrays, compare, corpus, evaluate, structured
from maskloom.operators.detect import Detector, all_entities
from maskloom.plans import measurement
from maskloom.plans import tables as B
from maskloom.plans.measurement import _SCORES, _SUMS, _WITH
from maskloom.runtime import spread

QUERIES: dict[str, tuple[Callable, str | None]] = {}
SYSTEMS = ("base", "cand")


def query(name: str, sql: str | None, *inputs: str):
    """Register a function of tables under a name."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = (lambda spark, sf_dir: function(*(B.table(spark, sf_dir, i) for i in inputs)), sql)
        return function

    return register


def spans(name: str, sql: str, *inputs: str):
    """Register a function of span tables under a name."""
    source = {"gold": B.GOLD, "base": B.BASE, "cand": B.CANDIDATE, "neg": B.NEGATIVE, "ign": B.IGNORE}

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = (lambda spark, sf_dir: function(*(B.spans(spark, sf_dir, source[i]) for i in inputs)), _WITH + sql)
        return function

    return register


def _systems(base: DataFrame, cand: DataFrame) -> DataFrame:
    key = ["doc_id", "entity", "start", "end"]
    return base.select(F.lit("base").alias("system"), *key).union(cand.select(F.lit("cand").alias("system"), *key))


# --- systems, versions, sources -------------------------------------------------------------------

_COUNTED = """
    , t2 AS (SELECT doc_id, entity, "start", "end", 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, entity, "start", "end", 0, 1 FROM cand),
    f2 AS (SELECT doc_id, entity, "start", "end", max(g) AS g, max(p) AS p FROM t2 GROUP BY ALL), c2 AS (SELECT *, g * p AS tp, (1 - g) * p AS fp, g * (1 - p) AS fn FROM f2),
    n AS (SELECT 'base' AS system, * FROM counted UNION ALL SELECT 'cand', * FROM c2),
    v AS (SELECT 'base' AS system, doc_id, shared = "end" - "start" AS ok FROM cover UNION ALL SELECT 'cand', doc_id, shared = "end" - "start" FROM cover2),
    d AS (SELECT system, doc_id, count(*) AS gold, count(*) FILTER (ok) AS covered FROM v GROUP BY ALL)"""

spans("systems_report", _COUNTED + f"""
    , h AS (SELECT 'base' AS system, count(*) AS hit FROM neg g WHERE EXISTS (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b."start" < g."end" AND g."start" < b."end")
            UNION ALL SELECT 'cand', count(*) FROM neg g WHERE EXISTS (SELECT 1 FROM cand b WHERE b.doc_id = g.doc_id AND b."start" < g."end" AND g."start" < b."end")),
    s AS (SELECT system, {_SUMS} FROM n GROUP BY system),
    c AS (SELECT system, cast(sum(gold) as bigint) AS gold, cast(sum(covered) as bigint) AS covered, count(*) AS positive, count(*) FILTER (covered < gold) AS leaking FROM d GROUP BY system)
    SELECT s.system, tp, fp, fn, {_SCORES.format(z='NULL')}, gold, covered, positive, leaking, hit AS negatives_hit FROM s JOIN c USING (system) JOIN h USING (system)""",
      "gold", "base", "cand", "neg")(lambda g, b, c, n: compare.systems_report(g, _systems(b, c), SYSTEMS, n))
spans("version_gate", """
    , a AS (SELECT doc_id, entity, "start", "end", max(g) AS g, max(b) AS b, max(c) AS c FROM (
        SELECT doc_id, entity, "start", "end", 1 AS g, 0 AS b, 0 AS c FROM gold UNION ALL SELECT doc_id, entity, "start", "end", 0, 1, 0 FROM base UNION ALL SELECT doc_id, entity, "start", "end", 0, 0, 1 FROM cand) GROUP BY ALL),
    x AS (SELECT count(*) AS exposed FROM cover JOIN cover2 USING (doc_id, entity, "start", "end") WHERE cover.shared = "end" - "start" AND cover2.shared < "end" - "start")
    SELECT 'base' AS base, 'cand' AS candidate, count(*) FILTER (g = 1 AND b = 1 AND c = 0) AS lost, count(*) FILTER (g = 0 AND b = 0 AND c = 1) AS introduced, (SELECT exposed FROM x) AS exposed,
           count(*) FILTER (g = 1 AND b = 1 AND c = 0) = 0 AND count(*) FILTER (g = 0 AND b = 0 AND c = 1) = 0 AND (SELECT exposed FROM x) = 0 AS passes FROM a""",
      "gold", "base", "cand")(lambda g, b, c: compare.versions(g, _systems(b, c), SYSTEMS))


def _cased(rows: DataFrame) -> DataFrame:
    """Documents named by a case id that ends in its source."""
    return rows.withColumn("doc_id", F.concat(F.lit("case-"), F.col("doc_id").cast("string"), F.lit("-s"), (F.col("doc_id") % 3).cast("string")))


spans("metrics_by_source", f"SELECT source, tp, fp, fn, {_SCORES.format(z='NULL')} FROM (SELECT 's' || cast(doc_id % 3 as varchar) AS source, {_SUMS} FROM counted GROUP BY 1)",
      "gold", "base")(lambda g, b: compare.by_source(_cased(g), _cased(b)))
spans("paired_sources", _COUNTED + f"""
    , a AS (SELECT doc_id, entity, "start", "end", max(g) AS g, max(b) AS b, max(c) AS c FROM (
        SELECT doc_id, entity, "start", "end", 1 AS g, 0 AS b, 0 AS c FROM gold UNION ALL SELECT doc_id, entity, "start", "end", 0, 1, 0 FROM base UNION ALL SELECT doc_id, entity, "start", "end", 0, 0, 1 FROM cand) GROUP BY ALL),
    l AS (SELECT 's' || cast(doc_id % 3 as varchar) AS source, count(*) FILTER (g = 1 AND b = 1 AND c = 0) AS lost, count(*) FILTER (g = 0 AND b = 0 AND c = 1) AS introduced FROM a GROUP BY 1),
    s AS (SELECT system, 's' || cast(doc_id % 3 as varchar) AS source, {_SUMS} FROM n GROUP BY 1, 2), f AS (SELECT system, source, {_SCORES.format(z='NULL')} FROM s)
    SELECT source, max(f1) FILTER (system = 'base') AS f1_base, max(f1) FILTER (system = 'cand') AS f1_candidate, any_value(lost) AS lost, any_value(introduced) AS introduced FROM f JOIN l USING (source) GROUP BY source""",
      "gold", "base", "cand")(lambda g, b, c: compare.paired_sources(_cased(g), _cased(b), _cased(c)))
spans("replay_comparison", """
    , p AS (SELECT a.score AS x, b.score AS y, a.doc_id AS i, b.doc_id AS j FROM base a FULL JOIN cand b ON a.doc_id = b.doc_id AND a.entity = b.entity AND a."start" = b."start" AND a."end" = b."end")
    SELECT count(*) FILTER (j IS NULL) AS only_first, count(*) FILTER (i IS NULL) AS only_second, round(max(abs(x - y)), 6) AS largest_gap FROM p""",
      "base", "cand")(compare.replay)
spans("type_map_scores", f"""
    , m AS (SELECT doc_id, CASE entity WHEN 'PHONE_NUMBER' THEN 'PHONE_NUMBER' WHEN 'EMAIL_ADDRESS' THEN 'PHONE_NUMBER' END AS entity, "start", "end" FROM base WHERE entity IN ('PHONE_NUMBER', 'EMAIL_ADDRESS')),
    t3 AS (SELECT doc_id, entity, "start", "end", 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, entity, "start", "end", 0, 1 FROM m), f3 AS (SELECT doc_id, entity, "start", "end", max(g) AS g, max(p) AS p FROM t3 GROUP BY ALL),
    c3 AS (SELECT entity, g * p AS tp, (1 - g) * p AS fp, g * (1 - p) AS fn FROM f3)
    SELECT entity, tp, fp, fn, {_SCORES.format(z='NULL')} FROM (SELECT entity, {_SUMS} FROM c3 GROUP BY entity)""",
      "gold", "base")(lambda g, b: evaluate.by_entity(g, compare.mapped(
          b.withColumn("entity", F.concat(F.lit("x-"), "entity")), {"x-PHONE_NUMBER": "PHONE_NUMBER", "x-EMAIL_ADDRESS": "PHONE_NUMBER"})))
spans("policy_grid", """
    SELECT threshold, longest, count(*) AS spans FROM base CROSS JOIN (VALUES (0.4), (0.6), (0.8)) a(threshold) CROSS JOIN (VALUES (8), (12)) b(longest)
    WHERE score >= threshold AND "end" - "start" <= longest GROUP BY ALL""", "base")(
    lambda b: compare.grid(b, threshold=[0.4, 0.6, 0.8], longest=[8, 12]).where("score >= threshold and `end` - `start` <= longest").groupBy(
        F.col("threshold").cast("double").alias("threshold"), "longest").agg(F.count("*").alias("spans")))
_REPORTS = """(SELECT p_size % 10 AS cutoff, cast(sum(p_size) as bigint) AS covered, cast(sum(p_partkey % 5) as bigint) AS extra_characters, count(*) AS false_sentences,
    cast(sum(p_partkey % 3) as double) / 1000 AS f1 FROM part GROUP BY 1)"""
query("coverage_cutoff", f"""
    SELECT cutoff, covered, extra_characters, false_sentences, round(f1, 6) AS f1 FROM {_REPORTS} WHERE covered >= 100 AND f1 >= 0.01 AND false_sentences <= 100000 AND extra_characters <= 100000
    ORDER BY covered DESC, extra_characters, f1 DESC, cutoff LIMIT 1""", "part")(
    lambda p: compare.coverage_cutoff(p.groupBy((F.col("p_size") % 10).alias("cutoff")).agg(
        F.sum("p_size").alias("covered"), F.sum(F.col("p_partkey") % 5).alias("extra_characters"), F.count("*").alias("false_sentences"),
        F.round(F.sum(F.col("p_partkey") % 3).cast("double") / 1000, 6).alias("f1")),
        {"covered": 100, "f1": 0.01, "false_sentences": 100000, "extra_characters": 100000}))


# --- structured fields ----------------------------------------------------------------------------

#: four leaves for each customer and system: a name, a number, a note, and a key
_LEAVES = """SELECT s.system, c_custkey AS doc_id, l.leaf, CASE l.leaf WHEN 0 THEN c_name WHEN 1 THEN '010-1234' WHEN 2 THEN c_mktsegment ELSE 'key' END AS original,
    CASE l.leaf WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '<KR_NAME>' WHEN c_custkey % 3 = 1 THEN '<KR_ADDRESS>' ELSE c_name END
                WHEN 1 THEN CASE WHEN s.system = 'cand' OR c_custkey % 2 = 0 THEN '<PHONE_NUMBER>' ELSE '010-1234' END
                WHEN 2 THEN CASE WHEN c_custkey % 7 = 0 THEN '<X>' ELSE c_mktsegment END ELSE CASE WHEN c_custkey % 11 = 0 THEN '<K>' ELSE 'key' END END AS tagged,
    CASE l.leaf WHEN 0 THEN CASE WHEN c_custkey % 3 < 2 THEN repeat('*', length(c_name)) ELSE c_name END
                WHEN 1 THEN CASE WHEN s.system = 'cand' THEN '********' WHEN c_custkey % 2 = 0 THEN '010*****' ELSE '010-1234' END
                WHEN 2 THEN CASE WHEN c_custkey % 7 = 0 THEN repeat('*', length(c_mktsegment)) ELSE c_mktsegment END ELSE CASE WHEN c_custkey % 11 = 0 THEN '***' ELSE 'key' END END AS starred,
    CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN l.leaf = 0 THEN 'KR_NAME' WHEN l.leaf = 1 THEN 'PHONE_NUMBER' END AS gold,
    l.leaf = 3 AS is_key, l.leaf = 0 AND c_custkey % 13 = 0 AS ignored, l.leaf = 2 AND c_custkey % 2 = 0 AS negative
    FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) l(leaf) CROSS JOIN (VALUES ('base'), ('cand')) s(system)"""
_FLAGGED = f"""WITH leaves AS ({_LEAVES}), f AS (SELECT *, NOT is_key AND NOT ignored AS counts, gold IS NOT NULL AS target, tagged <> original OR starred <> original AS changed,
    coalesce(tagged = '<' || gold || '>' AND tagged <> original, false) AS exact, coalesce(gold IS NOT NULL AND starred = repeat('*', length(original)) AND starred <> original, false) AS is_full FROM leaves)"""


def _leaves(c: DataFrame) -> DataFrame:
    return c.sparkSession.sql(_LEAVES.replace("FROM customer", "FROM {customer}"), customer=c)


query("field_counters", _FLAGGED + """
    , r AS (SELECT system, doc_id, count(*) FILTER (counts AND target) AS targets, count(*) FILTER (counts AND target AND exact) AS exact_type, count(*) FILTER (counts AND target AND is_full) AS fully_masked,
        count(*) FILTER (counts AND NOT target) AS others, count(*) FILTER (counts AND NOT target AND changed) AS others_changed, count(*) FILTER (counts AND NOT target AND negative) AS negatives,
        count(*) FILTER (counts AND NOT target AND negative AND changed) AS negatives_changed, count(*) FILTER (NOT is_key AND ignored) AS ignored, count(*) FILTER (is_key AND changed) AS keys_changed FROM f GROUP BY ALL)
    SELECT system, cast(sum(targets) as bigint) AS targets, cast(sum(exact_type) as bigint) AS exact_type, cast(sum(fully_masked) as bigint) AS fully_masked, cast(sum(others) as bigint) AS others,
        cast(sum(others_changed) as bigint) AS others_changed, cast(sum(negatives) as bigint) AS negatives, cast(sum(negatives_changed) as bigint) AS negatives_changed, cast(sum(ignored) as bigint) AS ignored,
        cast(sum(keys_changed) as bigint) AS keys_changed, count(*) FILTER (targets > 0) AS positive_records, count(*) FILTER (targets > 0 AND fully_masked < targets) AS positive_records_leaking,
        count(*) FILTER (targets = 0) AS negative_records, count(*) FILTER (targets = 0 AND others_changed > 0) AS negative_records_changed FROM r GROUP BY system""", "customer")(
    lambda c: compare.field_counters(_leaves(c)))
query("field_types", _FLAGGED + """
    SELECT system, gold, count(*) AS fields, count(*) FILTER (exact) AS exact_type, count(*) FILTER (is_full) AS fully_masked,
        count(*) FILTER (regexp_matches(tagged, '^<[A-Z_]+>$') AND tagged <> '<' || gold || '>') AS wrong_type FROM f WHERE counts AND target GROUP BY ALL""", "customer")(
    lambda c: compare.field_types(_leaves(c)))


@query("strict_against_default", """
    SELECT m.system, 4 * count(*) AS fields, (2 + m.more) * count(*) AS masked, cast(0 as bigint) AS notes_changed FROM customer CROSS JOIN (VALUES ('default', 0), ('strict', 1)) m(system, more) GROUP BY m.system, m.more""", "customer")
def strict_against_default(c: DataFrame) -> DataFrame:
    """The same records masked by default and strictly: an account of no known form is masked by the second alone."""
    rows = spread(c.select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(
        F.lit("김민서").alias("고객명"), F.expr(B.MOBILE).alias("휴대폰번호"), F.lit("abc-1").alias("계좌번호"), F.lit("문 앞에 두세요").alias("비고"))).alias("d"))
    out = None
    for system, strict in (("default", False), ("strict", True)):
        masked = structured.mask_json(rows, "d", all_entities(), "stars", strict)
        leaves = structured.paired_leaves(rows, masked, "doc_id", "d").where(F.col("n") % 2 == 1)  # keys and values alternate
        changed = F.col("before") != F.col("after")
        part = leaves.agg(F.count("*").alias("fields"), F.count_if(changed).alias("masked"), F.count_if(changed & (F.col("n") == 7)).alias("notes_changed"))
        out = part.withColumn("system", F.lit(system)) if out is None else out.unionByName(part.withColumn("system", F.lit(system)))
    return out


@query("transform_json", """SELECT c_custkey, '{"NAME": "' || upper(c_name) || '", "TAGS": ["A", 7, null, {"K": "' || c_mktsegment || '"}]}' AS d FROM customer""", "customer")
def transform_json(c: DataFrame) -> DataFrame:
    rows = c.select("c_custkey", F.concat(F.lit('{"name": "'), F.lower("c_name"), F.lit('", "tags": ["a", 7, null, {"k": "'), F.lower("c_mktsegment"), F.lit('"}]}')).alias("d"))
    return structured.transform_json(rows, "d", lambda text, label: text.upper(), pure=True)


# --- probes ---------------------------------------------------------------------------------------

_NEGATIVES = {
    "sales": "'오늘 매출은 ' || cast(1 + o_orderkey * 7919 % 9999999 as string) || '원입니다'",
    "meeting": "'회의는 2026-' || lpad(cast(1 + o_orderkey % 12 as string), 2, '0') || '-' || lpad(cast(1 + o_orderkey % 28 as string), 2, '0') || ' 14:00에 합니다'",
    "version": "'버전 ' || cast(1 + o_orderkey % 9 as string) || '.' || cast(o_orderkey % 21 as string) || '.' || cast(o_orderkey % 100 as string) || '로 업데이트했습니다'",
    "stock": "'재고 ' || cast(1 + o_orderkey % 99999 as string) || '개, 단가 ' || cast(100 + o_orderkey * 31 % 99900 as string) || '원'",
    "reference": "'참조번호 777777' || lpad(cast(o_orderkey * 104729 % 100000000 as string), 8, '0')",
    "product": "'상품코드 X' || lpad(cast(o_orderkey * 15485863 as string), 14, '0')",
}


@query("numeric_negatives", f"SELECT t.template, count(*) AS texts, cast(0 as bigint) AS flagged, cast(0 as bigint) AS findings FROM orders CROSS JOIN (VALUES {', '.join(repr((t,)).replace(',)', ')') for t in _NEGATIVES)}) t(template) GROUP BY t.template", "orders")
def numeric_negatives(o: DataFrame) -> DataFrame:
    """Numbers that are nobody's, in sentences: none may be flagged (target A9)."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("template"), F.expr(x).alias("text")) for t, x in _NEGATIVES.items())))
    return compare.false_alarms(compare.probes(spread(o.select("o_orderkey")).select(each.alias("x")).select("x.*"), Detector()))


_COLLISIONS = {"rrn": lambda k: generate.registration(k), "rrn bare": lambda k: generate.registration(k, dash=False), "brn": lambda k: generate.business(k),
               "mobile": lambda k: generate.mobile(k), "mobile bare": lambda k: generate.mobile(k, "")}


@query("identifier_collisions", f"SELECT t.template, count(*) AS texts, cast(0 as bigint) AS mislabelled FROM customer CROSS JOIN (VALUES {', '.join(repr((t,)).replace(',)', ')') for t in _COLLISIONS)}) t(template) GROUP BY t.template", "customer")
def identifier_collisions(c: DataFrame) -> DataFrame:
    """Other identifiers where an account is asked for: none may be taken for one (target A10)."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("template"), F.concat(F.lit("은행 계좌 확인: "), make(F.col("c_custkey"))).alias("text")) for t, make in _COLLISIONS.items())))
    return compare.mislabelled(compare.probes(spread(c.select("c_custkey")).select(each.alias("x")).select("x.*"), Detector()), "KR_ACCOUNT")


@query("synthetic_recall", """
    SELECT t.entity, t.template, count(*) AS cases, count(*) AS hits, count(*) AS covered, cast(0 as bigint) AS extra FROM customer
    CROSS JOIN (VALUES ('KR_RRN', '주민번호'), ('PHONE_NUMBER', '연락처'), ('EMAIL_ADDRESS', '메일'), ('KR_DRIVER_LICENSE', '운전면허번호')) t(entity, template) GROUP BY ALL""", "customer")
def synthetic_recall(c: DataFrame) -> DataFrame:
    """Generated identifiers behind their labels: all are found, masked, and nothing else is (EVL8)."""
    key = F.col("c_custkey")
    cases = [("KR_RRN", "주민번호", generate.registration(key)), ("PHONE_NUMBER", "연락처", generate.mobile(key)),
             ("EMAIL_ADDRESS", "메일", generate.email(key)), ("KR_DRIVER_LICENSE", "운전면허번호", generate.license_number(key))]
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("entity"), F.lit(t).alias("template"), n.alias("number"), F.concat(F.lit(f"{t} "), n, F.lit(" 확인")).alias("text")) for e, t, n in cases)))
    rows = spread(c.select("c_custkey")).select(each.alias("x")).select("x.*")
    probed = compare.probes(rows, Detector())
    probed = probed.withColumn("masked", masking.splice(F.col("text"), F.col("findings"), "stars"))  # by the same analysis
    return evaluate.recall_table(compare.recalled(probed))


# --- array kernels --------------------------------------------------------------------------------

_FEATURES = "transform(sequence(0, 15), i -> transform(slice(embedding, 4 * i + 1, 4), x -> cast(x as double)))"


@query("span_context", """
    WITH f AS (SELECT vec_id, list_transform(range(0, 16), lambda i: list_transform(embedding[4 * i + 1 : 4 * i + 4], lambda x: cast(x as double))) AS rows, cast(vec_id % 5 as int) AS s, cast(vec_id % 5 + 3 as int) AS e FROM embeddings WHERE len(embedding) = 64),
    c AS (SELECT *, [list_avg(list_transform(rows, lambda r: r[1])), list_avg(list_transform(rows, lambda r: r[2])), list_avg(list_transform(rows, lambda r: r[3])), list_avg(list_transform(rows, lambda r: r[4])),
        list_avg(list_transform(rows[s + 1 : e], lambda r: r[1])), list_avg(list_transform(rows[s + 1 : e], lambda r: r[2])), list_avg(list_transform(rows[s + 1 : e], lambda r: r[3])), list_avg(list_transform(rows[s + 1 : e], lambda r: r[4])),
        list_max(list_transform(rows[s + 1 : e], lambda r: r[1])), list_max(list_transform(rows[s + 1 : e], lambda r: r[2])), list_max(list_transform(rows[s + 1 : e], lambda r: r[3])), list_max(list_transform(rows[s + 1 : e], lambda r: r[4])),
        coalesce(list_avg(list_transform(rows[greatest(0, s - 2) + 1 : s], lambda r: r[1])), 0), coalesce(list_avg(list_transform(rows[greatest(0, s - 2) + 1 : s], lambda r: r[2])), 0),
        coalesce(list_avg(list_transform(rows[greatest(0, s - 2) + 1 : s], lambda r: r[3])), 0), coalesce(list_avg(list_transform(rows[greatest(0, s - 2) + 1 : s], lambda r: r[4])), 0),
        list_avg(list_transform(rows[e + 1 : e + 2], lambda r: r[1])), list_avg(list_transform(rows[e + 1 : e + 2], lambda r: r[2])), list_avg(list_transform(rows[e + 1 : e + 2], lambda r: r[3])), list_avg(list_transform(rows[e + 1 : e + 2], lambda r: r[4])),
        s / 16.0, e / 16.0] AS v FROM f)
    SELECT vec_id, unnest(range(0, 22)) AS i, round(unnest(v), 6) AS x FROM c""", "embeddings")
def span_context(e: DataFrame) -> DataFrame:
    rows = e.where(F.size("embedding") == 64).select("vec_id", F.expr(_FEATURES).alias("f"), F.array(F.struct(
        (F.col("vec_id") % 5).cast("int").alias("start"), (F.col("vec_id") % 5 + 3).cast("int").alias("end"))).alias("spans"))
    vectors = rows.select("vec_id", F.posexplode(F.get(arrays.span_context(F.col("f"), F.col("spans"), True, 2), F.lit(0))).alias("i", "x"))
    return vectors.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


query("reject_confident", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PHONE_NUMBER' ELSE 'KR_NAME,PHONE_NUMBER' END AS kept FROM customer""", "customer")(
    lambda c: c.select("c_custkey", F.array_join(F.transform(arrays.reject_confident(
        F.array(*(F.struct(F.lit(e).alias("entity"), F.lit(0).alias("start"), F.lit(2).alias("end")) for e in ("KR_NAME", "PHONE_NUMBER"))),
        F.array(F.when(F.col("c_custkey") % 3 == 0, 0.995).when(F.col("c_custkey") % 3 == 1, 0.5), F.lit(1.0))), lambda s: s["entity"]), ",").alias("kept")))
_WINDOWS = """SELECT user_id AS doc_id, event_id, p.pos, w.window_no, w.window_no * 8 AS "left", w.window_no * 8 + 16 AS "right" FROM (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id)
    CROSS JOIN (SELECT unnest(range(0, 24)) AS pos) p CROSS JOIN (VALUES (0), (1)) w(window_no) WHERE p.pos >= w.window_no * 8 AND p.pos < w.window_no * 8 + 16"""


@query("window_decode", """
    SELECT user_id AS doc_id, s.s, s.e FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES (2, 5), (12, 14)) s(s, e) WHERE s.s = 2 OR user_id % 2 = 0""", "events")
def window_decode(e: DataFrame) -> DataFrame:
    """Two windows of 16 characters over 24: a name at 2 to 5 in the first, and at 12 to 14 one that only the deeper window sees."""
    docs = e.select(F.col("user_id").alias("doc_id")).distinct()
    rows = docs.select("doc_id", F.explode(F.expr("flatten(transform(array(0, 1), w -> transform(sequence(0, 15), i -> struct(w as window_no, 8 * w + i as pos))))")).alias("x")).select(
        "doc_id", "x.*", (F.col("x.window_no") * 8).alias("left"), (F.col("x.window_no") * 8 + 16).alias("right"))
    deeper = F.least(F.col("pos") - F.col("left"), F.col("right") - 1 - F.col("pos"))
    seen = F.when(F.col("pos") < 12, (F.col("window_no") == 0) | (deeper < 0)).otherwise((F.col("window_no") == 1) & (F.col("doc_id") % 2 == 0))
    label = (F.when(F.col("pos") == 2, 1).when(F.col("pos") == 3, 2).when(F.col("pos") == 4, 3)
             .when((F.col("pos") == 12) & seen, 1).when((F.col("pos") == 13) & seen, 3).otherwise(0))
    logits = F.array(*(F.when(label == k, 5.0).otherwise(-5.0) for k in range(5)))
    out = arrays.merged_decode(rows.withColumn("logits", logits), docs.withColumn("n", F.lit(24)), 0.5)
    return out.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))


@query("character_prior", """
    WITH d AS (SELECT c_custkey AS doc_id, cast(c_custkey % 10 as double) / 10 AS q FROM customer), c AS (SELECT doc_id, q, p.pos FROM d CROSS JOIN (VALUES (0), (1), (2), (3), (4)) p(pos))
    SELECT doc_id, pos, round(CASE pos WHEN 3 THEN 1 WHEN 4 THEN 1 - q ELSE 1 - q END, 6) AS "O",
           round(CASE pos WHEN 0 THEN q ELSE 0 END, 6) AS "B", round(CASE pos WHEN 1 THEN q ELSE 0 END, 6) AS "I", round(CASE pos WHEN 2 THEN q ELSE 0 END, 6) AS "E", round(CASE pos WHEN 4 THEN q ELSE 0 END, 6) AS "S" FROM c""", "customer")
def character_prior(c: DataFrame) -> DataFrame:
    """Five characters: a token of three and, after a gap, one of one character, both S-NAME with probability q."""
    docs = c.select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 10).cast("double").alias("q") / 10)
    chars = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    tokens = docs.select("doc_id", F.explode(F.expr("array(struct(0 as token, 0 as start, 3 as end), struct(1 as token, 4 as start, 5 as end))")).alias("t")).select("doc_id", "t.*")
    return arrays.character_prior(chars, tokens, _classes(c)).select("doc_id", "pos", *(F.round(s, 6).alias(s) for s in arrays.STATES))


def _classes(c: DataFrame) -> DataFrame:
    q = (F.col("c_custkey") % 10).cast("double") / 10
    pairs = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(label).alias("label"), p.alias("p")) for t in (0, 1) for label, p in (("S-NAME", q), ("B-ORG", (1 - q) / 2), ("O", (1 - q) / 2))))
    return c.select(F.col("c_custkey").alias("doc_id"), F.explode(pairs).alias("x")).select("doc_id", "x.*")


# --- corpus versions, fingerprints, guards --------------------------------------------------------

query("dedup_signatures", """
    WITH r AS (SELECT doc_id, text, lang, source, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
    c AS (SELECT h FROM r GROUP BY h HAVING coalesce(min(lang) <> max(lang), false) OR coalesce(min(doc_id % 1000 // 999) <> max(doc_id % 1000 // 999), false)),
    x AS (SELECT h FROM r WHERE doc_id % 50 = 0)
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM r WHERE h NOT IN (SELECT h FROM c) AND h NOT IN (SELECT h FROM x)) WHERE n = 1""", "documents")(
    lambda d: corpus.dedup_by_signatures(
        d.where("text is not null").withColumn("full_signature", F.expr("doc_id % 1000 div 999")), "text", ["lang", "full_signature"], ["doc_id"],
        d.where("text is not null and doc_id % 50 = 0").select(texts.fingerprint(F.col("text")).alias("h"))).select("doc_id"))
query("corpus_manifest", """
    SELECT lang, count(*) AS rows, cast(sum(cast(('0x' || substr(sha256(cast(doc_id as varchar) || chr(31) || coalesce(text, '')), 1, 15)) as bigint)) as varchar) AS digest FROM documents GROUP BY lang""", "documents")(
    lambda d: corpus.manifest(d, ["lang"], ["doc_id", "text"]))
query("next_version", """
    WITH o AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'train' ELSE 'test' END AS split FROM documents WHERE doc_id % 4 <> 0 AND text IS NOT NULL),
    f AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL AND text NOT IN (SELECT text FROM o))
    SELECT doc_id, split FROM o UNION ALL SELECT doc_id, 'frozen' FROM f WHERE n = 1""", "documents")(
    lambda d: corpus.next_version(
        d.where("doc_id % 4 <> 0 and text is not null").select("doc_id", "text", F.expr("case doc_id % 3 when 0 then 'train' when 1 then 'retired' else 'test' end").alias("split")),
        d.where("doc_id % 4 = 0 and text is not null").select("doc_id", "text"), "text", "retired", "frozen").select("doc_id", "split"))
query("json_fingerprints", """
    SELECT c_custkey, sha256('{"a":' || cast(c_custkey as varchar) || ',"b":["' || c_mktsegment || '",null,true],"c":{"x":1,"y":2}}') AS digest FROM customer""", "customer")(
    lambda c: c.select("c_custkey", texts.json_fingerprint(F.concat(
        F.lit('{ "c": {"y": 2, "x": 1}, "b": ["'), "c_mktsegment", F.lit('", null, true],  "a": '), F.col("c_custkey").cast("string"), F.lit("}"))).alias("digest")))
query("honorific_fields", "SELECT c_custkey, 5 AS s, 8 AS e FROM customer", "customer")(
    lambda c: c.select("c_custkey", F.explode(all_entities().findings(F.concat(F.lit("고객명: 김민서 님 / 주문 "), F.col("c_custkey").cast("string")))).alias("f")).where(
        "f.entity = 'KR_NAME'").select("c_custkey", F.col("f.start").alias("s"), F.col("f.end").alias("e")))
query("guard_verdicts", f"""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'fail' ELSE 'pass' END AS outcome, CASE WHEN c_custkey % 2 = 0 THEN '연락처 <PHONE_NUMBER> 확인' ELSE '확인 바랍니다' END AS fix_value,
           CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS errors FROM customer""", "customer")(
    lambda c: udfs.guard(spread(c.select("c_custkey")).select("c_custkey", F.expr(f"CASE WHEN c_custkey % 2 = 0 THEN '연락처 ' || {B.MOBILE} || ' 확인' ELSE '확인 바랍니다' END").alias("text")), "text").select(
        "c_custkey", "outcome", "fix_value", F.size("error_spans").alias("errors")))

assert not set(QUERIES) & set(measurement.QUERIES)
