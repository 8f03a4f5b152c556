"""Queries of corpus preparation, label sequences, validation, decoding and plain sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators import corpus, decode, sequence, validate
from maskloom.plans import tables as B
from maskloom.runtime import spread

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None, *inputs: str):
    """Register a function of tables under a name."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = (lambda spark, sf_dir: function(*(B.table(spark, sf_dir, i) for i in inputs)), sql)
        return function

    return register


# --- sampling, splits and deduplication --------------------------------------------------------

query("hash_rank_sample", "SELECT doc_id, lang, source FROM documents ORDER BY sha256('draw:' || cast(doc_id as string)), doc_id LIMIT 100", "documents")(
    lambda d: corpus.hash_sample(d, "doc_id", 100, "draw:").select("doc_id", "lang", "source"))
query("first_ids", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50", "documents")(lambda d: corpus.first_ids(d, "doc_id", 50))
query("stratified_rank_pick", """
    SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(cast(doc_id as string)), doc_id) AS n FROM documents) WHERE n = 2""",
      "documents")(lambda d: corpus.rank_in_stratum(d, ["lang", "source"], "doc_id", 1).select("lang", "source", "doc_id"))
query("fraction_split", """
    SELECT source, doc_id, CASE WHEN n <= floor(k * cast(0.1 as double)) THEN 'validation' ELSE 'train' END AS split FROM (
        SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('split:' || cast(doc_id as string)), doc_id) AS n, count(*) OVER (PARTITION BY source) AS k
        FROM documents)""", "documents")(
    lambda d: corpus.fraction_split(d.select("source", "doc_id"), "source", "doc_id", 0.1, "split:"))
query("exact_dedup_priority", """
    SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source NULLS FIRST, doc_id) AS n FROM documents) WHERE n = 1""", "documents")(
    lambda d: corpus.dedup_by_priority(d, "text", [F.col("source").asc_nulls_first(), "doc_id"]).select("doc_id", "source"))
query("dedup_without_conflicts", """
    , h AS (SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), c AS (SELECT h FROM h GROUP BY h HAVING min(lang) <> max(lang))
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM h WHERE h NOT IN (SELECT h FROM c)) WHERE n = 1""".replace("\n    , h", "WITH h", 1),
      "documents")(lambda d: corpus.dedup_by_priority(d.where("text is not null and lang is not null"), "text", ["doc_id"], "lang").select("doc_id", "lang"))
query("conflicting_labels", """
    SELECT sha256(text) AS text_sha256, doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1)""", "documents")(
    lambda d: corpus.conflicts(d.where("text is not null"), "text", "doc_id", "source"))
_HELD = "(SELECT doc_id, text FROM documents WHERE doc_id % 10 = 0)"
query("contamination_semi", f"SELECT doc_id FROM documents d WHERE doc_id % 10 <> 0 AND EXISTS (SELECT 1 FROM {_HELD} h WHERE h.text = d.text)", "documents")(
    lambda d: corpus.contaminated(d.where("doc_id % 10 <> 0"), d.where("doc_id % 10 = 0")).select("doc_id"))
query("contamination_anti", f"SELECT doc_id FROM documents d WHERE doc_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM {_HELD} h WHERE h.text = d.text)", "documents")(
    lambda d: corpus.contaminated(d.where("doc_id % 10 <> 0"), d.where("doc_id % 10 = 0"), anti=True).select("doc_id"))
query("reserve_unique", """
    WITH r AS (SELECT lang AS domain, doc_id AS position, doc_id AS id, text FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL AND lang IS NOT NULL),
    u AS (SELECT DISTINCT text FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL)
    SELECT id, CASE WHEN text IN (SELECT text FROM u) THEN 'consumed' WHEN row_number() OVER (PARTITION BY text ORDER BY domain, position) > 1 THEN 'reserve_duplicate' ELSE 'selected' END AS verdict FROM r""",
      "documents")(lambda d: _reserve(spread(d.select("doc_id", "lang", "text"))))


def _reserve(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id % 5 <> 0 and text is not null and lang is not null").select(
        F.col("lang").alias("domain"), F.col("doc_id").alias("position"), F.col("doc_id").alias("id"), "text")
    return corpus.reserve_unique(rows, docs.where("doc_id % 5 = 0 and text is not null").select("text")).select("id", "verdict")


query("split_overlaps", """
    WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'held' ELSE 'train' END AS split, source, text FROM documents)
    SELECT 'source' AS field, count(*) AS shared FROM (SELECT source FROM s WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT split) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'text', count(*) FROM (SELECT text FROM s WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT split) > 1) HAVING count(*) > 0""", "documents")(
    lambda d: corpus.split_overlaps(d.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "held").otherwise("train")), "split", ["source", "text"]))
query("remaining_population", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "documents", "labels")(
    lambda d, lab: corpus.remaining(d.select("doc_id"), lab, "doc_id"))
query("shard_reassembly", "SELECT doc_id, cast(-1 as bigint) AS surplus FROM documents WHERE doc_id % 7 = 3", "documents")(
    lambda d: corpus.same_rows(d.where("doc_id % 7 < 3").select("doc_id").unionAll(d.where("doc_id % 7 > 3").select("doc_id")), d.select("doc_id")))
query("offset_slice", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 40 OFFSET 25", "events")(
    lambda e: corpus.offset_slice(e.select("event_id", "event_type"), "event_id", 25, 40))
query("selected_records", "SELECT c_custkey, c_name, c_custkey * 3 % 101 AS position FROM customer WHERE c_custkey % 50 = 7", "customer")(
    lambda c: corpus.select_records(c.select("c_custkey", "c_name"), c.where("c_custkey % 50 = 7").select("c_custkey", (F.col("c_custkey") * 3 % 101).alias("position")), "c_custkey"))
_TEMPLATES = ("담당자 {} 확인", "고객 {}님", "{}")
query("template_cross", f"""
    WITH t(template) AS (VALUES {', '.join(f"('{t}')" for t in _TEMPLATES)})
    SELECT n_name AS surface, template, replace(template, '{{}}', n_name) AS text, cast(strpos(template, '{{}}') - 1 as int) AS s, cast(strpos(template, '{{}}') - 1 + length(n_name) as int) AS e FROM nation, t""",
      "nation")(lambda n: corpus.cross_templates(n.select(F.col("n_name").alias("surface")), n.sparkSession.createDataFrame([(t,) for t in _TEMPLATES], "template string"))
                .withColumnsRenamed({"start": "s", "end": "e"}))
query("corpus_counts", """
    SELECT source AS track, count(*) AS rows, count(*) FILTER (doc_id % 3 = 0) AS positive, count(*) FILTER (doc_id % 3 <> 0) AS negative, count(DISTINCT lang) AS surfaces, count(DISTINCT n_chars % 100) AS contexts
    FROM documents GROUP BY GROUPING SETS ((), (source))""", "documents")(
    lambda d: corpus.corpus_counts(d.select(F.col("source").alias("track"), (F.col("doc_id") % 3 == 0).alias("positive"), F.col("lang").alias("surface"), (F.col("n_chars") % 100).alias("context"))))


@query("convert_spans", """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'PHONE_NUMBER:3:8' END AS gold, CASE c_custkey % 3 WHEN 0 THEN '3:8' WHEN 1 THEN '0:2' ELSE '' END AS ignored FROM customer""", "customer")
def convert_spans(c: DataFrame) -> DataFrame:
    """Source annotations to gold and ignore spans; masked surfaces are ignored."""
    rows = c.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN '번호 *****' ELSE '번호 01012' END AS text").withColumn("spans", F.array_compact(F.array(
        F.struct(F.lit(3).alias("start"), F.lit(8).alias("end"), F.lit("PHONE").alias("category"), F.substring("text", 4, 5).alias("surface")),
        F.when(F.col("id") % 3 == 1, F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("OTHER").alias("category"), F.substring("text", 1, 2).alias("surface"))))))
    out = corpus.convert_spans(rows, {"PHONE": "PHONE_NUMBER"}, ["OTHER"])
    pair = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    return out.select("id", F.array_join(F.transform("entities", lambda s: F.concat_ws(":", s["entity"], pair(s))), ",").alias("gold"),
                      F.array_join(F.transform("ignore", pair), ",").alias("ignored"))


@query("spans_to_record", "SELECT c_custkey AS id, '{\"email\":\"user' || c_custkey || '\",\"phone\":\"010\"}' AS record FROM customer", "customer")
def spans_to_record(c: DataFrame) -> DataFrame:
    rows = c.selectExpr("c_custkey AS id", "'010 user' || c_custkey AS text").withColumn("entities", F.array(
        F.struct(F.lit("PHONE_NUMBER").alias("entity"), F.lit(0).alias("start"), F.lit(3).alias("end")),
        F.struct(F.lit("EMAIL_ADDRESS").alias("entity"), F.lit(4).alias("start"), F.length("text").alias("end"))))
    return corpus.spans_to_record(rows, {"PHONE_NUMBER": "phone", "EMAIL_ADDRESS": "email"})


# --- label sequences ------------------------------------------------------------------------------

_TAG = """CASE event_id % 8 WHEN 0 THEN 'B-PS' WHEN 1 THEN 'I-PS' WHEN 2 THEN 'E-PS' WHEN 3 THEN 'O' WHEN 4 THEN 'S-LC' WHEN 5 THEN 'B-LC' WHEN 6 THEN 'I-PS' ELSE 'O' END"""
_SEQ = f"(SELECT user_id AS doc_id, event_id AS pos, {_TAG} AS tag, cast(event_id % 100 as double) / 100 AS score FROM events)"


def _sequence(e: DataFrame) -> DataFrame:
    return e.selectExpr("user_id AS doc_id", "event_id AS pos", f"{_TAG} AS tag", "cast(event_id % 100 as double) / 100 AS score")


query("bio_to_spans", f"""
    WITH t AS (SELECT *, split_part(tag, '-', 1) AS m, CASE WHEN tag LIKE '%-%' THEN split_part(tag, '-', 2) END AS en FROM {_SEQ}),
    o AS (SELECT *, CASE WHEN m IN ('B', 'S') OR lag(en) OVER w IS DISTINCT FROM en OR coalesce(lag(m) OVER w IN ('E', 'S'), false) THEN 1 ELSE 0 END AS o FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM o)
    SELECT doc_id, en AS entity, min(pos) AS s, max(pos) + 1 AS e, round(avg(score), 6) AS score FROM i WHERE en IS NOT NULL GROUP BY doc_id, i, en HAVING avg(score) >= 0.2""", "events")(
    lambda e: sequence.decode_tags(_sequence(e), 0.2).withColumnsRenamed({"start": "s", "end": "e"}).withColumn("score", F.round("score", 6)))
query("run_islands", f"""
    WITH k AS (SELECT doc_id, pos, score, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT event_id % 40 AS doc_id, event_id // 40 AS pos, cast(event_id % 97 as double) / 100 AS score FROM events) WHERE score >= 0.3)
    SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e, round(avg(score), 6) AS score FROM k GROUP BY doc_id, i""", "events")(
    lambda e: sequence.runs(e.selectExpr("event_id % 40 AS doc_id", "event_id div 40 AS pos", "cast(event_id % 97 as double) / 100 AS score"), "score", 0.3)
    .withColumnsRenamed({"start": "s", "end": "e"}).withColumn("score", F.round("score", 6)))
query("spans_to_bio", "SELECT c_custkey, 'O,O,O,' || 'B-PHONE_NUMBER' || repeat(',I-PHONE_NUMBER', 12) || ',O' AS tags FROM customer", "customer")(
    lambda c: c.select("c_custkey", F.expr(f"'번호 ' || {B.MOBILE} || '!'").alias("text")).select("c_custkey", F.array_join(sequence.spans_to_tags(
        F.col("text"), F.array(F.struct(F.lit("PHONE_NUMBER").alias("entity"), F.lit(3).alias("start"), F.lit(16).alias("end")))), ",").alias("tags")))
_WINDOWS = "SELECT l_orderkey AS doc_id, w AS window_no, w * 3 AS \"left\", w * 3 + 6 AS \"right\", p AS pos, (l_orderkey * 7 + w * 13 + p) % 5 AS label FROM (SELECT DISTINCT l_orderkey FROM lineitem), range(4) a(w), range(15) b(p) WHERE p >= w * 3 AND p < w * 3 + 6"
query("max_context_merge", f"""
    SELECT doc_id, pos, cast(arg_max(label, least(pos - "left", "right" - 1 - pos) * 100 - window_no) as bigint) AS label FROM ({_WINDOWS}) GROUP BY doc_id, pos""", "lineitem")(
    lambda l: sequence.interior_wins(l.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("window_no")).select(
        "*", (F.col("window_no") * 3).alias("left"), (F.col("window_no") * 3 + 6).alias("right")).select("*", F.explode(F.sequence(F.col("left"), F.col("right") - 1)).alias("pos")).withColumn(
            "label", (F.col("doc_id") * 7 + F.col("window_no") * 13 + F.col("pos")) % 5), ["doc_id"], ["label"]))
query("narrowest_token", """
    SELECT o_orderkey AS doc_id, p AS pos, CASE WHEN p < 2 THEN 'left' WHEN p < 4 THEN 'narrow' WHEN p < 6 THEN 'wide' ELSE 'tail' END AS token FROM orders, range(8) r(p)""", "orders")(
    lambda o: sequence.narrowest_token(
        o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos")),
        o.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(t).alias("token"))
                                                                         for s, e, t in ((0, 3, "left"), (2, 4, "narrow"), (1, 6, "wide"), (6, 8, "tail"))))))))


@query("header_documents", "SELECT 'c' || cast(c_custkey as string) AS id, '김' || cast(c_custkey % 10 as string) AS text, 'B-PS,I-PS' AS tags FROM customer", "customer")
def header_documents(c: DataFrame) -> DataFrame:
    """Tagged lines under headers, as one file."""
    lines = c.select("c_custkey", F.posexplode(F.array(
        F.concat(F.lit("## c"), F.col("c_custkey"), F.lit("\tsentence")), F.lit("김\tB-PS"), F.concat((F.col("c_custkey") % 10).cast("string"), F.lit("\tI-PS")))).alias("n", "line"))
    numbered = lines.select(F.concat(F.lit("f"), (F.col("c_custkey") % 16).cast("string")).alias("file"), (F.col("c_custkey") * 4 + F.col("n")).alias("line_no"), "line")
    return sequence.header_documents(numbered).select("id", "text", F.array_join("tags", ",").alias("tags"))


query("header_ids", "SELECT 'c' || cast(c_custkey as string) AS id FROM customer WHERE c_custkey % 2 = 0", "customer")(
    lambda c: sequence.header_ids(c.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("## c"), F.col("c_custkey"), F.lit("\tx"))).otherwise("김\tB-PS").alias("line"))))


# --- validation -----------------------------------------------------------------------------------


@query("span_case_errors", """
    SELECT cast(c_custkey as string) AS id, CASE c_custkey % 5 WHEN 1 THEN 'surface differs' WHEN 2 THEN 'overlapping gold' WHEN 3 THEN 'type not allowed' ELSE 'ignore overlaps gold' END AS error
    FROM customer WHERE c_custkey % 5 <> 0""", "customer")
def span_case_errors(c: DataFrame) -> DataFrame:
    """Annotated cases with one planted error each (four of five)."""
    kind = F.col("c_custkey") % 5
    item = lambda entity, s, e, surface: F.struct(entity.alias("type"), F.lit(s).alias("start"), F.lit(e).alias("end"), surface.alias("surface"))
    text = F.concat(F.lit("번호 "), F.expr(B.MOBILE))
    first = item(F.when(kind == 3, "OTHER").otherwise("PHONE_NUMBER"), 3, 16, F.when(kind == 1, "010").otherwise(F.expr(B.MOBILE)))
    second = item(F.lit("KR_NAME"), 5, 8, F.lit(None).cast("string"))
    none = F.array().cast("array<struct<start:int,end:int,surface:string>>")
    ignore = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit(None).cast("string").alias("surface")))
    cases = c.select(F.col("c_custkey").cast("string").alias("id"), text.alias("text"), F.when(kind == 2, F.array(first, second)).otherwise(F.array(first)).alias("entities"),
                     F.when(kind == 4, ignore).otherwise(none).alias("ignore"), none.alias("negative_spans"))
    return validate.span_case_errors(cases)


@query("path_case_errors", "SELECT cast(c_custkey as string) AS id, CASE c_custkey % 3 WHEN 1 THEN 'target without a leaf' ELSE 'path named twice' END AS error FROM customer WHERE c_custkey % 3 <> 0", "customer")
def path_case_errors(c: DataFrame) -> DataFrame:
    ids = F.col("c_custkey").cast("string").alias("id")
    kind = F.col("c_custkey") % 3
    path = F.when(kind == 1, F.array(F.lit("lost"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    cases = c.select(ids, F.array(F.struct(path.alias("path"), F.lit("KR_NAME").alias("type"), F.lit("x").alias("surface"))).alias("targets"),
                     F.when(kind == 2, F.array(path)).otherwise(F.array().cast("array<array<string>>")).alias("ignore_paths"),
                     F.array().cast("array<array<string>>").alias("negative_paths"))
    return validate.path_case_errors(cases, c.select(ids, F.lit("a/b").alias("path"), F.lit("값").alias("value")))


@query("tag_case_errors", "SELECT cast(c_custkey as string) AS sent_idx, 'tags differ from spans' AS error FROM customer WHERE c_custkey % 4 = 1", "customer")
def tag_case_errors(c: DataFrame) -> DataFrame:
    return validate.tag_case_errors(_tag_cases(c))


def _tag_cases(c: DataFrame) -> DataFrame:
    span = F.struct(F.lit(0).alias("begin"), F.lit(2).alias("end"), F.lit("PS").alias("label"), F.lit("김민").alias("form"))
    return c.select(F.col("c_custkey").cast("string").alias("sent_idx"), F.lit("김민 씨").alias("sentence"), F.array(*map(F.lit, "김민 씨")).alias("sent_seq"),
                    F.array(F.lit("B-PS"), F.when(F.col("c_custkey") % 4 == 1, "O").otherwise("I-PS"), F.lit("O"), F.lit("O")).alias("labelling_seq"),
                    F.when(F.col("c_custkey") % 4 == 2, F.array(span, span)).otherwise(F.array(span)).alias("PII_set"))


query("repeated_annotations", "SELECT cast(c_custkey as string) AS sent_idx, 'PS' AS label, 0 AS s, 2 AS e, '0,1' AS indices FROM customer WHERE c_custkey % 4 = 2", "customer")(
    lambda c: validate.repeated_annotations(_tag_cases(c)).withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ",")).withColumnsRenamed({"start": "s", "end": "e"}))


# --- decoding: no SQL form; the tests enumerate every legal path ----------------------------------

_LOGITS = "transform(sequence(0, 11), p -> transform(array(0, 1, 2, 3, 4), k -> cast((c_custkey * 31 + p * 17 + k * 7 + p * k * 5) % 23 as double) / 5))"


def _logits(c: DataFrame) -> DataFrame:
    return spread(c.select("c_custkey")).select("c_custkey", F.expr(_LOGITS).alias("logits"))


query("viterbi_bioes", None, "customer")(lambda c: _logits(c).select("c_custkey", F.explode(decode.decode_best(F.col("logits"), 0.2)).alias("x")).select("c_custkey", "x.*"))
query("name_marginals", None, "customer")(lambda c: _logits(c).select("c_custkey", F.posexplode(decode.marginals(F.col("logits"))).alias("pos", "p")))
query("coverage_decode", None, "customer")(lambda c: _logits(c).select("c_custkey", F.explode(decode.decode_coverage(F.col("logits"), 0.6)).alias("x")).select("c_custkey", "x.*"))
query("span_posteriors", None, "customer")(lambda c: _logits(c).select("c_custkey", F.explode(decode.decode_evidence(F.col("logits"), 0.2, 6)).alias("x")).select("c_custkey", "x.*"))
query("selective_evidence", None, "customer")(lambda c: _logits(c).select("c_custkey", F.explode(decode.decode_selective(
    F.col("logits"), F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit(0.9).alias("score"))), 0.3, 0.5)).alias("x")).select("c_custkey", "x.*"))
query("weighted_intervals", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '0:4,4:9' ELSE '2:7' END AS chosen FROM customer""", "customer")(
    lambda c: c.select("c_custkey", decode.select_intervals(F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), p.cast("double").alias("score")) for s, e, p in (
        (0, 4, F.lit(0.5)), (4, 9, F.lit(0.5)), (2, 7, F.when(F.col("c_custkey") % 2 == 0, 0.9).otherwise(1.1)), (1, 2, F.lit(-0.1)))))).alias("x")).select(
            "c_custkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("chosen")))
query("lexicon_boost", "SELECT c_custkey, round(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN least(1.0, 0.9 + 0.05) ELSE 0.9 END, 6) AS score FROM customer", "customer")(
    lambda c: c.select("c_custkey", F.round(sequence.lexicon_boost(F.lit(0.9), F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]), 6).alias("score")))
