"""Queries of the detector on texts whose findings are known by construction, and on the driver's texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import text as texts
from maskloom.functions import vocab as V
from maskloom.functions.kernel import find
from maskloom.operators import structured
from maskloom.operators.detect import Detector, all_entities
from maskloom.plans import tables as B
from maskloom.runtime import spread

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _rows(spark: SparkSession, sf_dir: str, name: str, steps) -> DataFrame:
    return B.derive(B.dealt(spark, sf_dir, name), steps)


def _long(rows: DataFrame, key: str, detector: Detector, text: str = "text") -> DataFrame:
    found = rows.select(F.col(key).alias("id"), F.explode(detector.findings(F.col(text))).alias("f"))
    return found.select("id", "f.entity", F.col("f.start").alias("s"), F.col("f.end").alias("e"), "f.score", F.col("f.text").alias("value"))


def _found(name: str, source: str, key: str, steps: list, prefix: str, suffix: str, entity: str, score: str,
           only: str = "true", detector: Detector | None = None) -> None:
    """Register a query over prefix || value || suffix, and what it must find: value, where ``only`` holds."""
    steps = [*steps, ("prefix", prefix), ("text", f"prefix || value || {suffix}")]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(_rows(spark, sf_dir, source, steps), key, detector or Detector())

    QUERIES[name] = (query, f"""SELECT {key} AS id, {entity} AS entity, cast(length(prefix) as int) AS s, cast(length(prefix) + length(value) as int) AS e,
        cast({score} as double) AS score, value FROM {B.derived_sql(source, steps)} WHERE {only}""")


_found("findings_rrn_checksum", "customer", "c_custkey", B.RRN, "'고객 ' || c_name || ' 주민번호 '", "' 확인'", "'KR_RRN'", "1.0")
# whether the check digit happens to be right: (13 - weighted sum mod 11) mod 10, region code up to 95
_fsteps = [*B.FRN, ("digits", "substr(value, 1, 6) || substr(value, 8)"),
           ("right_check", f"(13 - ({B.digit_sum('digits', V.RRN_WEIGHTS)}) % 11) % 10 = cast(substr(digits, 13, 1) as int) AND cast(substr(digits, 8, 2) as int) <= 95")]
_found("findings_frn_date", "customer", "c_custkey", _fsteps,
       "CASE WHEN c_custkey % 2 = 0 THEN '외국인등록번호 ' ELSE '참고 ' END", "'로 신고'", "'KR_FRN'",
       "CASE WHEN right_check THEN 1.0 WHEN c_custkey % 2 = 0 THEN 0.85 ELSE 0.5 END", "c_custkey % 2 = 0 OR c_custkey % 7 <> 0")
_found("findings_brn_checksum", "supplier", "s_suppkey", B.BRN, "'사업자등록번호 '", "' 입니다'", "'KR_BRN'", "1.0", "s_suppkey % 3 <> 0")
_found("findings_card_luhn", "orders", "o_orderkey", B.CARD, "'결제 카드번호 '", "'로 승인'", "'CREDIT_CARD'", "1.0", "o_orderkey % 4 <> 0")
_ACCOUNT = f"'3333-' || {B.padded('s_suppkey', 2)} || '-' || {B.padded('s_suppkey * 7919', 7)}"
_found("findings_account_context", "supplier", "s_suppkey",
       [("value", f"CASE WHEN s_suppkey % 2 = 0 THEN {_ACCOUNT} ELSE '302-' || {B.padded('s_suppkey * 3', 4)} || '-' || {B.padded('s_suppkey * 77', 4)} || '-' || {B.padded('s_suppkey', 2)} END")],
       "CASE s_suppkey % 3 WHEN 0 THEN '입금 계좌: ' WHEN 1 THEN '번호 ' ELSE '은행 안내, ' END", "' 보내 주세요'", "'KR_ACCOUNT'",
       "CASE WHEN s_suppkey % 3 = 0 THEN 0.75 ELSE 0.4 END", "s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
_found("account_blockers", "supplier", "s_suppkey", [("value", _ACCOUNT)],
       "CASE s_suppkey % 5 WHEN 0 THEN '계좌 안내 주문번호 ' WHEN 1 THEN '주문번호 확인 후 계좌번호 ' WHEN 2 THEN '은행 송장번호 ' WHEN 3 THEN '버전 ' ELSE '통장 ' END",
       "' 확인'", "'KR_ACCOUNT'", "0.75", "s_suppkey % 5 IN (1, 4)")
_EVIDENCE = [("value", "CASE s_suppkey % 2 WHEN 0 THEN '3333120145448' ELSE '3025382178204' END"),
             ("bank", "CASE s_suppkey % 3 WHEN 0 THEN '신한' WHEN 1 THEN CASE s_suppkey % 2 WHEN 0 THEN '카카오뱅크' ELSE '농협' END ELSE '은행' END")]
_found("account_evidence_override", "supplier", "s_suppkey", _EVIDENCE, "bank || ' 입금 계좌 '", "''",
       "CASE WHEN s_suppkey % 3 = 1 THEN 'KR_ACCOUNT' ELSE 'CREDIT_CARD' END", "CASE WHEN s_suppkey % 3 = 1 THEN 0.45 ELSE 1.0 END")
_found("findings_passport_context", "customer", "c_custkey",
       [("value", f"'M' || {B.padded('c_custkey', 3)} || substr('ABCDEFGHJK', cast(c_custkey % 10 as int) + 1, 1) || {B.padded('c_custkey * 3', 4)}")],
       "CASE WHEN c_custkey % 3 = 0 THEN '코드 ' ELSE '여권번호 ' END", "'를 제출'", "'KR_PASSPORT'", "0.45", "c_custkey % 3 <> 0")
_found("findings_license_gate", "customer", "c_custkey",
       [("value", f"CASE WHEN c_custkey % 2 = 0 THEN cast(11 + c_custkey % 16 as string) || '-' || {B.padded('c_custkey', 2)} || '-' || {B.padded('c_custkey * 11', 6)} || '-' || {B.padded('c_custkey * 5', 2)} ELSE cast(11 + c_custkey % 16 as string) || {B.padded('c_custkey * 7919', 10)} END")],
       "CASE WHEN c_custkey % 3 = 0 THEN '송장번호 ' ELSE '운전면허번호 ' END", "' 입니다'", "'KR_DRIVER_LICENSE'",
       "CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0.85 END", "c_custkey % 2 = 0 OR c_custkey % 3 <> 0")
_found("findings_phone_gate", "customer", "c_custkey",
       [("value", f"CASE c_custkey % 3 WHEN 0 THEN {B.MOBILE} WHEN 1 THEN '8210' || cast(2000 + c_custkey % 8000 as string) || {B.padded('c_custkey * 7', 4)} ELSE '02-' || cast(2000 + c_custkey % 8000 as string) || '-' || {B.padded('c_custkey * 7', 4)} END")],
       "CASE WHEN c_custkey % 2 = 0 THEN '송장 ' ELSE '연락처 ' END", "' 로'", "'PHONE_NUMBER'",
       "CASE c_custkey % 3 WHEN 0 THEN 0.5 ELSE 0.4 END + CASE WHEN c_custkey % 2 = 1 THEN 0.35 ELSE 0 END", "c_custkey % 3 <> 1 OR c_custkey % 2 = 1")
_found("findings_email_suffix", "customer", "c_custkey",
       [("value", "'user' || cast(c_custkey as string) || CASE c_custkey % 4 WHEN 0 THEN '@example.invalid' WHEN 1 THEN '@example.co.kr' WHEN 2 THEN '@mail.example.com' ELSE '@server.local' END")],
       "'메일은 '", "'으로 보내세요'", "'EMAIL_ADDRESS'", "1.0", "c_custkey % 4 IN (1, 2)")
_found("offset_roundtrip", "customer", "c_custkey",
       [("value", f"'010\u200b-' || cast(2000 + c_custkey % 8000 as string) || '-' || substr({B.padded('c_custkey * 7', 4)}, 1, 2) || '\u200b\u200d' || substr({B.padded('c_custkey * 7', 4)}, 3)")],
       "'가\u200b나 \U0001f4e9 연락처 '", "'\u200b 확인'", "'PHONE_NUMBER'", "0.85")
_found("name_fields", "customer", "c_custkey",
       [("value", "CASE c_custkey % 4 WHEN 0 THEN '미기재' WHEN 1 THEN '오지은' WHEN 2 THEN 'Anna Example' ELSE '안나·가온' END")],
       "CASE WHEN c_custkey % 5 = 0 THEN '상품 이름: ' WHEN c_custkey % 5 = 1 THEN '고객명=' ELSE '성명: ' END",
       "', 확인'", "'KR_NAME'", "0.85", "c_custkey % 4 <> 0 AND c_custkey % 5 <> 0", all_entities())
_found("address_full", "customer", "c_custkey",
       [("value", "CASE c_custkey % 3 WHEN 0 THEN '서울특별시 강남구' WHEN 1 THEN '경기도 수원시 팔달구' ELSE '부산 해운대구' END || CASE c_custkey % 2 WHEN 0 THEN ' 가상누리로 ' ELSE ' 가상동 산 ' END || cast(1 + c_custkey % 9998 as string) || CASE c_custkey % 4 WHEN 0 THEN ', 테스트아파트 101동 202호' ELSE '' END")],
       "'보내실 곳은 '", "' 입니다'", "'KR_ADDRESS'", "0.65", "true", all_entities())
_found("address_labeled", "customer", "c_custkey",
       [("value", "'가상누리로 ' || cast(1 + c_custkey % 9998 as string)")],
       "CASE c_custkey % 4 WHEN 0 THEN '배송지: ' WHEN 1 THEN '주소는 ' WHEN 2 THEN '위치 ' ELSE '주소=' END",
       "CASE WHEN c_custkey % 3 = 0 THEN '개' ELSE ' 확인' END", "'KR_ADDRESS'", "0.7", "c_custkey % 4 <> 2 AND c_custkey % 3 <> 0", all_entities())
_found("threshold_filter", "customer", "c_custkey", [("value", B.MOBILE)],
       "CASE WHEN c_custkey % 2 = 0 THEN '연락처 ' ELSE '번호 ' END", "''", "'PHONE_NUMBER'", "0.85", "c_custkey % 2 = 0", Detector(threshold=0.6))
_found("entity_filter", "customer", "c_custkey", [*B.RRN[:-1], ("value", B.RRN[-1][1])],
       f"'연락처 ' || {B.MOBILE} || ', 주민번호 '", "''", "'KR_RRN'", "1.0", "true", Detector(entities=("KR_RRN",)))
_found("identifier_veto", "customer", "c_custkey", [("value", B.MOBILE)], "'은행 계좌 확인: '", "''", "'PHONE_NUMBER'", "0.5", "true")


def _masks(style: str, shown: str) -> tuple[Callable, str]:
    text = f"'연락처 ' || {B.MOBILE} || ' 확인'"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = B.dealt(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
        return rows.select("c_custkey", Detector().mask(F.col("text"), style).alias("masked"))

    return query, f"SELECT c_custkey, '연락처 ' || {shown} || ' 확인' AS masked FROM customer"


QUERIES["mask_tag_mobile"] = _masks("tag", "'<PHONE_NUMBER>'")
QUERIES["mask_stars_mobile"] = _masks("stars", "repeat('*', 13)")
QUERIES["mask_partial_mobile"] = _masks("partial", "'010-****-****'")


def redaction_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two findings in a text; the second moves by what the first's tag added."""
    rows = B.dealt(spark, sf_dir, "customer").select(
        "c_custkey", F.expr(f"'메일 user' || cast(c_custkey as string) || '@example.com, 연락처 ' || {B.MOBILE}").alias("text"))
    made = rows.select("c_custkey", F.explode(Detector().mask_with_details(F.col("text"))["redactions"]).alias("r"))
    return made.select("c_custkey", "r.entity", F.col("r.start").alias("s"), F.col("r.end").alias("e"), "r.output_start", "r.output_end")


QUERIES["redaction_offsets"] = (redaction_offsets, """
    WITH f AS (SELECT c_custkey, 'EMAIL_ADDRESS' AS entity, 3 AS s, 3 + length('user' || cast(c_custkey as string) || '@example.com') AS e FROM customer
               UNION ALL SELECT c_custkey, 'PHONE_NUMBER', 3 + length('user' || cast(c_custkey as string) || '@example.com') + 6,
                      3 + length('user' || cast(c_custkey as string) || '@example.com') + 19 FROM customer),
         o AS (SELECT *, s + coalesce(sum(length(entity) + 2 - (e - s)) OVER (PARTITION BY c_custkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM f)
    SELECT c_custkey, entity, cast(s as int) AS s, cast(e as int) AS e, cast(o as int) AS output_start, cast(o + length(entity) + 2 as int) AS output_end FROM o""")


def should_mask_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's policy keeps mobile numbers that end in an even digit."""
    rows = B.dealt(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'연락처 ' || {B.MOBILE}").alias("text"))
    policy = lambda f: F.substring(f["text"], -1, 1).cast("int") % 2 == 1
    return rows.select("c_custkey", Detector().mask(F.col("text"), "tag", policy).alias("masked"), Detector().contains(F.col("text")).alias("found"))


QUERIES["should_mask_policy"] = (should_mask_policy, f"""
    SELECT c_custkey, '연락처 ' || CASE WHEN (c_custkey * 7) % 2 = 1 THEN '<PHONE_NUMBER>' ELSE {B.MOBILE} END AS masked, true AS found FROM customer""")


def normalize_fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width mobile numbers fold to ASCII, and are found in place."""
    wide = F.translate(F.expr(B.MOBILE), "0123456789-", "０１２３４５６７８９－")
    rows = B.dealt(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("연락처："), wide).alias("text"))
    return rows.select("c_custkey", texts.normalize(F.col("text")).alias("normalized"), Detector().mask(F.col("text"), "stars").alias("masked"))


QUERIES["normalize_fullwidth"] = (normalize_fullwidth, f"""
    SELECT c_custkey, '연락처:' || {B.MOBILE} AS normalized, '연락처：' || repeat('*', 13) AS masked FROM customer""")


def normalize_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible runs go inside identifiers and stay elsewhere; positions point into the original."""
    text = f"'값\u200b ' || substr({B.MOBILE}, 1, 5) || '\u200b\u200b' || substr({B.MOBILE}, 6)"
    rows = B.dealt(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    return rows.select("c_custkey", texts.normalize(F.col("text")).alias("normalized"), F.get(texts.positions(F.col("text")), F.lit(8)).alias("ninth"),
                       texts.fingerprint(F.col("text")).alias("exact"), texts.fingerprint(F.col("text"), True).alias("folded"))


QUERIES["normalize_invisible"] = (normalize_invisible, f"""
    SELECT c_custkey, '값\u200b ' || {B.MOBILE} AS normalized, cast(10 as int) AS ninth,
           sha256('값\u200b ' || substr({B.MOBILE}, 1, 5) || '\u200b\u200b' || substr({B.MOBILE}, 6)) AS exact,
           sha256('값\u200b ' || {B.MOBILE}) AS folded FROM customer""")


# --- the driver's texts ---------------------------------------------------------------------


def documents_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document masked, with the number of its findings by kind."""
    docs = spread(B.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    found = docs.select("doc_id", "source", Detector().mask_with_details(F.col("text")).alias("m"))
    count = lambda e: F.size(F.filter("m.redactions", lambda r: r["entity"] == e)).cast("long")
    return found.select("doc_id", "source", F.col("m.text").alias("masked"), *(count(e).alias(f"n_{e.lower()}") for e in V.STRUCTURED))


QUERIES["documents_mask"] = (documents_mask, None)


def _text_query(name: str, key: list[str], column: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spread(B.table(spark, sf_dir, name).select(*key, column)).select(*key, Detector().mask(F.col(column)).alias("masked"))

    return query


QUERIES["conversations_mask"] = (_text_query("conversations", ["conv_id", "turn", "role"], "text"), None)
QUERIES["pages_mask"] = (_text_query("pages", ["page_id"], "html"), None)
_PLAIN_EMAIL = "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}"


def email_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    n = F.size(find(F.coalesce(F.col("text"), F.lit("")), _PLAIN_EMAIL))
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum(n).alias("emails"), F.count_if(n > 0).alias("with_email"))


QUERIES["email_count_by_source"] = (email_count_by_source, f"""
    WITH n AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '{_PLAIN_EMAIL}')) AS n FROM documents)
    SELECT source, count(*) AS docs, cast(sum(n) as bigint) AS emails, count(*) FILTER (n > 0) AS with_email FROM n GROUP BY source""")


def scan_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The find-all kernel on documents: the first digit run of four or more, with code-point offsets."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", find(F.col("text"), "[0-9]{4,}").alias("hits"))
    first = F.get("hits", F.lit(0))
    return docs.where(F.size("hits") > 0).select("doc_id", F.size("hits").cast("long").alias("n"), first["s"].cast("long").alias("s"), first["v"].alias("value"))


QUERIES["scan_offsets"] = (scan_offsets, """
    WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{4,}') AS hits FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(hits) AS n, length(regexp_extract(text, '^([^0-9]|[0-9]{1,3}[^0-9])*')) AS s, hits[1] AS value FROM m WHERE len(hits) > 0""")


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", texts.fingerprint(F.col("text")).alias("text_sha256"))


QUERIES["text_fingerprints"] = (text_fingerprints, "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")


# --- fields -----------------------------------------------------------------------------------


def csv_fields(spark: SparkSession, sf_dir: str, style: str = "tag", strict: bool = False) -> DataFrame:
    """A customer table with field names masked column by column (every fourth e-mail is no address)."""
    rows = B.dealt(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) AS id", "c_name AS customer_name", f"{B.MOBILE} AS phone_no",
        "CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'user' || cast(c_custkey as string) || '@example.com' END AS email",
        "CASE WHEN c_custkey % 2 = 0 THEN '카카오뱅크' ELSE '신한' END AS bank", "'3333120145448' AS account_number",
        f"'비고 ' || {B.MOBILE} AS memo")
    return structured.mask_columns(rows, Detector(), style, strict, headers=False)


_CSV = """SELECT cast(c_custkey as string) AS id, c_name AS customer_name, '<PHONE_NUMBER>' AS phone_no,
    {email} AS email, CASE WHEN c_custkey % 2 = 0 THEN '카카오뱅크' ELSE '신한' END AS bank,
    {account} AS account_number, '비고 <PHONE_NUMBER>' AS memo FROM customer"""
QUERIES["csv_fields"] = (csv_fields, _CSV.format(
    email="CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE '<EMAIL_ADDRESS>' END",
    account="CASE WHEN c_custkey % 2 = 0 THEN '<KR_ACCOUNT>' ELSE '<CREDIT_CARD>' END"))
QUERIES["csv_strict_fields"] = (lambda spark, sf_dir: csv_fields(spark, sf_dir, "tag", True),
                                _CSV.format(email="'<EMAIL_ADDRESS>'", account="'<KR_ACCOUNT>'"))
_DOC = ("'{\"no\": ' || cast(c_custkey as string) || ', \"mobile\": \"' || {m} || '\", \"nested\": {{\"card_no\": \"1234 5678 9012 3456\", \"list\": [1, 2.5, null, \"' || {m} || '\"]}}}}'")
_JSON = _DOC.replace("'{\"no\"", "'{{\"no\"")


def json_field_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents masked in place: key order, numbers and nulls as they were."""
    rows = B.dealt(spark, sf_dir, "customer").select("c_custkey", F.expr(_JSON.format(m=B.MOBILE)).alias("document"))
    return structured.mask_json(rows, "document", Detector())


QUERIES["json_field_mask"] = (json_field_mask, "SELECT c_custkey, " + _JSON.format(m="'<PHONE_NUMBER>'").replace(
    "1234 5678 9012 3456", "<CREDIT_CARD>") + " AS document FROM customer")


def json_key_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in a key is masked too."""
    rows = B.dealt(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'{{\"' || {B.MOBILE} || '\": true}}'").alias("document"))
    return structured.mask_json(rows, "document", Detector())


QUERIES["json_key_mask"] = (json_key_mask, "SELECT c_custkey, '{\"<PHONE_NUMBER>\": true}' AS document FROM customer")


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar leaves of the events' properties."""
    rows = spread(B.table(spark, sf_dir, "events").select("event_id", "props").where("props is not null"))
    return structured.leaf_table(rows, "event_id", "props")


QUERIES["json_leaves"] = (json_leaves, """
    SELECT event_id, '$.' || unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events WHERE props IS NOT NULL""")


def sibling_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one documented bank among an object's fields; none where fields disagree or are unknown."""
    rows = B.table(spark, sf_dir, "supplier")
    value = "CASE s_suppkey % 4 WHEN 0 THEN '농협은행' WHEN 1 THEN '카카오뱅크' WHEN 2 THEN '신한' ELSE '농협' END"
    long = rows.selectExpr("s_suppkey AS doc_id", "'$' AS parent", "stack(2, 'bank', " + value + ", '은행명', CASE WHEN s_suppkey % 3 = 0 THEN '카카오뱅크' ELSE " + value + " END) AS (key, value)")
    return structured.sibling_banks(long)


QUERIES["sibling_bank"] = (sibling_bank, """
    SELECT s_suppkey AS doc_id, '$' AS parent, CASE WHEN s_suppkey % 4 = 2 THEN '' WHEN s_suppkey % 4 = 1 THEN '카카오뱅크'
           WHEN s_suppkey % 3 = 0 THEN '' ELSE '농협' END AS bank FROM supplier""")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector from SQL."""
    from maskloom import udfs

    udfs.register(spark)
    rows = B.dealt(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'연락처 ' || {B.MOBILE}").alias("t"))
    return spark.sql("SELECT c_custkey, mask_pii_partial(t) AS masked, contains_pii(t) AS found FROM {rows}", rows=rows)


QUERIES["sql_functions"] = (sql_functions, "SELECT c_custkey, '연락처 010-****-****' AS masked, true AS found FROM customer")


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a model proposes (here: any capitalised pair), beside the rules."""
    from maskloom import udfs

    def factory():
        import re

        return lambda text: [("KR_NAME", m.start(), m.end(), 0.9) for m in re.finditer(r"[A-Z][a-z]+ [A-Z][a-z]+", text)]

    rows = B.dealt(spark, sf_dir, "customer").selectExpr(
        "c_custkey", f"CASE WHEN c_custkey % 2 = 0 THEN '상품명: ' ELSE '방문: ' END || 'Mina Example, 연락처 ' || {B.MOBILE} AS text")
    found = udfs.with_model(rows, "text", all_entities(), factory)
    return found.select("c_custkey", F.transform("findings", lambda f: f["entity"]).alias("e")).select("c_custkey", F.array_join("e", ",").alias("entities"))


QUERIES["model_names"] = (model_names, """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'PHONE_NUMBER' ELSE 'KR_NAME,PHONE_NUMBER' END AS entities FROM customer""")


def stream_mask_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events masked by a stream over the same file, read back."""
    import uuid

    from maskloom.runtime import shared_dir
    from maskloom.streaming import mask as streaming

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/[e]vents.parquet"  # a pattern, since a stream takes no single file
    source = spark.readStream.schema(B.table(spark, sf_dir, "events").schema).parquet(path)
    texts_ = source.select("event_id", F.expr("'문의 ' || event_type || ' 010-' || lpad(cast(event_id % 10000 as string), 4, '0') || '-0000'").alias("text"))
    dealt = texts_.repartition(spark.sparkContext.defaultParallelism)
    masked = streaming.mask_stream(dealt, "text", Detector()).select("event_id", "masked")
    streaming.write_stream(masked, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES["stream_mask_equals_batch"] = (stream_mask_equals_batch, "SELECT event_id, '문의 ' || event_type || ' <PHONE_NUMBER>' AS masked FROM events")
