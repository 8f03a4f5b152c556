"""The detector on single texts: findings, gates, conflicts, masks, names, addresses and invariants."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.functions import vocab as V
from maskloom.operators.detect import Detector, all_entities

CASES = [  # text, expected (entity, value)
    ("계좌번호 3333-01-1234567로 보내 주세요", [("KR_ACCOUNT", "3333-01-1234567")]),
    ("📩 계좌번호3333011234567", [("KR_ACCOUNT", "3333011234567")]),
    ("번호 110-123-456789", [("KR_ACCOUNT", "110-123-456789")]),
    ("계좌번호 3333-01-1234567-99", []),
    ("은행 기준일 2026-10-09", []),
    ("우리 상품 3333011234567", []),
    ("민간기업 3333011234567", []),
    ("기업은행: 3333011234567", [("KR_ACCOUNT", "3333011234567")]),
    ("계좌 안내. 3333011234567", []),
    ("은행 안내\n3333011234567", []),
    ("주문 ID 110-123-456789", []),
    ("주문번호 확인 후 계좌번호 3333011234567", [("KR_ACCOUNT", "3333011234567")]),
    ("계좌번호 X3333011234567", []),
    ("주민번호 900101-1234568", [("KR_RRN", "900101-1234568")]),
    ("번호 900231-1234567", []),
    ("주민번호 900231-1234567", [("KR_RRN", "900231-1234567")]),
    ("등록번호 820519-6736018", [("KR_FRN", "820519-6736018")]),
    ("은행 계좌 확인: 123-45-67891", [("KR_BRN", "123-45-67891")]),
    ("사업자번호 123-45-67890", []),
    ("은행 계좌 확인: 010-1234-5678", [("PHONE_NUMBER", "010-1234-5678")]),
    ("연락처 (02) 1234-5678, +82 10-1234-5678", [("PHONE_NUMBER", "(02) 1234-5678"), ("PHONE_NUMBER", "+82 10-1234-5678")]),
    ("품번 01012345678A", []),
    ("송장번호 821775099818", []),
    ("카드번호 4111 1111 1111 1111", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("확인 4111-1111-1111-1111님의 카드", [("CREDIT_CARD", "4111-1111-1111-1111")]),
    ("X4111111111111111Z", []),
    ("카카오뱅크 입금 계좌 3333120145448", [("KR_ACCOUNT", "3333120145448")]),
    ("신한 계좌번호 3333120145448", [("CREDIT_CARD", "3333120145448")]),
    ("여권번호 M123A4567", [("KR_PASSPORT", "M123A4567")]),
    ("코드 M123A4567", []),
    ("운전면허번호 237751597627", [("KR_DRIVER_LICENSE", "237751597627")]),
    ("송장번호 237751597627", []),
    ("메일 user@example.co.kr로", [("EMAIL_ADDRESS", "user@example.co.kr")]),
    ("user@example.invalid user@co.kr", []),
    ("버전 3.11.4, 매출 1,234,567원, 2026-10-08 14:00", []),
    ("번호는 6507041449743 입니다", [("KR_RRN", "6507041449743")]),
    ("", []), (None, []),
    ("📩 연락처 ０１０-１２３４-５６７８ 확인", [("PHONE_NUMBER", "０１０-１２３４-５６７８")]),
    ("주민번호 900101−1234568", [("KR_RRN", "900101−1234568")]),
    ("연락처 010-1​234-5678 확인", [("PHONE_NUMBER", "010-1​234-5678")]),
    ("상품코드 X3333​011234567", []),
]
FIELDS = [
    ("성명: 안나·가온, 확인", [("KR_NAME", "안나·가온")]),
    ("성명: 김가온\t님", [("KR_NAME", "김가온")]),
    ("고객명=홍길동님 연락처: 010-1234-5678", [("KR_NAME", "홍길동"), ("PHONE_NUMBER", "010-1234-5678")]),
    ("상품 이름: 안나·가온", []), ("성명 입력 필요", []), ("담당자: 미정", []), ("성명: 미정", [("KR_NAME", "미정")]),
    ("성명: 안나·123", []), ("안내 문구에서 담당자 확인", []), ("- 담당자 김가온", [("KR_NAME", "김가온")]),
    ("담당자: 영업지원팀", []), ("성명: José Test", [("KR_NAME", "José Test")]),
    ("보내실 곳은 서울특별시 강남구 가상누리로 9999 입니다", [("KR_ADDRESS", "서울특별시 강남구 가상누리로 9999")]),
    ("주소: 가상누리로 9999, 연락처 010-1234-5678", [("KR_ADDRESS", "가상누리로 9999"), ("PHONE_NUMBER", "010-1234-5678")]),
    ("주소: 서울 강남구 가상누리로 9999 (가상동, 테스트아파트) 101동 202호 확인", [("KR_ADDRESS", "서울 강남구 가상누리로 9999 (가상동, 테스트아파트) 101동 202호")]),
    ("서울 강남구 도보로 3분", []), ("주소: 가상누리로 3개", []), ("가상누리로 9999", []), ("주소: 가상동 999층", []),
    ("서울 강남구 가상누리로 9999로 보내 주세요", [("KR_ADDRESS", "서울 강남구 가상누리로 9999")]),
]


def run(spark, detector, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r.id: r.f for r in rows.select("id", detector.findings(F.col("text")).alias("f")).collect()}


@pytest.mark.parametrize("detector,cases", [(Detector(), CASES), (all_entities(), FIELDS)], ids=["structured", "fields"])
def test_findings(spark, detector, cases):
    found = run(spark, detector, [t for t, _ in cases])
    for i, (text, expected) in enumerate(cases):
        assert [(f.entity, f.text) for f in found[i]] == expected, text
        assert all(text[f.start : f.end] == f.text for f in found[i]), text


def test_account_only_detector_still_lets_identifiers_veto(spark):
    texts = ["은행 계좌 확인: 900101-1234568", "은행 계좌 확인: 11-22-123456-78", "코드 77777712345678", "계좌 110-123-456789"]
    found = run(spark, Detector(entities=("KR_ACCOUNT",), threshold=0.0), texts)
    assert [[f.entity for f in found[i]] for i in range(4)] == [[], [], [], ["KR_ACCOUNT"]]


def test_thresholds_and_literal_mode(spark):
    text = "번호 010-1234-5678 연락처 010-1234-5679"
    assert [f.text for f in run(spark, Detector(threshold=0.6), [text])[0]] == ["010-1234-5679"]
    assert run(spark, Detector(normalize=False), ["연락처 ０１０-1234-5678"])[0] == []


@pytest.mark.parametrize("arguments,error", [
    ({"entities": ()}, ValueError), ({"entities": "KR_RRN"}, TypeError), ({"entities": ("US_SSN",)}, ValueError), ({"entities": (1,)}, TypeError),
    ({"threshold": 1.5}, ValueError), ({"threshold": True}, ValueError),
])
def test_bad_arguments(arguments, error):
    with pytest.raises(error):
        Detector(**arguments)


def test_masks(spark):
    text = "주민번호 900101-1234568, 사업자등록번호 123-45-67891, 메일 a@b.kr"
    rows = spark.createDataFrame([(text,)], "text string")
    got = rows.select(*(Detector().mask(F.col("text"), s).alias(s) for s in V.STYLES)).first()
    assert got.tag == "주민번호 <KR_RRN>, 사업자등록번호 <KR_BRN>, 메일 <EMAIL_ADDRESS>"
    assert got.stars == text.replace("900101-1234568", "*" * 14).replace("123-45-67891", "*" * 12).replace("a@b.kr", "*" * 6)
    assert got.partial == "주민번호 900101-*******, 사업자등록번호 12*-**-*****, 메일 a@b.**"
    names = spark.createDataFrame([("성명: 이상",), ("성명: Mina Example",)], "text string").select(all_entities().mask(F.col("text"), "partial").alias("m"))
    assert [r.m for r in names.collect()] == ["성명: 이*", "성명: M*** *******"]
    with pytest.raises(ValueError):
        Detector().mask(F.col("text"), "bogus")


def test_a_model_that_breaks_its_contract_fails_the_query(spark):
    from maskloom import udfs

    rows = spark.createDataFrame([("김가온 방문",)], "text string")
    found = lambda spans: udfs.with_model(rows, "text", all_entities(), lambda: lambda text: spans).first().findings
    assert [f.text for f in found([("KR_NAME", 0, 3, 0.9)])] == ["김가온"]
    with pytest.raises(Exception, match="invalid name or address span"):
        found([("KR_NAME", 0, 99, 0.9)])


_PIECES = ["연락처 ", "계좌번호 ", "카드번호: ", "주문번호 ", "010-1234-5678", "3333-01-1234567", "4111 1111 1111 1111", "900101-1234568", "user@example.com",
           "로 ", ", ", "\n", "​", "📩", "１２３", "-", "은행 ", "M123A4567", "여권번호 ", "82", " "]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**9))
def test_invariants_on_random_texts(spark, seed):
    """Findings are ordered, disjoint and slices of the text; stars keep the length; redactions point at replacements."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice(_PIECES) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    d = Detector()
    for r in rows.select("text", d.findings(F.col("text")).alias("f"), d.mask(F.col("text"), "stars").alias("stars"), d.mask_with_details(F.col("text")).alias("m")).collect():
        assert all(0 <= f.start < f.end <= len(r.text) and r.text[f.start : f.end] == f.text for f in r.f)
        assert all(a.end <= b.start for a, b in zip(r.f, r.f[1:]))
        assert len(r.stars) == len(r.text)
        assert all((c == "*") == any(f.start <= i < f.end for f in r.f) or c == r.text[i] for i, c in enumerate(r.stars))
        assert [r.m.text[x.output_start : x.output_end] for x in r.m.redactions] == [f"<{f.entity}>" for f in r.f]


@pytest.mark.parametrize("name", ["synthetic_recall", "csv_fields", "findings_email_suffix", "normalize_invisible"])
def test_costly_rows_are_dealt_out(spark, sf, name):
    """The customers are one small file, and one task would read it."""
    from maskloom import plans

    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4" in plan


def test_recall_detects_once(spark, sf):
    """Masks and hits of generated identifiers come from one analysis."""
    from maskloom import plans

    plan = plans.queries()["synthetic_recall"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("luhn_check") + plan.count("luhnCheck") + plan.count("isLuhnNumber") <= 2  # of number tokens and of spaced cards


def test_a_phone_number_is_not_read_inside_a_card_number(spark):
    rows = spark.createDataFrame([(1, "카드번호 4000 0502 3861 1147 승인"), (2, "연락처 0502 3861 1147"), (3, "2명 0502 3861 1147")], "i int, t string")
    got = {r.i: [(f.entity, f.text) for f in r.f] for r in rows.select("i", Detector().findings(F.col("t")).alias("f")).collect()}
    assert got == {1: [], 2: [("PHONE_NUMBER", "0502 3861 1147")], 3: [("PHONE_NUMBER", "0502 3861 1147")]}


def test_a_value_is_bound_without_a_list(spark):
    """Nor are the findings of a field moved anew for each of their uses."""
    from maskloom.operators.structured import mask_field

    plan = lambda column: spark.createDataFrame([("a",)], "t string").select(column)._jdf.queryExecution().analyzed().toString()
    assert "transform(array(" not in plan(Detector().findings(F.col("t")))
    assert plan(mask_field(Detector(), F.col("t"), "")).count(".start - length(") <= 2


def test_texts_without_digits_of_any_width_are_passed_over(spark):
    rows = spark.createDataFrame([(1, "연락처 ０１０-１２３４-５６７８"), (2, "a＠example.com"), (3, "가나다"), (4, "연락처 𝟎𝟏𝟎-1234-5678"), (5, None)], "i int, t string")
    got = {r.i: [f.entity for f in r.f] for r in rows.select("i", Detector().findings(F.col("t")).alias("f")).collect()}
    assert got == {1: ["PHONE_NUMBER"], 2: ["EMAIL_ADDRESS"], 3: [], 4: ["PHONE_NUMBER"], 5: []}


def test_birth_dates_equal_the_calendar(spark):
    import datetime

    from maskloom.functions import checks

    def right(entity, value):
        century = {"KR_RRN": {"0": 18, "9": 18, "1": 19, "2": 19, "3": 20, "4": 20}, "KR_FRN": {"5": 19, "6": 19, "7": 20, "8": 20}}[entity].get(value[6])
        try:
            return century is not None and bool(datetime.date(century * 100 + int(value[:2]), int(value[2:4]), int(value[4:6])))
        except ValueError:
            return False

    values = [f"{y:02}{m:02}{d:02}{c}000000" for y in (0, 3, 4, 96) for m in (0, 1, 2, 4, 12, 13) for d in (0, 1, 28, 29, 30, 31, 32) for c in range(10)]
    rows = spark.createDataFrame([(e, v) for e in ("KR_RRN", "KR_FRN") for v in values], "e string, v string")
    got = rows.select("e", "v", checks.birth_date_valid(F.col("e"), F.col("v")).alias("ok")).collect()
    assert all(r.ok == right(r.e, r.v) for r in got) and any(r.ok for r in got)
    assert "gettimestamp" not in rows.select(checks.birth_date_valid(F.col("e"), F.col("v")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_detection_searches_texts_no_more_than_needed(spark):
    """A number's length is looked at before the patterns of its readings."""
    plan = spark.createDataFrame([("a",)], "t string").select(Detector().findings(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "octet_length" in plan
