"""JSON, CSV, readers, writers, command line and streams."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from maskloom import cli
from maskloom.operators import structured
from maskloom.operators.detect import Detector, all_entities
from maskloom.sources import files


def mask(spark, values, detector=None, style="tag", strict=False):
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "id int, d string")
    out = structured.mask_json(rows, "d", detector or all_entities(), style, strict).collect()
    return [json.loads(r.d) for r in sorted(out, key=lambda r: r.id)]


def test_json_fields(spark):
    given = [
        {"name": "김가온", "n": 5, "x": [1, 2.5, None, True], "phone": "010-1234-5678"}, {"rrn": 9001011234568, "other": 9001},
        {"bank": "농협", "account": "3025382178204"}, {"bank": "신한", "account": "3025382178204"}, {"email": "a@b.invalid"},
        {"card_no": "1234 5678 9012 3456"}, {"성명": "가"}, {"010-1234-5678": 1}, "연락처 010-1234-5678", [], {"memo": "a@b.invalid"},
    ]
    assert mask(spark, given) == [
        {"name": "<KR_NAME>", "n": 5, "x": [1, 2.5, None, True], "phone": "<PHONE_NUMBER>"}, {"rrn": "<KR_RRN>", "other": 9001},
        {"bank": "농협", "account": "<KR_ACCOUNT>"}, {"bank": "신한", "account": "<CREDIT_CARD>"}, {"email": "<EMAIL_ADDRESS>"},
        {"card_no": "<CREDIT_CARD>"}, {"성명": "<KR_NAME>"}, {"<PHONE_NUMBER>": 1}, "연락처 <PHONE_NUMBER>", [], {"memo": "a@b.invalid"},
    ]


def test_strict_fields_mask_what_no_detector_finds_and_inherit(spark):
    given = [{"phone": "없음", "email": " ", "address": {"city": "어딘가", "zip": 123}}, {"phone": None}, {"name": "가"}]
    assert mask(spark, given, strict=True) == [
        {"phone": "<PHONE_NUMBER>", "email": " ", "address": {"city": "<KR_ADDRESS>", "zip": "<KR_ADDRESS>"}}, {"phone": None}, {"name": "<KR_NAME>"}]
    assert mask(spark, [{"phone": "-"}], style="partial", strict=True) == [{"phone": "*"}]
    assert mask(spark, given[:1], Detector(entities=("EMAIL_ADDRESS",)), strict=True)[0]["phone"] == "없음"


@pytest.mark.parametrize("document", ['{"a": 1, "a": 2}', '{"a": NaN}', "[" * 102 + "]" * 102, '{"phone": 1.5}', '{"010-1234-5678": 1, "010-1234-5679": 2}'])
def test_bad_documents_fail(spark, document):
    rows = spark.createDataFrame([(document,)], "d string")
    with pytest.raises(Exception):
        structured.mask_json(rows, "d", Detector()).collect()


def test_leaf_order_and_pairs(spark):
    rows = spark.createDataFrame([(1, '{"phone": "010-1234-5678", "b": [1]}')], "id int, d string")
    masked = structured.mask_json(rows, "d", Detector())
    got = structured.paired_leaves(rows, masked, "id", "d").orderBy("n").collect()
    assert [(r.before, r.after) for r in got] == [("phone", "phone"), ("010-1234-5678", "<PHONE_NUMBER>"), ("b", "b"), ("1", "1")]


def test_batches_do_not_change_results(spark):
    from maskloom.functions.generate import csv_load

    table = csv_load(spark, 300)
    once = structured.mask_columns(table, all_entities()).collect()
    many = structured.mask_columns(table.repartition(7), all_entities()).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, many))
    assert set(once) == {("<KR_NAME>", "<PHONE_NUMBER>", "<EMAIL_ADDRESS>", r[3]) for r in once}


def test_headers_are_masked_and_may_not_clash(spark):
    assert structured.mask_headers(spark, Detector(), ["name", "010-1234-5678"]) == ["name", "<PHONE_NUMBER>"]
    with pytest.raises(ValueError):
        structured.mask_headers(spark, Detector(), ["010-1234-5678", "010-1234-5679"])


def test_csv_command(spark, tmp_path):
    source, target = tmp_path / "in.csv", tmp_path / "out"
    source.write_text('고객명,메모,휴대폰번호\n김가온,"두 줄\n연락처 010-1234-5678",01012345678\n이나래,,없음\n', encoding="utf-8")
    assert cli.main(["mask", str(source), "--folder", str(target), "--format", "csv"]) == 0
    rows = files.read_csv(spark, str(target)).collect()
    assert sorted(map(tuple, rows)) == [("김가온", "두 줄\n연락처 <PHONE_NUMBER>", "<PHONE_NUMBER>"), ("이나래", "", "없음")]
    assert cli.main(["mask", str(source), "--folder", str(target), "--format", "csv"]) == 2  # never overwrites


@pytest.mark.parametrize("content", ["", "a,a\n1,2\n", "a,\n1,2\n", "a,b\n1,2,3\n"])
def test_bad_csv_fails(spark, tmp_path, content):
    (tmp_path / "in.csv").write_text(content)
    assert cli.main(["mask", str(tmp_path / "in.csv"), "--folder", str(tmp_path / "out"), "--format", "csv"]) == 2
    assert not os.path.exists(tmp_path / "out" / "_SUCCESS")


def test_jsonl_json_text_and_check(spark, tmp_path, capsys):
    lines = tmp_path / "in.jsonl"
    lines.write_text('﻿{"phone": "010-1234-5678"}\n{"n": 1}\n', encoding="utf-8")
    assert cli.main(["mask", str(lines), "--folder", str(tmp_path / "o1"), "--format", "jsonl"]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "o1")).collect()] == ['{"phone": "<PHONE_NUMBER>"}', '{"n": 1}']
    lines.write_text('{"n": 1}\n\n{"n": 2}\n')
    assert cli.main(["mask", str(lines), "--folder", str(tmp_path / "o2"), "--format", "jsonl"]) == 2
    text = tmp_path / "in.txt"
    text.write_text("연락처\n010-1234-5678", encoding="utf-8")
    assert cli.main(["check", str(text)]) == 1
    capsys.readouterr()
    assert cli.main(["analyze", str(text)]) == 0
    assert json.loads(capsys.readouterr().out) == [{"entity": "PHONE_NUMBER", "start": 4, "end": 17, "score": 0.5}]
    text.write_text("없음", encoding="utf-8")
    assert cli.main(["check", str(text)]) == 0


def test_standard_input_and_output(spark, tmp_path, capsys, monkeypatch):
    def given(text):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text.encode()), encoding="utf-8"))
        capsys.readouterr()

    given("연락처 010-1234-5678\n끝")
    assert cli.main(["mask"]) == 0 and capsys.readouterr().out == "연락처 <PHONE_NUMBER>\n끝"
    given('{"phone": "010-1234-5678"}\n{"n": 1}\n')
    assert cli.main(["mask", "-", "--format", "jsonl"]) == 0 and capsys.readouterr().out == '{"phone": "<PHONE_NUMBER>"}\n{"n": 1}\n'
    given('{"phone": "010-1234-5678"}\n{"n": \n')
    assert cli.main(["mask", "--format", "jsonl"]) == 2 and capsys.readouterr().out == ""  # nothing of a late failure
    given('고객명,메모\n김가온,"a, ""b"""\n')
    assert cli.main(["mask", "--format", "csv", "--entity", "KR_NAME", "--entity", "PHONE_NUMBER"]) == 0
    assert capsys.readouterr().out == '고객명,메모\n<KR_NAME>,"a, ""b"""\n'
    given("a@b.co.kr")
    assert cli.main(["check", "--entity", "PHONE_NUMBER"]) == 0
    target = tmp_path / "o.txt"
    target.write_text("before")
    given("연락처 010-1234-5678")
    assert cli.main(["mask", "-o", str(target)]) == 0 and target.read_text() == "연락처 <PHONE_NUMBER>"
    assert cli.main(["mask", str(target), "-o", str(target)]) == 2 and cli.main(["mask", str(target), "-o", str(tmp_path)]) == 2
    given("\ud7ff")
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"\xff\xfe"), encoding="utf-8"))
    assert cli.main(["mask", "-o", str(target)]) == 2 and target.read_text() == "연락처 <PHONE_NUMBER>"
    assert [p.name for p in tmp_path.iterdir()] == ["o.txt"]  # no staged file stays
    for wrong in (["check", "--format", "csv"], ["analyze", "-o", "x"], ["mask", "--strict-fields"], ["mask", "--ner"], ["mask", "--ner-threshold", "0.5"],
                  ["mask", "--ner", "--entity", "KR_NAME", "--ner-threshold", "2"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)


def test_a_registered_model_on_the_command_line(spark, tmp_path, capsys):
    from maskloom import udfs

    (tmp_path / "a.txt").write_text("어제 김민서 씨가 왔다", encoding="utf-8")
    call = ["mask", str(tmp_path / "a.txt"), "--entity", "KR_NAME", "--ner", "--ner-model", "kcelectra"]
    assert cli.main(call) == 2  # not registered
    udfs.register_model("kcelectra", lambda: lambda text: [("KR_NAME", text.index("김민서"), text.index("김민서") + 3, 0.95), ("KR_NAME", 0, 2, 0.3)])
    capsys.readouterr()
    assert cli.main(call) == 0 and capsys.readouterr().out == "어제 <KR_NAME> 씨가 왔다"


def test_jsonl_stream_and_counts(spark, tmp_path):
    from maskloom.streaming import mask as streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"phone": "010-1234-5678"}\n', encoding="utf-8")
    stream = spark.readStream.text(str(tmp_path / "in"))
    streaming.mask_jsonl_stream(stream, "value", Detector(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"phone": "<PHONE_NUMBER>"}']
    batch = spark.createDataFrame([("연락처 010-1234-5678",)], "t string").withColumn("at", F.to_timestamp(F.lit("2024-01-01 10:20:00")))
    row = streaming.finding_counts(batch, "t", "at", Detector()).first()
    assert (row.entity, row.n, str(row.window_start)) == ("PHONE_NUMBER", 1, "2024-01-01 10:00:00")


def test_lines_digests_and_freeze(spark, tmp_path):
    (tmp_path / "a.txt").write_text("## d1\tx\n김\tB-PS\n민\tI-PS\n## d2\n", encoding="utf-8")
    lines = files.read_lines(spark, str(tmp_path / "a.txt"))
    from maskloom.operators import sequence

    assert [(r.id, r.text, r.tags) for r in sequence.header_documents(lines).collect()] == [("d1", "김민", ["B-PS", "I-PS"])]
    with pytest.raises(ValueError):
        files.verify_digest(spark, str(tmp_path / "a.txt"), "0" * 64)
    frozen = files.freeze(spark.range(3), str(tmp_path / "frozen"))
    assert frozen.count() == 3 and len(frozen.first().row_sha256) == 64


def test_leaves_of_many_and_deep_documents(spark):
    """Neither the number of leaves nor the depth of a document is bounded by the engine's limits on recursive queries."""
    from maskloom.operators import structured

    rows = spark.createDataFrame([(i, f'{{"a": {i}, "b": ["x", 1.50, null]}}') for i in range(200)] + [(200, "[" * 150 + "7" + "]" * 150)], "i int, d string")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = structured.leaf_table(rows, "i", "d").collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    assert len(got) == 801 and {tuple(r)[1:] for r in got if r.i == 3} == {("$.a", "3"), ("$.b[0]", "x"), ("$.b[1]", "1.5"), ("$.b[2]", None)}
    assert [tuple(r)[1:] for r in got if r.i == 200] == [("$" + "[0]" * 150, "7")]
