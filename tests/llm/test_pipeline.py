"""The pipeline against brute force made of the operators' own plain functions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm import langid, mixing, pieces
from tests.llm.test_operators import brute_components, brute_fingerprint


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = table.union(table.limit(3)).union(spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "12 34", "en", "src1", 5)], table.schema))
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = [r for r in docs.collect() if not model.predict([r.text])[2][0]]
    assert 9001 not in {r.doc_id for r in rows} and 9002 not in {r.doc_id for r in rows}
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        if key not in best or (-len(r.text), r.doc_id) < (-len(best[key].text), best[key].doc_id):
            best[key] = r
    prints = {r.doc_id: brute_fingerprint(r.text) for r in best.values()}
    classes = brute_components(prints)
    left = [r for r in best.values() if classes[r.doc_id] == r.doc_id]
    current = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, "").write.parquet(f"{tmp_path}/{number}")
        current = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert current.columns == table.columns
        if number == 0:
            assert sorted(r.doc_id for r in current.collect()) == sorted(r.doc_id for r in rows)
        if number == 1:
            assert sorted(r.doc_id for r in current.collect()) == sorted(r.doc_id for r in best.values())
        if number == 2:
            assert sorted(r.doc_id for r in current.collect()) == sorted(r.doc_id for r in left)
            copies = {r.doc_id: r.copies for r in mixing.mix(current).collect()}
    got = current.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, c in copies.items() for _ in range(c))
    sampler, texts = pieces.Sampler(pieces.Vocabulary.load()), {r.doc_id: r.text for r in left}
    assert all(sampler.decode(np.array(r.ids), np.array([len(r.ids)]))[0] == texts[r.doc_id] for r in got)


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "two  words\n\u2581", "en", "a", 1), (2, "", "en", "a", 0), (3, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert [got[i].decoded for i in (1, 2, 3)] == ["two  words\n\u2581", "", None] and all(r.lossless for r in got.values())


def test_empty_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_repeated_ids_clashing_columns_and_long_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected int, lang_pred string, row string, key long, __stay long, shard int, tie string"
    more = ("s", 1, "p", "r", 2, 3, 4, "t")
    base = "the of and in that was for it with as his on be at by from"
    rows = [(i, f"{base} word{i} {'tail ' * (i % 5)}other{i * 7}", "en", f"s{i % 3}", 0, *more) for i in range(40)]
    rows += [(1, "quite another text of the same number, long enough to be one", "en", "s0", 0, *more), rows[2], rows[2], (None, "a text without a number, the only one", "en", None, 0, *more),
             (90, "long words in one text " * 20000, "en", "s1", 0, *more), (91, None, "en", "s1", 0, *more), (92, rows[5][1].replace(" ", "  "), "en", "s2", 0, *more)]
    docs = spark.createDataFrame(rows, schema)
    sizes = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        sizes.append(docs.count())
        if number == 0:
            left = docs.collect()
            bodies = {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in left}
        assert number == 4 or docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert all(r.text is not None for r in left) and sizes[0] >= 40  # a text far from all others may be rejected too
    assert sizes[1] == len(bodies) <= sizes[0] - 3  # two repeated rows and a copy in other white space
    assert 0 < sizes[2] <= sizes[1] and all(r.lossless for r in docs.collect())


def test_run_deletes_what_it_has_read(spark):
    import os

    from maskloom.runtime import shared_dir

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0
    folder = shared_dir(spark).removeprefix("file:")
    newest = max((f"{folder}/{x}" for x in os.listdir(folder) if x.startswith("pipeline-")), key=os.path.getmtime)
    assert sorted(os.listdir(newest)) == ["3"]
