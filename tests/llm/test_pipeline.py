"""Registered text queries, and the pipeline's stages on planted cases."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from adlumen.llm.common import documents, free_names
from adlumen.llm.decontaminate import drop_contaminated
from adlumen.llm.exact_dedup import drop_copies
from adlumen.llm.jaccard_join import keep_one_of_each
from adlumen.llm.oracles import ORACLES
from adlumen.llm.toxicity import train_on, with_score
from tests.compare import differences
from tests.llm.conftest import ODD, prose

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), ORACLES[name], FOLDER) == []


def test_all_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op10_decontamination"])
def test_native_plans(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    for word in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_stages_drop_what_is_planted_and_keep_the_rest(spark, tmp_path):
    docs = documents(spark, FOLDER)
    top = docs.agg(F.max("doc_id")).first()[0] + 1
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("item_id = 3").first().text
    near = prose(21, 90).split()
    edited = [*near[:40], "changed", *near[41:]]
    planted = [prose(20, 60), prose(20, 60).replace(" ", "\n"), " ".join(near), " ".join(edited),
               f"{prose(22, 30)} {item} {prose(23, 30)}", prose(24, 50)]
    extra = spark.createDataFrame(
        [(top + k, t, "en", "src0", len(t)) for k, t in enumerate(planted)], docs.schema)
    stage = docs.unionByName(extra)
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        stage = function(spark, stage, FOLDER)
        path = str(tmp_path / name)
        stage.write.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(stage.columns) == sorted(docs.columns)
        stage = spark.read.parquet(path)
        kept[name] = {r.doc_id - top for r in stage.filter(F.col("doc_id") >= top).collect()}
    assert kept == {"toxicity": {0, 1, 2, 3, 4, 5}, "exact_dedup": {0, 2, 3, 4, 5},
                    "jaccard_join": {0, 2, 4, 5}, "decontamination": {0, 2, 5},
                    "sentencepiece": {0, 2, 5}}


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(t[0], t[1], None, None, None) if isinstance(t, tuple) else (i, t, None, None, None)
         for i, t in enumerate(ODD)], "doc_id bigint, text string, lang string, source string, "
                                      "n_chars bigint")
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), FOLDER).count() == 0, name
        assert function(spark, docs, FOLDER).count() > 0, name


NAMES = ["_hash", "_gone", "_dirty", "_score", "h", "n", "id", "t", "_ID"]


def test_columns_of_any_name_come_through(spark):
    texts = [prose(k % 7, 30) for k in range(20)] + [None, "", "one", "x" * 300_000]
    table = spark.createDataFrame(
        [(i, text, *range(i, i + len(NAMES))) for i, text in enumerate(texts)],
        "doc_id bigint, text string, " + ", ".join(f"`{name}` int" for name in NAMES))
    items = spark.createDataFrame([(1, prose(3, 30)), (2, None)], "item_id bigint, text string")
    clean = drop_contaminated(table, items)
    kept = keep_one_of_each(table)
    once = drop_copies(table)
    for found in (clean, kept, once):
        assert found.columns == table.columns
        rows = {r.doc_id: tuple(r) for r in found.collect()}
        assert all(rows[i] == (i, texts[i], *range(i, i + len(NAMES))) for i in rows)
    assert {i for i in range(24)} - {r.doc_id for r in clean.collect()} == {3, 10, 17}
    assert {r.doc_id for r in kept.collect()} == {*range(7), 20, 21, 22, 23}
    assert {r.doc_id for r in once.collect()} == {*range(7), 20, 22, 23}
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    for found in (with_score(table, train_on(table, marks), name) for name in free_names(table, "_score")):
        assert found.columns == [*table.columns, "_score_"]
        assert {tuple(r)[:-1] for r in found.collect()} == {tuple(r) for r in table.collect()}
