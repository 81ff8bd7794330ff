"""The pipeline stage by stage against plain Python on whole small tables."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from barline.llm import mixing, toxicity
from barline.llm.common import fold, table
from pyspark.sql import functions as F

from tests.llm.test_exact_packing import check_packed
from tests.llm.test_neardup import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    steps = dict(cp.STAGES)
    clean = steps["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    model = toxicity.train(docs, table(spark, SF, "labels"), fold(F.col("doc_id"), 3) != 1)
    rejected = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    rows = clean.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - rejected

    clean = spark.createDataFrame(rows, docs.schema)
    unique = steps["exact dedup"](spark, clean, SF)
    best = {}
    for r in rows:
        best[r.text] = max(best.get(r.text, r), r, key=lambda x: x.doc_id)
    assert Counter(unique.collect()) == Counter(best.values()) and unique.columns == columns

    near = steps["near dedup"](spark, unique, SF)
    classes = brute_classes([(r.doc_id, r.text) for r in best.values()])
    assert {r.doc_id for r in near.collect()} == set(classes.values()) and near.columns == columns

    mix = steps["mixing"](spark, near, SF)
    assert mix.columns == columns
    words = defaultdict(int)
    for r in mix.collect():
        words[r.source] += len(r.text.split())
    plan = mixing.mix_plan(near).join(near.select("doc_id", "source"), "doc_id").collect()
    longest = max(r["size"] for r in plan)
    for r in plan:
        assert abs(words[r.source] - r.target) <= longest + 1

    packed = steps["packing"](spark, mix, SF)
    check_packed(packed.collect(), mix.select("doc_id", "text").collect(), 1024)


def test_run_gives_the_last_stage(spark):
    rows = cp.run(spark, SF).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert rows and max(by.values()) <= 1024


def test_odd_rows_pass_through_all_stages(spark, odd, none):
    for docs in (odd, none):
        for _, step in cp.STAGES:
            out = step(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)
